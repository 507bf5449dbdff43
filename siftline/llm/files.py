"""Whole files put together from overlapping chunks.

``newest_files`` gives one row per (codebase_id, file_path): the rows with the greatest
modified_at, or all rows if every time is null.  Repeated chunks count once, before the
shuffle.  Null content is an empty chunk; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_files(chunks: DataFrame) -> DataFrame:
    """(codebase_id, file_path, language, starts array<int>, parts array<string>), parts by start line."""
    piece = F.struct(
        F.col("modified_at").cast("long").alias("m"), F.coalesce(F.col("start_line").cast("int"), F.lit(1)).alias("s"), F.coalesce("content", F.lit("")).alias("c")
    )
    held = chunks.groupBy("codebase_id", "file_path").agg(F.collect_set(piece).alias("p"), F.max(F.lower(F.trim("language"))).alias("language"))
    newest = F.expr("array_sort(filter(p, x -> x.m <=> array_max(transform(p, y -> y.m))))")
    return held.select("codebase_id", "file_path", "language", newest.alias("p")).select(
        "codebase_id", "file_path", "language", F.expr("transform(p, x -> x.s)").alias("starts"), F.expr("transform(p, x -> x.c)").alias("parts")
    )


def assemble(starts: list[int], parts: list[str]) -> str:
    """The text of a file; lines that an earlier part has are cut, missing lines are left blank."""
    if len(parts) == 1:
        return parts[0]
    out, after = [], None  # after: the line behind the last one put out
    for s, text in zip(starts, parts, strict=True):
        n = text.count("\n") + 1
        if after is None:
            out.append(text)
            after = s + n
            continue
        if s + n <= after:
            continue
        at = 0
        for _ in range(after - s):
            at = text.index("\n", at) + 1
        out.extend([""] * (s - after))
        out.append(text[at:] if at else text)
        after = s + n
    return "\n".join(out)

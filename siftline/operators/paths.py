"""Which files belong to a collection: skip rules and ignore files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.config import EngineConfig


def skipped(path: Column, config: EngineConfig | None = None) -> Column:
    """Whether a relative path is in a skipped folder, is a skipped file, or has an extension that is not indexed."""
    c = config or EngineConfig()
    name = F.element_at(F.split(path, "/"), -1)
    folders = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in c.skip_dirs]))
    inside = folders & (F.size(F.array_intersect(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1))), F.array(*[F.lit(x) for x in c.skip_dirs]))) > 0) & F.contains(path, F.lit("/"))
    ends = [F.endswith(name, F.lit(x[1:])) for x in c.skip_files if x.startswith("*")]
    exact = name.isin([x for x in c.skip_files if not x.startswith("*")])
    ext = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    unknown = (ext != "") & ~F.concat(F.lit("."), ext).isin([x.lower() for x in c.extensions])
    bad = inside | exact | unknown
    for e in ends:
        bad = bad | e
    return bad


def ignore_regex(pattern: str) -> tuple[str, bool, bool] | None:
    """(regular expression over paths relative to the rule's folder, negated, folders only) of one ignore line; None for blanks and comments."""
    p = pattern.rstrip("\r\n")
    p = re.sub(r"(?<!\\)[ \t]+$", "", p)
    if not p or p.startswith("#"):
        return None
    negated = p.startswith("!")
    p = p[1:] if negated else p
    p = p[1:] if p.startswith(("\\#", "\\!")) else p
    folder = p.endswith("/")
    p = p.rstrip("/")
    if not p:
        return None
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            body = p[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]", j + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$", negated, folder


def rules(ignore_files: DataFrame) -> DataFrame:
    """(folder, rule_no, regex, negated, folders_only) from ignore files (path, content)."""
    import pandas as pd

    def parse(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                folder = path.rsplit("/", 1)[0] if "/" in path else ""
                for n, line in enumerate((content or "").split("\n")):
                    r = ignore_regex(line)
                    if r:
                        out.append((folder, n, *r))
            yield pd.DataFrame(out, columns=["folder", "rule_no", "regex", "negated", "folders_only"])

    return ignore_files.select("path", "content").mapInPandas(parse, "folder string, rule_no int, regex string, negated boolean, folders_only boolean")


def not_ignored(files: DataFrame, rule_rows: DataFrame, path: str = "path") -> DataFrame:
    """Files that no rule ignores.

    A file is ignored if it or a folder above it is; the last matching rule of the nearest ignore file decides.
    Rules are joined by the folder they stand in, so a file meets only the rules above it.
    """
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    each = files.select(path).distinct().select(path, F.explode(above).alias("_p")).withColumn("_is_folder", F.col("_p") != F.col(path))
    up = F.split("_p", "/")
    homes = F.transform(F.sequence(F.lit(0), F.size(up) - 1), lambda k: F.array_join(F.slice(up, 1, k), "/"))
    met = each.withColumn("folder", F.explode(homes)).join(rule_rows, "folder")
    rest = F.when(F.col("folder") == "", F.col("_p")).otherwise(F.expr("substring(_p, length(folder) + 2)"))
    hit = met.filter((F.col("_is_folder") | ~F.col("folders_only")) & F.expr("rlike(if(folder = '', _p, substring(_p, length(folder) + 2)), regex)")).withColumn("_rest", rest)
    last = hit.groupBy(path, "_p").agg(F.max_by("negated", F.struct(F.length("folder"), "rule_no")).alias("_n"))
    ignored = last.filter(~F.col("_n")).select(path).distinct()
    return files.join(ignored, path, "left_anti")


def latest(files: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return files.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order)))).filter("_k = 1").drop("_k")

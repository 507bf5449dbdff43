"""Files whose text no dialect of their language accepts, and the rates.

The extension names the language.  Files are put together from their newest chunks, lexed, and
recognised by generalised LL over all dialects at once (see ``gll`` and ``grammars``).

Defined results: a null path or one with another extension is not judged; null content is an
empty text (valid, but not as JSON or Go); repeated rows count once; an empty table gives an
empty table; extra columns are dropped.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.files import assemble, newest_files
from siftline.llm.grammars import LANGUAGE_OF, valid

JUDGED = "|".join(LANGUAGE_OF)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def flags(chunks: DataFrame) -> DataFrame:
    """(codebase_id, file_path, language, valid) of each file with a judged extension; language is the extension's."""

    def run(batches):
        for b in batches:
            c = b.to_pydict()
            names = [LANGUAGE_OF[p.rsplit(".", 1)[-1].lower()] for p in c["file_path"]]
            good = [valid(assemble(s, t), n) for s, t, n in zip(c["starts"], c["parts"], names, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(good, pa.bool_())], names=["codebase_id", "file_path", "language", "valid"])

    files = newest_files(chunks.filter(F.col("file_path").rlike(rf"(?i)\.({JUDGED})$")))
    return files.select("codebase_id", "file_path", "starts", "parts").mapInArrow(run, "codebase_id string, file_path string, language string, valid boolean")


def found(chunks: DataFrame) -> DataFrame:
    return flags(chunks).filter(~F.col("valid")).select("codebase_id", "file_path")


def rates(chunks: DataFrame) -> DataFrame:
    """(codebase_id, language, files, invalid, rate)."""
    n, bad = F.count("*"), F.count_if(~F.col("valid"))
    return flags(chunks).groupBy("codebase_id", "language").agg(n.alias("files"), bad.alias("invalid"), (bad / n).alias("rate"))

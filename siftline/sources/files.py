"""Directory trees, text tables and manifests as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.languages import detect
from siftline.functions.text import sha16
from siftline.operators import paths

MANIFEST_PART = 100_000  # entries of one JSON object


def _ignore_files(spark: SparkSession, root: str, depth: int = 10) -> list[tuple[str, str]]:
    """(relative path, text) of ignore files down to a depth; Spark's own readers leave out names that begin with a dot."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for k in range(depth + 1):
        for h in fs.globStatus(path(root.rstrip("/") + "/*" * k + "/.gitignore")) or []:
            stream = fs.open(h.getPath())
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            found.append((h.getPath().toUri().getPath()[len(root.rstrip("/")) + 1 :], text))
    return found


def _relative(root: str) -> Column:
    return F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(root.rstrip('/')) + 2})")


def scan(spark: SparkSession, root: str, ignore: bool = True) -> DataFrame:
    """(path, content bytes, size, modified_at, hash): files below ``root`` that no rule skips."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = _relative(root)
    files = raw.select(rel.alias("path"), "content", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified_at")).withColumn("hash", sha16("content"))
    kept = files.filter(~paths.skipped(F.col("path")))
    if not ignore:
        return kept
    found = _ignore_files(spark, root)
    return paths.not_ignored(kept, paths.rules(spark.createDataFrame(found, "path string, content string"))) if found else kept


def texts(files: DataFrame) -> DataFrame:
    """(file_path, content, language, hash, modified_at) of files that are valid UTF-8."""
    ok = files.withColumn("_t", F.col("content").cast("string")).filter(F.is_valid_utf8("_t"))
    return ok.select(F.col("path").alias("file_path"), F.col("_t").alias("content"), detect(F.col("path")).alias("language"), "hash", "modified_at")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash) of a manifest: a JSON object of paths and hashes, on one or several lines, or a folder of such objects."""
    raw = spark.read.option("wholetext", "true").text(path)
    held = raw.select(F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}).alias("m"), F.length(F.trim("value")).alias("n"))
    checked = held.select(F.when((F.col("n") > 0) & F.col("m").isNull(), F.raise_error(F.lit(f"{path} is no manifest"))).otherwise(F.col("m")).alias("m"))
    return checked.select(F.explode("m").alias("path", "hash"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A folder of JSON objects of at most MANIFEST_PART entries each, which ``read_manifest`` reads; a repeated path keeps its greatest hash."""
    once = manifest.filter("path is not null").groupBy("path").agg(F.max("hash").alias("hash"))
    parts = F.greatest(F.lit(1), F.ceil(once.groupBy().count().first()[0] / F.lit(MANIFEST_PART)))
    keyed = once.withColumn("part", F.pmod(F.xxhash64("path"), parts))
    objects = keyed.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("path", F.coalesce("hash", F.lit("")))))).alias("value"))
    objects.select("value").write.mode("overwrite").text(path)


def delete_manifest(spark: SparkSession, path: str) -> bool:
    """Whether there was one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet, ORC, CSV (with header), JSON lines or text, by the path's extension."""
    kind = next((k for k in ("parquet", "orc", "csv", "json", "txt") if f".{k}" in path), "parquet")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("header", "true").csv(path) if kind == "csv" else getattr(reader, {"txt": "text"}.get(kind, kind))(path)

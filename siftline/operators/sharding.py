"""Routing of codebases to shards and merging of their results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.errors import ConfigError
from siftline.functions.text import djb2, stable_score
from siftline.session import kept


def shard_of(codebase: Column, shards: int) -> Column:
    return F.pmod(djb2(codebase), F.lit(shards).cast("decimal(20,0)")).cast("int")


def replicas(codebase: Column, shards: int, copies: int) -> Column:
    first = shard_of(codebase, shards)
    return F.transform(F.sequence(F.lit(0), F.lit(min(copies, shards) - 1)), lambda i: F.pmod(first + i, F.lit(shards)).cast("int"))


def route(codebases: DataFrame, shards: int, copies: int = 1, enabled: bool = True) -> DataFrame:
    """(codebase_id, shards, merge): where a search of a codebase goes; a null codebase goes to all."""
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    where = F.when(F.col("codebase_id").isNull(), every).otherwise(replicas(F.col("codebase_id"), shards, copies)) if enabled else F.array(F.lit(0))
    return codebases.select("codebase_id", where.alias("shards")).withColumn("merge", F.size("shards") > 1)


def merged(lists: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """(id, score, best): ranked lists (shard, id, score, rank from 1) merged by reciprocal ranks, best the greatest own score."""
    scored = lists.groupBy("id").agg(stable_score(F.sum(1.0 / (F.col("rank") - 1 + k))).alias("score"), F.max("score").alias("best"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


@dataclass
class Shards:
    """Which shards there are and where codebases lie; tables are split by ``spread``."""

    names: list[str] = field(default_factory=lambda: ["shard-0"])
    copies: int = 1
    enabled: bool = True

    def add(self, name: str) -> None:
        if name in self.names:
            raise ConfigError(f"shard {name} is there already")
        self.names.append(name)

    def remove(self, name: str) -> None:
        if name not in self.names:
            raise ConfigError(f"there is no shard {name}")
        if len(self.names) == 1:
            raise ConfigError("the last shard cannot go")
        self.names.remove(name)

    def spread(self, chunks: DataFrame) -> DataFrame:
        """The rows with their shard's number, once for each copy, put together by shard."""
        at = replicas(F.col("codebase_id"), len(self.names), self.copies) if self.enabled else F.array(F.lit(0))
        return chunks.withColumn("shard", F.explode(F.when(F.col("codebase_id").isNull(), F.array(F.lit(0))).otherwise(at)))

    def write(self, chunks: DataFrame, folder: str) -> None:
        """One partition a shard and codebase; a search of a codebase reads only its own."""
        self.spread(chunks).repartition("shard", "codebase_id").write.mode("overwrite").partitionBy("shard", "codebase_id").parquet(folder)

    def read(self, spark: SparkSession, folder: str, codebase: str | None = None) -> DataFrame:
        """The rows a search of the codebase sees: its first shard's, or each codebase's in its first shard."""
        rows = spark.read.parquet(folder)
        if codebase is not None:
            rows = rows.filter(F.col("codebase_id") == codebase)
        first = shard_of(F.col("codebase_id"), len(self.names)) if self.enabled else F.lit(0)
        return rows.filter(F.col("shard") == F.coalesce(first, F.lit(0))).drop("shard")


def batches(items: DataFrame, order: str, size: int, ranges: int = 64) -> DataFrame:
    """Rows a batch, by a running number over the distinct values of ``order``: one row a batch (batch_no, items).

    Values are numbered within ranges of them, on top of the ranges before, so no task holds all.
    """
    split = items.select(F.col(order).alias("_v")).distinct().repartitionByRange(ranges, "_v").withColumn("_part", F.spark_partition_id())
    rows = kept(split)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    # only the number of values in a range matters for the sizes of its batches
    first, last = F.floor(F.col("_before") / size), F.floor((F.col("_before") + F.col("_n") - 1) / size)
    each = counts.withColumn("batch_no", F.explode(F.sequence(first, last)))
    inside = F.least(F.col("_before") + F.col("_n"), (F.col("batch_no") + 1) * size) - F.greatest(F.col("_before"), F.col("batch_no") * size)
    return each.groupBy("batch_no").agg(F.sum(inside).alias("items"))

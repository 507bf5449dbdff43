"""Processing only new or changed records, by comparing two Merkle trees over key ranges.

An entry is a key and the digest of its record's state.  Keys are hashed; a leaf is a range of the
hashed keys, its digest combines its entries', and each inner node combines its ``FANOUT``
children.  Two trees are compared from the root: only children of nodes that differ are looked at,
and only entries in differing leaves are compared one by one.

The depth follows the number of entries (about ``LEAF_ROWS`` a leaf) and is saved with the tree; a comparison is made at
the saved depth.

``Store`` keeps entries and tree of the last successful run.  A run first writes down what it sees, compares that, and
processes a snapshot of the records in just that state; records that changed meanwhile are left to the next run.  Output,
entries and tree lie in one new version folder, to which the pointer is moved by one rename (one writer at a time), so after a crash
at any point the next run sees either all of a run or nothing of it: nothing is skipped or repeated.

Defined results: entries with a null key part are left out; a null digest is a state of its own;
repeated entries count once; a key with several digests takes the greatest; empty sides are empty
trees; extra columns are dropped.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import cut, kept

FANOUT_BITS, LEAF_ROWS, DEEPEST = 4, 64, 7  # 16 children a node, at most 2**28 leaves


def depth_for(n: int) -> int:
    """Levels below the root for so many entries."""
    return max(1, min(DEEPEST, math.ceil(math.log(max(n, 1) / LEAF_ROWS, 1 << FANOUT_BITS)) if n > LEAF_ROWS else 1))


def leaf_of(keys: list[str], depth: int) -> Column:
    """The leaf's number: the upper bits of the hashed key."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - FANOUT_BITS * depth).cast("int")


def entries(records: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys..., digest), one row a key."""
    named = records.select(*keys, F.col(digest).alias("digest")).dropna(subset=keys)
    return named.groupBy(*keys).agg(F.max("digest").alias("digest"))


def tree(entry_rows: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(level, node, a, b, n): two independent 64-bit digests and the number of entries of each node; level 0 is the root."""
    state = F.coalesce("digest", F.lit("\x00"))
    leaves = entry_rows.groupBy(leaf_of(keys, depth).alias("node")).agg(F.bit_xor(F.xxhash64(*keys, state)).alias("a"), F.bit_xor(F.xxhash64(state, F.lit(1), *keys)).alias("b"), F.count("*").alias("n"))
    # each leaf adds to its node on every level, so all levels come from one small aggregate
    up = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).selectExpr("level", f"shiftright(node, {FANOUT_BITS} * ({depth} - level)) AS node", "node AS leaf", "a", "b", "n")
    mixed = [F.bit_xor(F.xxhash64("leaf", c)).alias(c) for c in ("a", "b")]
    return up.groupBy("level", "node").agg(*mixed, F.sum("n").alias("n"))


def differing_leaves(current: DataFrame, saved: DataFrame, depth: int) -> DataFrame:
    """(leaf) of the leaves that differ, found by going down from the root."""
    side = lambda t, k: t.select("level", "node", F.lit(k).alias("side"), "a", "b", "n")
    both = side(current, 0).unionByName(side(saved, 1)).groupBy("level", "node")
    # a node on one side only, or with unlike digests, differs
    unlike = (F.count("*") < 2) | (F.min("a") != F.max("a")) | (F.min("b") != F.max("b")) | (F.min("n") != F.max("n"))
    nodes = cut(both.agg(unlike.alias("unlike")).filter("unlike").select("level", "node"))
    here = nodes.filter("level = 0").select("node")
    for level in range(1, depth + 1):
        below = nodes.filter(F.col("level") == level).select("node", F.expr(f"shiftright(node, {FANOUT_BITS})").alias("up"))
        here = below.join(here.withColumnRenamed("node", "up"), "up", "left_semi").select("node")
    return here.withColumnRenamed("node", "leaf")


def changed(current: DataFrame, saved: DataFrame, keys: list[str], trees: tuple[DataFrame, DataFrame] | None = None, depth: int | None = None) -> DataFrame:
    """(keys..., digest, change) with change one of added, modified, removed."""
    depth = depth or depth_for(saved.count())
    now, old = trees or (tree(current, keys, depth), tree(saved, keys, depth))
    leaves = differing_leaves(now, old, depth)
    rows = lambda t, k: t.withColumn("leaf", leaf_of(keys, depth)).join(leaves, "leaf", "left_semi").select(*keys, F.lit(k).alias("side"), "digest")
    of = lambda k: F.max(F.when(F.col("side") == k, F.struct("digest")))
    both = rows(current, 0).unionByName(rows(saved, 1)).groupBy(*keys).agg(of(0).alias("x"), of(1).alias("y")).filter(~F.col("x").eqNullSafe(F.col("y")))
    kind = F.when(F.col("y").isNull(), "added").when(F.col("x").isNull(), "removed").otherwise("modified")
    return both.select(*keys, F.coalesce("x", "y")["digest"].alias("digest"), kind.alias("change"))


# ------------------------------------------------------------------ the state of files
def short_hash(h: Column) -> Column:
    return F.lower(F.substring(h, 1, 16))


def scanned(file_hashes: DataFrame) -> DataFrame:
    """Entries of what the latest scan of each file saw."""
    path = F.regexp_replace("relative_path", r"^(\./)+", "")
    seen = file_hashes.select("codebase_id", path.alias("file_path"), F.struct(F.col("scanned_at"), short_hash(F.col("hash")).alias("hash")).alias("s"))
    return seen.dropna(subset=["codebase_id", "file_path"]).groupBy("codebase_id", "file_path").agg(F.max("s")["hash"].alias("digest"))


def recorded(manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """Entries of what the latest succeeded run that wrote each file recorded."""
    good = runs.filter(F.lower(F.trim("status")) == "success").select("run_id").distinct()
    rows = manifest.join(good, "run_id", "left_semi").select("codebase_id", F.regexp_replace("path", r"^(\./)+", "").alias("file_path"), F.struct("run_id", short_hash(F.col("hash")).alias("hash")).alias("s"))
    return rows.dropna(subset=["codebase_id", "file_path"]).groupBy("codebase_id", "file_path").agg(F.max("s")["hash"].alias("digest"))


def pending(file_hashes: DataFrame, manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """Files whose present state no succeeded run has recorded, with the kind of change; vanished files as removed."""
    keys, saved = ["codebase_id", "file_path"], kept(recorded(manifest, runs))
    depth = depth_for(saved.count())
    return changed(kept(scanned(file_hashes)), saved, keys, depth=depth)


def found(file_hashes: DataFrame, manifest: DataFrame, runs: DataFrame) -> DataFrame:
    return pending(file_hashes, manifest, runs).filter("change != 'removed'").select("codebase_id", "file_path")


# ------------------------------------------------------------------ runs that survive failures
class Store:
    """The last successful run's entries and tree, in a folder of any file system Spark can write."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> dict | None:
        """What the pointer says: {"version": ..., "run": ..., "depth": ...}, or None before the first run."""
        fs, path = self._fs()
        pointers = [s.getPath().getName() for s in fs.listStatus(path(self.folder)) if s.getPath().getName().startswith("current-")] if fs.exists(path(self.folder)) else []
        if not pointers:
            return None
        number = max(int(p.split("-")[1]) for p in pointers)
        name = next(p for p in pointers if int(p.split("-")[1]) == number)
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/{name}").collect()))

    def saved(self) -> tuple[DataFrame, DataFrame] | None:
        v = self.version()
        return v and tuple(self.spark.read.parquet(f"{self.folder}/{v['version']}/{t}") for t in ("entries", "tree"))

    def changes(self, now: DataFrame) -> DataFrame:
        """How entries differ from the saved ones."""
        v, old = self.version(), self.saved()
        if old is None:
            return now.select(*self.keys, "digest", F.lit("added").alias("change"))
        return changed(now, old[0], self.keys, (tree(now, self.keys, v["depth"]), old[1]), v["depth"])

    def run(self, records: DataFrame, digest: str, process: Callable[[DataFrame], DataFrame]) -> str | None:
        """Process exactly the changed records and publish output, entries and tree together.

        ``process`` gets the changed records with a column ``change`` (added or modified).  Gives the folder of the
        output, or None if nothing changed.  Files left by a run that broke off are in a version folder that no
        pointer names, and are never read.
        """
        fs, path = self._fs()
        before, old = self.version(), self.saved()
        number = (before["run"] if before else 0) + 1
        name = f"run={number}-{uuid.uuid4().hex}"
        at = f"{self.folder}/{name}"

        def written(df: DataFrame, part: str) -> DataFrame:
            df.write.parquet(f"{at}/{part}")
            return self.spark.read.schema(df.schema).parquet(f"{at}/{part}")

        now = written(entries(records, self.keys, digest), "now")
        delta = written(self.changes(now), "changes")
        if delta.isEmpty():
            fs.delete(path(at), True)
            return None
        # the records in the state that was compared; a record that has moved on is none of them
        wanted = delta.filter("change != 'removed'").select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(self.keys)), F.col("digest").alias("_digest"), "change")
        same = F.col(digest).eqNullSafe(F.col("_digest"))
        for i, k in enumerate(self.keys):
            same = same & (records[k] == F.col(f"_key_{i}"))
        taken = written(records.drop("change").join(wanted, same).drop("_digest", *(f"_key_{i}" for i in range(len(self.keys)))), "records")
        written(process(taken), "output")
        missed = written(delta.filter("change != 'removed'").join(taken.select(*self.keys), self.keys, "left_anti").select(*self.keys), "missed")
        final = now.join(missed, self.keys, "left_anti")
        if old is not None:
            final = final.unionByName(old[0].join(missed, self.keys, "left_semi").select(*final.columns))
        final = written(final, "entries")
        depth = depth_for(final.count())
        written(tree(final, self.keys, depth), "tree")
        for part in ("now", "records", "missed"):
            fs.delete(path(f"{at}/{part}"), True)
        out = fs.create(path(f"{at}/pointer"), True)
        out.write(bytearray(json.dumps({"version": name, "run": number, "depth": depth}), "utf-8"))
        out.close()
        target = path(f"{self.folder}/current-{number}")
        if fs.exists(target) or not fs.rename(path(f"{at}/pointer"), target):
            raise RuntimeError(f"run {number} was published by another process")
        return f"{at}/output"

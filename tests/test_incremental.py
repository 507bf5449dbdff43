"""Incremental runs: trees, edge cases, and recovery from failures at any point."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.operators import incremental as I


def table(spark, rows):
    return spark.createDataFrame(rows, "key string, digest string, leaf string")  # leaf: a clashing extra column


def test_changes_against_brute_force(spark):
    rng = random.Random(3)
    old = {f"k{i}": str(rng.random()) for i in range(500)}
    new = {k: v for k, v in old.items() if rng.random() > 0.02} | {f"n{i}": "x" for i in range(7)}
    for k in rng.sample(sorted(new), 9):
        new[k] = "changed"
    a, b = (I.entries(table(spark, [(k, v, "?") for k, v in d.items()] * 2), ["key"], "digest") for d in (new, old))
    got = {(r.key, r.change) for r in I.changed(a, b, ["key"]).collect()}
    want = {(k, "added") for k in new.keys() - old.keys()} | {(k, "removed") for k in old.keys() - new.keys()} | {(k, "modified") for k in new.keys() & old.keys() if new[k] != old[k]}
    assert got == want
    for depth in (1, 2, 4, 7):
        leaves = I.differing_leaves(I.tree(a, ["key"], depth), I.tree(b, ["key"], depth), depth).count()
        assert 0 < leaves <= len(want)
        assert {(r.key, r.change) for r in I.changed(a, b, ["key"], depth=depth).collect()} == want
    assert [I.depth_for(n) for n in (0, 64, 1000, 2000, 83_000, 10**9, 10**15)] == [1, 1, 1, 2, 3, 6, 7]
    assert I.changed(a, a, ["key"]).count() == 0


def test_edges(spark):
    a = I.entries(table(spark, [("x", None, ""), (None, "1", ""), ("y", "1", ""), ("y", "2", "")]), ["key"], "digest")
    assert {(r.key, r.digest) for r in a.collect()} == {("x", None), ("y", "2")}
    none = I.entries(table(spark, []), ["key"], "digest")
    assert {(r.key, r.change) for r in I.changed(a, none, ["key"]).collect()} == {("x", "added"), ("y", "added")}
    assert {(r.key, r.change) for r in I.changed(none, a, ["key"]).collect()} == {("x", "removed"), ("y", "removed")}
    assert I.changed(none, none, ["key"]).count() == 0
    b = I.entries(table(spark, [("x", "", ""), ("y", "2", "")]), ["key"], "digest")
    assert {(r.key, r.change) for r in I.changed(a, b, ["key"]).collect()} == {("x", "modified")}


def test_found(spark):
    scans = spark.createDataFrame(
        [("c", "/p/a", "./a", "AA" * 8, 1, 1), ("c", "/p/a", "a", "BB" * 32, 1, 2), ("c", "/p/b", "b", "cc" * 8, 1, 1), ("c", "/p/d", "d", "dd" * 8, 1, 1)] * 2,
        "codebase_id string, path string, relative_path string, hash string, size long, scanned_at long",
    )
    manifest = spark.createDataFrame([("c", "a", "bb" * 8, 1), ("c", "b", "cc" * 8, 1), ("c", "b", "ee" * 8, 2), ("c", "gone", "ff" * 8, 1)], "codebase_id string, path string, hash string, run_id long")
    runs = spark.createDataFrame([(1, "c", " Success"), (2, "c", "failed")], "run_id long, codebase_id string, status string")
    assert {r.file_path for r in I.found(scans, manifest, runs).collect()} == {"d"}
    assert {(r.file_path, r.change) for r in I.pending(scans, manifest, runs).collect()} == {("d", "added"), ("gone", "removed")}


def test_store_survives_failures(spark, tmp_path):
    store = I.Store(spark, str(tmp_path / "state"), ["key"])
    seen = []

    def keep(delta):
        seen.append(sorted(r.key for r in delta.collect()))
        return delta.select("key", F.col("digest").alias("d"))

    def fail(delta):
        raise RuntimeError("lost")

    rows = [("a", "1", ""), ("b", "1", "")]
    with pytest.raises(RuntimeError):
        store.run(table(spark, rows), "digest", fail)
    assert store.version() is None
    out = store.run(table(spark, rows), "digest", keep)
    assert seen[-1] == ["a", "b"] and spark.read.parquet(out).count() == 2
    assert store.run(table(spark, rows), "digest", keep) is None
    rows = [("a", "2", ""), ("b", "1", ""), ("c", "1", "")]
    with pytest.raises(RuntimeError):
        store.run(table(spark, rows), "digest", fail)
    store.run(table(spark, rows), "digest", keep)
    assert seen[-1] == ["a", "c"] and store.version()["run"] == 2
    store.run(table(spark, rows[1:]), "digest", keep)  # a removal alone still moves the state on
    assert seen[-1] == [] and store.run(table(spark, rows[1:]), "digest", keep) is None


def test_records_that_move_during_a_run(spark, tmp_path, monkeypatch):
    """Records added, changed, or changed and put back between the steps of a run are neither skipped nor repeated."""
    at, store, seen = tmp_path / "records.json", I.Store(spark, str(tmp_path / "state"), ["key"]), []

    def put(rows):
        at.write_text(json.dumps(rows))

    def keep(delta):
        seen.append(sorted((r.key, r.digest) for r in delta.collect()))
        return delta.select("key")

    def look(batches):  # whenever the rows are asked for, they are as the file says then
        for _ in batches:
            rows = json.loads(at.read_text())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["key", "digest", "leaf"])

    records = lambda: spark.range(1).coalesce(1).mapInArrow(look, "key string, digest string, leaf string")
    put([("a", "1", ""), ("b", "1", "")])
    store.run(records(), "digest", keep)
    put([("a", "2", ""), ("b", "2", ""), ("c", "1", "")])
    changes = I.Store.changes

    def moving(self, now):
        out = changes(self, now)
        put([("a", "2", ""), ("b", "3", ""), ("d", "1", "")])  # b moves on, c goes, d comes
        return out

    monkeypatch.setattr(I.Store, "changes", moving)
    store.run(records(), "digest", keep)
    assert seen[-1] == [("a", "2")]
    monkeypatch.setattr(I.Store, "changes", changes)
    put([("a", "2", ""), ("b", "2", ""), ("c", "1", ""), ("d", "1", "")])  # b and c are as the broken look saw them
    store.run(records(), "digest", keep)
    assert seen[-1] == [("b", "2"), ("c", "1"), ("d", "1")]
    assert store.run(records(), "digest", keep) is None

"""Indexing, searching, clicks, sessions, the command line and the server over a small tree."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline import cli, server
from siftline.cache import QueryCache, cache_key
from siftline.collection import Collection
from siftline.config import EngineConfig
from siftline.errors import BadQuery, CodebaseNotFound, ConfigError, ModelUnavailable, NotIndexed, SessionNotFound, UnreadableFile
from siftline.operators import catalog, embeddings, search, sessions, sharding
from siftline.sources import files as sources


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "src").mkdir()
    (root / "node_modules").mkdir()
    (root / "src" / "token.py").write_text("def stale_token(window):\n    return window\n")
    (root / "src" / "other.rs").write_text("fn merge_cells() {}\n" * 120)
    (root / "src" / "empty.py").write_text("")
    (root / "node_modules" / "x.js").write_text("let stale_token = 1")
    (root / "skipped.log").write_text("stale token")
    return root


def test_index_search_click_delete(spark, tree, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), EngineConfig(fuzzy=False))
    with pytest.raises(NotIndexed):
        c.search("stale token")
    with pytest.raises(UnreadableFile):
        c.index(str(tmp_path / "absent"))
    first = c.index(str(tree), "toys", tags="a,b")
    assert (first["added"], first["modified"], first["removed"], first["chunks"]) == (2, 0, 0, 4)  # an empty file has no chunk and is not seen
    again = c.index(str(tree), "toys")
    assert (again["added"], again["modified"], again["removed"], again["unchanged"], again["chunks"]) == (0, 0, 0, 2, 4)
    found = c.search("stale token", "toys", 2)
    assert found[0]["file_path"] == "src/token.py" and found[0]["lines"] == "1-2" and found[0]["codebase"] == "toys" and [r["rank"] for r in found] == [1, 2]
    assert c.search("stale token", "toys", 2) == found and c.cache.hits == 1 and c.search("  ") == []
    with pytest.raises(CodebaseNotFound):
        c.search("stale token", "unknown")
    with pytest.raises(BadQuery):
        c.search("stale token", limit=0)
    c.click("stale token", found[1]["id"], 1, "toys")
    stats = c.table("query_stats", "query_text string, search_count long, last_searched long, avg_result_count double").collect()
    assert [(r.query_text, r.search_count, r.avg_result_count) for r in stats] == [("stale token", 3, 2.0)]
    assert c.table("search_clicks", "id long, chunk_id long").collect() == [(1, found[1]["id"])]
    before = {r["id"]: float(r["score"]) for r in found}
    after = {r["id"]: float(r["score"]) for r in c.search("stale token", "toys", 2)}
    assert after[found[1]["id"]] > before[found[1]["id"]]

    (tree / "src" / "token.py").write_text("def fresh(): pass\n")
    (tree / "src" / "other.rs").unlink()
    third = c.index(str(tree), "toys")
    assert (third["added"], third["modified"], third["removed"], third["chunks"]) == (0, 1, 1, 1)
    row = c.status().first()
    assert (row.name, row.files, row.chunks) == ("toys", 1, 1)
    forced = c.index(str(tree), "toys", force=True)
    assert forced["added"] == 1 and forced["chunks"] == 1
    assert c.delete("toys") == 1 and c.status().count() == 0
    c.reset()
    with pytest.raises(NotIndexed):
        c.delete("toys")


def test_command_line_and_server(spark, tree, tmp_path):
    (tree / "src" / "token.py").write_text("def stale_token(window):\n    return window\n")

    def told(*words):
        out = io.StringIO()
        assert cli.run(cli.parser().parse_args(["--folder", str(tmp_path / "d"), *words]), spark, out) == 0
        return out.getvalue()

    assert json.loads(told("index", str(tree), "--name", "toys"))["chunks"] >= 1
    assert "src/token.py:1-2" in told("search", "stale token", "--codebase", "toys", "-n", "1", "--no-fuzzy")
    assert told("search", "stale token", "--after", "2999-01-01", "--json", "--no-fuzzy").strip() == "[]"
    assert json.loads(told("status", "--json"))[0]["name"] == "toys" and json.loads(told("config"))["chunk_size"] == 50
    with pytest.raises(BadQuery):
        told("search", "x", "--after", "never")

    c = Collection(spark, str(tmp_path / "d"), EngineConfig(fuzzy=False))
    ask = lambda **r: server.answer(c, json.dumps({"jsonrpc": "2.0", "id": 7} | r))
    assert ask(method="ping")["result"] == {} and len(ask(method="tools/list")["result"]["tools"]) == 4 and "serverInfo" in ask(method="initialize")["result"]
    hits = json.loads(ask(method="tools/call", params={"name": "codebase_search", "arguments": {"query": "stale token", "limit": 1}})["result"]["content"][0]["text"])
    assert hits[0]["file_path"] == "src/token.py"
    uri = ask(method="resources/list")["result"]["resources"][0]["uri"]
    assert json.loads(ask(method="resources/read", params={"uri": uri})["result"]["contents"][0]["text"])["name"] == "toys"
    codes = [
        server.answer(c, "{")["error"]["code"], ask(method="absent")["error"]["code"], ask(method="tools/call", params={})["error"]["code"], ask(method="tools/call", params={"name": "x"})["error"]["code"],
        ask(method="tools/call", params={"name": "codebase_search", "arguments": {}})["error"]["code"], ask(method="tools/call", params={"name": "codebase_delete", "arguments": {"path": "?"}})["error"]["code"],
        ask(method="resources/read", params={"uri": "?"})["error"]["code"],
    ]
    assert codes == [-32700, -32601, -32602, -32601, -32602, -32000, -32001]
    assert server.answer(c, '{"method": "ping"}') is None


def test_sessions(spark):
    s = sessions.Sessions()
    k = s.create("one")
    with pytest.raises(BadQuery):
        s.create("one")
    with pytest.raises(SessionNotFound):
        s.get("two")
    assert s.add_step(k, "first", [{"id": 1, "file_path": "a", "score": 0.9}, {"id": 2, "file_path": "b", "score": 0.8}], 5) == 1
    s.select(k, 1, 1)
    s.select(k, 1, 2)
    s.note(k, 1, 2, "see")
    s.add_step(k, "second", [{"id": 2, "file_path": "b", "score": 0.7}], 6)
    s.select(k, 2, 2)
    assert s.refined(k) == "second in b OR a" and s.names() == ["one"]
    steps, results = s.tables(spark)
    assert sessions.history(steps).first().queries == ["first", "second"]
    assert sessions.refined_query(steps, sessions.relevant_files(results)).first().refined == "second in b OR a"
    row = sessions.summary(steps).first()
    assert (row.steps, row.queries, row.first_query, row.last_query) == (2, 2, "first", "second")
    assert results.filter("notes = 'see'").count() == 1
    marked = sessions.with_selection(results.drop("selected"), spark.createDataFrame([(1,)], "id long"), ["id"])
    assert {(r.id, r.selected) for r in marked.collect()} == {(1, True), (2, False)}
    answers = {"q": [{"id": 3, "file_path": "c", "score": 0.5}], "q in c": [{"id": 3, "file_path": "c", "score": 0.5}, {"id": 4, "file_path": "d", "score": 0.6}]}
    found = s.search(s.create("two"), lambda q: answers.get(q, []), "q")
    assert [r["id"] for r in found] == [4, 3] and s.get("two")["steps"][1][0] == "q in c"
    s.delete("one")
    assert s.names() == ["two"]


def test_embeddings(spark):
    assert embeddings.model_of("NOMIC-embed-text-v1.5").dim == 768 and embeddings.model_of("what").name == "minilm" and embeddings.model_of("custom", 5).dim == 5
    with pytest.raises(ModelUnavailable):
        embeddings.model_of("custom")
    assert embeddings.mean_pooled(np.array([[[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]]), np.array([[1, 1, 0]])).tolist() == [[2.0, 3.0]]
    assert embeddings.mean_pooled(np.ones((1, 2, 2)), np.zeros((1, 2))).tolist() == [[0.0, 0.0]]

    def encoder():
        def encode(texts):
            if "bad" in texts:
                raise ValueError("bad")
            return np.array([[3.0 * len(t), 4.0 * len(t)] for t in texts])

        return encode

    df = spark.createDataFrame([(1, "aa"), (2, None), (3, "bad"), (4, "")], "id long, text string").coalesce(1)
    got = {r.id: r.embedding for r in embeddings.embedded(df, "text", embeddings.Model("m", 2), encoder=encoder, batch=1).collect()}
    assert got[2] is None and got[3] == [0.0, 0.0] and got[4] == [0.0, 0.0] and got[1] == pytest.approx([0.6, 0.8])
    assert len(embeddings.embedded(df.limit(1), "text", embeddings.MODELS["nomic"], query=True).first().embedding) == 768
    assert [embeddings.best_batch(n) for n in (2, 4, 8, 9)] == [16, 32, 48, 64] and embeddings.best_batch(1, "cuda") == 128
    assert embeddings.batch_statistics(df, 3, 2.0).first() == (4, 2, 2.0) and embeddings.batch_statistics(df.limit(0), 3).first() == (0, 0, None)


def test_cache_shards_manifest_clicks(spark, tmp_path):
    q = QueryCache(2)
    assert q.get("a") is None and cache_key("a") != cache_key("a", "") and cache_key("a").endswith("_a")
    q.put("a", 1)
    q.put("a", 2, "c")
    assert q.get("a") == 1 and q.get("a", "c") == 2
    q.put("b", 3)
    assert q.get("a") is None and q.stats() == {"size": 2, "hits": 2, "misses": 2, "hit_rate": 0.5}
    q.invalidate()
    assert q.get("b") is None and len(q) == 1
    q.warm(["x"], str.upper)
    assert q.get("x") == "X"

    shards = sharding.Shards(["s0", "s1", "s2"], copies=2)
    rows = spark.createDataFrame([(i, f"c{i % 5}") for i in range(50)], "id long, codebase_id string")
    assert shards.spread(rows).count() == 100
    shards.write(rows, str(tmp_path / "shards"))
    assert shards.read(spark, str(tmp_path / "shards")).count() == 50 and {r.id % 5 for r in shards.read(spark, str(tmp_path / "shards"), "c3").collect()} == {3}
    with pytest.raises(ConfigError):
        shards.add("s1")
    shards.remove("s1")
    assert shards.names == ["s0", "s2"]
    assert {(r.batch_no, r["items"]) for r in sharding.batches(spark.range(105), "id", 20, 7).collect()} == {(k, 20) for k in range(5)} | {(5, 5)}
    assert sharding.batches(spark.range(0), "id", 20).count() == 0

    held = {(f"p{i}/é \"x\"", f"h{i}") for i in range(40)}
    sources.write_manifest(spark.createDataFrame(sorted(held), "path string, hash string"), str(tmp_path / "m"))
    assert {tuple(r) for r in sources.read_manifest(spark, str(tmp_path / "m")).collect()} == held
    sources.write_manifest(spark.createDataFrame([], "path string, hash string"), str(tmp_path / "m"))
    assert sources.read_manifest(spark, str(tmp_path / "m")).count() == 0 and sources.delete_manifest(spark, str(tmp_path / "m"))

    clicks = spark.createDataFrame([(7, "q", 1, 1, 100, "c")], "id long, query_text string, chunk_id long, click_rank long, clicked_at long, codebase_id string")
    stats = spark.createDataFrame([("q", 4, 100, 2.5)], "query_text string, search_count long, last_searched long, avg_result_count double")
    new = spark.createDataFrame([("q", 2, 1, 200_000, None), ("z", 3, 2, 150, "c"), (None, 1, 1, 5, None)], "query_text string, chunk_id long, click_rank long, clicked_at long, codebase_id string")
    both, counted = catalog.recorded_clicks(clicks, stats, new)
    assert {(r.id, r.query_text) for r in both.collect()} == {(7, "q"), (8, "z"), (9, "q")}
    assert {tuple(r) for r in counted.collect()} == {("q", 5, 200_000, 2.5), ("z", 1, 150, 0.0)}
    assert catalog.codebase_paths(spark.createDataFrame([("c", None), ("d", "/d")], "codebase_id string, path string")).orderBy("codebase_id").collect() == [("c", "c"), ("d", "/d")]


def test_fuzzy_against_brute_force(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    texts = ["stale token window", "stäle tökn", "STALED tokens", "", "nothing near at all", "windw tken stle", "tékn"]
    for q in ("stale tokn", "wndow", "x"):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", search.fuzzy(F.col("t"), q).alias("s")).collect()
        for r in got:
            want = 0.0
            for w in q.split():
                near = min((edits(w, x) for x in r.t.lower().split() if abs(len(x) - len(w)) <= 2), default=9)
                want += 1.0 if w in r.t.lower() else 1 - near / 3 if near <= 2 else 0.0
            assert r.s == pytest.approx(want / len(q.split())), (q, r.t)

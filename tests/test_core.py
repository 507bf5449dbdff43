"""Facts about the operators, on small fixtures."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from siftline import config
from siftline.functions import languages, vectors
from siftline.functions import text as T
from siftline.operators import catalog, chunking, enrich, graph, paths, rewrite, search, sessions, sharding
from siftline.operators.search import Filters
from siftline.sources import files as sources
from siftline.streaming import feedback

CHUNKS = "id long, codebase_id string, file_path string, start_line long, end_line long, content string, language string, hash string, embedding array<float>, author string, created_at long, modified_at long"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def chunk(i, content, path="a.py", language="python", embedding=None, codebase="c", at=1):
    return (i, codebase, path, 1, 1, content, language, "h", embedding, "me", 1, at)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [
            chunk(1, "def stale_token(window): pass", embedding=[1.0, 0.0, 0.0]), chunk(2, "nothing here", "b.rs", "rust", [0.0, 1.0, 0.0]),
            chunk(3, "token token token", "c.py", embedding=[0.9, 0.1, 0.0], codebase="d", at=5), chunk(4, None, "d.PY", None, None), chunk(5, "", "e.md", "markdown", [0.0, 0.0, 0.0]),
        ],
        CHUNKS,
    )


def windows(spark, text, size=50, overlap=10):
    df = spark.createDataFrame([("f", text)], "file_path string, content string")
    return [(r.start_line, r.end_line, r.chunk) for r in chunking.windows(df, size, overlap).orderBy("chunk_no").collect()]


def test_windows(spark):
    lines = [f"line {i}" for i in range(1, 101)]
    got = windows(spark, "\n".join(lines))
    assert [(a, b) for a, b, _ in got] == [(1, 50), (41, 90), (81, 100)]
    assert got[1][2] == "\n".join(lines[40:90])
    assert [(a, b) for a, b, _ in windows(spark, "line1\nline2\nline3")] == [(1, 3)]
    assert windows(spark, "") == [] and windows(spark, None) == []
    assert len(windows(spark, "\n".join(lines[:50]))) == 1 and len(windows(spark, "\n".join(lines[:51]))) == 2
    assert windows(spark, "a\r\nb\r\n")[0] == (1, 2, "a\nb")
    with pytest.raises(ValueError):
        chunking.windows(spark.createDataFrame([], "content string"), 10, 10)


def test_budget_chunkers():
    lines = [f"fn f{i}() {{ let x = {i}; }}" for i in range(60)]
    spans = chunking.by_budget(lines, 64)
    assert spans[0][0] == 0 and spans[-1][1] == 60 and all(a < b for a, b in spans)
    assert all(x[0] < y[0] <= x[1] for x, y in zip(spans, spans[1:], strict=False))
    cut = chunking.by_definition(lines, 64, "rust")
    assert cut[0][0] == 0 and cut[-1][1] == 60 and all(x[1] == y[0] for x, y in zip(cut, cut[1:], strict=False))
    assert chunking.by_budget(["x" * 5000, "y"], 16)[-1][1] == 2


def test_hashes_and_budgets(spark):
    assert one(spark, "test content", T.sha16) == hashlib.sha256(b"test content").hexdigest()[:16]
    ids = spark.range(1).select(T.chunk_id(F.lit("src/main.rs"), F.lit(1), F.lit(50)).alias("a"), T.chunk_id(F.lit("src/main.rs"), F.lit(2), F.lit(51)).alias("b")).first()
    assert len(ids.a) == 16 and ids.a != ids.b and ids.a == hashlib.sha256(b"src/main.rs:1-50").hexdigest()[:16]
    h = 5381
    for b in "Grüße/e39327468f035f54".encode():
        h = (h * 33 + b) % 2**64
    assert int(one(spark, "Grüße/e39327468f035f54", T.djb2)) == h and int(one(spark, "", T.djb2)) == 5381
    assert [one(spark, b, T.budget_tokens) for b in ("small", "MEDIUM", " Large ", "384", "auto", None)] == [256, 512, 1024, 384, 512, 512]
    assert one(spark, "small", T.budget_chars) == 1024 and one(spark, "small", T.budget_overlap) == 256
    assert one(spark, "Ää", T.token_estimate) == 1


def test_timestamps(spark):
    assert one(spark, "1700000000", T.parse_timestamp) == 1700000000
    assert one(spark, "2024-01-02", T.parse_timestamp) == 1704153600
    assert one(spark, "2024-01-02T03:04:05+01:00", T.parse_timestamp) == 1704161045
    assert one(spark, "junk", T.parse_timestamp) is None


def test_languages(spark):
    for name, language in [("src/main.rs", "rust"), ("a.py", "python"), ("Cargo.toml", "rust"), ("Makefile", "makefile"), ("unknown.xyz", "unknown"), ("x/y.tsx", "typescript"), (".env", "unknown"), ("noext", "unknown")]:
        assert one(spark, name, languages.detect) == language
    table = spark.createDataFrame(list(languages.LANGUAGES.items()), "key string, language string")
    df = spark.createDataFrame([("a/b.go",), ("Makefile",), ("q",)], "file_path string")
    assert {r.file_path: r.detected for r in languages.detect_join(df, table).collect()} == {"a/b.go": "go", "Makefile": "makefile", "q": "unknown"}


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)).cast("float") for y in x])
    r = spark.range(1).select(
        vectors.cosine(v(1, 0, 0), v(1, 0, 0)).alias("a"), vectors.cosine(v(1, 0, 0), v(0, 1, 0)).alias("b"), vectors.cosine(v(1, 0), v(1, 0, 0)).alias("c"), vectors.cosine(v(0, 0), v(1, 0)).alias("d"),
        vectors.l2_normalised(v(3, 4)).alias("e"), vectors.l2_normalised(v(0, 0)).alias("f"), vectors.similarity(F.lit(0.0)).alias("g"), vectors.similarity(F.lit(1.0)).alias("h"), vectors.similarity(F.lit(0.5)).alias("i"),
        vectors.hash_embedding(F.lit("hello world"), 384).alias("j"), vectors.distance(v(0, 0), v(1, 0)).alias("k"),
    ).first()
    assert (r.a, r.b, r.c, r.d) == (1.0, 0.0, 0.0, 0.0) and r.f == [0.0, 0.0] and (r.g, r.h, r.i) == (1.0, 0.0, 0.5) and r.k == vectors.FAR
    assert r.e == pytest.approx([0.6, 0.8], abs=1e-6)
    assert math.sqrt(sum(x * x for x in r.j)) == pytest.approx(1, abs=1e-5) and len(r.j) == 384
    assert r.j == pytest.approx(vectors.hash_vector("hello world", 384), abs=1e-7)
    assert vectors.hash_vector("a", 14) != vectors.hash_vector("b", 14)


def test_search(spark, rows, tmp_path):
    bm = {r.id: r.score for r in search.bm25(rows, "stale token").collect()}
    assert set(bm) == {1, 3}
    hits = search.full_text(rows, "stale token", 10).orderBy("rank").collect()
    assert hits[0].score == 1.0 and [h.rank for h in hits] == [1, 2]
    assert search.bm25(rows, "  ").count() == 0 and search.bm25(rows, "C++ AND it's").count() == 0
    top = search.vector(rows, [1.0, 0.0, 0.0], 2).orderBy("rank").collect()
    assert [t.id for t in top] == [1, 3] and top[0].score == 1.0
    assert [r.id for r in search.vector(rows, [1.0, 0.0, 0.0], 2, python=True).orderBy("rank").collect()] == [1, 3]
    assert {r.id for r in search.filtered(rows, None, Filters(file_type="py")).collect()} == {1, 3, 4}
    assert {r.id for r in search.filtered(rows, "d", Filters(after=4)).collect()} == {3}
    assert search.filtered(rows, None, Filters(author="nobody")).count() == 0

    index = search.Index(spark, str(tmp_path / "index"), 4).build(rows)
    assert {r.id: r.score for r in index.bm25("stale token").collect()} == bm
    new = rows.withColumn("content", F.when(F.col("id") == 2, "token window").otherwise(F.col("content")))
    moved = index.updated(new, spark.createDataFrame([(2,)], "id long"), str(tmp_path / "index2"))
    assert {r.id: r.score for r in moved.bm25("token").collect()} == {r.id: r.score for r in search.bm25(new, "token").collect()}


def test_hybrid_search(spark, rows):
    clicks = spark.createDataFrame([(1, "stale token", 3, 1, 10, "c"), (1, "stale token", 3, 1, 10, "c"), (2, "stale token", 3, 2, 11, None)], "id long, query_text string, chunk_id long, click_rank long, clicked_at long, codebase_id string")
    assert search.click_boosts(clicks, "stale token").first().boost == pytest.approx(0.75)
    plain = {r.id: r for r in search.hybrid(rows, "stale token", [1.0, 0.0, 0.0], 5).collect()}
    ranks = sorted(r.rank for r in plain.values())
    assert ranks == list(range(1, len(plain) + 1)) and plain[1].rank == 1
    boosted = {r.id: r.score for r in search.hybrid(rows, "stale token", [1.0, 0.0, 0.0], 5, clicks=clicks).collect()}
    assert boosted[3] > plain[3].score
    spelled = {r.id: r.score for r in search.hybrid(rows, "stale token", [1.0, 0.0, 0.0], 5, use_fuzzy=True).collect()}
    assert all(spelled[k] >= plain[k].score for k in plain)
    few = {r.id for r in search.hybrid(rows, "stale token", [1.0, 0.0, 0.0], 5, filters=Filters(language="rust")).collect()}
    assert few <= {2}
    assert {r.id for r in search.hybrid(rows, "stale token", [1.0, 0.0, 0.0], 5, filters=Filters(language="rust"), leaky=True).collect()} > few
    assert search.hybrid(rows, " ", [1.0, 0.0, 0.0]).count() == 0
    only = search.hybrid(rows, "stale token", [0.0, 1.0, 0.0], 1, vector_only=True).first()
    assert only.id == 2
    stats = spark.createDataFrame([("stale token", 40)], "query_text string, search_count long")
    assert search.popularity(stats, "stale token") == 0.4 and search.popularity(stats, "x") is None


def test_catalog(spark, rows):
    assert catalog.codebase_stats(rows, "none").count() == 0 and catalog.codebase_stats(rows, "d").first().chunks == 1
    books = spark.createDataFrame([("c", "C", "/c", 1, None, None, None), ("x", "X", "/x", 1, None, None, None)], "codebase_id string, name string, path string, indexed_at long, last_updated long, model string, tags string")
    assert {r.codebase_id: r.chunks for r in catalog.with_metadata(books, rows).collect()} == {"c": 4, "x": 0}
    assert catalog.resolve(books, "/x").first().codebase_id == "x" and catalog.resolve(books, "?").count() == 0
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long"), spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "k string, v long")
    assert {tuple(r) for r in catalog.upsert(old, new, ["k"], "v").collect()} == {("a", 1), ("b", 4), ("c", 5)}
    log = spark.createDataFrame([("q", 1, 10), ("q", 2, 20)], "query_text string, searched_at long, results long")
    assert catalog.search_stats(log).first().avg_result_count == 15.0
    merged = catalog.merged_stats(spark.createDataFrame([("q", 2, 1, 30.0)], "query_text string, search_count long, last_searched long, avg_result_count double"), log).first()
    assert (merged.search_count, merged.last_searched, merged.avg_result_count) == (4, 2, 22.5)
    a, b = spark.createDataFrame([("x", "1"), ("y", "2")], "p string, hash string"), spark.createDataFrame([("y", "3"), ("z", "4")], "p string, hash string")
    assert {tuple(r) for r in catalog.manifest_diff(a, b, ["p"]).collect()} == {("x", "added"), ("y", "modified"), ("z", "removed")}
    assert catalog.cache_stats(spark.createDataFrame([(True,), (False,), (True,)], "hit boolean")).first().hits == 2
    assert catalog.without_file(rows, "c", "a.py").count() == 4 and catalog.without_codebase(rows, "c").count() == 1


def test_paths(spark):
    for p, skip in [("node_modules/x.js", True), ("src/target/x.rs", True), ("a.pyc", True), ("Cargo.lock", True), ("x/photo.png", True), ("src/main.rs", False), ("LICENSE", False), ("lib/a.PY", False), ("targets/a.py", False)]:
        assert one(spark, p, paths.skipped) is skip, p
    ignore = spark.createDataFrame([(".gitignore", "target/\n*.o\n*.tmp\n# c\n*.log\n!keep.log\n"), ("src/.gitignore", "generated/\n")], "path string, content string")
    names = ["main.rs", "src/lib.rs", "tests/test.rs", "target/debug/a", "a.o", "x/b.tmp", "app.log", "keep.log", "src/generated/a.rs", "generated/b.rs"]
    kept = {r.path for r in paths.not_ignored(spark.createDataFrame([(n,) for n in names], "path string"), paths.rules(ignore)).collect()}
    assert kept == {"main.rs", "src/lib.rs", "tests/test.rs", "keep.log", "generated/b.rs"}


def test_rewriting(spark):
    syn = rewrite.thesaurus(spark)
    auth = {r.synonym for r in syn.filter("term = 'auth'").collect()}
    assert {"authentication", "login", "oauth"} <= auth and {"db", "sql"} <= {r.synonym for r in syn.filter("term = 'database'").collect()}
    q = spark.createDataFrame([("auth flow",)], "query_text string")
    out = {r.expansion for r in rewrite.expanded(q, syn).collect()}
    assert {"auth flow", "login flow", "token flow"} <= out
    assert "authentication" in rewrite.expanded_for_text_search(q, syn).first().terms.split(" OR ")
    known = spark.createDataFrame([("authentication",), ("database",), ("cache",)], "term string")
    words = spark.createDataFrame([("Authentiction",), ("cashe",), ("zzzzzz",), ("db",), ("cache",)], "word string")
    assert {r.word: r.corrected for r in rewrite.corrected(words, known).collect()} == {"Authentiction": "Authentication", "cashe": "cache", "zzzzzz": "zzzzzz", "db": "db", "cache": "cache"}
    assert "function" in one(spark, "fucntion", rewrite.variants) and "application programming interface" in one(spark, "API", rewrite.variants) and "index" in one(spark, "indexing", rewrite.variants)


def test_enrichment_and_graph(spark):
    rust = "use std::io;\nuse crate::x::Y;\n/// Reads it\n/// all.\npub fn main(a: u8) -> u8 {\n}\npub struct Big {}\nimpl Big {}\ntype Id = u8;\n"
    go = 'package a\nimport (\n\t"fmt"\n\tx "net/http"\n)\n// Run it.\nfunc (s *S) Run(a int) error {\n}\ntype S struct {\n}\n'
    js = "import { A } from './a';\nconst b = require(\"b\");\n/** Adds. */\nexport function add(x) {}\nclass C {}\n"
    rows = spark.createDataFrame([chunk(1, rust, "m.rs", "rust"), chunk(2, go, "m.go", "go"), chunk(3, js, "m.js", "javascript"), chunk(4, "import Big\nclass K:\n    pass", "n.py", "Python "), chunk(5, "x", "r.toml", "toml")], CHUNKS)
    m = {r.id: r.m for r in rows.select("id", enrich.enriched(F.col("content"), F.lower(F.trim("language"))).alias("m")).collect()}
    assert m[1].imports == ["std::io"] and m[1].function_signatures == ["pub fn main(a: u8) -> u8"] and m[1].doc_comments == ["Reads it all."] and m[1].context == ["struct Big"] and m[1].types == ["Id"]
    assert m[2].imports == ["fmt", "net/http"] and m[2].function_signatures == ["func (s *S) Run(a int) error"] and m[2].doc_comments == ["Run it."]
    assert m[3].imports == ["./a", "b"] and m[3].function_signatures == ["add(...)"] and m[3].exports == ["add(...)", "class C"] and m[3].doc_comments == ["Adds."]
    n = graph.nodes(rows)
    found = {(r.node_type, r.name) for r in n.collect()}
    assert {("Function", "main"), ("Struct", "Big"), ("Impl", "Big"), ("Function", "Run"), ("Class", "C"), ("Class", "K"), ("Import", "Big"), ("Module", "r.toml")} <= found
    assert graph.import_edges(n).count() == 2  # the struct and its impl
    theta = {tuple(r) for r in graph.import_edges_by_containment(spark.createDataFrame([("ab",), ("x.Foo",), ("Fo",)], "name string"), spark.createDataFrame([("Foo",), ("ab",), ("q",)], "name string")).collect()}
    assert theta == {("ab", "ab"), ("x.Foo", "Foo")} | {("Fo", "Foo")} - {("Fo", "Foo")} or ("Fo", "Foo") in theta
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "from_id string, to_id string")
    assert {tuple(r) for r in graph.traverse(edges, spark.createDataFrame([("a",)], "node_id string"), 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_sessions_and_shards(spark):
    results = spark.createDataFrame([("s", "a.py", 0.9, True), ("s", "b.py", 0.8, True), ("s", "c.py", 5.0, False)], "session_id string, file_path string, score double, selected boolean")
    files = sessions.relevant_files(results)
    assert [r.file_path for r in files.orderBy(F.desc("score")).collect()] == ["a.py", "b.py"]
    steps = spark.createDataFrame([("s", "first", 1), ("s", "last", 2), ("t", "only", 1)], "session_id string, query_text string, step_number long")
    assert {tuple(r) for r in sessions.refined_query(steps, files).collect()} == {("s", "last in a.py OR b.py"), ("t", "only")}
    books = spark.createDataFrame([("abc",), (None,)], "codebase_id string")
    routes = {r.codebase_id: r for r in sharding.route(books, 4, 2).collect()}
    assert len(routes["abc"].shards) == 2 and routes["abc"].merge and routes[None].shards == [0, 1, 2, 3]
    lists = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 2), (2, 1, 0.7, 1), (2, 3, 0.6, 2)], "shard int, id long, score double, rank long")
    assert sharding.merged(lists, 2).first().id == 1 and sharding.merged(lists, 2).count() == 2


def test_streams(spark, tmp_path):
    schema = "id long, query_text string, chunk_id long, click_rank long, clicked_at long, codebase_id string"
    rows = [(1, "q", 5, 1, 1000, None), (1, "q", 5, 1, 1000, None), (2, "q", 5, 2, 1100, None), (3, "r", 6, 4, 90000, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = feedback.click_boosts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("boosts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in feedback.click_boosts(spark.createDataFrame(rows, schema)).collect()}
    assert {tuple(r) for r in spark.table("boosts").collect()} == want and ("q", 5, 0.75, 2) in want


def test_config(tmp_path):
    c = config.load(env={})
    assert (len(c.extensions), len(c.skip_dirs), len(c.skip_files)) == (119, 26, 30) and (c.chunk_size, c.chunk_overlap, c.limit) == (50, 10, 10)
    f = tmp_path / "c.toml"
    f.write_text("[chunking]\nchunk_size = 20\nchunk_overlap = 5\n[search]\nlimit = 7\n")
    assert config.load(str(f), {"SIFTLINE_LIMIT": "3", "SIFTLINE_FUZZY": "no"}).limit == 3 and config.load(str(f), {}).chunk_size == 20
    with pytest.raises(ValueError):
        config.EngineConfig(chunk_size=10, chunk_overlap=10)
    f.write_text("nonsense = 1\n")
    with pytest.raises(ValueError):
        config.load(str(f), {})


def test_sources(spark, tmp_path):
    root = tmp_path / "tree"
    for name, data in {"a.py": b"x = 1\n", "sub/b.rs": b"fn b() {}\n", "sub/c.log": b"no", "node_modules/d.js": b"no", "bad.py": b"\xff\xfe", ".gitignore": b"skip.py\n", "skip.py": b"no"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    found = sources.scan(spark, str(root))
    assert {r.path for r in found.collect()} >= {"a.py", "sub/b.rs", "bad.py"} and not {r.path for r in found.collect()} & {"skip.py", "sub/c.log", "node_modules/d.js"}
    assert {(r.file_path, r.language) for r in sources.texts(found).filter("file_path like '%.py' or file_path like '%.rs'").collect()} == {("a.py", "python"), ("sub/b.rs", "rust")}
    (tmp_path / "m.json").write_text(json.dumps({"a": "1", "b": "2"}))
    assert {tuple(r) for r in sources.read_manifest(spark, str(tmp_path / "m.json")).collect()} == {("a", "1"), ("b", "2")}

"""Queries over the collection tables, each over its whole tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.config import EngineConfig
from siftline.functions import languages, vectors
from siftline.functions import text as T
from siftline.operators import catalog, chunking, enrich, graph, paths, rewrite, search, sessions, sharding
from siftline.operators.search import Filters
from siftline.session import cut, read, spread, tables_dir
from siftline.streaming import feedback

QUERY = "stale token window"
TYPED = "how to split a centroid"
VECTOR = [round(x, 6) for x in vectors.hash_vector(QUERY, 64)]
CODEBASE = "e39327468f035f54"
_VEC = "[" + ", ".join(f"{x!r}::FLOAT" for x in VECTOR) + "]"
WORDS = T.query_terms(QUERY)

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def chunks(s, d):
    return read(s, d, "chunks")


# ------------------------------------------------------------------ counts and tables
query("codebase_stats", f"SELECT * FROM (SELECT count(*) AS chunks, count(DISTINCT file_path) AS files FROM chunks WHERE codebase_id = '{CODEBASE}') WHERE chunks > 0")(lambda s, d: catalog.codebase_stats(chunks(s, d), CODEBASE))
query("global_stats", "SELECT count(*) AS chunks, count(DISTINCT file_path) AS files, count(DISTINCT codebase_id) AS codebases FROM chunks")(lambda s, d: catalog.global_stats(chunks(s, d)))
query("list_codebases", "SELECT codebase_id, count(*) AS chunks, count(DISTINCT file_path) AS files FROM chunks GROUP BY codebase_id")(lambda s, d: catalog.by_codebase(chunks(s, d)))
query(
    "codebases_left_join",
    """SELECT c.codebase_id, c.name, c.path, c.indexed_at, c.last_updated, c.model, c.tags, coalesce(k.chunks, 0) AS chunks, coalesce(k.files, 0) AS files
       FROM codebases c LEFT JOIN (SELECT codebase_id, count(*) AS chunks, count(DISTINCT file_path) AS files FROM chunks GROUP BY 1) k USING (codebase_id)""",
)(lambda s, d: catalog.with_metadata(read(s, d, "codebases"), chunks(s, d)))
query("resolve_codebase", "SELECT DISTINCT codebase_id FROM codebases WHERE codebase_id = 'oversized-frame' OR name = 'oversized-frame' OR path = 'oversized-frame'")(lambda s, d: catalog.resolve(read(s, d, "codebases"), "oversized-frame"))
query("language_weights", f"SELECT language, round(2.0 * (1.0 - n / sum(n) OVER ()), 9) AS weight FROM (SELECT language, count(*) AS n FROM chunks WHERE codebase_id = '{CODEBASE}' AND language IS NOT NULL GROUP BY 1)")(
    lambda s, d: search.language_weights(chunks(s, d), CODEBASE).withColumn("weight", F.round("weight", 9))
)
query("click_boosts", f"SELECT chunk_id AS id, round(avg(1.0 / click_rank), 9) AS boost FROM (SELECT DISTINCT id, query_text, chunk_id, click_rank FROM search_clicks) WHERE query_text = '{TYPED}' GROUP BY 1")(
    lambda s, d: search.click_boosts(read(s, d, "search_clicks"), TYPED).withColumn("boost", F.round("boost", 9))
)
query("query_popularity", "SELECT query_text, least(search_count, 100) / 100.0 AS popularity FROM query_stats")(lambda s, d: read(s, d, "query_stats").select("query_text", (F.least("search_count", F.lit(100)) / 100.0).alias("popularity")))
query("click_stats", "SELECT query_text, count(*) AS search_count, max(clicked_at) AS last_searched FROM (SELECT DISTINCT id, query_text, clicked_at FROM search_clicks) GROUP BY 1")(lambda s, d: catalog.click_stats(read(s, d, "search_clicks")))
_LOG = "SELECT query_text, clicked_at AS searched_at, click_rank AS results FROM search_clicks"
query("query_stats_running_avg", f"SELECT query_text, count(*) AS search_count, max(searched_at) AS last_searched, round(avg(results), 9) AS avg_result_count FROM ({_LOG}) GROUP BY 1")(
    lambda s, d: catalog.search_stats(read(s, d, "search_clicks").select("query_text", F.col("clicked_at").alias("searched_at"), F.col("click_rank").alias("results"))).withColumn("avg_result_count", F.round("avg_result_count", 9))
)
query(
    "query_stats_merged",
    f"""WITH n AS (SELECT query_text, count(*) AS n, max(searched_at) AS t, sum(results) AS r FROM ({_LOG}) GROUP BY 1)
        SELECT query_text, coalesce(search_count, 0) + coalesce(n, 0) AS search_count, greatest(last_searched, t) AS last_searched,
               round((coalesce(avg_result_count * search_count, 0) + coalesce(r, 0)) / (coalesce(search_count, 0) + coalesce(n, 0)), 6) AS avg_result_count
        FROM (SELECT query_text, search_count, last_searched, avg_result_count FROM query_stats) FULL JOIN n USING (query_text)""",
)(
    lambda s, d: catalog.merged_stats(read(s, d, "query_stats"), read(s, d, "search_clicks").select("query_text", F.col("clicked_at").alias("searched_at"), F.col("click_rank").alias("results"))).withColumn("avg_result_count", F.round("avg_result_count", 6))
)
query("first_chunks", "SELECT codebase_id, file_path, arg_min(hash, id) AS hash, min(id) AS id FROM chunks GROUP BY 1, 2")(lambda s, d: catalog.first_chunks(chunks(s, d), ["hash"]))
query(
    "upsert_chunks",
    """WITH new AS (SELECT codebase_id, file_path, start_line, end_line, max(id) AS id FROM chunks WHERE id % 3 = 0 GROUP BY ALL), old AS (SELECT codebase_id, file_path, start_line, end_line, id FROM chunks WHERE id % 3 <> 0)
       SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.codebase_id IS NOT DISTINCT FROM old.codebase_id AND new.file_path IS NOT DISTINCT FROM old.file_path AND new.start_line IS NOT DISTINCT FROM old.start_line AND new.end_line IS NOT DISTINCT FROM old.end_line)
       UNION ALL SELECT * FROM new""",
)(lambda s, d: (lambda c: catalog.upsert(c.filter("id % 3 <> 0"), c.filter("id % 3 = 0"), catalog.CHUNK_KEY, "id"))(chunks(s, d).select(*catalog.CHUNK_KEY, "id")))
query("delete_file", f"SELECT codebase_id, file_path, count(*) AS n FROM chunks WHERE (codebase_id = '{CODEBASE}' AND file_path = (SELECT min(file_path) FROM chunks WHERE codebase_id = '{CODEBASE}')) IS NOT TRUE GROUP BY ALL")(
    lambda s, d: (lambda c: catalog.without_file(c, CODEBASE, c.filter(F.col("codebase_id") == CODEBASE).agg(F.min("file_path")).first()[0]).groupBy("codebase_id", "file_path").agg(F.count("*").alias("n")))(chunks(s, d))
)
query("delete_codebase", f"SELECT id FROM chunks WHERE codebase_id IS DISTINCT FROM '{CODEBASE}'")(lambda s, d: catalog.without_codebase(chunks(s, d), CODEBASE).select("id"))
query(
    "manifest_diff",
    """WITH a AS (SELECT codebase_id, file_path, max(hash) AS h FROM chunks GROUP BY 1, 2), b AS (SELECT codebase_id, path AS file_path, max(hash) AS h FROM manifest GROUP BY 1, 2)
       SELECT codebase_id, file_path, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (codebase_id, file_path) WHERE a.h IS DISTINCT FROM b.h""",
)(
    lambda s, d: catalog.manifest_diff(
        chunks(s, d).groupBy("codebase_id", "file_path").agg(F.max("hash").alias("hash")),
        read(s, d, "manifest").groupBy("codebase_id", F.col("path").alias("file_path")).agg(F.max("hash").alias("hash")), ["codebase_id", "file_path"],
    )
)
query("cache_stats", "SELECT count(*) FILTER (click_rank <= 3) AS hits, count(*) FILTER (click_rank > 3) AS misses, round(count(*) FILTER (click_rank <= 3) / count(*), 9) AS hit_rate FROM search_clicks")(
    lambda s, d: catalog.cache_stats(read(s, d, "search_clicks").select((F.col("click_rank") <= 3).alias("hit"))).withColumn("hit_rate", F.round("hit_rate", 9))
)

# ------------------------------------------------------------------ search
_TOK = r"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+')"
_BM25 = f"""
    w AS (SELECT id, {_TOK.format(c='content')} AS c, {_TOK.format(c='file_path')} AS p FROM chunks),
    r AS (SELECT id, len(c) + len(p) AS dl, {', '.join(f"len(list_filter(c, lambda x: x = '{t}')) * 1.5 + len(list_filter(p, lambda x: x = '{t}')) * 0.75 AS tf{i}" for i, t in enumerate(WORDS))} FROM w),
    st AS (SELECT count(*)::DOUBLE AS docs, avg(dl) AS mean, {', '.join(f"count(*) FILTER (tf{i} > 0)::DOUBLE AS n{i}" for i in range(len(WORDS)))} FROM r),
    bm AS (SELECT id, round({' + '.join(f"greatest(ln((docs - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(WORDS)))}, 6) AS score
           FROM r, st WHERE greatest({', '.join(f"tf{i}" for i in range(len(WORDS)))}) > 0)"""
_COS = f"""CASE WHEN embedding IS NOT NULL AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0
    THEN round(list_cosine_similarity(embedding::DOUBLE[], {_VEC}::DOUBLE[]), 6) ELSE 0.0 END"""


def _top(source: str, n: int) -> str:
    return f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {source} QUALIFY rank <= {n}"


def _fts(n: int, where: str = "true") -> str:
    return f"SELECT id, score / max(score) OVER () AS score, rank FROM ({_top(f'(SELECT bm.* FROM bm JOIN chunks USING (id) WHERE {where})', n)})"


query("bm25_scores", f"WITH {_BM25} SELECT id, score FROM bm")(lambda s, d: search.bm25(chunks(s, d), QUERY))
query("fts_match", f"WITH {_BM25} SELECT id FROM bm")(lambda s, d: search.bm25(chunks(s, d), QUERY).select("id"))
query("bm25_topk_normalized", f"WITH {_BM25} SELECT id, round(score, 9) AS score, rank FROM ({_fts(30)})")(lambda s, d: search.full_text(chunks(s, d), QUERY, 30, index=indexed(s, d)).withColumn("score", F.round("score", 9)))
query("bm25_topk_scanned", f"WITH {_BM25} SELECT id, round(score, 9) AS score, rank FROM ({_fts(30)})")(lambda s, d: search.full_text(chunks(s, d), QUERY, 30).withColumn("score", F.round("score", 9)))
query("fts_filtered", f"WITH {_BM25} SELECT id, round(score, 9) AS score, rank FROM ({_fts(20, f'''codebase_id = '{CODEBASE}' AND language = 'python' AND lower(file_path) LIKE '%.py' AND modified_at > 1720000000''')})")(
    lambda s, d: search.full_text(chunks(s, d), QUERY, 20, CODEBASE, Filters(language="python", file_type="PY", after=1720000000)).withColumn("score", F.round("score", 9))
)
query("cosine_scores", f"SELECT id, {_COS} AS score FROM chunks")(lambda s, d: chunks(s, d).select("id", T.stable_score(vectors.cosine(F.col("embedding"), F.array(*[F.lit(x).cast("float") for x in VECTOR]))).alias("score")))
query("cosine_topk", _top(f"(SELECT id, {_COS} AS score FROM chunks)", 10))(lambda s, d: search.vector(chunks(s, d), VECTOR, 10))
query("cosine_topk_python", _top(f"(SELECT id, {_COS} AS score FROM chunks)", 10))(lambda s, d: search.vector(chunks(s, d), VECTOR, 10, python=True))
query("cosine_topk_codebase", _top(f"(SELECT id, {_COS} AS score FROM chunks WHERE codebase_id = '{CODEBASE}')", 10))(lambda s, d: search.vector(chunks(s, d), VECTOR, 10, CODEBASE))
query("cosine_distance_clamped", f"SELECT id, round(CASE WHEN embedding IS NULL OR len(embedding) <> 64 OR list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) = 0 THEN 0 ELSE greatest(0.0, list_cosine_similarity(embedding::DOUBLE[], {_VEC}::DOUBLE[])) END, 6) AS similarity FROM chunks")(
    lambda s, d: chunks(s, d).select("id", F.round(vectors.similarity(vectors.distance(F.col("embedding"), F.array(*[F.lit(x).cast("float") for x in VECTOR]))), 6).alias("similarity"))
)
query("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS total FROM embeddings")(
    lambda s, d: read(s, d, "embeddings").select("vec_id", F.round(F.aggregate(vectors.l2_normalised(F.col("embedding")), F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))
)
query("hash_embedding")(lambda s, d: read(s, d, "documents").filter("text is not null").select("doc_id", vectors.hash_embedding(F.col("text"), 64).alias("embedding")))
query("language_filter", "SELECT id FROM chunks WHERE language = 'rust'")(lambda s, d: search.filtered(chunks(s, d), None, Filters(language="rust")).select("id"))
query("author_filter", "SELECT id FROM chunks WHERE author = 'otter7'")(lambda s, d: search.filtered(chunks(s, d), None, Filters(author="otter7")).select("id"))
query("file_type_filter", "SELECT id FROM chunks WHERE lower(file_path) LIKE '%.rs'")(lambda s, d: search.filtered(chunks(s, d), None, Filters(file_type=".RS")).select("id"))
query("after_filter", "SELECT id FROM chunks WHERE modified_at > 1725000000")(lambda s, d: search.filtered(chunks(s, d), None, Filters(after=1725000000)).select("id"))
query("rrf_fusion", f"""WITH {_BM25}, f AS ({_fts(30)}), v AS ({_top(f'(SELECT id, {_COS} AS score FROM chunks)', 30)})
    SELECT id, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM (SELECT id, rank FROM f UNION ALL SELECT id, rank FROM v) GROUP BY id""")(
    lambda s, d: search.fused_ranks(search.full_text(chunks(s, d), QUERY, 30).unionByName(search.vector(chunks(s, d), VECTOR, 30))).withColumn("rrf", F.round("rrf", 9))
)
_COVER = "(" + " + ".join(f"contains(lower(coalesce(content, '')), '{w}')::INT" for w in QUERY.split()) + f")::DOUBLE / {len(QUERY.split())}"
query("coverage", f"SELECT id, round({_COVER}, 9) AS coverage FROM chunks")(lambda s, d: chunks(s, d).select("id", F.round(T.coverage(QUERY, F.coalesce("content", F.lit(""))), 9).alias("coverage")))
# edits are counted in letters: a letter that is not ASCII is as far from the query's as any other
_NEAR = lambda w: f"""CASE WHEN contains(lower(content), '{w}') THEN 1.0 ELSE coalesce((SELECT CASE WHEN min(levenshtein('{w}', x)) <= 2 THEN 1.0 - min(levenshtein('{w}', x)) / 3.0 ELSE 0.0 END FROM unnest(regexp_split_to_array(regexp_replace(lower(content), '[^\\x00-\\x7f]', '~', 'g'), '\\s+')) AS t(x) WHERE x <> '' AND abs(length(x) - {len(w)}) <= 2), 0.0) END"""
query("fuzzy_boost", f"SELECT id, round(({' + '.join(_NEAR(w) for w in 'stale tokn wndow'.split())}) / 3.0, 6) AS fuzzy FROM chunks WHERE content IS NOT NULL")(
    lambda s, d: chunks(s, d).filter("content is not null").select("id", F.round(search.fuzzy(F.col("content"), "stale tokn wndow"), 6).alias("fuzzy"))
)
query("popularity_weights", "SELECT query_text, p AS popularity, round(0.5 * 0.6 + 0.5 * (1 - p), 6) AS fts_weight, round(0.5 * 0.4 + 0.5 * p, 6) AS vector_weight FROM (SELECT query_text, least(search_count, 100) / 100.0 AS p FROM query_stats)")(
    lambda s, d: search.popularity_weights(read(s, d, "query_stats")).withColumn("fts_weight", F.round("fts_weight", 6)).withColumn("vector_weight", F.round("vector_weight", 6))
)
_IGNORED = ["tests/", "*.min.js", "/docs/**", "*_generated.*", "!keep_generated.go", "build/"]
query("gitignore_filter", """SELECT DISTINCT file_path FROM (SELECT file_path, string_split(file_path, '/') AS parts, string_split(file_path, '/')[-1] AS name FROM chunks WHERE file_path IS NOT NULL)
    WHERE NOT (list_contains(parts[:-2], 'tests') OR list_contains(parts[:-2], 'build') OR parts[1] = 'docs' AND len(parts) > 1 OR ends_with(name, '.min.js') OR (regexp_matches(name, '_generated\\.') AND name <> 'keep_generated.go'))""")(
    lambda s, d: paths.not_ignored(chunks(s, d).filter("file_path is not null").select(F.col("file_path").alias("path")).distinct(), paths.rules(s.createDataFrame([(".gitignore", "\n".join(_IGNORED))], "path string, content string"))).select(F.col("path").alias("file_path"))
)


_INDEXES: dict = {}


def indexed(s, d):
    """The search index of the chunks below a folder, built once a session."""
    key = (s.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = search.Index(s, f"{tables_dir(s)}/index-{len(_INDEXES)}").build(chunks(s, d))
    return _INDEXES[key]


def _hybrid_sql(codebase: str | None, clicks: bool, where: str = "true", vector_where: str | None = None) -> str:
    inside = f"codebase_id = '{codebase}' AND " if codebase else ""
    wf, wv = 0.6, 0.4
    adjust = "(s.score + 0.3 * coalesce(b.boost, 0))" if clicks else "s.score"
    if codebase:
        adjust = f"({adjust} * (1 + 0.2 * coalesce(l.weight, 0)))"
    return f"""
    WITH {_BM25}, f AS ({_fts(30, inside + where)}), v AS ({_top(f"(SELECT id, {_COS} AS score FROM chunks WHERE {inside} {vector_where or where})", 30)}),
    boosts AS (SELECT chunk_id AS id, avg(1.0 / click_rank) AS boost FROM (SELECT DISTINCT id, query_text, chunk_id, click_rank FROM search_clicks) WHERE query_text = '{QUERY}' GROUP BY 1),
    lw AS (SELECT language, 2.0 * (1.0 - n / sum(n) OVER ()) AS weight FROM (SELECT language, count(*) AS n FROM chunks WHERE codebase_id = '{codebase}' AND language IS NOT NULL GROUP BY 1)),
    s AS (SELECT id, score, rank, 0 AS side FROM f UNION ALL SELECT id, score, rank, 1 AS side FROM v),
    rrf AS (SELECT id, sum(1.0 / (60 + rank)) AS rrf FROM s GROUP BY id),
    one AS (SELECT s.id, CASE WHEN s.side = 0 THEN {wf} ELSE {wv} END * ({adjust} + 0.2 * {_COVER}) AS score
            FROM s JOIN chunks c ON c.id = s.id LEFT JOIN boosts b ON b.id = s.id LEFT JOIN lw l ON l.language = c.language
            QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY side) = 1),
    final AS (SELECT id, round(0.7 * score + 0.3 * rrf, 6) AS score FROM one JOIN rrf USING (id))
    SELECT t.id, c.codebase_id, c.file_path, c.start_line, c.end_line, c.language, t.score, t.rank FROM ({_top('final', 10)}) t JOIN chunks c ON c.id = t.id"""


query("hybrid_search", _hybrid_sql(None, True))(lambda s, d: search.hybrid(chunks(s, d), QUERY, VECTOR, 10, clicks=read(s, d, "search_clicks"), index=indexed(s, d)))
query("hybrid_search_scanned", _hybrid_sql(None, True))(lambda s, d: search.hybrid(chunks(s, d), QUERY, VECTOR, 10, clicks=read(s, d, "search_clicks")))
query("hybrid_search_codebase", _hybrid_sql(CODEBASE, True))(lambda s, d: search.hybrid(chunks(s, d), QUERY, VECTOR, 10, CODEBASE, clicks=read(s, d, "search_clicks")))
query("hybrid_search_filtered", _hybrid_sql(None, False, "language = 'python'"))(lambda s, d: search.hybrid(chunks(s, d), QUERY, VECTOR, 10, filters=Filters(language="python")))
query("hybrid_search_leaky", _hybrid_sql(None, False, "language = 'python'", "true"))(lambda s, d: search.hybrid(chunks(s, d), QUERY, VECTOR, 10, filters=Filters(language="python"), leaky=True))
query("hybrid_search_fuzzy")(lambda s, d: search.hybrid(chunks(s, d), "stale tokn wndow", VECTOR, 10, use_fuzzy=True, clicks=read(s, d, "search_clicks"), stats=read(s, d, "query_stats")))
query("multi_codebase_topk", f"""WITH r AS (SELECT id, codebase_id, {_COS} AS score FROM chunks), k AS (SELECT *, row_number() OVER (PARTITION BY codebase_id ORDER BY score DESC, id) AS codebase_rank FROM r QUALIFY codebase_rank <= 3)
    SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM k QUALIFY rank <= 20""")(lambda s, d: search.by_codebase(chunks(s, d), VECTOR, 3, 20))
query("format_results", f"""WITH {_BM25}, f AS ({_fts(10)}) SELECT f.rank, coalesce(n.name, c.codebase_id) AS codebase, c.file_path, c.start_line || '-' || c.end_line AS lines, printf('%.4f', f.score) AS score
    FROM f JOIN chunks c ON c.id = f.id LEFT JOIN (SELECT codebase_id, max(name) AS name FROM codebases GROUP BY 1) n ON n.codebase_id = c.codebase_id""")(
    lambda s, d: search.shown(search.full_text(chunks(s, d), QUERY, 10).join(chunks(s, d).select("id", "codebase_id", "file_path", "start_line", "end_line"), "id"), read(s, d, "codebases"))
)

# ------------------------------------------------------------------ text and chunks
_LINES = r"CASE WHEN {c} = '' THEN []::VARCHAR[] WHEN {c} LIKE '%' || chr(10) THEN string_split(replace({c}, chr(13) || chr(10), chr(10)), chr(10))[:-2] ELSE string_split(replace({c}, chr(13) || chr(10), chr(10)), chr(10)) END"
query("chunk_fixed_overlap", f"""WITH l AS (SELECT doc_id, {_LINES.format(c='text')} AS l FROM documents WHERE text IS NOT NULL),
    k AS (SELECT doc_id, l, unnest(range(0, CASE WHEN len(l) <= 20 THEN 1 ELSE ceil((len(l) - 20) / 15.0)::BIGINT + 1 END)) AS chunk_no FROM l WHERE len(l) > 0)
    SELECT doc_id, chunk_no, chunk_no * 15 + 1 AS start_line, least(chunk_no * 15 + 20, len(l)) AS end_line, substr(sha256(array_to_string(l[chunk_no * 15 + 1:chunk_no * 15 + 20], chr(10))), 1, 16) AS h FROM k""")(
    lambda s, d: chunking.windows(read(s, d, "documents").select("doc_id", "text"), 20, 5, "text").select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "start_line", "end_line", T.sha16("chunk").alias("h"))
)
query("chunk_ids", "SELECT DISTINCT file_path, start_line, end_line, substr(sha256(file_path || ':' || start_line || '-' || end_line), 1, 16) AS chunk_id FROM chunks")(
    lambda s, d: chunks(s, d).select("file_path", "start_line", "end_line").distinct().select("*", T.chunk_id("file_path", "start_line", "end_line").alias("chunk_id"))
)
query("file_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents WHERE text IS NOT NULL")(lambda s, d: read(s, d, "documents").filter("text is not null").select("doc_id", T.sha16("text").alias("hash")))
query("chunk_by_budget")(lambda s, d: chunking.budgeted(chunks(s, d), 128))
query("chunk_by_definition")(lambda s, d: chunking.budgeted(chunks(s, d).withColumn("language", F.lower(F.trim("language"))), 256, definitions=True))
query("line_count", f"SELECT doc_id, len({_LINES.format(c='text')}) AS n FROM documents WHERE text IS NOT NULL")(lambda s, d: read(s, d, "documents").filter("text is not null").select("doc_id", F.size(T.lines_of("text")).cast("long").alias("n")))
query("token_estimate", "SELECT doc_id, strlen(text) // 4 AS tokens FROM documents WHERE text IS NOT NULL")(lambda s, d: read(s, d, "documents").filter("text is not null").select("doc_id", T.token_estimate("text").alias("tokens")))
query("token_budget", """SELECT DISTINCT token_budget, t AS tokens, t * 4 AS chars, t AS overlap_chars FROM (SELECT token_budget, CASE lower(trim(token_budget)) WHEN 'small' THEN 256 WHEN 'medium' THEN 512 WHEN 'large' THEN 1024
    ELSE coalesce(CASE WHEN regexp_full_match(trim(token_budget), '[0-9]{1,9}') THEN trim(token_budget)::BIGINT END, 512) END AS t FROM code_chunks)""")(
    lambda s, d: read(s, d, "code_chunks").select("token_budget").distinct().select("token_budget", T.budget_tokens("token_budget").alias("tokens"), T.budget_chars("token_budget").alias("chars"), T.budget_overlap("token_budget").alias("overlap_chars"))
)
query("term_statistics", r"SELECT term, count(*) AS n, count(DISTINCT id) AS df FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(content, '')), '[\p{L}\p{N}]+')) AS term FROM chunks) GROUP BY 1")(
    lambda s, d: chunks(s, d).select("id", F.explode(T.tokens_of(F.coalesce("content", F.lit("")))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("k")).groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("df"))
)
# said again for the names that occur in the tables, so that the table of the library is checked
_NAMED = {
    "python": ("py",), "rust": ("rs",), "javascript": ("js", "jsx"), "typescript": ("ts", "tsx"), "go": ("go",), "java": ("java",), "json": ("json",), "yaml": ("yaml", "yml"), "toml": ("toml",),
    "shell": ("sh", "bash"), "markdown": ("md",), "pem": ("pem",), "key": ("key",), "ini": ("ini",), "config": ("cfg", "conf"), "sql": ("sql",), "css": ("css",), "html": ("html",),
}
_BY_EXTENSION = "CASE string_split(name, '.')[-1] " + " ".join(f"WHEN '{e}' THEN '{k}'" for k, es in _NAMED.items() for e in es) + " ELSE 'unknown' END"
query("detect_language", f"""SELECT DISTINCT file_path, CASE WHEN name IN ('Cargo.toml', 'Cargo.lock') THEN 'rust' WHEN name IN ('package.json', 'package-lock.json') THEN 'npm' WHEN name IN ('pyproject.toml', 'setup.py', 'requirements.txt') THEN 'python'
        WHEN name IN ('Makefile') THEN 'makefile' WHEN name IN ('Dockerfile') THEN 'dockerfile' WHEN NOT contains(name, '.') OR regexp_full_match(name, '\\.[^.]*') THEN 'unknown' ELSE {_BY_EXTENSION} END AS detected
    FROM (SELECT file_path, string_split(file_path, '/')[-1] AS name FROM chunks)""")(lambda s, d: chunks(s, d).select("file_path").distinct().select("file_path", languages.detect(F.col("file_path")).alias("detected")))
_C = EngineConfig()
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
query("skip_file_predicate", f"""SELECT DISTINCT file_path, list_has_any(parts[:-2], {_LIST(_C.skip_dirs)}) OR list_contains({_LIST(x for x in _C.skip_files if x[0] != "*")}, name) OR {" OR ".join(f"ends_with(name, '{x[1:]}')" for x in _C.skip_files if x[0] == "*")}
        OR (ext <> '' AND NOT list_contains({_LIST(x.lower() for x in _C.extensions)}, '.' || ext)) AS skipped
    FROM (SELECT *, lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) AS ext FROM (SELECT file_path, string_split(file_path, '/') AS parts, string_split(file_path, '/')[-1] AS name FROM chunks WHERE file_path IS NOT NULL))""")(
    lambda s, d: chunks(s, d).filter("file_path is not null").select("file_path").distinct().select("file_path", paths.skipped(F.col("file_path")).alias("skipped"))
)
query("parse_timestamp", "SELECT l_orderkey, l_linenumber, epoch(date_trunc('day', l_shipdate))::BIGINT AS day, epoch(l_shipdate)::BIGINT AS at FROM lineitem")(
    lambda s, d: read(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", T.parse_timestamp(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("day"), T.parse_timestamp(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("at")
    )
)
_DJB2 = "list_reduce(list_prepend(5381::HUGEINT, list_transform(range(1, strlen(codebase_id) + 1), lambda i: ord(codebase_id[i])::HUGEINT)), lambda h, c: (h * 33 + c) % 18446744073709551616)"
query("shard_routing", f"SELECT codebase_id, [(h % 7)::INT, ((h + 1) % 7)::INT] AS shards, true AS merge FROM (SELECT codebase_id, {_DJB2} AS h FROM codebases)")(lambda s, d: sharding.route(read(s, d, "codebases"), 7, 2))
query("shard_of_codebase", f"SELECT codebase_id, h::VARCHAR AS hash, (h % 7)::INT AS shard FROM (SELECT codebase_id, {_DJB2} AS h FROM codebases)")(lambda s, d: read(s, d, "codebases").select("codebase_id", T.djb2("codebase_id").cast("string").alias("hash"), sharding.shard_of(F.col("codebase_id"), 7).alias("shard")))
_SHARDS = f"(SELECT id, codebase_id, {_COS} AS score, row_number() OVER (PARTITION BY codebase_id ORDER BY {_COS} DESC, id) AS rank FROM chunks QUALIFY rank <= 5)"
query("shard_merge", f"SELECT id, round(sum(1.0 / (rank - 1 + 60)), 6) AS score, max(score) AS best FROM {_SHARDS} GROUP BY id ORDER BY 2 DESC, id LIMIT 20")(
    lambda s, d: sharding.merged(search.by_codebase(chunks(s, d), VECTOR, 5, 1 << 30).select("id", "score", F.col("codebase_rank").alias("rank")), 20)
)

# ------------------------------------------------------------------ rewriting
_THESAURUS = "(VALUES " + ", ".join(f"('{t}', '{x}')" for t, xs in rewrite.THESAURUS.items() for x in xs) + ")"
_EXPANDED = f"""t(term, synonym) AS {_THESAURUS}, w AS (SELECT DISTINCT query_text, unnest(string_split_regex(lower(query_text), '\\s+')) AS word FROM query_stats),
    p AS (SELECT term AS word, synonym AS other FROM t UNION SELECT word, term FROM (SELECT DISTINCT word FROM w WHERE word <> '') JOIN t ON contains(synonym, word) OR contains(word, synonym))"""
query("expand_query", f"""WITH {_EXPANDED} SELECT query_text, lower(query_text) AS expansion FROM query_stats UNION SELECT query_text, replace(lower(query_text), word, other) FROM w JOIN p USING (word)""")(
    lambda s, d: rewrite.expanded(read(s, d, "query_stats"), rewrite.thesaurus(s))
)
query("expand_query_fts", f"""WITH t(term, synonym) AS (SELECT DISTINCT * FROM {_THESAURUS}),
    w AS (SELECT DISTINCT query_text, unnest(string_split_regex(lower(query_text), '\\s+')) AS word FROM query_stats), u AS (SELECT query_text, word AS x FROM w UNION SELECT query_text, synonym FROM w JOIN t ON t.term = w.word)
    SELECT query_text, coalesce(string_agg(x, ' OR ' ORDER BY x) FILTER (length(x) > 2), '') AS terms FROM u GROUP BY 1""")(
    lambda s, d: rewrite.expanded_for_text_search(read(s, d, "query_stats"), rewrite.thesaurus(s))
)
query("process_query")(lambda s, d: rewrite.processed(read(s, d, "query_stats"), rewrite.thesaurus(s)))
_TYPED_WORDS = "SELECT DISTINCT unnest(string_split_regex(lower(query_text), '\\s+')) AS word FROM search_clicks"
query("correct_typos", f"""WITH k AS (SELECT DISTINCT n AS term FROM (SELECT unnest(string_split(name, '-')) AS n FROM codebases) WHERE n <> ''), w AS ({_TYPED_WORDS}),
    c AS (SELECT word, term, levenshtein(word, term) AS d FROM w, k WHERE length(word) > 2 AND word NOT IN (SELECT term FROM k) AND levenshtein(word, term) <= 2)
    SELECT w.word, coalesce(b.term, w.word) AS corrected FROM w LEFT JOIN (SELECT word, arg_min(term, (d, term)) AS term FROM c GROUP BY 1) b USING (word) WHERE w.word <> ''""")(
    lambda s, d: rewrite.corrected(
        read(s, d, "search_clicks").select(F.explode(F.split(F.lower("query_text"), r"\s+")).alias("word")).filter("word <> ''").distinct(),
        read(s, d, "codebases").select(F.explode(F.split("name", "-")).alias("term")).filter("term <> ''"),
    )
)
_VARIANTS = ["[query_text]"] + [f"CASE WHEN contains(q, '{a}') THEN [replace(q, '{a}', '{b}')] ELSE [] END" for a, b in rewrite.TYPOS] + [f"CASE WHEN q = '{a}' THEN ['{b}', '{b} {a}'] ELSE [] END" for a, b in rewrite.ACRONYMS]
_VARIANTS += [f"CASE WHEN ends_with(q, '{e}') THEN [q[:-{len(e) + 1}]] ELSE [] END" for e in ("ing", "tion", "er")]
query("fuzzy_variants", f"SELECT query_text, list_sort(list_distinct(flatten([{', '.join(_VARIANTS)}]))) AS variants FROM (SELECT query_text, lower(query_text) AS q FROM query_stats)")(lambda s, d: read(s, d, "query_stats").select("query_text", rewrite.variants(F.col("query_text")).alias("variants")))
query("summary_lines", f"SELECT doc_id, array_to_string(({_LINES.format(c='text')})[:5], chr(10)) AS summary FROM documents WHERE text IS NOT NULL")(lambda s, d: read(s, d, "documents").filter("text is not null").select("doc_id", rewrite.summary_lines(F.col("text")).alias("summary")))

# ------------------------------------------------------------------ enrichment


def _lang():
    return F.lower(F.trim("language"))


_TRIMMED = f"list_transform({_LINES.format(c='content')}, lambda x: trim(x))"
query("extract_imports")(lambda s, d: chunks(s, d).select("id", enrich.imports(F.col("content"), _lang()).alias("imports")))
query("extract_imports_java", f"""SELECT id, list_sort(list_distinct(list_transform(list_filter({_TRIMMED}, lambda x: regexp_matches(x, '^import (?:static )?([^;]+);')), lambda x: regexp_extract(x, '^import (?:static )?([^;]+);', 1)))) AS imports
    FROM chunks WHERE lower(trim(language)) = 'java' AND content IS NOT NULL""")(lambda s, d: chunks(s, d).filter((_lang() == "java") & F.col("content").isNotNull()).select("id", enrich.imports(F.col("content"), _lang()).alias("imports")))
query("extract_signatures")(lambda s, d: chunks(s, d).select("id", enrich.signatures(F.col("content"), _lang()).alias("signatures")))
query("extract_signatures_python", f"""SELECT id, list_transform(list_filter({_TRIMMED}, lambda x: regexp_matches(x, '^((?:async )?def [^:]*)')), lambda x: regexp_extract(x, '^((?:async )?def [^:]*)', 1)) AS signatures
    FROM chunks WHERE lower(trim(language)) = 'python' AND content IS NOT NULL""")(lambda s, d: chunks(s, d).filter((_lang() == "python") & F.col("content").isNotNull()).select("id", enrich.signatures(F.col("content"), _lang()).alias("signatures")))
query("extract_doc_comments")(lambda s, d: chunks(s, d).select("id", enrich.doc_comments(F.col("content"), _lang()).alias("doc_comments")))
query("extract_context")(lambda s, d: chunks(s, d).select("id", enrich.context(F.col("content"), _lang()).alias("context")))
query("extract_types")(lambda s, d: chunks(s, d).select("id", enrich.types(F.col("content"), _lang()).alias("types")))
query("enrich_chunk")(lambda s, d: spread(chunks(s, d).select("id", "content", "language")).select("id", enrich.enriched(F.col("content"), _lang()).alias("meta")))
query("context_string")(lambda s, d: chunks(s, d).select("id", enrich.rendered(F.col("file_path"), _lang(), enrich.enriched(F.col("content"), _lang()), F.col("content")).alias("text")))
query("filter_imports")(lambda s, d: search.filtered(chunks(s, d), None, Filters(imports="worker")).select("id"))

# ------------------------------------------------------------------ graph
_CASES = "".join(f" WHEN lang = '{of}' AND regexp_matches(x, '{p.replace(chr(39), chr(39) * 2)}') THEN struct_pack(k := '{t}', n := regexp_extract(x, '{p.replace(chr(39), chr(39) * 2)}', 1))" for t, of, p in graph.PATTERNS if "(?!" not in p)
_NODES = f"""
    l AS (SELECT codebase_id, file_path, lower(trim(language)) AS lang, coalesce(start_line, 1) AS s, {_LINES.format(c="coalesce(content, '')")} AS l FROM chunks WHERE language IS NOT NULL),
    x AS (SELECT codebase_id, file_path, lang, s + i - 1 AS line_no, trim(l[i]) AS x FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l)),
    e AS (SELECT codebase_id, file_path, lang AS language, line_no, CASE {_CASES} END AS e FROM x),
    nodes AS (SELECT DISTINCT e.k AS node_type, e.n AS name, codebase_id, file_path, line_no, language FROM e WHERE e IS NOT NULL
              UNION SELECT 'Module', file_path, codebase_id, file_path, 1, lower(trim(language)) FROM chunks WHERE language IS NOT NULL AND lower(trim(language)) NOT IN ('rust', 'javascript', 'typescript', 'python', 'go', 'java'))"""
query("graph_nodes", f"WITH {_NODES} SELECT node_type, name, codebase_id, file_path, line_no, language FROM nodes")(lambda s, d: graph.nodes(chunks(s, d)).drop("node_id"))
_GRAPH = f"""{_NODES}, k AS (SELECT *, substr(sha256(concat_ws(':', codebase_id, file_path, node_type, name, line_no::VARCHAR)), 1, 16) AS node_id, substr(sha256(concat_ws(':', codebase_id, file_path)), 1, 16) AS file_id FROM nodes),
    g AS (SELECT file_id AS from_id, node_id AS to_id, 'Contains' AS edge_type FROM k WHERE node_type NOT IN ('Import', 'Module') UNION SELECT i.node_id, k.node_id, 'Imports' FROM
        (SELECT codebase_id, file_path, node_id, unnest(list_distinct(string_split_regex(name, '\\W+'))) AS part FROM k WHERE node_type = 'Import') i JOIN k ON k.codebase_id = i.codebase_id AND k.name = i.part
        WHERE k.node_type NOT IN ('Import', 'Module') AND i.file_path <> k.file_path AND length(part) > 2)"""
_edges = lambda n: graph.contains_edges(n).unionByName(graph.import_edges(n)).distinct()
query("graph_edges", f"WITH {_GRAPH} SELECT DISTINCT from_id, to_id, edge_type FROM g")(lambda s, d: _edges(cut(graph.nodes(chunks(s, d)))))
query("graph_degree", f"""WITH {_GRAPH}, o AS (SELECT from_id AS node_id, count(*) AS out_edges FROM g GROUP BY 1), i AS (SELECT to_id AS node_id, count(*) AS in_edges FROM g GROUP BY 1)
    SELECT node_id, coalesce(out_edges, 0) AS out_edges, coalesce(in_edges, 0) AS in_edges FROM o FULL JOIN i USING (node_id)""")(lambda s, d: graph.degree(_edges(cut(graph.nodes(chunks(s, d))))))
query("graph_incident", f"WITH {_GRAPH}, m AS (SELECT min(to_id) AS x FROM g WHERE edge_type = 'Imports') SELECT from_id, to_id, edge_type FROM g, m WHERE from_id = x OR to_id = x")(
    lambda s, d: (lambda e: graph.incident(e, e.filter("edge_type = 'Imports'").agg(F.min("to_id")).first()[0] or ""))(cut(_edges(cut(graph.nodes(chunks(s, d))))))
)
query("import_edges", f"""WITH {_NODES}, i AS (SELECT DISTINCT codebase_id, file_path AS f1, line_no AS l1, unnest(list_distinct(string_split_regex(name, '\\W+'))) AS name FROM nodes WHERE node_type = 'Import')
    SELECT DISTINCT i.codebase_id, f1, file_path AS f2, i.name FROM i JOIN nodes n ON n.codebase_id = i.codebase_id AND n.name = i.name WHERE n.node_type NOT IN ('Import', 'Module') AND f1 <> file_path AND length(i.name) > 2""")(
    lambda s, d: (
        lambda n: graph.import_edges(n).join(n.select(F.col("node_id").alias("from_id"), "codebase_id", F.col("file_path").alias("f1")), "from_id")
        .join(n.select(F.col("node_id").alias("to_id"), F.col("file_path").alias("f2"), "name"), "to_id").select("codebase_id", "f1", "f2", "name").distinct()
    )(cut(graph.nodes(chunks(s, d))))
)
query("import_edges_theta", f"""WITH {_NODES}, a AS (SELECT DISTINCT name AS import_name FROM nodes WHERE node_type = 'Import'), b AS (SELECT DISTINCT name AS defined_name FROM nodes WHERE node_type <> 'Import' AND name <> '')
    SELECT import_name, defined_name FROM a, b WHERE contains(import_name, defined_name) OR contains(defined_name, import_name)""")(
    lambda s, d: (lambda n: graph.import_edges_by_containment(n.filter("node_type = 'Import'"), n.filter("node_type <> 'Import'")))(cut(graph.nodes(chunks(s, d))))
)
query("file_dependencies", f"WITH {_NODES} SELECT DISTINCT codebase_id, file_path, name AS import FROM nodes WHERE node_type = 'Import'")(lambda s, d: graph.dependencies(graph.nodes(chunks(s, d))))
query("graph_dependents", f"""WITH {_NODES}, i AS (SELECT DISTINCT codebase_id, file_path, name FROM nodes WHERE node_type = 'Import'),
    f AS (SELECT codebase_id, file_path FROM i WHERE (codebase_id, name) IN (SELECT codebase_id, name FROM i GROUP BY ALL HAVING count(*) > 1) ORDER BY 1, 2 LIMIT 1)
    SELECT DISTINCT i.codebase_id, i.file_path FROM i JOIN f ON f.codebase_id = i.codebase_id AND f.file_path <> i.file_path WHERE name IN (SELECT name FROM i JOIN f USING (codebase_id, file_path))""")(lambda s, d: _dependents(cut(graph.nodes(chunks(s, d)))))


def _dependents(n):
    """Of the first file that shares an import with another one."""
    deps = graph.dependencies(n)
    shared = deps.groupBy("codebase_id", "import").agg(F.count("*").alias("n")).filter("n > 1")
    first = deps.join(shared, ["codebase_id", "import"], "left_semi").agg(F.min(F.struct("codebase_id", "file_path"))).first()[0]
    return graph.dependents(n, *(first or ("", "")))


query("graph_bfs", f"""WITH RECURSIVE {_GRAPH}, r(node_id, depth) AS (SELECT DISTINCT x, 0 FROM (SELECT file_id AS x FROM k WHERE codebase_id = '{CODEBASE}' AND node_type NOT IN ('Import', 'Module') UNION SELECT node_id FROM k WHERE codebase_id = '{CODEBASE}' AND node_type = 'Import')
        UNION SELECT g.to_id, r.depth + 1 FROM r JOIN g ON g.from_id = r.node_id WHERE r.depth < 3) SELECT node_id, min(depth) AS depth FROM r GROUP BY 1""")(lambda s, d: _reached(cut(graph.nodes(chunks(s, d)))))


def _reached(n):
    """From the files and imports of one codebase."""
    own = n.filter(F.col("codebase_id") == CODEBASE)
    starts = graph.contains_edges(own).select(F.col("from_id").alias("node_id")).unionByName(own.filter("node_type = 'Import'").select("node_id"))
    return graph.traverse(_edges(n), starts, 3)


query("related_tests", "SELECT DISTINCT codebase_id, file_path FROM chunks WHERE lower(file_path) LIKE '%test%' OR lower(file_path) LIKE '%spec%'")(lambda s, d: graph.related_tests(chunks(s, d)))
query("graph_resources", f"WITH {_NODES} SELECT name, node_type || ' in ' || file_path AS description, node_type FROM nodes WHERE node_type IN ('Module', 'Function', 'Class')")(lambda s, d: graph.resources(graph.nodes(chunks(s, d))).drop("uri"))


def _modified(s, d):
    return [r[0] for r in graph.file_vectors(chunks(s, d).filter(F.col("codebase_id") == CODEBASE)).select("file_path").orderBy("file_path").limit(2).collect()]


_FV = f"SELECT file_path, arg_min(embedding, id) AS e FROM chunks WHERE codebase_id = '{CODEBASE}' AND embedding IS NOT NULL GROUP BY 1"
_SIM = "CASE WHEN len(o.e) = len(q.e) AND list_sum(list_transform(o.e, lambda x: x::DOUBLE * x::DOUBLE)) > 0 AND list_sum(list_transform(q.e, lambda x: x::DOUBLE * x::DOUBLE)) > 0 THEN list_cosine_similarity(o.e::DOUBLE[], q.e::DOUBLE[]) ELSE 0 END"
query("predict_changes", f"""WITH v AS ({_FV}), q AS (SELECT * FROM v ORDER BY file_path LIMIT 2), s AS (SELECT o.file_path, round(max({_SIM}), 6) AS similarity FROM v o, q WHERE o.file_path NOT IN (SELECT file_path FROM q) GROUP BY 1)
    SELECT file_path, similarity, CASE WHEN lower(file_path) LIKE '%test%' OR lower(file_path) LIKE '%spec%' THEN 'LikelyTestChange' ELSE 'LikelyRelatedChange' END AS kind FROM s WHERE similarity > 0.5 ORDER BY similarity DESC, file_path LIMIT 20""")(
    lambda s, d: graph.predicted_changes(chunks(s, d), CODEBASE, _modified(s, d))
)
query("prediction_confidence")(lambda s, d: graph.confidence(graph.predicted_changes(chunks(s, d), CODEBASE, _modified(s, d))))
query("api_change_impact", f"WITH {_BM25}, f AS ({_fts(30)}) SELECT file_path, arg_min(start_line, rank) AS start_line, 0.85::DOUBLE AS confidence FROM f JOIN chunks USING (id) GROUP BY 1")(
    lambda s, d: graph.api_impact(search.full_text(chunks(s, d), QUERY, 30).join(chunks(s, d).select("id", "file_path", "start_line"), "id"))
)

# ------------------------------------------------------------------ sessions and streams
_STEPS = "SELECT user_id, event_type AS query_text, event_id, epoch(ts)::BIGINT AS moment FROM events"
query("sessions", f"""SELECT user_id, session_no, count(*) AS steps FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY moment RANGE UNBOUNDED PRECEDING) AS session_no FROM
    (SELECT user_id, moment, CASE WHEN moment - lag(moment) OVER (PARTITION BY user_id ORDER BY moment) > 1800 THEN 1 ELSE 0 END AS new FROM ({_STEPS}))) GROUP BY ALL""")(
    lambda s, d: sessions.sessionised(read(s, d, "events").select("user_id", F.unix_timestamp("ts").alias("at")).groupBy("user_id", "at").agg(F.count("*").alias("n")), "user_id", "at").groupBy("user_id", "session_no").agg(F.sum("n").alias("steps"))
)


def _steps(s, d):
    log = read(s, d, "events").select("user_id", F.col("event_type").alias("query_text"), "event_id", "value", F.unix_timestamp("ts").alias("at"))
    return sessions.steps(log, ["user_id"], "at", "event_id")


query("session_summary", f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment, event_id) AS n FROM ({_STEPS}))
    SELECT user_id, count(*) AS steps, count(DISTINCT query_text) AS queries, arg_min(query_text, n) AS first_query, arg_max(query_text, n) AS last_query FROM k GROUP BY 1""")(lambda s, d: sessions.summary(_steps(s, d), "user_id"))
_RESULTS = "SELECT query_text AS session_id, chunk_id || '.x' AS file_path, 1.0 / click_rank AS score, click_rank <= 3 AS selected FROM search_clicks"
query("session_relevant_files", f"SELECT session_id, file_path, round(sum(score), 6) AS score FROM ({_RESULTS}) WHERE selected GROUP BY 1, 2")(lambda s, d: sessions.relevant_files(_results(s, d)).withColumn("score", F.round("score", 6)))
query("refined_query", f"""WITH f AS (SELECT session_id, file_path, round(sum(score), 6) AS score FROM ({_RESULTS}) WHERE selected GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, file_path) AS k FROM f QUALIFY k <= 3),
    n AS (SELECT session_id, string_agg(file_path, ' OR ' ORDER BY k) AS x FROM k GROUP BY 1), q AS (SELECT DISTINCT query_text AS session_id FROM search_clicks)
    SELECT session_id, CASE WHEN x IS NULL THEN session_id ELSE session_id || ' in ' || x END AS refined FROM q LEFT JOIN n USING (session_id)""")(
    lambda s, d: sessions.refined_query(
        read(s, d, "search_clicks").select(F.col("query_text").alias("session_id"), "query_text", F.col("id").alias("step_number")), sessions.relevant_files(_results(s, d)).withColumn("score", F.round("score", 6))
    )
)


def _results(s, d):
    c = read(s, d, "search_clicks")
    return c.select(F.col("query_text").alias("session_id"), F.concat(F.col("chunk_id").cast("string"), F.lit(".x")).alias("file_path"), (1.0 / F.col("click_rank")).alias("score"), (F.col("click_rank") <= 3).alias("selected"))


_ONCE = "(SELECT DISTINCT ON (id) * FROM search_clicks ORDER BY id)"
query("stream_click_boosts", f"SELECT query_text, chunk_id, round(avg(1.0 / click_rank), 9) AS boost, count(*) AS clicks FROM {_ONCE} GROUP BY 1, 2")(lambda s, d: feedback.click_boosts(read(s, d, "search_clicks")).withColumn("boost", F.round("boost", 9)))
query("stream_clicks_per_window", f"SELECT clicked_at // 86400 * 86400 AS start, query_text, count(*) AS clicks FROM {_ONCE} GROUP BY 1, 2")(lambda s, d: feedback.clicks_per_window(read(s, d, "search_clicks")))
query("stream_sessions", f"""SELECT query_text, min(clicked_at) AS start, max(clicked_at) + 1800 AS "end", count(*) AS clicks FROM (SELECT *, sum(new) OVER (PARTITION BY query_text ORDER BY clicked_at RANGE UNBOUNDED PRECEDING) AS k FROM
    (SELECT *, CASE WHEN clicked_at - lag(clicked_at) OVER (PARTITION BY query_text ORDER BY clicked_at) >= 1800 THEN 1 ELSE 0 END AS new FROM {_ONCE})) GROUP BY query_text, k""")(lambda s, d: feedback.sessions(read(s, d, "search_clicks")))

"""Full-text, vector and hybrid search over chunks.

A scan scores with built-in expressions only and keeps identifiers and scores; contents are joined to
the few rows that are left.  ``Index`` is for many queries over one collection: postings stored by
term, so that a query reads its own terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.config import EngineConfig
from siftline.errors import BadQuery
from siftline.functions import text as T
from siftline.functions import vectors as V
from siftline.session import cut, spread

DEFAULTS = EngineConfig()
SALTS = 8  # tasks that write one bucket of an index


@dataclass(frozen=True)
class Filters:
    language: str | None = None
    author: str | None = None
    file_type: str | None = None
    after: int | None = None
    imports: str | None = None


def filtered(chunks: DataFrame, codebase: str | None = None, filters: Filters | None = None) -> DataFrame:
    """Rows of a codebase that pass all filters; the file type is compared without case, ``after`` is exclusive."""
    out, f = chunks, filters or Filters()
    if codebase is not None:
        out = out.filter(F.col("codebase_id") == codebase)
    if f.language is not None:
        out = out.filter(F.col("language") == f.language)
    if f.author is not None:
        out = out.filter(F.col("author") == f.author)
    if f.file_type is not None:
        out = out.filter(F.endswith(F.lower("file_path"), F.lit("." + f.file_type.lower().lstrip("."))))
    if f.after is not None:
        out = out.filter(F.col("modified_at") > f.after)
    if f.imports is not None:
        from siftline.operators import enrich

        out = out.filter(F.exists(enrich.imports(F.col("content"), F.lower(F.trim("language"))), lambda x: F.contains(x, F.lit(f.imports))))
    return out


def _bm25(tf: Column, n: Column, docs: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    idf = F.greatest(F.ln((docs - n + 0.5) / (n + 0.5)), F.lit(1e-6))
    return idf * tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * length / mean))


def bm25(chunks: DataFrame, query: str, keep: Column | None = None, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(id, score) of rows with a term of the query; statistics cover all rows, ``keep`` only drops rows afterwards."""
    terms = T.query_terms(query)
    if not terms:
        return chunks.select("id", F.lit(0.0).alias("score")).limit(0)
    kept = keep if keep is not None else F.lit(True)
    low = chunks.select("id", kept.alias("keep"), F.lower(F.coalesce("content", F.lit(""))).alias("lc"), F.lower(F.coalesce("file_path", F.lit(""))).alias("lp"))
    low = spread(low)
    # words are cut out only where a term can be; elsewhere they are only counted
    may = None
    for t in terms:
        here = F.contains("lc", F.lit(t)) | F.contains("lp", F.lit(t))
        may = here if may is None else may | here
    none = F.array().cast("array<string>")
    cut_out = lambda c: F.when(F.col("may"), F.regexp_extract_all(c, F.lit(T.TOKEN), F.lit(0))).otherwise(none)
    words = low.withColumn("may", may).select("id", "keep", cut_out("lc").alias("c"), cut_out("lp").alias("p"), F.when(~F.col("may"), F.regexp_count("lc", F.lit(T.TOKEN)) + F.regexp_count("lp", F.lit(T.TOKEN))).alias("other"))
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    tf = [(count(F.col("c"), t) * config.content_weight + count(F.col("p"), t) * config.path_weight).alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = words.select("id", "keep", F.coalesce("other", F.size("c") + F.size("p")).alias("dl"), *tf)
    stats = rows.agg(F.count("*").cast("double").alias("docs"), F.avg("dl").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).cast("double").alias(f"n{i}") for i in range(len(terms))])
    score = sum((_bm25(F.col(f"tf{i}"), F.col(f"n{i}"), F.col("docs"), F.col("dl"), F.col("mean"), config.k1, config.b) for i in range(len(terms))), F.lit(0.0))
    # the statistics are one row.  A hit is what scores above 0: asked behind the join, as a filter on counts would be
    # pushed down and cut out all words again
    scored = rows.filter("keep").crossJoin(F.broadcast(stats)).select("id", score.alias("score"))
    return scored.filter("score > 0").select("id", T.stable_score(F.col("score")).alias("score"))


def top(scored: DataFrame, limit: int) -> DataFrame:
    """The best rows with their rank from 1; equal scores by id."""
    best = scored.orderBy(F.desc("score"), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))  # at most ``limit`` rows


def normalised(ranked: DataFrame) -> DataFrame:
    """Scores over the list's greatest, if that is positive."""
    most = F.max("score").over(Window.partitionBy())
    return ranked.withColumn("score", F.when(most > 0, F.col("score") / most).otherwise(F.col("score")))


def full_text(chunks: DataFrame, query: str, limit: int = 10, codebase: str | None = None, filters: Filters | None = None, config: EngineConfig = DEFAULTS, index: Index | None = None) -> DataFrame:
    """(id, score, rank): the best rows by BM25, scores over the best one's; read from an index of the same rows where one is given."""
    scored = index.bm25(query, config) if index is not None else bm25(chunks, query, None, config)
    if codebase is None and filters is None:
        return normalised(top(scored, limit))
    allowed = filtered(chunks, codebase, filters).select("id")
    return normalised(top(scored.join(allowed, "id", "left_semi"), limit))


def vector(chunks: DataFrame, embedding: list[float], limit: int = 10, codebase: str | None = None, filters: Filters | None = None, python: bool = False) -> DataFrame:
    """(id, score, rank): the most similar rows by cosine; python=True scores with numpy, faster for long vectors."""
    rows = filtered(chunks, codebase, filters)
    score = V.cosine_to(embedding)(F.col("embedding")) if python else V.cosine(F.col("embedding"), F.array(*[F.lit(float(x)).cast("float") for x in embedding]))
    return top(rows.select("id", T.stable_score(score).alias("score")), limit)


def click_boosts(clicks: DataFrame, query: str) -> DataFrame:
    """(id, boost): the mean of 1 / click_rank of each chunk clicked for the query; a click delivered twice counts once."""
    own = clicks.filter(F.col("query_text") == query).dropDuplicates(["id"])
    return own.groupBy(F.col("chunk_id").alias("id")).agg(F.avg(1.0 / F.col("click_rank")).alias("boost"))


def language_weights(chunks: DataFrame, codebase: str) -> DataFrame:
    """(language, weight): 2 (1 - share) of each language of the codebase."""
    n = filtered(chunks, codebase).filter("language is not null").groupBy("language").agg(F.count("*").alias("n"))
    return n.select("language", (2.0 * (1.0 - F.col("n") / F.sum("n").over(Window.partitionBy()))).alias("weight"))


def popularity(stats: DataFrame, query: str) -> float | None:
    """Share of 100 searches that the query has reached; None if it is unknown."""
    row = stats.filter(F.col("query_text") == query).agg(F.max("search_count")).first()
    return None if row is None or row[0] is None else min(row[0], 100) / 100.0


def popularity_weights(stats: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(query_text, popularity, fts_weight, vector_weight) of each known query: the more popular, the more its vector counts."""
    p = stats.groupBy("query_text").agg((F.least(F.max("search_count"), F.lit(100)) / 100.0).alias("popularity"))
    return p.withColumn("fts_weight", 0.5 * config.fts_weight + 0.5 * (1 - F.col("popularity"))).withColumn("vector_weight", 0.5 * config.vector_weight + 0.5 * F.col("popularity"))


def fused_ranks(ids: DataFrame, k: int = 60) -> DataFrame:
    """(id, rrf): the sum of 1 / (k + rank) over lists (id, rank)."""
    return ids.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def fuzzy(content: Column, query: str, most: int = 2) -> Column:
    """Mean over the query's words: 1 if contained, else 1 - d/3 for the nearest content word within ``most`` edits, else 0."""
    words = query.split()
    if not words:
        return F.lit(0.0)
    low = F.lower(content)
    spread = F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: w != ""))

    def of(word: str) -> Column:
        near = F.filter(spread, lambda w: F.abs(F.length(w) - F.lit(len(word))) <= most)
        d = F.array_min(F.transform(near, lambda w: F.levenshtein(F.lit(word), w)))
        return F.when(F.contains(low, F.lit(word.lower())), 1.0).when(d <= most, 1.0 - d / 3.0).otherwise(0.0)

    return sum((of(w) for w in words), F.lit(0.0)) / float(len(words))


def hybrid(
    chunks: DataFrame, query: str, embedding: list[float], limit: int = 10, codebase: str | None = None, filters: Filters | None = None,
    clicks: DataFrame | None = None, stats: DataFrame | None = None, use_fuzzy: bool = False, config: EngineConfig = DEFAULTS, vector_only: bool = False, leaky: bool = False, index: Index | None = None,
) -> DataFrame:
    """The best chunks by full text and vectors, adjusted by clicks, languages, coverage and spelling.

    Gives id, codebase_id, file_path, start_line, end_line, language, score, rank.  ``leaky`` leaves the filters off
    the vector side.  A blank query gives no rows.
    """
    out = ["id", "codebase_id", "file_path", "start_line", "end_line", "language"]
    if not query.strip():
        return chunks.select(*out, F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("rank")).limit(0)
    wf, wv = (0.0, 1.0) if vector_only else (config.fts_weight, config.vector_weight)
    p = popularity(stats, query) if stats is not None else None
    if p is not None:
        wf, wv = 0.5 * wf + 0.5 * (1 - p), 0.5 * wv + 0.5 * p
    wide = 3 * limit
    if limit < 1:
        raise BadQuery("a search gives at least one row")
    sides = [vector(chunks, embedding, wide, codebase, None if leaky else filters, python=True).withColumn("side", F.lit(1))]
    if not vector_only:
        sides.insert(0, full_text(chunks, query, wide, codebase, filters, config, index).withColumn("side", F.lit(0)))
    both = cut(sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1]))  # at most 6 x limit rows, used three times

    if limit <= 1000:  # the identifiers reach the scan
        shown = chunks.filter(F.col("id").isin([r.id for r in both.select("id").distinct().collect()])).select(*out, "content")
    else:
        shown = chunks.join(both.select("id").distinct(), "id", "left_semi").select(*out, "content")
    rows = both.join(shown, "id")
    score = F.col("score")
    if clicks is not None and config.learn_from_clicks:
        rows = rows.join(click_boosts(clicks, query), "id", "left").fillna(0.0, ["boost"])
        score = score + 0.3 * F.col("boost")
    if codebase is not None:
        rows = rows.join(language_weights(chunks, codebase), "language", "left").fillna(0.0, ["weight"])
        score = score * (1 + 0.2 * F.col("weight"))
    weight = F.when(F.col("side") == 0, F.lit(wf)).otherwise(F.lit(wv))
    scored = rows.withColumn("score", weight * (score + 0.2 * T.coverage(query, F.coalesce("content", F.lit("")))))
    first = scored.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("side"))).filter("_k = 1").drop("_k")
    if use_fuzzy:
        first = first.withColumn("score", F.col("score") + 0.2 * fuzzy(F.coalesce("content", F.lit("")), query, config.fuzzy_max_distance))
    merged = first.drop("rank").join(fused_ranks(both, config.rrf_k), "id")
    final = merged.withColumn("score", T.stable_score(0.7 * F.col("score") + 0.3 * F.col("rrf")))
    return top(final.select(*out, "score"), limit)


def by_codebase(chunks: DataFrame, embedding: list[float], k: int, limit: int) -> DataFrame:
    """The k best of each codebase by cosine, then the best of all."""
    score = T.stable_score(V.cosine(F.col("embedding"), F.array(*[F.lit(float(x)).cast("float") for x in embedding])))
    rows = chunks.select("id", "codebase_id", score.alias("score"))
    own = rows.withColumn("codebase_rank", F.row_number().over(Window.partitionBy("codebase_id").orderBy(F.desc("score"), "id")).cast("long")).filter(F.col("codebase_rank") <= k)
    return top(own, limit)


def shown(results: DataFrame, codebases: DataFrame | None = None) -> DataFrame:
    """Results as text: codebase name (its id where unknown), lines as start-end, score with four digits."""
    rows = results
    name = F.col("codebase_id")
    if codebases is not None:
        names = codebases.groupBy("codebase_id").agg(F.max("name").alias("name"))
        rows = rows.join(names, "codebase_id", "left")
        name = F.coalesce("name", "codebase_id")
    return rows.select("rank", name.alias("codebase"), "file_path", F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("lines"), F.format_string("%.4f", "score").alias("score"))


class Index:
    """Postings with the length of their row, lengths and totals of a collection, stored in a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _counted(self, chunks: DataFrame) -> DataFrame:
        """(id, dl, words) with words (term, w) of content and path; words are cut out once."""
        cut_out = lambda c: T.tokens_of(F.coalesce(c, F.lit("")))
        rows = chunks.select("id", cut_out("content").alias("c"), cut_out("file_path").alias("p"))
        weighed = lambda c, w: F.transform(c, lambda x: F.struct(x.alias("term"), F.lit(w).alias("w")))
        return rows.select("id", (F.size("c") + F.size("p")).alias("dl"), F.concat(weighed(F.col("c"), DEFAULTS.content_weight), weighed(F.col("p"), DEFAULTS.path_weight)).alias("words"))

    def _write(self, postings: DataFrame, lengths: DataFrame, folder: str) -> None:
        # a common term is written by several tasks, each with its own part of the ids
        spread_out = postings.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).repartition("bucket", "_salt").drop("_salt")
        spread_out.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
        self.spark.read.parquet(f"{folder}/lengths").agg(F.count("*").cast("double").alias("docs"), F.avg("dl").alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")

    def _postings(self, counted: DataFrame) -> DataFrame:
        each = counted.select("id", "dl", F.explode("words").alias("x")).groupBy("id", "dl", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("tf"))
        return each.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))

    def build(self, chunks: DataFrame) -> Index:
        counted = self._counted(spread(chunks.select("id", "content", "file_path")))
        self._write(self._postings(counted), counted.select("id", "dl"), self.folder)
        return self

    def updated(self, chunks: DataFrame, changed: DataFrame, folder: str) -> Index:
        """A new index in another folder: postings of ``changed`` ids (id) anew from ``chunks``, all others as they are."""
        fresh = self._counted(chunks.join(changed, "id", "left_semi"))
        old = [self.spark.read.parquet(f"{self.folder}/{t}").join(changed, "id", "left_anti") for t in ("postings", "lengths")]
        new = Index(self.spark, folder.rstrip("/"), self.buckets)
        new._write(old[0].unionByName(self._postings(fresh)), old[1].unionByName(fresh.select("id", "dl")), new.folder)
        return new

    def bm25(self, query: str, config: EngineConfig = DEFAULTS) -> DataFrame:
        """(id, score) as by ``bm25`` over the same rows; reads the buckets of the query's terms only."""
        terms = T.query_terms(query)
        postings, totals = (self.spark.read.parquet(f"{self.folder}/{t}") for t in ("postings", "totals"))
        bucket = F.pmod(F.xxhash64(F.lit("")), F.lit(1)) if not terms else F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int") for t in terms])
        own = postings.filter(F.array_contains(bucket, F.col("bucket")) & F.col("term").isin(terms)) if terms else postings.limit(0)
        n = own.groupBy("term").agg(F.count("*").cast("double").alias("n"))
        rows = own.join(F.broadcast(n), "term").crossJoin(F.broadcast(totals))  # one row a query term; one row
        score = _bm25(F.col("tf"), F.col("n"), F.col("docs"), F.col("dl"), F.col("mean"), config.k1, config.b)
        return rows.groupBy("id").agg(T.stable_score(F.sum(score)).alias("score"))

"""Tables of the collection: counts, codebases, keyed upserts, deletes, click and search statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.errors import CodebaseNotFound

CHUNK_KEY = ["codebase_id", "file_path", "start_line", "end_line"]


def codebase_stats(chunks: DataFrame, codebase: str) -> DataFrame:
    """Chunks and files of one codebase; no row if it has none."""
    own = chunks.filter(F.col("codebase_id") == codebase)
    return own.agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files")).filter("chunks > 0")


def global_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files"), F.count_distinct("codebase_id").alias("codebases")).filter("chunks > 0")


def by_codebase(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("codebase_id").agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files"))


def with_metadata(codebases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every codebase with its counts, zero for those without chunks."""
    counts = by_codebase(chunks)  # aggregated before the join: one row a codebase
    out = codebases.select("codebase_id", "name", "path", "indexed_at", "last_updated", "model", "tags").join(counts, "codebase_id", "left")
    return out.fillna(0, ["chunks", "files"])


def require(codebases: DataFrame, name: str) -> str:
    """The id of the codebase with this id, name or path; an unknown one is an error, of several the least id is taken."""
    found = resolve(codebases, name).agg(F.min("codebase_id")).first()[0]
    if found is None:
        raise CodebaseNotFound(name)
    return found


def resolve(codebases: DataFrame, name: str) -> DataFrame:
    """Codebases whose id, name or path this is."""
    return codebases.filter((F.col("codebase_id") == name) | (F.col("name") == name) | (F.col("path") == name)).select("codebase_id").distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Old rows whose key is not new, and the last new row of each key (by ``order``); missing columns become null."""
    last = new
    if order:
        last = new.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order)))).filter("_k = 1").drop("_k")
    same = [old[k].eqNullSafe(last[k]) for k in keys]
    kept = old.join(last.select(*keys), same, "left_anti")
    return kept.unionByName(last, allowMissingColumns=True)


def without_file(chunks: DataFrame, codebase: str, path: str) -> DataFrame:
    return chunks.filter(~((F.col("codebase_id") == codebase) & (F.col("file_path") == path)) | F.col("codebase_id").isNull() | F.col("file_path").isNull())


def without_codebase(table: DataFrame, codebase: str) -> DataFrame:
    return table.filter((F.col("codebase_id") != codebase) | F.col("codebase_id").isNull())


def first_chunks(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of each file's chunk with the smallest id."""
    least = F.min(F.struct("id", *columns)).alias("m")
    return chunks.groupBy("codebase_id", "file_path").agg(least).select("codebase_id", "file_path", "m.*")


def click_stats(clicks: DataFrame) -> DataFrame:
    """(query_text, search_count, last_searched) as clicks count them: the first opens the row with 1."""
    once = clicks.dropDuplicates(["id"])
    return once.groupBy("query_text").agg(F.count("*").alias("search_count"), F.max("clicked_at").alias("last_searched"))


def search_stats(log: DataFrame) -> DataFrame:
    """(query_text, search_count, last_searched, avg_result_count) of a log (query_text, searched_at, results)."""
    return log.groupBy("query_text").agg(F.count("*").alias("search_count"), F.max("searched_at").alias("last_searched"), F.avg("results").alias("avg_result_count"))


def merged_stats(stats: DataFrame, log: DataFrame) -> DataFrame:
    """Running averages continued: (avg count + sum) / (count + n)."""
    new = search_stats(log).select("query_text", F.col("search_count").alias("n"), F.col("last_searched").alias("t"), F.col("avg_result_count").alias("m"))
    both = stats.select("query_text", "search_count", "last_searched", "avg_result_count").join(new, "query_text", "full_outer")
    a, n = F.coalesce("search_count", F.lit(0)), F.coalesce("n", F.lit(0))
    mean = (F.coalesce(F.col("avg_result_count") * a, F.lit(0.0)) + F.coalesce(F.col("m") * n, F.lit(0.0))) / (a + n)
    return both.select("query_text", (a + n).alias("search_count"), F.greatest("last_searched", "t").alias("last_searched"), mean.alias("avg_result_count"))


def cache_stats(lookups: DataFrame) -> DataFrame:
    """(hits, misses, hit_rate) of a log (hit boolean)."""
    hits = F.count_if("hit")
    return lookups.agg(hits.alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(F.try_divide(hits, F.count("hit")), F.lit(0.0)).alias("hit_rate"))


def manifest_diff(current: DataFrame, saved: DataFrame, keys: list[str], digest: str = "hash") -> DataFrame:
    """(keys, change): added, modified or removed."""
    a, b = current.select(*keys, F.col(digest).alias("_a")).dropDuplicates(keys), saved.select(*keys, F.col(digest).alias("_b")).dropDuplicates(keys)
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("change")).filter("change is not null")


def recorded_clicks(clicks: DataFrame, stats: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clicks, query statistics) with new clicks (query_text, chunk_id, click_rank, clicked_at, codebase_id) appended and counted.

    New rows are numbered on from the greatest id, in the order of time; a query's first click opens its statistics with an
    average of 0 results. Clicks with a null query or chunk are left out.
    """
    ok = new.filter("query_text is not null and chunk_id is not null")
    last = clicks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
    order = ["clicked_at", "query_text", "chunk_id", "click_rank"]
    # numbers within days, on top of the days before: no day is more than its own task's work
    day = ok.withColumn("_day", F.coalesce(F.floor(F.col("clicked_at") / 86400), F.lit(-1)))
    before = day.groupBy("_day").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = day.join(before.select("_day", "_before"), "_day").withColumn("_k", F.row_number().over(Window.partitionBy("_day").orderBy(*order)))
    numbered = placed.crossJoin(F.broadcast(last)).withColumn("id", F.col("_last") + F.col("_before") + F.col("_k"))
    added = numbered.select(*(F.col(c) for c in clicks.columns))
    counted = ok.groupBy("query_text").agg(F.count("*").alias("_c"), F.max("clicked_at").alias("_t"))
    both = stats.join(counted, "query_text", "full_outer")
    now = both.select(
        "query_text", (F.coalesce("search_count", F.lit(0)) + F.coalesce("_c", F.lit(0))).alias("search_count"),
        F.coalesce("_t", "last_searched").alias("last_searched"), F.coalesce("avg_result_count", F.lit(0.0)).alias("avg_result_count"),
    )
    return clicks.unionByName(added), now


def codebase_paths(codebases: DataFrame) -> DataFrame:
    """(codebase_id, path), each once; without a path the id stands for it."""
    return codebases.groupBy("codebase_id").agg(F.max("path").alias("path")).select("codebase_id", F.coalesce("path", "codebase_id").alias("path"))


def indexing_stats(changes: DataFrame, chunks: DataFrame | None = None, seconds: float | None = None) -> DataFrame:
    """One row (added, modified, removed, unchanged, chunks, seconds) of changes (change; null for unchanged files)."""
    of = lambda k: F.count_if(F.col("change") == k).alias(k)
    counts = changes.agg(of("added"), of("modified"), of("removed"), F.count_if(F.col("change").isNull()).alias("unchanged"))
    made = F.lit(0).cast("long") if chunks is None else None
    out = counts.withColumn("chunks", made) if made is not None else counts.crossJoin(chunks.agg(F.count("*").alias("chunks")))
    return out.withColumn("seconds", F.lit(seconds).cast("double"))

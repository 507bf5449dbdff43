"""A stored collection: index trees of files, search them, record what was used.

Each table of each codebase lies in version folders; a version counts once it is complete, so readers never see
half a write, and a run that breaks off leaves the last version in force.  Chunks come before the manifest: what
the manifest does not say is indexed again.  One writer at a time.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.cache import QueryCache
from siftline.config import EngineConfig
from siftline.errors import BadQuery, CodebaseNotFound, NotIndexed, UnreadableFile
from siftline.functions import vectors as V
from siftline.operators import catalog, chunking, embeddings, search
from siftline.sources import files as sources

CHUNKS = "id long, codebase_id string, file_path string, start_line long, end_line long, content string, language string, hash string, embedding array<float>, author string, created_at long, modified_at long"
CODEBASES = "codebase_id string, name string, path string, indexed_at long, last_updated long, model string, tags string"
CLICKS = "id long, query_text string, chunk_id long, click_rank long, clicked_at long, codebase_id string"
STATS = "query_text string, search_count long, last_searched long, avg_result_count double"
MANIFEST = "path string, hash string"


class Collection:
    """Tables below a folder of any file system that Spark can write.

    ``encoder`` makes the vectors in place of hashing (see ``embeddings``); ``authors`` (file_path, author,
    created_at) may say who wrote what.
    """

    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig | None = None, encoder=None):
        self.spark, self.folder, self.config, self.encoder = spark, folder.rstrip("/"), config or EngineConfig(), encoder
        self.cache = QueryCache()

    # ------------------------------------------------------------------ tables
    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self, table: str) -> list[int]:
        fs, path = self._fs()
        at = path(f"{self.folder}/{table}")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{self.folder}/{table}/{n}/_SUCCESS")))

    def table(self, table: str, schema: str) -> DataFrame:
        """The current rows; none where the table was never written, null in columns that came later."""
        found = self._versions(table)
        empty = self.spark.createDataFrame([], schema)
        if not found:
            return empty
        return empty.unionByName(self.spark.read.parquet(f"{self.folder}/{table}/v={found[-1]}"), allowMissingColumns=True).select(*empty.columns)

    def _write(self, rows: DataFrame, table: str) -> None:
        fs, path = self._fs()
        found = self._versions(table)
        number = found[-1] + 1 if found else 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/v={number}")
        for old in found[:-1]:  # the last one may still be read
            fs.delete(path(f"{self.folder}/{table}/v={old}"), True)

    def codebases(self) -> DataFrame:
        return self.table("codebases", CODEBASES)

    def chunks(self, codebase: str | None = None) -> DataFrame:
        """The chunks of one codebase, or of all."""
        if codebase is not None:
            return self.table(f"chunks/{codebase}", CHUNKS)
        rows = self.spark.createDataFrame([], CHUNKS)
        for r in self.codebases().select("codebase_id").collect():  # one row a codebase
            rows = rows.unionByName(self.table(f"chunks/{r.codebase_id}", CHUNKS))
        return rows

    def resolve(self, name: str) -> str:
        """The id of a codebase by id, name or path; unknown ones are an error."""
        if not self._versions("codebases"):
            raise NotIndexed(self.folder)
        return catalog.require(self.codebases(), name)

    # ------------------------------------------------------------------ indexing
    def index(self, root: str, name: str | None = None, model: str | None = None, tags: str | None = None, force: bool = False, ignore: bool = True, authors: DataFrame | None = None) -> dict:
        """Index a tree; only files whose hash is new or changed are cut and embedded, unless ``force``. Gives the run's statistics."""
        began = time.time()
        fs, path = self._fs()
        root = root.rstrip("/") or "/"
        if not fs.exists(path(root)):
            raise UnreadableFile(root)
        codebase = hashlib.sha256(root.encode()).hexdigest()[:16]
        kind = embeddings.model_of(model or self.config.model)
        seen = sources.texts(sources.scan(self.spark, root, ignore))
        saved = self.table(f"manifest/{codebase}", MANIFEST)
        saved = saved.limit(0) if force else saved
        now = seen.select(F.col("file_path").alias("path"), "hash")
        changes = now.join(catalog.manifest_diff(now, saved, ["path"]), "path", "full_outer").select("path", "hash", "change")
        self._write(changes, f"changes/{codebase}")  # what this run goes by, whatever happens to the tree meanwhile
        changes = self.table(f"changes/{codebase}", "path string, hash string, change string")
        stats = catalog.indexing_stats(changes).first().asDict()

        if stats["added"] + stats["modified"] + stats["removed"]:
            todo = changes.filter("change in ('added', 'modified')").select(F.col("path").alias("file_path"), "hash")
            texts = seen.join(todo, ["file_path", "hash"])  # a file that changed since then waits for the next run
            pieces = chunking.windows(texts, self.config.chunk_size, self.config.chunk_overlap)
            if authors is not None:
                pieces = pieces.join(authors.select("file_path", "author", "created_at").dropDuplicates(["file_path"]), "file_path", "left")
            for c, t in (("author", "string"), ("created_at", "long")):
                if c not in pieces.columns:
                    pieces = pieces.withColumn(c, F.lit(None).cast(t))
            key = F.xxhash64(F.lit(codebase), "file_path", "start_line", "end_line")
            rows = pieces.select(
                F.shiftrightunsigned(key, 1).alias("id"), F.lit(codebase).alias("codebase_id"), "file_path", "start_line", "end_line", F.col("chunk").alias("content"),
                "language", "hash", "author", "created_at", "modified_at",
            )
            rows = embeddings.embedded(rows, "content", kind, encoder=self.encoder, batch=self.config.batch_size)
            old = self.chunks(codebase).join(changes.filter("change is not null").select(F.col("path").alias("file_path")), "file_path", "left_anti")
            if force:
                old = old.limit(0)
            order = self.spark.createDataFrame([], CHUNKS).columns
            self._write(old.select(*order).unionByName(rows.select(*order)), f"chunks/{codebase}")
            done = self.chunks(codebase).select(F.col("file_path").alias("path"), "hash").distinct()
            self._write(done, f"manifest/{codebase}")
        self._register(codebase, name or root.rsplit("/", 1)[-1], root, kind.name, tags)
        self.cache.invalidate()
        return stats | {"codebase_id": codebase, "chunks": self.chunks(codebase).count(), "seconds": round(time.time() - began, 3)}

    def _register(self, codebase: str, name: str, path: str, model: str, tags: str | None) -> None:
        now = int(time.time())
        known = self.codebases().filter(F.col("codebase_id") == codebase).agg(F.min("indexed_at")).first()[0]
        row = self.spark.createDataFrame([(codebase, name, path, known if known is not None else now, now, model, tags)], CODEBASES)
        self._write(catalog.upsert(self.codebases(), row, ["codebase_id"]).coalesce(1), "codebases")

    # ------------------------------------------------------------------ searching
    def search(
        self, query: str, codebase: str | None = None, limit: int | None = None, filters: search.Filters | None = None, vector_only: bool = False,
        use_fuzzy: bool | None = None, learn: bool = True, record: bool = True,
    ) -> list[dict]:
        """The best chunks as rows (rank, codebase, file_path, lines, score, id); a blank query gives none, an unknown codebase is an error."""
        limit = self.config.limit if limit is None else limit
        if limit < 1:
            raise BadQuery("a search gives at least one row")
        if not query.strip():
            return []
        own = self.resolve(codebase) if codebase is not None else None
        if own is None and not self._versions("codebases"):
            raise NotIndexed(self.folder)
        key = f"{query}\x00{limit}\x00{filters}\x00{vector_only}\x00{use_fuzzy}\x00{learn}"

        def find() -> list[dict]:
            rows = self.chunks(own)
            name = self.codebases().filter(F.col("codebase_id") == own).select("model").first()[0] if own else self.config.model
            clicks, stats = (self.table("search_clicks", CLICKS), self.table("query_stats", STATS)) if learn else (None, None)
            found = search.hybrid(rows, query, self.vector(query, name), limit, own, filters, clicks, stats, self.config.fuzzy if use_fuzzy is None else use_fuzzy, self.config, vector_only)
            text = search.shown(found, self.codebases()).join(found.select("rank", "id"), "rank").orderBy("rank")
            return [r.asDict() for r in text.collect()]  # at most ``limit`` rows

        answer = self.cache.get_or(key, find, own)
        if record:
            self.record_search(query, len(answer))
        return answer

    def vector(self, query: str, model: str | None = None) -> list[float]:
        kind = embeddings.model_of(model or self.config.model)
        if self.encoder is None:
            return V.hash_vector(query, kind.dim, kind.query_prefix)
        return [float(x) for x in embeddings.normalised(self.encoder()([kind.query_prefix + query]))[0]]

    # ------------------------------------------------------------------ what was used
    def click(self, query: str, chunk: int, rank: int, codebase: str | None = None) -> None:
        """Append a click and count it; later searches learn from it."""
        if not query.strip() or rank < 1:
            raise BadQuery("a click needs a query and a rank from 1")
        new = self.spark.createDataFrame([(query, chunk, rank, int(time.time()), self.resolve(codebase) if codebase else None)], "query_text string, chunk_id long, click_rank long, clicked_at long, codebase_id string")
        clicks, stats = catalog.recorded_clicks(self.table("search_clicks", CLICKS), self.table("query_stats", STATS), new)
        self._write(clicks, "search_clicks")
        self._write(stats, "query_stats")
        self.cache.invalidate()

    def record_search(self, query: str, results: int) -> None:
        log = self.spark.createDataFrame([(query, int(time.time()), results)], "query_text string, searched_at long, results long")
        self._write(catalog.merged_stats(self.table("query_stats", STATS), log).coalesce(1), "query_stats")

    def status(self) -> DataFrame:
        """Every codebase with its counts, by name."""
        return catalog.with_metadata(self.codebases(), self.chunks()).orderBy("name", "codebase_id")

    def delete(self, name: str) -> int:
        """Remove a codebase; gives the number of chunks it had."""
        own = self.resolve(name)
        n = self.chunks(own).count()
        self._write(self.codebases().filter(F.col("codebase_id") != own).coalesce(1), "codebases")
        fs, path = self._fs()
        for table in ("chunks", "manifest", "changes"):
            fs.delete(path(f"{self.folder}/{table}/{own}"), True)
        self.cache.invalidate()
        return n

    def reset(self) -> None:
        """Remove everything."""
        fs, path = self._fs()
        fs.delete(path(self.folder), True)
        self.cache.invalidate()


__all__ = ["CodebaseNotFound", "Collection"]

"""Click feedback and search statistics kept up to date from streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(clicks: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Clicks with an event time ``at``, each id once within the watermark."""
    timed = clicks.withColumn("at", F.timestamp_seconds("clicked_at"))
    if not timed.isStreaming:
        return timed.dropDuplicates(["id"])
    return timed.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["id"])


def click_boosts(clicks: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(query_text, chunk_id, boost, clicks), for output mode update or complete."""
    return once(clicks, lateness).groupBy("query_text", "chunk_id").agg(F.avg(1.0 / F.col("click_rank")).alias("boost"), F.count("*").alias("clicks"))


def clicks_per_window(clicks: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """(start, query_text, clicks) per tumbling window."""
    return once(clicks, lateness).groupBy(F.window("at", width), "query_text").agg(F.count("*").alias("clicks")).select(F.unix_timestamp("window.start").alias("start"), "query_text", "clicks")


def sessions(clicks: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """(query_text, start, end, clicks) per session of a query."""
    return once(clicks, lateness).groupBy(F.session_window("at", gap), "query_text").agg(F.count("*").alias("clicks")).select("query_text", F.unix_timestamp("session_window.start").alias("start"), F.unix_timestamp("session_window.end").alias("end"), "clicks")


def keep(stream: DataFrame, folder: str, checkpoint: str, name: str):
    """Write each batch of updated rows as its own folder; a batch written again replaces itself."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).queryName(name)

"""Structured Streaming forms of ingest, request handling, counts, sessions and latest values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_documents(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """(doc_path, text) of text files as they arrive."""
    files = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_path"), F.col("value").alias("text"))


def ingest(stream: DataFrame, build: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame], good: str, failed: str, checkpoint: str):
    """Starts a query that runs ``build`` on each batch and appends rows that ``check`` marks in ``ok`` to one folder, others to another.

    A batch is written under its number, so a batch that runs again replaces what it wrote.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = check(build(batch)).persist()
        rows.filter("ok").drop("ok").write.mode("overwrite").parquet(f"{good}/batch={number}")
        rows.filter("NOT ok").drop("ok").write.mode("overwrite").parquet(f"{failed}/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_requests(requests: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(request_id, fingerprint, ts, …): a request of the same id and fingerprint counts once within the watermark."""
    deduped = requests.withWatermark("ts", lateness)
    return deduped.dropDuplicatesWithinWatermark(["request_id", "fingerprint"]) if requests.isStreaming else deduped.dropDuplicates(["request_id", "fingerprint"])


def conflicting_requests(requests: DataFrame) -> DataFrame:
    """Request ids that come with different fingerprints (batch)."""
    return requests.groupBy("request_id").agg(F.countDistinct("fingerprint").alias("fingerprints")).filter("fingerprints > 1")


def windowed_counts(events: DataFrame, key: str, window: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """(key, start, n, keys): events of each key and window; events later than the watermark are dropped from a stream."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.withWatermark("ts", lateness).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of a key's events without a longer pause than the gap."""
    out = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key; older results are ignored whenever they arrive."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("v")).select(key, "v.*")

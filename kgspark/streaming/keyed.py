"""Stream operators with state per key: distinct projects of an entity, outcomes of requests, newest results.

Each keeps its state in RocksDB through ``transformWithState``, in the stream's checkpoint folder, so it goes on
after a restart where it stopped. Rows older than the watermark are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of a key that very many rows share.
PARTS = 16


def use_keyed_state(spark: SparkSession) -> None:
    """Streams that start from now on in this session keep their state in RocksDB, which state per key needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _millis(ts: datetime) -> float:
    return (ts if ts.tzinfo else ts.astimezone(timezone.utc)).timestamp() * 1000


class _DistinctProjects(StatefulProcessor):
    """The projects seen for a key; says their number when it grows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "project string", "one int")
        self.total = handle.getValueState("total", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.total.get()[0] if self.total.exists() else 0
        n, late = before, timerValues.getCurrentWatermarkInMs()
        for project in sorted({r["project_id"] for r in rows if r["project_id"] is not None and _millis(r["ts"]) >= late}):
            if not self.seen.containsKey((project,)):
                self.seen.updateValue((project,), (1,))
                n += 1
        if n > before:
            self.total.update((n,))
            yield Row(entity_id=key[0], part=key[1], projects=n)

    def close(self) -> None:
        pass


def mention_counts(mentions: DataFrame, lateness: str = "10 minutes", parts: int = PARTS) -> DataFrame:
    """(entity_id, part, projects) in update mode from a stream (entity_id, project_id, ts): distinct projects so far.

    An entity's projects are dealt into parts by hash, so one entity may hold most rows; ``mention_totals`` adds its
    parts. Mentions behind the watermark are not counted.
    """
    keyed = mentions.withWatermark("ts", lateness).filter("entity_id IS NOT NULL AND ts IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("project_id"), F.lit(parts)).cast("int"))
    use_keyed_state(mentions.sparkSession)
    return keyed.groupBy("entity_id", "part").transformWithState(_DistinctProjects(), "entity_id string, part int, projects long", "Update", "EventTime")


def mention_totals(updates: DataFrame) -> DataFrame:
    """(entity_id, projects) from all updates written so far: counts of a part only grow, the largest is the newest."""
    newest = updates.groupBy("entity_id", "part").agg(F.max("projects").alias("projects"))
    return newest.groupBy("entity_id").agg(F.sum("projects").alias("projects"))


class _Requests(StatefulProcessor):
    """The fingerprint of a request id until its time is over; other fingerprints are conflicts."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "fingerprint string, until double")
        self.told = handle.getMapState("told", "fingerprint string", "one int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        late = timerValues.getCurrentWatermarkInMs()
        for at, fingerprint in sorted((_millis(r["ts"]), r["fingerprint"] or "") for r in rows):
            if at < late:
                continue
            if not self.first.exists():
                self.first.update((fingerprint, at + self.keep_ms))
                self.handle.registerTimer(int(at + self.keep_ms))
                yield Row(request_id=key[0], fingerprint=fingerprint, outcome="accepted")
            elif fingerprint != self.first.get()[0] and not self.told.containsKey((fingerprint,)):
                self.told.updateValue((fingerprint,), (1,))
                yield Row(request_id=key[0], fingerprint=fingerprint, outcome="conflict")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        self.told.clear()
        yield from ()

    def close(self) -> None:
        pass


def request_outcomes(requests: DataFrame, lateness: str = "10 minutes", keep_seconds: int = 3600) -> DataFrame:
    """(request_id, fingerprint, outcome) in append mode from a stream (request_id, fingerprint, ts).

    The first request of an id is accepted; the same fingerprint again says nothing; another one is a conflict, told once. An id is
    forgotten when the watermark has passed its first request by ``keep_seconds``. Null fingerprints are empty ones.
    """
    use_keyed_state(requests.sparkSession)
    keyed = requests.withWatermark("ts", lateness).filter("request_id IS NOT NULL AND ts IS NOT NULL")
    return keyed.groupBy("request_id").transformWithState(_Requests(keep_seconds * 1000), "request_id string, fingerprint string, outcome string", "Append", "EventTime")


class _Newest(StatefulProcessor):
    """The highest sequence number of a scope."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "seq long, result string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seq, result = max(((r["seq"], r["result"] or "") for r in rows), default=(None, None))
        if seq is not None and (not self.best.exists() or (seq, result) > tuple(self.best.get())):
            self.best.update((seq, result))
            yield Row(scope=key[0], seq=seq, result=result)

    def close(self) -> None:
        pass


def newest_results(results: DataFrame) -> DataFrame:
    """(scope, seq, result) in update mode from a stream of the same columns: a result is passed on only if no newer one came before."""
    use_keyed_state(results.sparkSession)
    rows = results.filter("scope IS NOT NULL AND seq IS NOT NULL").select("scope", "seq", "result")
    return rows.groupBy("scope").transformWithState(_Newest(), "scope string, seq long, result string", "Update", "None")


def run_to_end(stream: DataFrame, mode: str, folder: str, checkpoint: str, seconds: int = 600) -> None:
    """Runs a stream over all that is there; a batch is written under its number, so one that runs again replaces its rows."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = stream.writeStream.foreachBatch(one).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream did not end within {seconds} s")

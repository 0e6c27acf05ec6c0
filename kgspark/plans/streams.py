"""Registered stream operators in batch form over the event table (the same code runs on a stream), and bundle round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kgspark.sources.scratch import new_folder, shared_folder
from kgspark.registry import register
from kgspark.sources import files as S
from kgspark.sources.graph import ORDER_SQL, order_graph, read_table
from kgspark.streaming import keyed as K
from kgspark.streaming import streams as X

HERE = __name__


def _events(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@register("windowed_counts", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL", HERE)
def windowed_counts(spark, sf_dir):
    return X.windowed_counts(_events(spark, sf_dir), "event_type", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register(
    "sliding_counts",
    """SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS start, count(*) AS n FROM events, range(2) r(i) GROUP BY ALL""", HERE,
)
def sliding_counts(spark, sf_dir):
    return X.windowed_counts(_events(spark, sf_dir), "event_type", "1 hour", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register(
    "sessions",
    """WITH m AS (SELECT user_id, ts, (ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM m)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""", HERE,
)
def sessions(spark, sf_dir):
    out = X.sessions(_events(spark, sf_dir), "user_id", "30 minutes")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@register("latest_per_key", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id", HERE)
def latest(spark, sf_dir):
    return X.latest_per_key(_events(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@register("dedupe_requests", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)", HERE)
def dedupe(spark, sf_dir):
    return X.dedupe_requests(_events(spark, sf_dir).select(F.col("user_id").alias("request_id"), F.col("event_type").alias("fingerprint"), "ts")).agg(F.count("*").alias("n"))


@register("conflicting_requests", "SELECT user_id AS request_id, count(DISTINCT event_type) AS fingerprints FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1", HERE)
def conflicts(spark, sf_dir):
    return X.conflicting_requests(_events(spark, sf_dir).select(F.col("user_id").alias("request_id"), F.col("event_type").alias("fingerprint")))


def _event_stream(spark, sf_dir):
    """The event table as a stream of its files."""
    path = f"{sf_dir}/events.parquet"
    files = spark.read.parquet(path)
    e = spark.readStream.schema(files.schema).parquet(path) if len(files.inputFiles()) > 1 else spark.readStream.schema(files.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("user_id"), "event_type")


def _streamed(spark, stream, mode):
    """What a stream writes over all files that are there."""
    folder = new_folder(spark, "stream")
    K.run_to_end(stream, mode, f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


@register("mention_counts", "SELECT user_id::VARCHAR AS entity_id, count(DISTINCT event_type) AS projects FROM events GROUP BY 1", HERE)
def mention_counts(spark, sf_dir):
    """Event types as projects of users, counted by a stream with state per key."""
    mentions = _event_stream(spark, sf_dir).select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("project_id"), "ts")
    return K.mention_totals(_streamed(spark, K.mention_counts(mentions, "3650 days", 2), "update"))


@register(
    "request_outcomes",
    """WITH f AS (SELECT user_id::VARCHAR AS request_id, arg_min(event_type, (ts, event_type)) AS first FROM events GROUP BY 1)
    SELECT DISTINCT request_id, event_type AS fingerprint, CASE WHEN event_type = first THEN 'accepted' ELSE 'conflict' END AS outcome FROM events JOIN f ON request_id = user_id::VARCHAR""", HERE,
)
def request_outcomes(spark, sf_dir):
    """Users as request ids, event types as fingerprints, from a stream."""
    requests = _event_stream(spark, sf_dir).select(F.col("user_id").alias("request_id"), F.col("event_type").alias("fingerprint"), "ts")
    return _streamed(spark, K.request_outcomes(requests, "3650 days", 10 * 365 * 86400), "append").drop("batch")


@register("newest_results", "SELECT user_id::VARCHAR AS scope, max(event_id)::BIGINT AS seq, arg_max(event_type, event_id) AS result FROM events GROUP BY 1", HERE)
def newest_results(spark, sf_dir):
    """The newest event of each user, from a stream that ignores older ones."""
    results = _event_stream(spark, sf_dir).select(F.col("user_id").alias("scope"), F.col("event_id").cast("long").alias("seq"), F.col("event_type").alias("result"))
    return X.latest_per_key(_streamed(spark, K.newest_results(results), "update").drop("batch"), "scope", ["seq"]).select("scope", "seq", "result")


@register("conversation_projects", "SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS n_chars, arg_min(role, turn) AS opened_by FROM conversations GROUP BY 1", HERE)
def conversations(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.min_by("role", "turn").alias("opened_by"))


@register("bundle_round_trip", ORDER_SQL + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", true AS ok, count(*) AS n FROM {t}" for t in S.TABLES), HERE)
def bundle(spark, sf_dir):
    """Writes the graph as a portable bundle, reads it back and compares."""
    folder = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    S.write_bundle(order_graph(spark, sf_dir), folder)
    g, report = S.read_bundle(spark, folder)
    counts = None
    for name in S.TABLES:
        row = getattr(g, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        counts = row if counts is None else counts.unionByName(row)
    return report.join(counts, "table")

"""Connected components of an edge list, by alternating large-star and small-star steps.

Each round is a few joins and partial aggregates over the edges that are left; no node's neighbours are
ever gathered in one row. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.sources.scratch import drop, write_out


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return (row[0], row[1])


def connected_components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(a, b) edges -> (id, component): every node that has an edge and the least node it reaches.

    Edges with a null end and loops are left out; an edge may come in either direction and repeatedly. It runs
    to the end, or for ``most_rounds`` rounds, after which components may still be parts of the whole ones.
    """
    now = write_out(
        edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before, rounds = _state(now), 0
    while before[0] and (most_rounds is None or rounds < most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = write_out(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, write_out(moved.filter("a <> b").unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop(old, large)
        after, rounds = _state(now), rounds + 1
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))

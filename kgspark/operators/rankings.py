"""Rankings, importance and view ordering. Every top-k has a total order: value, then name, then id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("page_rank", "betweenness", "degree", "project_count")
#: Weights of the composite importance, by metric.
WEIGHTS = {"page_rank": 0.35, "betweenness": 0.25, "degree": 0.20, "project_count": 0.20}
#: Percentile breakpoints of the size levels and the radius of each level.
BREAKPOINTS, RADII = (20, 40, 60, 80, 95), (4, 6, 8, 11, 15, 20)
MAGNITUDES = ("foundational", "significant", "marginal")


def importance_ranking(metrics: DataFrame, metric: str = "page_rank", k: int = 20) -> DataFrame:
    """The k best entities by a metric; an unknown metric means page rank."""
    metric = metric if metric in metrics.columns else "page_rank"
    return metrics.orderBy(F.desc_nulls_last(metric), "name", "entity_id").limit(k)


def top_per_group(df: DataFrame, group: str | list[str], metric: str, n: int, ties: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """The n best rows of each group, with their rank."""
    keys = [group] if isinstance(group, str) else group
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(metric), *ties)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


#: Ranges of a running sum over all values.
RANGES = 256


def value_counts_upto(df: DataFrame, value: str) -> DataFrame:
    """(value, below, upto, n): rows strictly below and up to each distinct value.

    The running sum goes over distinct values in ranges between approximate quantiles of them: each range is summed on its own and starts from the
    sums of the ranges before it, so no task sees all values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    bounds = counts.agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)]).alias("bounds"))
    part = F.size(F.filter("bounds", lambda b: b <= F.col(value)))
    parted = counts.crossJoin(F.broadcast(bounds)).withColumn("part", part).drop("bounds")  # one row
    totals = parted.groupBy("part").agg(F.sum("c").alias("t"))
    before = totals.withColumn("start", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = F.sum("t").over(Window.partitionBy())
    before = before.withColumn("n", n).select("part", "start", "n")
    inside = F.sum("c").over(Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        parted.withColumn("_inside", inside)
        .join(F.broadcast(before), "part")  # at most RANGES rows
        .select(value, (F.col("start") + F.col("_inside") - F.col("c")).alias("below"), (F.col("start") + F.col("_inside")).alias("upto"), "n")
    )


def composite_importance(nodes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds importance_raw, importance (percentile 0 to 100, ties share the upper rank).

    Metrics are scaled by their range; project_count by (x - 1) / (max - 1). A range of zero counts as 1 wide.
    """
    weights = weights or WEIGHTS
    used = {m: w for m, w in weights.items() if m in nodes.columns}
    ranges = nodes.agg(*[F.min(m).cast("double").alias(f"_lo_{m}") for m in used], *[F.max(m).cast("double").alias(f"_hi_{m}") for m in used])

    def scaled(m: str) -> Column:
        low = F.lit(1.0) if m == "project_count" else F.col(f"_lo_{m}")
        width = F.col(f"_hi_{m}") - low
        return (F.coalesce(F.col(m).cast("double"), F.lit(0.0)) - low) / F.when(width == 0, F.lit(1.0)).otherwise(width)

    raw = F.round(sum((F.lit(w) * scaled(m) for m, w in used.items()), F.lit(0.0)), 9)
    out = nodes.crossJoin(F.broadcast(ranges)).withColumn("importance_raw", raw)  # one row
    out = out.drop(*[c for c in out.columns if c.startswith(("_lo_", "_hi_"))])
    ranks = value_counts_upto(out, "importance_raw").select("importance_raw", F.floor(100.0 * F.col("upto") / F.col("n") + 0.5).cast("long").alias("importance"))
    return out.join(ranks, "importance_raw")


def size_level(percentile: Column) -> Column:
    """0 to 5 by the breakpoints."""
    level = F.lit(0)
    for b in BREAKPOINTS:
        level = level + (percentile >= b).cast("int")
    return level


def radius(percentile: Column) -> Column:
    return F.get(F.array(*[F.lit(r) for r in RADII]), size_level(percentile))


def percentile_rank(df: DataFrame, value: str) -> DataFrame:
    """Adds ``share_below``: the share of values strictly below."""
    ranks = value_counts_upto(df, value).select(value, F.round(F.col("below") / F.col("n"), 6).alias("share_below"))
    return df.join(ranks, value, "left")


def parallel_edges(links: DataFrame, src: str = "src", dst: str = "dst", key: str = "rel_id") -> DataFrame:
    """Adds ``curvature``: edges of an unordered pair are spread around 0, 0.2 apart; a single one has 0."""
    pair = Window.partitionBy(F.least(src, dst), F.greatest(src, dst))
    n = F.count("*").over(pair)
    i = F.row_number().over(pair.orderBy(key)) - 1
    return links.withColumn("curvature", F.round((i - (n - 1) / 2) * 0.2, 6))


def magnitude_rank(magnitude: Column) -> Column:
    """0 for the largest, 3 for unknown ones."""
    rank = F.when(magnitude == MAGNITUDES[0], 0)
    for k, m in enumerate(MAGNITUDES[1:], 1):
        rank = rank.when(magnitude == m, k)
    return rank.otherwise(len(MAGNITUDES))

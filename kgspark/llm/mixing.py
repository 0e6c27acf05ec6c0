"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document gets the exponential key ``-ln(u) / weight`` from a uniform hash of its id. A source's
target is met by as many complete epochs as fit, then by its documents in key order until their sizes
reach the rest. The order is never made as one sorted run of a source: keys fall in logarithmic
buckets whose sums are prefix-summed, so only the one bucket that holds the cut is sorted row by row.

Defined cases: a null size counts 0 and a null source is a source of its own, after all others. A null
or non-positive quality weight counts as the smallest one. Repeated rows are separate documents with
equal keys. Sources of size 0 get target 0. An empty table gives an empty result. Columns of the input
named in ``keep`` are carried along; those of the names returned here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import HASH52_SQL, hash52, n_words, small, table
from kgspark.sources.scratch import write_out

#: Buckets to each doubling of the key; a bucket then holds about 0.2 % of a source's documents at most.
RESOLUTION = 256
LEAST_WEIGHT = 1e-6


def quality_weight(text: Column) -> Column:
    """Sampling weight of a text, 0.25 to 1.25: its share of letters, so that clean prose goes first."""
    whole = F.coalesce(text, F.lit(""))
    letters = F.length(F.regexp_replace(whole, r"[^\p{L}]++", ""))
    return F.lit(0.25) + letters / F.greatest(F.length(whole), F.lit(1))


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Adds ``source_weight``: the cycle dealt to the sources in code point order, null last."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*[F.lit(float(w)) for w in cycle])
    return sources.withColumn("source_weight", F.get(values, order % len(cycle)))


def fill_targets(sources: DataFrame, total_share: float = 1.0, most_epochs: float = 3.0) -> DataFrame:
    """(source, source_size, source_weight) -> adds ``target``.

    Shares of the total by weight; a target stops at ``most_epochs`` times the source's size and the
    excess is shared again by weight. That is one water level L with target = min(cap, L * weight):
    in the order of cap / weight, the first source that its level does not exceed sets L.
    The windows run over one row for each source.
    """
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    capped = (
        sources.withColumn("_cap", F.col("source_size") * F.lit(float(most_epochs)))
        .withColumn("_ratio", F.col("_cap") / F.col("source_weight"))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(total_share)))
        .withColumn("_pos", F.row_number().over(by_ratio))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("source_weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
    )
    fits = F.when(F.col("_level") <= F.col("_ratio"), F.col("_pos"))
    level = F.coalesce(F.min_by("_level", fits).over(everything), F.max("_ratio").over(everything))
    return capped.withColumn("target", F.least(F.col("_cap"), level * F.col("source_weight"))).select(
        "source", "source_size", "source_weight", "target"
    )


def mix_sources(
    docs: DataFrame,
    size: Column,
    quality: Column,
    weights=cyclic_weights,
    most_epochs: float = 3.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    keep: tuple[str, ...] | None = (),
) -> DataFrame:
    """One row per document: id, size, source_size, target (its source's), copies, taken.

    ``weights`` maps (source, source_size) rows to rows with source_weight added. ``keep`` names further
    columns of the input to carry along (None: all of them); they are written with the keys, so no row is joined back.
    """
    added = {"size", "source_size", "target", "copies", "taken", id_col}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    u = (hash52(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) + F.lit(0.5)) / F.lit(float(1 << 52))
    slim = write_out(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("source"),
            F.coalesce(size, F.lit(0)).cast("long").alias("size"),
            (-F.log(u) / F.greatest(F.coalesce(quality, F.lit(0.0)), F.lit(LEAST_WEIGHT))).alias("key"),
            *([F.struct(*kept).alias("_kept")] if kept else []),
        ).withColumn("bucket", F.floor(F.log2("key") * RESOLUTION)),
        "mix",
    )
    buckets = slim.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sizes = buckets.groupBy("source").agg(F.sum("n").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = (
        fill_targets(weights(sizes), most_epochs=most_epochs)
        .withColumn("epochs", whole.cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    start = F.coalesce(
        F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    begun = buckets.withColumn("start", start)
    cut = (
        begun.alias("b")
        .join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
        .groupBy(F.col("g.source").alias("source"))
        .agg(
            F.first("source_size").alias("source_size"),
            F.first("target").alias("target"),
            F.first("epochs").alias("epochs"),
            F.first("rest").alias("rest"),
            F.max(F.when(F.col("start") < F.col("rest"), F.struct("bucket", "start"))).alias("cut"),
        )
    )
    planned = slim.alias("s").join(small(cut, "cut").alias("c"), F.col("s.source").eqNullSafe(F.col("c.source"))).select(
        "s.*", "source_size", "target", "epochs", "rest", "cut"
    )
    in_cut = F.coalesce(F.col("bucket") == F.col("cut.bucket"), F.lit(False))
    sure = planned.filter(~in_cut).withColumn("_more", F.coalesce(F.col("bucket") < F.col("cut.bucket"), F.lit(False)))
    ordered = Window.partitionBy("source").orderBy("key", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_cut = planned.filter(in_cut).withColumn(
        "_more", F.col("cut.start") + F.sum("size").over(ordered) - F.col("size") / 2 < F.col("rest")
    )
    copies = F.col("epochs") + F.col("_more").cast("long")
    return sure.unionByName(at_cut).select(
        F.col("_id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col("_kept")[c].alias(c) for c in kept]
    )


def op10_mixing_sources(spark, sf_dir: str) -> DataFrame:
    """Mix all documents; sizes are words, sources weigh 1, 2, 3 in turn."""
    docs = table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, n_words(F.col("text")), quality_weight(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
    length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS size,
    -ln(({HASH52_SQL.format("coalesce(doc_id::VARCHAR, '')")} + 0.5) / 4503599627370496.0)
      / (0.25 + length(regexp_replace(coalesce(text, ''), '[^\p{{L}}]', '', 'g'))::DOUBLE / greatest(length(coalesce(text, '')), 1)) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source),
r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS pos,
    coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened FROM r),
l AS (SELECT *, (total - filled) / opened AS level FROM o),
m AS (SELECT min_by(level, pos) AS level FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, least(cap, m.level * w) AS target FROM l, m),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS middle
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (epochs + (middle < rest)::INT))::BIGINT AS taken FROM c
"""

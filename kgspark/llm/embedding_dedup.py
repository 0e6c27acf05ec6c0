"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order. Inverted lists hold, for each
pivot, the vectors that have it among their nearest; two vectors of a list are candidates when they share
at least ``min_shared`` pivots (1: no pair of a list is left out) or have the same nearest one, and are linked when their cosine in double
precision is at least ``threshold``. The pivots are a bounded sample of the vectors, twice the root of
their number, less those near an earlier one (``APART``): a hot group of near copies so has few pivots,
which all its vectors share, and is compared whole. Every vector is indexed.

A pivot's list is dealt in blocks of about ``BLOCK`` vectors, and each pair of blocks is one group, so a
long list becomes many groups of equal size. A pair is counted only in the list of the least pivot it
shares; within a group, vectors that share a lower pivot are set apart before the multiplication. A group returns what each vector gained in links and a forest of what it connected: rows follow
the vectors, not the pairs. Equal vectors are one class: they are compared once and count as often as
they come. Classes have numbers of their own; ids come in again only at the end. Vectors of each length have their own pivots.

Defined cases: a vector that is null, zero, or has null or non-finite components links with nothing; vectors of different
lengths do not link; rows of one id are vectors of their own with that id, and so are rows without id, which count as links of
others; a component is named by its least id, or null if it has none, and a row without id has a null ``kept``; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import bounded_batches, table
from kgspark.operators.components import connected_components
from kgspark.sources.scratch import drop, write_out

THRESHOLD, NEAREST, MIN_SHARED = 0.9, 10, 1
#: Bounds of the number of pivots, and vectors in a block.
LEAST_PIVOTS, MOST_PIVOTS, BLOCK = 32, 8192, 1500
#: Cosine from which a sampled pivot is dropped for an earlier one.
APART = 0.7


def distinct_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(least, n, vector): the valid vectors, equal ones once, with the least id among them."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.size(v) > 0
    fine &= F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    fine &= F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    clean = F.transform(v, lambda x: x + F.lit(0.0))  # -0.0 and 0.0 are equal
    return (
        vectors.filter(F.coalesce(fine, F.lit(False)))
        .groupBy(clean.alias("vector"))
        .agg(F.min(id_col).alias("least"), F.count("*").alias("n"))
    )


def _unit(rows: pa.Array, width: int) -> np.ndarray:
    """Rows of unit length; the values of an Arrow list column of equal lengths."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def choose_pivots(distinct: DataFrame, width: int, most: int = MOST_PIVOTS) -> np.ndarray:
    """Unit pivots of pairwise cosine below ``APART``: of twice the root of the vectors, within bounds, taken in hash order."""
    n = int(min(most, max(LEAST_PIVOTS, 2 * distinct.count() ** 0.5)))
    rows = distinct.orderBy(F.xxhash64("vector"), "cls").limit(n).select("vector").collect()  # at most MOST_PIVOTS
    return thin(_unit(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), width)) if rows else np.zeros((0, width))


def thin(pivots: np.ndarray, apart: float = APART) -> np.ndarray:
    """Without the pivots whose cosine to an earlier one that stays is at least ``apart``."""
    kept, n = np.empty_like(pivots), 0
    for row in pivots:
        if not n or (kept[:n] @ row).max() < apart:
            kept[n] = row
            n += 1
    return kept[:n]


def index(distinct: DataFrame, pivots: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """(cls, n, vector, near array<int>): the nearest pivots of every vector, nearest first."""
    shared = distinct.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS rows

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        k = min(nearest, len(known))
        for batch in batches:
            if not batch.num_rows:
                continue
            close = _unit(batch.column("vector"), known.shape[1]) @ known.T
            some = np.argpartition(-close, k - 1, axis=1)[:, :k]
            order = np.take_along_axis(some, np.argsort(-np.take_along_axis(close, some, 1), axis=1, kind="stable"), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))], names=[*batch.schema.names, "near"])

    return distinct.select("cls", "n", "vector").mapInArrow(describe, "cls long, n long, vector array<double>, near array<int>")


def _bits(near: np.ndarray, pivots: int) -> np.ndarray:
    words = np.zeros((len(near), (pivots + 63) // 64), np.uint64)
    for column in near.T:
        words[np.arange(len(near)), column >> 6] |= np.uint64(1) << (column & 63).astype(np.uint64)
    return words


def _met_here(near: np.ndarray, pivot: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of left x right without most pairs that share a lower pivot, which are counted in that one's list."""
    many = [np.bincount(near[side][near[side] < pivot], minlength=pivot) for side in (left, right)]
    both = many[0] * many[1]
    if not pivot or 4 * both.max() < len(left) * len(right):
        yield left, right
        return
    lower = both.argmax()
    has_left, has_right = ((near[side] == lower).any(axis=1) for side in (left, right))
    for a, b in ((left[~has_left], right), (left[has_left], right[~has_right])):
        if len(a) and len(b):
            yield from _met_here(near, pivot, a, b)


def link(indexed: DataFrame, width: int, pivots: int, threshold: float = THRESHOLD, min_shared: int = MIN_SHARED) -> DataFrame:
    """(cls, links, other): for each group what a class gained in links, and one class it is connected with."""
    lists = indexed.select("cls", F.explode("near").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        indexed.withColumn("pivot", F.explode("near"))
        .join(F.broadcast(lists), "pivot")  # one row per pivot, at most MOST_PIVOTS
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "n", "vector", "near")
    )

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        pivot, i, j = (k.as_py() for k in key)
        rows = rows.combine_chunks()
        block = rows.column("block").to_numpy()
        ids, weight = rows.column("cls").to_numpy(), rows.column("n").to_numpy().astype(np.int64)
        unit = _unit(rows.column("vector").combine_chunks(), width)
        near = rows.column("near").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        bits = _bits(near, pivots)
        below = np.zeros(bits.shape[1], np.uint64)
        below[: pivot >> 6] = np.uint64(0xFFFFFFFFFFFFFFFF)
        below[pivot >> 6] = np.uint64((1 << (pivot & 63)) - 1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for part, right in ((some[at : at + 256], other) for some, other in _met_here(near, pivot, left, right) for at in range(0, len(some), 256)):
            a, b = np.nonzero(unit[part] @ unit[right].T >= threshold)
            a, b = part[a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            for lo in range(0, len(a), 100_000):
                x, y = a[lo : lo + 100_000], b[lo : lo + 100_000]
                common = bits[x] & bits[y]
                good = ~(common & below).any(axis=1)
                x, y, common = x[good], y[good], common[good]
                good = (np.bitwise_count(common).sum(axis=1) >= min_shared) | (near[x, 0] == near[y, 0])
                x, y = x[good], y[good]
                np.add.at(links, x, weight[y])
                np.add.at(links, y, weight[x])
                while len(x):
                    # labels name a member of the same component and only fall
                    least = np.minimum(label[x], label[y])
                    apart = label[x] != label[y]
                    if not apart.any():
                        break
                    for end in (x, y):
                        np.minimum.at(label, label[end], least)
                        np.minimum.at(label, end, least)
                    label = label[label]
        while (label[label] != label).any():
            label = label[label]
        hit = np.flatnonzero(links)
        return pa.table({"cls": ids[hit], "links": links[hit], "other": ids[label[hit]]})

    return dealt.groupBy("pivot", "i", "j").applyInArrow(compare, "cls long, links long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, nearest: int = NEAREST, min_shared: int = MIN_SHARED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    bounded_batches(vectors.sparkSession)
    distinct = write_out(distinct_vectors(vectors, id_col, vector_col).withColumn("cls", F.monotonically_increasing_id()), "vectors")  # written, so numbers stay
    none = found = distinct.sparkSession.createDataFrame([], "cls long, links long, other long")
    for width in [r["w"] for r in distinct.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("c")).filter("c > 1").orderBy("w").collect()]:  # one row for each length
        same = distinct.filter(F.size("vector") == width)
        pivots = choose_pivots(same, width)
        indexed = write_out(index(same, pivots, nearest), "indexed")
        one = write_out(link(indexed, width, len(pivots), threshold, min(min_shared, max(1, len(pivots)))), "links")
        drop(indexed)
        found = one if found is none else found.unionByName(one)
    parts = connected_components(found.select(F.col("cls").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "cls")
    parts = write_out(distinct.select("cls", "least").join(parts, "cls", "left").select("cls", "least", F.coalesce("component", "cls").alias("component")), "parts")
    named = parts.groupBy("component").agg(F.min("least").alias("component_id"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    classes = (
        distinct.join(links, "cls", "left")
        .join(parts.select("cls", "component"), "cls")
        .join(named, "component")
        .select("vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("valid"))
    )
    clean = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col(id_col).alias("id"), F.md5(F.to_json(F.struct(clean.alias("v"))).cast("binary")).alias("h"), clean.alias("v"))
    classes = classes.select(F.md5(F.to_json(F.struct(F.col("vector").alias("v"))).cast("binary")).alias("h"), "vector", "n_links", "component_id", "valid")
    joined = rows.join(classes, (rows["h"] == classes["h"]) & (rows["v"] == classes["vector"]), "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op6_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))

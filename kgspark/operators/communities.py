"""Communities by modularity: labels move in turns, one class of nodes at a time.

Where all nodes take a label at once, neighbours swap labels or all end in one community. Here nodes are dealt into
classes by hash; a class moves while the others stay, so a node sees the moves of the classes before it. A node goes to
the neighbouring community with the largest gain in modularity: the weight of its edges to it less what
chance would give, its own weight times the community's over twice the weight of all edges. Then each community becomes one
node, and whole communities move in the same way.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.algorithms import project_edges
from kgspark.operators.blocks import Cells, numbered, rows_of
from kgspark.operators.rankings import magnitude_rank, top_per_group
from kgspark.sources.scratch import drop, write_out

#: Classes, rounds over them on each level, and levels.
CLASSES, ROUNDS, LEVELS = 4, 3, 2


def class_of(node: str, classes: int):
    """0 to classes - 1 from the first hexadecimal digits of the MD5 of the id."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(node).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(classes))


class Moves:
    """Where the nodes of one class go: of the communities around a node, and its own, the one of largest gain, then of least number."""

    total = 0

    def __init__(self, first, own, part):
        self.first, self.own, self.to, self.met = first, own, own["community"].copy(), []

    def add(self, values, to, at, w):
        key, one, place = np.unique(to.astype(np.int64) << 32 | values["community"][at], return_index=True, return_inverse=True)
        self.met.append((key, values["size"][at[one]], np.bincount(place, w, len(key)).astype(np.int64)))

    def done(self):
        if self.met:
            movers = np.unique(np.concatenate([k >> 32 for k, _, _ in self.met]))
            self.met.append((movers << 32 | self.own["community"][movers], self.own["size"][movers], np.zeros(len(movers), np.int64)))
            key, one, place = np.unique(np.concatenate([k for k, _, _ in self.met]), return_index=True, return_inverse=True)
            size = np.concatenate([s for _, s, _ in self.met])[one]
            w = np.zeros(len(key), np.int64)
            np.add.at(w, place, np.concatenate([v for _, _, v in self.met]))
            to, community = key >> 32, key & 0xFFFFFFFF
            k = self.own["k"][to]
            gain = w * self.total - k * (size - np.where(community == self.own["community"][to], k, 0))  # without the node itself
            order = np.lexsort((community, -gain, to))
            best = order[np.flatnonzero(np.diff(to[order], prepend=-1))]
            self.to[to[best]] = community[best]
        return rows_of({"node": np.arange(self.first, self.first + len(self.to)), "community": self.to, "k": self.own["k"]}, [pa.int64(), pa.int32(), pa.int64()], 1 << 14)


class Ends:
    """How much weight leads to each node."""

    def __init__(self, first, own, part):
        self.first, self.k = first, own["k"].copy()

    def add(self, values, to, at, w):
        self.k += np.bincount(to, w, len(self.k)).astype(np.int64)

    def done(self):
        return rows_of({"node": np.arange(self.first, self.first + len(self.k)), "k": self.k}, [pa.int64(), pa.int64()], 1 << 14)


class Contracted:
    """The weights between the communities of a part's nodes and those around them, with the class of the first one."""

    def __init__(self, first, own, part):
        self.own, self.met = own, []

    def add(self, values, to, at, w):
        x, y = self.own["community"][to].astype(np.int64), values["community"][at]
        far = np.flatnonzero(x != y)
        key, one, place = np.unique(x[far] << 32 | y[far], return_index=True, return_inverse=True)
        self.met.append((key, self.own["class"][to[far[one]]], np.bincount(place, None if w is None else w[far], len(key)).astype(np.int64)))

    def done(self):
        if self.met:
            key, one, place = np.unique(np.concatenate([k for k, _, _ in self.met]), return_index=True, return_inverse=True)
            w = np.zeros(len(key), np.int64)
            np.add.at(w, place, np.concatenate([v for _, _, v in self.met]))
            of = np.concatenate([c for _, c, _ in self.met])[one]
            yield from rows_of({"a": key >> 32, "b": key & 0xFFFFFFFF, "w": w, "class": of}, [pa.int64(), pa.int64(), pa.int64(), pa.int32()], 1 << 14)


def _moves(cells: Cells, nodes: DataFrame, total: int, rounds: int, classes: int) -> DataFrame:
    """(node, community, k) of nodes (node, k) that begin alone, after so many rounds over the cells, which are by class."""
    visitor = type("Moves", (Moves,), {"total": total})
    labels = write_out(nodes.select("node", F.col("node").cast("int").alias("community"), "k"), "labels")
    for turn in range(rounds * classes):
        sizes = labels.groupBy("community").agg(F.sum("k").alias("size"))
        sized = write_out(labels.join(sizes, "community"), "sized")
        kinds = [("community", "<i4"), ("size", "<i8")], [("community", "<i4"), ("size", "<i8"), ("k", "<i8")]
        following = write_out(cells.exchange(sized, sized, kinds, visitor, "node long, community int, k long", turn % classes), "labels")
        drop(labels, sized)
        labels = following
    return labels


def modular_communities(nodes: DataFrame, relations: DataFrame, rounds: int = ROUNDS, classes: int = CLASSES, levels: int = LEVELS) -> DataFrame:
    """(entity_id, community): the community's name is one of its first members; nodes without relations stay alone.

    Parallel relations weigh as one edge each; loops are left out. Gains are compared as whole numbers, ties go to the least name.
    Nodes and communities are numbers in the order of the ids; a turn sends each node's community to each part of the graph (``blocks``). On a later level the
    numbers that name no community stay, alone and without edges.
    """
    ids, n = numbered(nodes)
    if not n:
        return nodes.select("entity_id", F.col("entity_id").alias("community"))
    classed = write_out(ids.select("node", class_of("entity_id", classes).cast("int").alias("class"), "entity_id"), "classed")
    of = lambda end: classed.select(F.col("entity_id").alias(end), F.col("node").alias(end + "_"), F.col("class").alias(end + "_class")).hint("shuffle_hash")
    ends = relations.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(of("a"), "a", "left").join(of("b"), "b", "left")
    half = write_out(ends.select(F.col("a_").alias("a"), F.col("b_").alias("b"), "a_class", "b_class"), "half")
    every = half.count()
    total = 2 * every
    way = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(x + "_class").alias("class"))
    inside = half.filter("a IS NOT NULL AND b IS NOT NULL").select(F.inline(F.array(way("a", "b"), way("b", "a"))))
    cells = Cells(inside, n, 12, n_edges=total, turns=classes)
    # relations to what is no node weigh for the node at their other end
    loose = half.filter("(a IS NULL) <> (b IS NULL)").groupBy(F.coalesce("a", "b").alias("node")).agg(F.count("*").alias("k"))
    own = classed.select("node").join(loose, "node", "left").select("node", F.coalesce("k", F.lit(0)).alias("k"))
    now = write_out(cells.exchange(own, own, ([("k", "<i8")], [("k", "<i8")]), Ends, "node long, k long"), "strength")
    found = None
    for level in range(levels):
        labels = _moves(cells, now, total, rounds, classes)
        of_level = labels.select("node", "community")
        found = of_level if found is None else write_out(found.withColumnRenamed("community", "_old").join(of_level.withColumnRenamed("node", "_old"), "_old").select("node", "community"), "communities")
        if level + 1 < levels:
            named = write_out(of_level.join(classed.select(F.col("node").alias("community"), "class"), "community"), "named")
            kinds = [("community", "<i4")], [("community", "<i4"), ("class", "<i4")]
            some = [write_out(cells.exchange(named, named, kinds, Contracted, "a long, b long, w long, class int", turn), "contracted") for turn in range(classes)]
            edges = reduce(DataFrame.unionByName, some)
            cells.drop()
            cells = Cells(edges, n, 12, n_edges=edges.count(), turns=classes)
            drop(now, named, *some)
            sums = labels.groupBy(F.col("community").alias("node")).agg(F.sum("k").alias("k"))
            now = write_out(classed.select("node").join(sums, "node", "left").select("node", F.coalesce("k", F.lit(0)).alias("k")), "strength")
    cells.drop()
    drop(half, now)
    names = classed.select(F.col("node").alias("community"), F.col("entity_id").alias("name"))
    return classed.select("node", "entity_id").join(found, "node").join(names, "community").select("entity_id", F.col("name").alias("community"))


def modularity(labels: DataFrame, relations: DataFrame) -> DataFrame:
    """(communities, modularity) of labels (entity_id, community): one row."""
    ends = project_edges(relations.filter("src <> dst"))
    of = labels.select(F.col("entity_id").alias("a"), F.col("community").alias("x"))
    per = ends.join(of, "a").join(of.select(F.col("a").alias("b"), F.col("x").alias("y")), "b").groupBy("x").agg(F.sum((F.col("x") == F.col("y")).cast("long")).alias("inside"), F.count("*").alias("all"))
    share = per.crossJoin(F.broadcast(per.agg(F.sum("all").alias("total"))))  # one row
    found = share.agg(F.round(F.sum(F.col("inside") / F.col("total") - F.pow(F.col("all") / F.col("total"), 2)), 6).alias("modularity"))
    return labels.agg(F.countDistinct("community").alias("communities")).crossJoin(F.broadcast(found))


def community_detail(labels: DataFrame, entities: DataFrame, relations: DataFrame, most: int = 50) -> dict[str, DataFrame]:
    """members (community, entity_id, name, category) and relations (community, rank, rel_id, src, dst): of those inside a
    community the ``most`` first, by magnitude, then id."""
    of = labels.select("entity_id", "community")
    members = of.join(entities.select("entity_id", "name", "category"), "entity_id").select("community", "entity_id", "name", "category")
    at = lambda end: of.select(F.col("entity_id").alias(end), "community").hint("shuffle_hash")
    ends = relations.select("rel_id", "src", "dst", (-magnitude_rank(F.col("magnitude"))).alias("_m")).join(at("src"), "src").join(at("dst"), ["dst", "community"])
    inside = top_per_group(ends, "community", "_m", most, ("rel_id",))
    return {"members": members, "relations": inside.select("community", "rank", "rel_id", "src", "dst")}

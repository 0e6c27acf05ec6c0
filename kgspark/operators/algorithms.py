"""Graph algorithms over edge lists: centralities, similarity, communities, cores.

Iterations write their state to the shared folder every round, which cuts lineage and survives lost
executors. Undirected views keep parallel edges unless a definition needs a simple graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators import twosteps as T
from kgspark.operators.blocks import Cells, by_number, numbered, rows_of
from kgspark.sources.scratch import drop, write_out
from kgspark.operators.rankings import top_per_group

DAMPING, ROUNDS = 0.85, 20


def project_edges(relations: DataFrame) -> DataFrame:
    """(a, b): each relation in both orientations, parallel ones kept."""
    return relations.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(relations.select(F.col("dst").alias("a"), F.col("src").alias("b")))


def simple_edges(relations: DataFrame) -> DataFrame:
    """(a, b) both ways, without repeats and loops."""
    return project_edges(relations.filter("src <> dst")).distinct()


def pagerank(nodes: DataFrame, relations: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(entity_id, page_rank): undirected, unnormalised; a node without edges has 1 - damping.

    Parallel edges are one weighted edge; a round sends one number for each node to each part of the graph (``blocks``).
    """
    ids, n = numbered(nodes)
    edges = write_out(by_number(ids, project_edges(relations), "left").groupBy("a", "b").agg(F.count("*").alias("w")), "edges")
    out = write_out(edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").cast("double").alias("out")), "out")  # neighbours that are no nodes count
    cells = Cells(edges.filter("b IS NOT NULL"), n, 8)
    drop(edges)

    class Given:
        def __init__(self, first, own, part):
            self.first, self.given = first, np.zeros(len(own))

        def add(self, values, to, at, w):
            sent = values["sent"][at]
            self.given += np.bincount(to, sent if w is None else sent * w, len(self.given))

        def done(self):
            return rows_of({"node": np.arange(self.first, self.first + len(self.given)), "page_rank": 1 - damping + damping * self.given}, [pa.int64(), pa.float64()], 1 << 14)

    ranks = write_out(ids.select("node", F.lit(float(1 - damping)).alias("page_rank")), "ranks")
    for _ in range(rounds if n else 0):
        sent = ranks.join(out, "node").select("node", (F.col("page_rank") / F.col("out")).alias("sent"))
        following = write_out(cells.exchange(sent, ranks.limit(0), ([("sent", "<f8")], [("page_rank", "<f8")]), Given, "node long, page_rank double"), "ranks")
        drop(ranks)
        ranks = following
    cells.drop()
    return ids.join(ranks, "node", "left").select("entity_id", F.coalesce("page_rank", F.lit(float(1 - damping))).alias("page_rank"))


def node_similarity(relations: DataFrame, cutoff: float = 0.3, k: int = 5) -> DataFrame:
    """(a, b, similarity, rank): Jaccard of neighbour sets, at least ``cutoff``, the k best of each node.

    Up to a cutoff of one eighth whole sets meet, and what is counted is exact. Above it, of two sets that reach the cutoff both hold a
    common neighbour among their first ones, rare neighbours first: what first ones share is counted where they meet, and a pair's sets are compared
    only if the rest, which lies behind one of the two prefixes, could still lift it to the cutoff.
    """
    ids, edges = T.numbered(relations)
    n_of = T.sizes(edges)
    other = n_of.select(F.col("a").alias("c"), F.col("n").alias("m"))
    near = F.col("n") >= F.col("m") * F.lit(cutoff) - 1e-9
    if cutoff <= 1 / 8:
        members = edges.select(F.col("a").alias("z"), F.col("n").alias("d"), F.col("b").alias("a")).join(n_of, "a")
        # a pair goes to the larger set, so it must share 2 * cutoff / (1 + cutoff) of the smaller one
        shared = T.counted(T.two_steps(members), edges, 2 * cutoff / (1 + cutoff)).join(other, "c").withColumnRenamed("seen", "shared")
    else:
        rest = lambda n: F.ceil(F.col(n) * F.lit(cutoff) - 1e-9) - 1
        order = n_of.select(F.col("a").alias("b"), F.col("n").alias("d"))
        placed = edges.join(order, "b").withColumn("pos", F.row_number().over(Window.partitionBy("a").orderBy("d", "b")))
        members = write_out(placed.filter(F.col("pos") <= F.col("n") - rest("n")).select(F.col("b").alias("z"), "d", "a", "n"), "prefix")
        met = T.counted(T.two_steps(members), edges, 0).join(other, "c").filter(near)
        unseen = F.greatest(rest("n"), rest("m"))
        candidates = write_out(met.filter((F.col("seen") + unseen) * (1 + cutoff) >= (F.col("n") + F.col("m")) * F.lit(cutoff) - 1e-6).select("a", "c", "n", "m"), "candidates")
        mine = candidates.join(edges.select("a", "b"), "a").join(edges.select(F.col("a").alias("c"), "b"), ["c", "b"])
        shared = mine.groupBy("a", "c", "n", "m").agg(F.count("*").alias("shared"))
    scored = shared.select("a", "c", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("similarity")).filter(F.col("similarity") >= cutoff)
    scored = write_out(scored.select("a", "c", F.round("similarity", 6).alias("similarity")), "similar")
    drop(edges)
    named = scored.join(ids.select(F.col("node").alias("a"), F.col("entity_id").alias("x")), "a").join(ids.select(F.col("node").alias("c"), F.col("entity_id").alias("y")), "c")
    ways = named.select("similarity", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b"), "similarity")
    return top_per_group(ways, "a", "similarity", k, ("b",))


def similar_entities(similar: DataFrame, keys: DataFrame, k: int = 5) -> DataFrame:
    """The k most similar of each key, from stored pairs of either direction."""
    both = similar.select("a", "b", "similarity").unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    best = both.groupBy("a", "b").agg(F.max("similarity").alias("similarity")).join(keys.select(F.col("entity_id").alias("a")), "a", "left_semi")
    return top_per_group(best, "a", "similarity", k, ("b",))


def overlaps(similar: DataFrame, threshold: float = 0.85, k: int = 30) -> DataFrame:
    """The k most similar unordered pairs at or over the threshold."""
    pairs = similar.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return pairs.filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "a", "b").limit(k)


def label_propagation(nodes: DataFrame, relations: DataFrame, rounds: int = 10) -> DataFrame:
    """(entity_id, community): each node takes the commonest label around it, ties to the smallest.

    Labels are numbers in the order of the ids; a round sends each node's label to each part of the graph (``blocks``).
    """
    ids, n = numbered(nodes)
    cells = Cells(by_number(ids, project_edges(relations)).groupBy("a", "b").agg(F.count("*").alias("w")), n, 4)

    class Votes:
        def __init__(self, first, own, part):
            self.first, self.own, self.met = first, own["label"].copy(), []

        def add(self, values, to, at, w):
            key, place = np.unique(to.astype(np.int64) << 32 | values["label"][at], return_inverse=True)
            self.met.append((key, np.bincount(place, w, len(key)).astype(np.int64)))

        def done(self):
            if self.met:
                key, place = np.unique(np.concatenate([k for k, _ in self.met]), return_inverse=True)
                votes = np.bincount(place, np.concatenate([v for _, v in self.met]), len(key)).astype(np.int64)
                to, label = key >> 32, key & 0xFFFFFFFF
                order = np.lexsort((label, -votes, to))
                best = order[np.flatnonzero(np.diff(to[order], prepend=-1))]
                self.own[to[best]] = label[best]
            return rows_of({"node": np.arange(self.first, self.first + len(self.own)), "label": self.own}, [pa.int64(), pa.int32()], 1 << 14)

    kind = [("label", "<i4")]
    labels = write_out(ids.select("node", F.col("node").cast("int").alias("label")), "labels")
    for _ in range(rounds if n else 0):
        following = write_out(cells.exchange(labels, labels, (kind, kind), Votes, "node long, label int"), "labels")
        drop(labels)
        labels = following
    cells.drop()
    named = ids.select(F.col("node").alias("label"), F.col("entity_id").alias("community"))
    return ids.join(labels, "node").join(named, "label").select("entity_id", "community")


def gaps(nodes: DataFrame, degrees: DataFrame, most: int = 2) -> DataFrame:
    """(entity_id, kind): isolated entities, and those with at most so many relation ends."""
    d = nodes.select("entity_id").join(degrees, "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return d.filter(F.col("degree") <= most).select("entity_id", F.when(F.col("degree") == 0, "isolated").otherwise("under-connected").alias("kind"), "degree")


def triangles(relations: DataFrame) -> DataFrame:
    """(entity_id, triangles, clustering) of nodes with neighbours.

    No row is made for an open pair of neighbours: nodes are numbered, and lists of them meet.
    """
    ids, edges = T.numbered(relations)
    per_node = T.triangle_counts(edges)
    out = ids.join(T.sizes(edges).select(F.col("a").alias("node"), F.col("n").cast("long").alias("d")), "node").join(per_node, "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0).cast("long")))
    rate = F.when(F.col("d") > 1, F.round(2 * F.col("triangles") / (F.col("d") * (F.col("d") - 1)), 6)).otherwise(F.lit(0.0))
    return out.select("entity_id", "triangles", rate.alias("clustering"))


def core_numbers(relations: DataFrame) -> DataFrame:
    """(entity_id, core): each node's h-index over its neighbours' values, from their degrees, until nothing changes.

    A round sends each node's value to each part of the graph (``blocks``).
    """
    apart = relations.filter("src <> dst").select("src", "dst")
    ids, n = numbered(apart.select(F.col("src").alias("entity_id")).distinct().unionByName(apart.select(F.col("dst").alias("entity_id")).distinct()))
    near = by_number(ids, apart.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    cells = Cells(project_edges(near.select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct(), n, 4)

    class Least:
        def __init__(self, first, own, part):
            self.first, self.own, self.to, self.around = first, own["core"], [], []

        def add(self, values, to, at, w):
            self.to.append(to.astype(np.int32))
            self.around.append(values["core"][at])

        def done(self):
            core = self.own.copy()
            if self.to:
                to, around = np.concatenate(self.to), np.concatenate(self.around)
                order = np.lexsort((-around, to))
                to, around = to[order], around[order]
                starts = np.flatnonzero(np.diff(to, prepend=-1))
                place = np.arange(1, len(to) + 1) - np.repeat(starts, np.diff(starts, append=len(to)))
                core[to[starts]] = np.minimum(core[to[starts]], np.maximum.reduceat(np.minimum(around, place), starts))
            return rows_of({"node": np.arange(self.first, self.first + len(core)), "core": core, "moved": core < self.own}, [pa.int64(), pa.int32(), pa.bool_()], 1 << 14)

    kind = [("core", "<i4")]
    core = write_out(cells.edges.groupBy(F.col("a").alias("node")).agg(F.count("*").cast("int").alias("core")), "core")
    while n:  # each round lowers a value, so it ends
        following = write_out(cells.exchange(core, core, (kind, kind), Least, "node long, core int, moved boolean"), "core")
        drop(core)
        core = following
        if core.filter("moved").isEmpty():
            break
    cells.drop()
    return ids.join(core, "node").select("entity_id", F.col("core").cast("long").alias("core"))


def link_scores(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, common, adamic_adar, resource_allocation) of the given pairs that share neighbours.

    The lists of nodes two steps away meet the pairs of their first node; no row is made for a pair's common neighbour.
    """
    ids, edges = T.numbered(relations)
    known = ids.join(T.sizes(edges).withColumnRenamed("a", "node"), "node")
    side = lambda name, node, n: known.select(F.col("entity_id").alias(name), F.col("node").alias(node), F.col("n").alias(n))
    asked = write_out(pairs.select("a", "b").distinct().join(side("a", "x", "n"), "a").join(side("b", "y", "m"), "b").select("x", "n", "y", "m"), "asked")
    low, high = F.struct("n", "x"), F.struct(F.col("m").alias("n"), F.col("y").alias("x"))
    ways = asked.filter("x <> y").select("x", "y", F.least(low, high)["x"].alias("a"), F.greatest(low, high)["x"].alias("c"))
    members = edges.select(F.col("a").alias("z"), F.col("n").alias("d"), F.col("b").alias("a")).join(T.sizes(edges), "a")
    scored = T.weighed(T.two_steps(members), edges, ways)
    own = asked.filter("x = y").select(F.col("x").alias("a"), "x", "y").join(edges.select("a", "b"), "a").join(T.sizes(edges).select(F.col("a").alias("b"), F.col("n").alias("d")), "b")
    own = own.groupBy("x", "y").agg(F.count("*").alias("common"), F.sum(1 / F.log("d")).alias("adamic_adar"), F.sum(1 / F.col("d")).alias("resource_allocation"))
    name = lambda node, column: ids.select(F.col("node").alias(node), F.col("entity_id").alias(column))
    named = scored.unionByName(own).join(name("x", "a"), "x").join(name("y", "b"), "y")
    return named.select("a", "b", "common", F.round("adamic_adar", 6).alias("adamic_adar"), F.round("resource_allocation", 6).alias("resource_allocation"))


def unlinked_scores(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """``link_scores`` of all pairs of entities (a before b) that a project mentions together and no relation joins; no table of the pairs is made."""
    ids, edges = T.numbered(relations)
    known = ids.join(T.sizes(edges).withColumnRenamed("a", "node"), "node").select("entity_id", F.col("node").alias("a"), "n")
    seen = mentions.select(F.col("project_id").alias("z"), "entity_id").join(known, "entity_id").select("z", "a", "n").repartition("z").dropDuplicates(["z", "a"])
    members = write_out(seen.join(seen.groupBy("z").agg(F.count("*").cast("int").alias("d")), "z").filter("d > 1"), "members")
    scored = T.weighed_unlinked(edges, members)
    name = lambda node, column: ids.select(F.col("node").alias(node), F.col("entity_id").alias(column))
    named = scored.join(name("x", "p"), "x").join(name("y", "q"), "y")
    return named.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "common", F.round("adamic_adar", 6).alias("adamic_adar"), F.round("resource_allocation", 6).alias("resource_allocation"))

"""Neighbourhoods and paths by frontier joins. Every step joins only the newest frontier with the edges."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.algorithms import simple_edges
from kgspark.operators.blocks import by_number, numbered
from kgspark.operators.joins import explain_pairs
from kgspark.sources.scratch import drop, write_out
from kgspark.operators.rankings import top_per_group
from kgspark.sources.graph import Graph


def neighborhood(relations: DataFrame, seeds: DataFrame, hops: int = 2, limit: int | None = None) -> DataFrame:
    """(seed, entity_id, distance): what each seed reaches in at most so many undirected steps, itself at 0."""
    near = write_out(simple_edges(relations), "simple")
    seen = seeds.select(F.col("entity_id").alias("seed"), "entity_id").distinct().withColumn("distance", F.lit(0))
    newest = seen
    for k in range(1, hops + 1):
        step = newest.join(near, newest["entity_id"] == near["a"]).select("seed", F.col("b").alias("entity_id")).distinct()
        newest = write_out(step.join(seen.select("seed", "entity_id"), ["seed", "entity_id"], "left_anti").withColumn("distance", F.lit(k)), "frontier")
        seen = seen.unionByName(newest)
    if limit is None:
        return seen
    return top_per_group(seen.withColumn("_near", -F.col("distance")), "seed", "_near", limit).drop("_near", "rank")


#: Nodes of a slice, as a power of two: lists of neighbours and levels are cut into rows of one slice each.
SLICE_BITS = 21
#: Numbers that a task gathers before it lets go of repeats.
GATHERED = 1 << 22
#: Pairs whose levels are kept at once; numbers of the lists that meet at once, and how many of them a list's row counts as.
PAIRS, MET, ROW = 1 << 16, 1 << 29, 8


def _stretches(batch: pa.RecordBatch, keys: int):
    """(key, first row, end) of each run of rows with equal first columns."""
    columns = [batch.column(k).to_numpy() for k in range(keys)]
    cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield tuple(int(c[s]) for c in columns), s, e


def _grow(batches):
    """Of (root, slice, seen, list), sorted by root and slice: (root, slice, list) of the numbers in lists that are not seen."""
    key, fresh, seen, held = None, [], [], 0

    def unite(some):
        return np.unique(np.concatenate(some)) if some else np.empty(0, np.int32)

    def done():
        new = np.setdiff1d(unite(fresh), unite(seen), assume_unique=True)
        if len(new):
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), pa.array(new, pa.int32()))], ["root", "slice", "list"])

    for batch in batches:
        if not batch.num_rows:
            continue
        old, lists = batch.column(2).to_numpy(), batch.column(3)
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        for k, s, e in _stretches(batch, 2):
            if k != key:
                if key is not None:
                    yield from done()
                key, fresh, seen, held = k, [], [], 0
            values, was = flat[ends[s] : ends[e]], np.repeat(old[s:e], np.diff(ends[s : e + 1])) > 0
            fresh.append(values[~was].copy())
            seen.append(values[was].copy())
            held += len(values)
            if held > GATHERED:
                fresh, seen, held = [unite(fresh)], [unite(seen)], 0
    if key is not None:
        yield from done()


def _touch(batches):
    """Of (a, b, slice, y, list), sorted so: rows of y = -1 hold a level around a, the others neighbours of y; (a, b, y, m) with the least common m."""
    key, level, ready = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ys, lists = batch.column(3).to_numpy(), batch.column(4)
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        out = []
        for k, s, e in _stretches(batch, 3):
            if k != key:
                key, level, ready = k, [], None
            cut = s + int(np.searchsorted(ys[s:e], 0))
            if cut > s:
                level.append(flat[ends[s] : ends[cut]].copy())
            if cut == e or not level:
                continue
            if ready is None:
                ready = np.sort(np.concatenate(level))
            values = flat[ends[cut] : ends[e]]
            hit = np.flatnonzero(ready[np.minimum(np.searchsorted(ready, values), len(ready) - 1)] == values)
            if len(hit):
                row = np.repeat(ys[cut:e], np.diff(ends[cut : e + 1]))[hit]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                out.append((np.full(len(first), k[0]), np.full(len(first), k[1]), row[first], np.minimum.reduceat(values[hit], first)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int32()) for c in zip(*out)], ["a", "b", "y", "m"])


def shortest_paths(relations: DataFrame, pairs: DataFrame, max_hops: int = 6, mentions: DataFrame | None = None, grown: list[int] | None = None) -> DataFrame:
    """(a, b, hops, path): one shortest undirected path per pair; of several, the one whose nodes are least from the end back.

    With ``mentions`` (entity_id, project_id) paths may also lead through projects. Searches run from both ends: each step grows
    the side with the smaller frontier by one level, and the pairs of which a node of the one level has a neighbour in the other leave, so the last level is never made.
    Nodes are numbers in the order of their ids; levels and neighbours are lists of them, four bytes each, cut into slices.
    Levels of one end are shared by its pairs; ``PAIRS`` pairs are searched at once, and their levels are deleted before the next ones. Pairs of equal ends, absent ends or further apart have no row. ``grown`` gets the nodes of each new level.
    """
    edges = relations.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if mentions is not None:
        edges = edges.unionByName(mentions.select(F.col("entity_id").alias("a"), F.col("project_id").alias("b")))
    edges = write_out(edges.filter("a <> b"), "ends")
    ids, _ = numbered(edges.select(F.explode(F.array("a", "b")).alias("entity_id")))
    whole = lambda df: df.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    of = lambda c: F.shiftright(c, SLICE_BITS).alias("slice")
    way = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("to"))
    ends = whole(by_number(ids, edges)).select(F.inline(F.array(way("a", "b"), way("b", "a"))))
    near = write_out(ends.groupBy("node", of("to")).agg(F.collect_set("to").alias("list")), "near")  # at most one slice of nodes
    asked = write_out(whole(by_number(ids, pairs.select("a", "b").filter("a <> b").distinct())), "pairs")
    batches = -(-asked.count() // PAIRS)
    most = near.groupBy("node").agg(F.sum(F.size("list")).alias("n")).agg(F.max("n")).first()[0] or 0
    found = []
    for batch in range(batches):
        found += _ways(near, most, asked if batches == 1 else write_out(asked.filter(F.pmod(F.xxhash64("a", "b"), F.lit(batches)) == batch), "left"), max_hops, grown)
    if not found:
        return pairs.select("a", "b", F.lit(0).alias("hops"), F.array("a").alias("path")).limit(0)
    rows = reduce(DataFrame.unionByName, found)
    named = rows.select("a", "b", "hops", F.posexplode("path").alias("pos", "node")).join(ids, "node").groupBy("a", "b", "hops").agg(F.array_sort(F.collect_list(F.struct("pos", "entity_id")))["entity_id"].alias("path"))
    return named.select(F.element_at("path", 1).alias("a"), F.element_at("path", -1).alias("b"), "hops", "path")


def _touching(near: DataFrame, most: int, left: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, y, m): of pairs whose levels touch, each node y of the level around b and its least neighbour m in the one around a.

    The lists that meet are counted, and meet in parts of about ``MET`` numbers."""
    sizes = lambda level, end: level.groupBy(F.col("root").alias(end)).agg(F.sum(F.size("list")).alias("n"))
    rows = left.join(sizes(b, "b"), "b").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = 1
    if rows * (most + ROW) > MET:
        degree = near.groupBy(F.col("node").alias("y")).agg(F.sum(F.size("list")).alias("d"))
        weight = b.select(F.col("root").alias("b"), F.explode("list").alias("y")).join(degree, "y").groupBy("b").agg(F.sum(F.col("d") + ROW).alias("w"))
        parts = -(-(left.join(weight, "b").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]) // MET) or 1
    met = []
    for part in range(parts):
        some = left if parts == 1 else left.filter(F.pmod(F.xxhash64("b", "a"), F.lit(parts)) == part)
        front = some.join(a.withColumnRenamed("root", "a"), "a").select("a", "b", "slice", F.lit(-1).alias("y"), "list")
        back = some.join(b.select(F.col("root").alias("b"), F.explode("list").alias("y")), "b").join(near.withColumnRenamed("node", "y"), "y").select("a", "b", "slice", "y", "list")
        both = front.unionByName(back).repartition("a", "b", "slice").sortWithinPartitions("a", "b", "slice", "y")
        met.append(write_out(both.mapInArrow(_touch, "a int, b int, y int, m int").groupBy("a", "b", "y").agg(F.min("m").alias("m")), "met"))
    return reduce(DataFrame.unionByName, met)


def _ways(near: DataFrame, most: int, left: DataFrame, max_hops: int, grown: list[int] | None) -> list[DataFrame]:
    """Tables (a, b, hops, path) in numbers of the pairs ``left``, one for each number of hops."""
    of = lambda c: F.shiftright(c, SLICE_BITS).alias("slice")
    levels = {end: [write_out(left.select(F.col(end).alias("root"), of(end), F.array(end).alias("list")).distinct(), "level")] for end in ("a", "b")}
    found = []
    for hops in range(1, max_hops + 1):
        if left.isEmpty():
            break
        if hops > 1:
            live = {e: levels[e][-1].join(left.select(F.col(e).alias("root")).distinct(), "root", "left_semi") for e in ("a", "b")}
            end = min(("a", "b"), key=lambda e: live[e].agg(F.coalesce(F.sum(F.size("list")), F.lit(0))).first()[0])
            own = levels[end]
            step = live[end].select("root", F.explode("list").alias("node")).join(near, "node").select("root", "slice", F.lit(0).alias("seen"), "list")
            for level in own[-2:]:  # a neighbour of a level is in it, in the one before or in the next one
                step = step.unionByName(level.select("root", "slice", F.lit(1).alias("seen"), "list"))
            own.append(write_out(step.repartition("root", "slice").sortWithinPartitions("root", "slice").mapInArrow(_grow, "root int, slice int, list array<int>"), "level"))
            if grown is not None:
                grown.append(own[-1].agg(F.coalesce(F.sum(F.size("list")), F.lit(0))).first()[0])
        i, j = len(levels["a"]) - 1, len(levels["b"]) - 1
        met = _touching(near, most, left, levels["a"][i], levels["b"][j])
        found.append(_path_back(near, levels, i, j, met))
        following = write_out(left.join(met.select("a", "b").distinct(), ["a", "b"], "left_anti"), "left")
        drop(met, left)
        left = following
    drop(left, *levels["a"], *levels["b"])
    return found


def _path_back(near: DataFrame, levels: dict[str, list[DataFrame]], i: int, j: int, met: DataFrame) -> DataFrame:
    """(a, b, hops, path) in numbers of pairs whose node y, j steps from b, has a neighbour m, i steps from a: from b back always to the least node."""
    steps = near.select("node", F.explode("list").alias("to"))
    on = [met.select("a", "b", F.col("y").alias("node"))]  # nodes of shortest paths, j steps from b, then nearer
    for t in range(j - 1, 0, -1):
        level = levels["b"][t].select(F.col("root").alias("b"), F.explode("list").alias("to"))
        on.append(write_out(on[-1].join(steps, "node").join(level, ["b", "to"]).select("a", "b", F.col("to").alias("node")).distinct(), "on"))
    back = met.select("a", "b").distinct().select("a", "b", F.array("b").alias("path"), F.col("b").alias("at"))
    for t in range(1, j + 1):
        there = on[j - t].select("a", "b", F.col("node").alias("to"))
        if t > 1:
            there = there.join(back.select("a", "b", F.col("at").alias("node")), ["a", "b"]).join(steps, ["node", "to"], "left_semi")
        least = there.groupBy("a", "b").agg(F.min("to").alias("to"))  # those one step from b are next to it
        back = back.drop("at").join(least, ["a", "b"]).select("a", "b", F.concat(F.array("to"), "path").alias("path"), F.col("to").alias("at"))
    back = back.join(met.withColumnRenamed("y", "at"), ["a", "b", "at"]).select("a", "b", F.concat(F.array("m"), "path").alias("path"), F.col("m").alias("at"))
    for t in range(i - 1, 0, -1):
        shared = back.join(near.withColumnRenamed("node", "at"), "at").join(levels["a"][t].select(F.col("root").alias("a"), "slice", F.col("list").alias("level")), ["a", "slice"])
        least = shared.select("a", "b", "path", F.array_min(F.array_intersect("level", "list")).alias("to")).groupBy("a", "b", "path").agg(F.min("to").alias("at"))
        back = least.select("a", "b", F.concat(F.array("at"), "path").alias("path"), "at")
    if i:
        back = back.select("a", "b", F.concat(F.array("a"), "path").alias("path"))
    return write_out(back.select("a", "b", F.lit(i + j + 1).alias("hops"), "path"), "ways")


def all_paths(relations: DataFrame, pairs: DataFrame, max_hops: int = 3, k: int = 10) -> DataFrame:
    """(a, b, hops, path, rank): the k first simple paths of each pair, by hops, then nodes.

    Each step closes paths by the edges into ``b`` alone; a pair with k paths of fewer hops is not searched on, and the last step opens none.
    """
    near = write_out(simple_edges(relations), "simple")
    last = F.element_at("path", -1)
    now = pairs.select("a", "b").filter("a <> b").distinct().select("a", "b", F.array("a").alias("path"))
    found = None
    for hops in range(1, max_hops + 1):
        ends = near.select(F.col("a").alias("at"), "b")
        done = now.withColumn("at", last).join(ends, ["at", "b"]).select("a", "b", F.concat("path", F.array("b")).alias("path"), F.lit(hops).alias("hops"))
        done = write_out(top_per_group(done.withColumn("_o", F.lit(0)), ["a", "b"], "_o", k, ("path",)).drop("_o", "rank"), "paths")
        found = done if found is None else found.unionByName(done)
        if hops < max_hops:
            full = found.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
            open_paths = now.join(full, ["a", "b"], "left_anti").withColumn("at", last)
            step = open_paths.join(near.select(F.col("a").alias("at"), F.col("b").alias("to")), "at").filter(~F.array_contains("path", F.col("to")) & (F.col("to") != F.col("b")))
            now = write_out(step.select("a", "b", F.concat("path", F.array("to")).alias("path")), "open")
    return top_per_group(found.withColumn("_near", -F.col("hops")), ["a", "b"], "_near", k, ("path",)).drop("_near")


def explain_connections(g: Graph, pairs: DataFrame, max_hops: int = 3) -> tuple[DataFrame, DataFrame]:
    """Summary (a, b, forward, backward, projects, hops, path, connected) of each pair, and the direct relations of the pairs as evidence
    (a, b, rel_id, direction, rel_type, evidence_strength).

    A path of at most ``max_hops`` is looked for only where no relation joins the pair; hops is null where there is none. A pair is connected by
    a relation, a shared project or a path.
    """
    asked = pairs.select("a", "b").distinct()
    base = write_out(explain_pairs(g, asked), "direct")
    found = shortest_paths(g.relations, base.filter("forward + backward = 0").select("a", "b"), max_hops)
    summary = base.drop("connected").join(found, ["a", "b"], "left").withColumn("connected", (F.col("forward") + F.col("backward") + F.col("projects") > 0) | F.col("hops").isNotNull())
    return summary, direct_evidence(g, asked)


def direct_evidence(g: Graph, pairs: DataFrame) -> DataFrame:
    """(a, b, rel_id, direction, rel_type, evidence_strength): the direct relations of the pairs; no path is looked for."""
    asked = pairs.select("a", "b").distinct()
    ends = g.relations.select("rel_id", "rel_type", "evidence_strength", "src", "dst")
    out = ends.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_id", F.lit("outgoing").alias("direction"), "rel_type", "evidence_strength")
    back = ends.filter("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel_id", F.lit("incoming").alias("direction"), "rel_type", "evidence_strength")
    return out.unionByName(back).join(asked, ["a", "b"], "left_semi")


def projects_of_paths(paths: DataFrame, mentions: DataFrame) -> DataFrame:
    """Adds the number of distinct projects that mention a node of the path."""
    nodes = paths.select("a", "b", F.explode("path").alias("entity_id")).join(mentions.select("entity_id", "project_id"), "entity_id")
    counts = nodes.groupBy("a", "b").agg(F.countDistinct("project_id").alias("projects"))
    return paths.join(counts, ["a", "b"], "left").withColumn("projects", F.coalesce("projects", F.lit(0)))


def highlight_set(links: DataFrame, focus: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, node_id, distance) over a view's links, memberships included: what lights up around the focused nodes in 1 to 3 steps."""
    if not 1 <= hops <= 3:
        raise ValueError("hops must be 1 to 3")
    return neighborhood(links.select("src", "dst"), focus.select(F.col("node_id").alias("entity_id")), hops).withColumnRenamed("entity_id", "node_id")

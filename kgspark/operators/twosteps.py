"""What two nodes have in common, counted without a row for every common neighbour.

Nodes are numbered. The members of a neighbourhood are sorted by their numbers of neighbours, then by number; each member is sent
once with the list of those after it, so a pair costs four bytes. Lists of a node meet in one group, and groups are sized by count. A
pair goes from the node of fewer neighbours to the other one, so a hub only meets the few nodes as large as itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.sources.scratch import drop, write_out

#: Members of a neighbourhood that are listed at once; list entries that one group counts; list entries that are shuffled at once.
CHUNK, ENTRIES, WAVE = 1024, 4_000_000, 1 << 30


def numbered(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (entity_id, node) that have neighbours, and the simple edges (a, n, b) by number both ways; n: neighbours of a."""
    ends = write_out(relations.filter("src <> dst").select("src", "dst"), "ends")
    names = ends.select(F.explode(F.array("src", "dst")).alias("entity_id")).distinct()
    placed = write_out(write_out(names, "names").withColumn("row", F.monotonically_increasing_id()), "placed")
    part, row = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)  # a partition and a place in it
    width = (placed.agg(F.max(row)).first()[0] or 0) + 1
    ids = placed.select("entity_id", (part * F.lit(width) + row).cast("int").alias("node"))
    pairs = ends.join(ids.select(F.col("entity_id").alias("src"), F.col("node").alias("a")), "src").join(ids.select(F.col("entity_id").alias("dst"), F.col("node").alias("b")), "dst")
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    near = both.repartition("a").dropDuplicates(["a", "b"])
    sizes = near.groupBy("a").agg(F.count("*").cast("int").alias("n"))
    edges = write_out(near.join(sizes, "a").select("a", "n", "b"), "edges")
    drop(ends)
    return ids, edges


def sizes(edges: DataFrame) -> DataFrame:
    """(a, n): the number of neighbours of each node."""
    return edges.select("a", "n").distinct()


def two_steps(members: DataFrame, chunk: int | None = None, stored: bool = False) -> DataFrame:
    """(a, n, d, others): for each member of a neighbourhood those that come after it by (n, a), in chunks.

    Input: (z, d, a, n), where z is a node with d neighbours and a one of them with n. A neighbourhood larger than ``chunk`` is listed in parts, so none is
    gathered in one row; parts meet in pairs. ``stored`` lists are written, so that rows may be asked for in several waves.
    """
    chunk = chunk or CHUNK
    part = F.pmod(F.xxhash64("a"), F.ceil(F.col("d") / chunk)).alias("part")

    def lists(rows: DataFrame) -> DataFrame:
        listed = rows.groupBy("z", "d", part).agg(F.sort_array(F.collect_list(F.struct("n", "a"))).alias("m"))  # at most about a chunk
        return write_out(listed, "lists") if stored else listed

    short = lists(members)
    place = short.select("d", F.col("m.a").alias("nodes"), F.posexplode("m").alias("at", "x"))
    out = place.select("x.a", "x.n", "d", F.slice("nodes", F.col("at") + 2, F.size("nodes")).alias("others")).filter("size(others) > 0")
    large = members.filter(F.col("d") > chunk)
    if not large.isEmpty():
        long = short.filter(F.col("d") > chunk) if stored else lists(large)
        x = long.select("z", "d", "part", F.explode("m").alias("x"))
        y = long.select("z", F.col("part").alias("other"), F.col("m").alias("y"))
        across = x.join(y, "z").filter("part <> other").select("x.a", "x.n", "d", F.expr("transform(filter(y, c -> c > x), c -> c.a)").alias("others"))
        out = out.unionByName(across.filter("size(others) > 0"))
    return out


def _bucketed(rows: DataFrame, edges: DataFrame, entries: int | None):
    """The rows with their group: so many groups that each has about ``entries`` list entries."""
    most = edges.agg(F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0))).first()[0] // 2
    return F.pmod(F.xxhash64("a"), F.lit(-(-most // (entries or ENTRIES)) or 1)).alias("bucket")


def _keys(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """One whole number for each list entry, from the node and the entry, and the lengths of the lists."""
    lists = pa.concat_arrays(rows.column("others").chunks) if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    lengths = lists.value_lengths().to_numpy()
    return np.repeat(rows.column("a").to_numpy().astype(np.int64) << 32, lengths) | lists.flatten().to_numpy(), lengths


def counted(rows: DataFrame, edges: DataFrame, least: float, entries: int | None = None) -> DataFrame:
    """(a, c, n, seen): how often pairs occur in lists of ``two_steps``, where that is ``least`` times n or more."""

    def count(found: pa.Table) -> pa.Table:
        key, _ = _keys(found)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        seen = np.diff(np.append(first, len(key)))
        nodes, at = np.unique(found.column("a").to_numpy(), return_index=True)
        a = (key[first] >> 32).astype(np.int32)
        n = found.column("n").to_numpy()[at][np.searchsorted(nodes, a)]
        keep = seen >= least * n - 1e-9
        return pa.table({"a": a[keep], "c": (key[first][keep] & 0xFFFFFFFF).astype(np.int32), "n": n[keep], "seen": seen[keep].astype(np.int32)})

    return rows.select(_bucketed(rows, edges, entries), "a", "n", "others").groupBy("bucket").applyInArrow(count, "a int, c int, n int, seen int")


def weighed(rows: DataFrame, edges: DataFrame, pairs: DataFrame, entries: int | None = None) -> DataFrame:
    """(x, y, common, adamic_adar, resource_allocation) of the pairs (x, y, a, c) that occur in lists; a comes before c in them."""

    def weigh(found: pa.Table, asked: pa.Table) -> pa.Table:
        key, lengths = _keys(found)
        d = np.repeat(found.column("d").to_numpy().astype(float), lengths)
        wanted, of = np.unique(asked.column("a").to_numpy().astype(np.int64) << 32 | asked.column("c").to_numpy(), return_inverse=True)
        at = np.searchsorted(wanted, key)
        hit = wanted[np.minimum(at, len(wanted) - 1)] == key if len(wanted) else np.zeros(len(key), bool)
        at, d = at[hit], d[hit]
        common, adamic, share = (np.bincount(at, w, len(wanted))[of] for w in (None, 1 / np.log(d), 1 / d))
        keep = common > 0
        return pa.table({"x": asked.column("x").filter(pa.array(keep)), "y": asked.column("y").filter(pa.array(keep)), "common": common[keep].astype(np.int64), "adamic_adar": adamic[keep].astype(float), "resource_allocation": share[keep].astype(float)})

    bucket = _bucketed(rows, edges, entries)
    left, right = rows.select(bucket, "a", "d", "others"), pairs.select(bucket, "x", "y", "a", "c")
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(weigh, "x int, y int, common long, adamic_adar double, resource_allocation double")


def weighed_unlinked(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(x, y, common, adamic_adar, resource_allocation) of pairs that share neighbours, are in a group of ``members`` (z, d, a, n) together and are not joined by ``edges``.

    Groups list their pairs as neighbourhoods do, so a pair is four bytes until it is weighed. All lists go in waves of about ``WAVE`` entries."""
    near = edges.select(F.col("a").alias("z"), F.col("n").alias("d"), F.col("b").alias("a")).join(sizes(edges), "a")
    count = lambda df, n: df.agg(F.coalesce(F.sum(F.col(n).cast("long")), F.lit(0))).first()[0] // 2
    most = count(edges, "n") + count(members, "d")
    waves, buckets = -(-most // WAVE) or 1, -(-most // ENTRIES) or 1
    up = edges.join(sizes(edges).select(F.col("a").alias("b"), F.col("n").alias("m")), "b").filter("n < m OR (n = m AND a < b)")
    taken = write_out(up.groupBy("a").agg(F.collect_list("b").alias("others")), "taken")
    rows, asked = two_steps(near, stored=waves > 1), two_steps(members, stored=waves > 1)

    def weigh(found: pa.Table, asked: pa.Table) -> pa.Table:
        linked = np.array(asked.column("linked").to_pylist(), bool)
        wanted, out = (np.unique(_keys(asked.filter(pa.array(which, pa.bool_())))[0]) for which in (~linked, linked))
        wanted = np.setdiff1d(wanted, out, assume_unique=True)
        key, lengths = _keys(found)
        d = np.repeat(found.column("d").to_numpy().astype(float), lengths)
        if len(wanted) and len(key):
            at = np.searchsorted(wanted, key)
            hit = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == key)
            at, d = at[hit], d[hit]
        else:
            at, d = np.empty(0, np.int64), d[:0]
        common, adamic, share = (np.bincount(at, w, len(wanted)) for w in (None, 1 / np.log(d), 1 / d))
        keep = common > 0
        return pa.table({"x": (wanted[keep] >> 32).astype(np.int32), "y": (wanted[keep] & 0xFFFFFFFF).astype(np.int32), "common": common[keep].astype(np.int64), "adamic_adar": adamic[keep].astype(float), "resource_allocation": share[keep].astype(float)})

    bucket, scored = F.pmod(F.xxhash64("a"), F.lit(buckets)), []
    pairs = asked.select("a", "others", F.lit(False).alias("linked")).unionByName(taken.select("a", "others", F.lit(True).alias("linked")))
    for wave in range(waves):
        left, right = (df.withColumn("bucket", bucket).filter(F.lit(waves == 1) | (F.pmod("bucket", F.lit(waves)) == wave)) for df in (rows.select("a", "d", "others"), pairs))
        one = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(weigh, "x int, y int, common long, adamic_adar double, resource_allocation double")
        scored.append(write_out(one, "scored"))
    whole = scored[0]
    for one in scored[1:]:
        whole = whole.unionByName(one)
    return whole


def _closed(batches):
    """Of (x, a, list), sorted by x and a: lists of a = -1 hold what x points to, the others what a points to beside x; (node, n): corners of the triangles."""
    held = np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        lists, last = batch.column(2), batch.column(0)[batch.num_rows - 1].as_py()
        lengths = lists.value_lengths().to_numpy()
        x, a = (np.repeat(batch.column(k).to_numpy().astype(np.int64), lengths) for k in (0, 1))
        key, own = x << 32 | lists.flatten().to_numpy(), a < 0
        known = np.sort(np.concatenate([held, key[own]]))
        held = known[known >> 32 == last]
        at = np.flatnonzero(~own)
        if len(known) and len(at):
            at = at[known[np.minimum(np.searchsorted(known, key[at]), len(known) - 1)] == key[at]]
            node, n = np.unique(np.concatenate([x[at], a[at], key[at] & 0xFFFFFFFF]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), pa.array(n, pa.int64())], ["node", "n"])


def triangle_counts(edges: DataFrame) -> DataFrame:
    """(node, triangles) of nodes in triangles, from ``numbered``'s edges.

    Edges point from lower to higher (neighbours, number), so a node points to no more nodes than the root of the edges allows. A node sends to each
    node that it points to those that come after it, four bytes a pair; these lists go in waves of about ``WAVE`` entries."""
    up = edges.join(sizes(edges).select(F.col("a").alias("b"), F.col("n").alias("m")), "b").filter("n < m OR (n = m AND a < b)")
    out = write_out(up.groupBy("a").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "b"))), lambda e: e["b"]).alias("to")), "out")
    entries = out.agg(F.coalesce(F.sum(F.expr("cast(size(to) AS long) * (size(to) - 1) div 2")), F.lit(0))).first()[0]
    rows = out.select("a", "to", F.posexplode("to").alias("at", "x")).select("x", "a", F.slice("to", F.col("at") + 2, F.size("to")).alias("list")).filter("size(list) > 0")
    rows = rows.unionByName(out.select(F.col("a").alias("x"), F.lit(-1).alias("a"), F.col("to").alias("list")))
    waves, found = -(-entries // WAVE) or 1, []
    for wave in range(waves):
        some = rows if waves == 1 else rows.filter(F.pmod(F.xxhash64("x"), F.lit(waves)) == wave)
        cut = some.select("x", "a", F.explode(F.transform(F.sequence(F.lit(0), F.size("list") - 1, F.lit(CHUNK)), lambda s: F.slice("list", s + 1, F.lit(CHUNK)))).alias("list"))
        counts = cut.repartition("x").sortWithinPartitions("x", "a").mapInArrow(_closed, "node int, n long")
        found.append(write_out(counts.groupBy("node").agg(F.sum("n").alias("triangles")), "triangles"))
    drop(out)
    whole = found[0]
    for one in found[1:]:
        whole = whole.unionByName(one)
    return whole.groupBy("node").agg(F.sum("triangles").alias("triangles"))

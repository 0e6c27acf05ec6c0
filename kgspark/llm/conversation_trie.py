"""Conversation prefix trie: double arrays per prefix shard, shared upper nodes merged globally.

A conversation is rebuilt from the first turns of its family's first conversation and its own turns after them. Each
distinct sequence of first turns is a node of one trie over all conversations.

Rebuilt conversations, as rows of turn digests, are sorted by their turns, then by id. A shard is a piece of
that order with a bounded number of turns, so a first turn, a prefix or a whole conversation that very many share is
spread over as many shards as it needs. In a shard distinct turns get dense numbers, in the order in which the nodes
come, and the shard's trie is packed into a double array: the child of slot s by turn c is slot t = BASE[s] + c, and
CHECK[t] = s says that it is one. Nodes with several children look for a gap that takes them all; nodes
with one child fill the slots that are left. Every conversation then walks the arrays, which finds its nodes; counts,
leaves and savings are summed up the tree.

Only nodes on the way to a shard's first or last conversation can also lie in another shard. These upper nodes
come out as parts, keyed by a digest of their path; parts are summed by key, and what lies below is added up by
doubling: after round k each node has the sums of less than 2^k levels below it. All other nodes are final where they are.

Defined cases: null role or text is empty; a null turn comes first; rows of one turn are ordered by the digest of role
and text, and all count; rows without conv_id belong to no conversation and are left out; ids below 0 belong to the family of their
remainder as SQL has it (toward 0); an empty table gives no rows; other columns are ignored. A conversation is one row
of about 40 bytes a turn, so it may have some ten million turns; texts are not carried.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import small, table
from kgspark.sources.scratch import drop, write_out

#: Conversations of a family; most turns taken over from its first one.
FAMILY, MOST_SHARED = 5, 8
#: Turns of a shard, about; gaps that a node with several children tries before it goes to the end.
SHARD_TURNS, GAPS = 100_000, 16


def digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's own turns in order, as array<struct<digest, bytes>>."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    one = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("later"), "turn", one.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t")
    )
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return each.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuild(own: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of the family's first conversation, then the own ones after the first h."""
    first = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, MOST_SHARED).alias("_turns"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    shared = F.when(F.col("_turns").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("_turns", F.lit(1), h))
    joined = own.join(first, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("_first"), "left")
    return joined.select("conv_id", F.concat(shared, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


class DoubleArray:
    """A trie packed over dense turn numbers; slot 0 is the root."""

    def __init__(self, sequences: list[list[int]]):
        """``sequences`` must be sorted so that those with a common prefix lie together."""
        parent, turn, path, before = [0], [-1], [0], []
        for one in sequences:
            same = 0
            for x, y in zip(one, before, strict=False):
                if x != y:
                    break
                same += 1
            del path[same + 1 :]
            for x in one[same:]:
                parent.append(path[-1])
                turn.append(x)
                path.append(len(turn) - 1)
            before = one
        self._pack(np.array(parent), np.array(turn))

    def _pack(self, parent: np.ndarray, turn: np.ndarray) -> None:
        order = np.argsort(parent[1:], kind="stable") + 1  # children of one node lie together
        self.dense = np.full(int(turn.max(initial=-1)) + 1, -1)
        known, at = np.unique(turn[order], return_index=True)
        self.dense[known[np.argsort(at)]] = np.arange(len(known))
        code = self.dense[turn[order]]
        starts = np.flatnonzero(np.r_[True, np.diff(parent[order]) > 0]) if len(order) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(order)])
        used = np.zeros(2 * len(turn) + len(known) + 2, dtype=bool)
        used[0], end = True, 1
        place, low = np.zeros(len(turn), dtype=np.int64), 1
        for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            codes = code[a : a + n]
            spread = codes - codes.min()
            if end + spread.max() + n >= len(used):
                used = np.r_[used, np.zeros(len(used) + int(spread.max()) + n, dtype=bool)]
            gaps = low + np.flatnonzero(~used[low : low + 8 * GAPS])[:GAPS]
            fits = next((g for g in gaps.tolist() if not used[g + spread].any()), end)
            place[order[a : a + n]] = fits + spread
            used[fits + spread] = True
            end = max(end, fits + int(spread.max()) + 1)
            while used[low]:
                low += 1
        single = order[starts[sizes == 1]]
        free = np.flatnonzero(~used[:end])[: len(single)]
        place[single] = np.r_[free, np.arange(end, end + len(single) - len(free))]
        self.base = np.zeros(int(place.max()) + 1, dtype=np.int64)
        self.check = np.full(len(self.base), -1, dtype=np.int64)
        children = place[order]
        self.check[children] = place[parent[order]]
        self.base[place[parent[order]]] = children - code

    def walk(self, sequences: list[list[int]]) -> list[list[int]]:
        """The slots that each sequence visits after the root."""
        base, check, dense = self.base.tolist(), self.check.tolist(), self.dense.tolist()
        out = []
        for one in sequences:
            slot, seen = 0, []
            for x in one:
                to = base[slot] + dense[x]
                if check[to] != slot:
                    raise KeyError("sequence is not in the trie")
                slot = to
                seen.append(slot)
            out.append(seen)
        return out


#: upper: a part of a node that other shards may have too. Sums of an upper node leave out its upper children.
SHARD_SCHEMA = """upper boolean, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,
    saved_tokens long, bytes long, ends string, first_end long"""
NOBODY = hashlib.sha256(b"").hexdigest()


def shard_nodes(ids: list[int], turns: list[list[int]], names: list[bytes], size: list[int]) -> dict[str, list]:
    """Columns of ``SHARD_SCHEMA`` for the nodes of a shard: sorted conversations, of turns by number; a turn's digest and bytes."""
    trie = DoubleArray(turns)
    seen = trie.walk(turns)
    slots = len(trie.check)
    depth, convs, first, nbytes = [0] * slots, [0] * slots, [0] * slots, [0] * slots
    ends, order = defaultdict(list), [0]
    convs[0], first[0] = len(ids), min(ids)
    for key, own, path in zip(ids, turns, seen, strict=True):
        ends[path[-1] if path else 0].append(key)
        for d, (x, slot) in enumerate(zip(own, path, strict=True), 1):
            if not convs[slot]:
                depth[slot], nbytes[slot], first[slot] = d, size[x], key
                order.append(slot)
            convs[slot] += 1
            first[slot] = min(first[slot], key)
    keys, check = {0: hashlib.md5(b"").digest()}, trie.check.tolist()
    for own, path in ((turns[0], seen[0]), (turns[-1], seen[-1])):
        for x, slot in zip(own, path, strict=True):
            keys[slot] = hashlib.md5(keys[check[slot]] + names[x]).digest()
    children, leaves, saved = [0] * slots, [0] * slots, [0] * slots
    for slot in reversed(order):
        if slot in keys:
            continue
        leaves[slot] += not children[slot]
        saved[slot] += (convs[slot] - 1) * nbytes[slot]
        up = check[slot]
        children[up] += 1
        leaves[up] += leaves[slot]
        saved[up] += saved[slot]
    out: dict[str, list] = {name.split()[0]: [] for name in SHARD_SCHEMA.split(",")}
    for slot in order:
        upper, up, here = slot in keys, check[slot], ends.get(slot)
        said = ",".join(map(str, here)) if here else ""
        row = (
            upper, keys.get(slot), keys.get(up) if slot else None, first[slot], depth[slot], first[up] if slot and up not in keys else None, convs[slot], children[slot], leaves[slot], saved[slot],
            nbytes[slot], said if upper else hashlib.sha256(said.encode()).hexdigest() if said else NOBODY, here[0] if here else None,
        )
        for column, value in zip(out.values(), row, strict=True):
            column.append(value)
    return out


def _shards(batches: Iterator[pa.RecordBatch], shard_turns: int) -> Iterator[pa.RecordBatch]:
    """Cuts the sorted rows into shards of about that many turns and gives their nodes."""
    types = {"upper": pa.bool_(), "key": pa.binary(), "parent_key": pa.binary(), "ends": pa.string()}

    def nodes(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        lists = rows.column(1).combine_chunks()
        flat = lists.flatten()
        digests_ = flat.field("digest").dictionary_encode()
        names, number = digests_.dictionary.to_pylist(), digests_.indices.to_numpy(zero_copy_only=False)
        size = np.zeros(len(names), dtype=np.int64)
        size[number] = flat.field("bytes").to_numpy(zero_copy_only=False)
        numbers, at, turns = number.tolist(), 0, []
        for n in lists.value_lengths().to_pylist():
            turns.append(numbers[at : at + n])
            at += n
        out = shard_nodes(rows.column(0).to_pylist(), turns, names, size.tolist())
        return pa.RecordBatch.from_pydict({name: pa.array(values, types.get(name, pa.int64())) for name, values in out.items()})

    held, turns = [], 0
    for batch in batches:
        sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        start = 0
        for stop in [*(np.flatnonzero(np.diff((turns + np.cumsum(sizes)) // shard_turns)) + 1).tolist(), len(batch)]:
            held.append(batch.slice(start, stop - start))
            turns += int(sizes[start:stop].sum())
            start = stop
            if turns >= shard_turns:
                yield nodes(held)
                held, turns = [], 0
    if sum(map(len, held)):
        yield nodes(held)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, piece) in order, the SHA-256 of each key's pieces joined by commas, one piece in memory at a time."""
    key, state, keys, hashes = None, None, [], []
    for batch in batches:
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k == key:
                state.update(b",")
            else:
                if state is not None:
                    keys.append(key)
                    hashes.append(state.hexdigest())
                key, state = k, hashlib.sha256()
            state.update(piece.encode())
    if state is not None:
        keys.append(key)
        hashes.append(state.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["_key", "ends_sha256"])


def _sums_below(nodes: DataFrame, levels: int) -> DataFrame:
    """(key, n_leaves, saved_tokens): of each node (key, parent_key, n_leaves, saved_tokens) the sums over its subtree of that many levels."""
    now = small(nodes.select("key", F.col("parent_key").alias("up"), "n_leaves", "saved_tokens"), "upper")
    for _ in range(levels.bit_length()):
        gain = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("_key")).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        higher = now.select(F.col("key").alias("_up"), F.col("up").alias("_higher"))
        after = now.join(gain, F.col("key") == F.col("_key"), "left").join(higher, F.col("up") == F.col("_up"), "left")
        following = small(after.select(
            "key", F.col("_higher").alias("up"), (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens")
        ), "upper")
        drop(now)
        now = following
    return now.drop("up")


def trie_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie over all rebuilt conversations."""
    own = write_out(digests(conversations), "turns")
    rebuilt = write_out(rebuild(own), "rebuilt")
    sorted_ = rebuilt.select("conv_id", "turns", F.transform("turns", lambda t: t["digest"]).alias("path"))
    sorted_ = sorted_.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")
    parts = write_out(sorted_.mapInArrow(partial(_shards, shard_turns=shard_turns), SHARD_SCHEMA), "parts")
    drop(own, rebuilt)

    merged = parts.filter("upper").groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    merged = write_out(merged, "merged")
    kids = merged.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("_key")).agg(F.count("*").alias("_kids"))
    counted = merged.join(kids, F.col("key") == F.col("_key"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0))).drop("_key", "_kids")
    counted = write_out(counted, "counted")
    own_sums = counted.select(
        "key", "parent_key", (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
    )
    below = _sums_below(own_sums, counted.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0])
    pieces = parts.filter("upper AND first_end IS NOT NULL").select("key", "first_end", "ends")
    hashed = pieces.repartition("key").sortWithinPartitions("key", "first_end").select("key", "ends").mapInArrow(_hash_pieces, "_key binary, ends_sha256 string")
    upper = counted.select("key", "parent_key", "conv_id", "depth", "n_convs", "n_children").join(below, "key").join(hashed, F.col("key") == F.col("_key"), "left").drop("_key")

    names = small(merged.select(F.col("key").alias("_key"), F.col("conv_id").alias("_conv_id")), "names")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    private = parts.filter("NOT upper").withColumnRenamed("ends", "ends_sha256").select(*columns, "parent_key")
    upper = upper.withColumn("parent_conv_id", F.lit(None).cast("long")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY)))
    every = private.unionByName(upper.select(*columns, "parent_key"))
    named = every.join(names, F.col("parent_key") == F.col("_key"), "left")
    return named.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_conv_id")).select(*columns)


def op13_conversation_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations."""
    return trie_nodes(table(spark, sf_dir, "conversations"))


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ord(substr(c::VARCHAR, i, 1))::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295)"
SQL = f"""
WITH o AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT o.c, o.turns, b.turns AS base, {_CRC.replace("c::", "o.c::")} % {MOST_SHARED + 1} AS h FROM o LEFT JOIN o b ON b.c = o.c - o.c % {FAMILY}),
x AS (SELECT c, list_concat(coalesce(base[1:h], []), turns[h + 1:]) AS s FROM h),
p AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM x),
n AS (SELECT s[1:d] AS s, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (len(s) = d), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
k AS (SELECT s[1:d - 1] AS s, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(strlen(n.s[d].t), 0) AS saved FROM n LEFT JOIN k ON k.s = n.s),
u AS (SELECT s, unnest(range(0, d + 1)) AS e, saved, n_children FROM v),
w AS (SELECT s[1:e] AS s, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM u GROUP BY 1)
SELECT v.conv_id, v.d::BIGINT AS depth, a.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN w ON w.s = v.s LEFT JOIN v a ON a.d = v.d - 1 AND a.s = v.s[1:v.d - 1]
"""

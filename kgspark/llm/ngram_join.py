"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct five-word shingles (hashed to 64 bits); equal sets are one class.
All sets share one order of tokens: rare ones first, then frequent ones. Rare tokens are indexed
singly. Frequent ones are dealt to classes by hash and indexed in combinations of two of one class. A
set's prefix is the shortest start of its ordered tokens from which the loss of the tokens that a
linked set may lack cannot take every combination: p tokens of a frequent class withstand the loss of
p - 1, rare ones of all. Of two linked sets, the one whose prefix ends first keeps at least one
combination among the tokens they share, and these lie in the other's prefix as well; so every link is
a candidate. The number of classes grows with the size of the set, in steps of a quarter, so that a
class has a few tokens of a prefix; a set is indexed for its own step and the next one, hence two linked
sets for one in common.

Where rare tokens suffice, the prefix is extended by ``EXTRA`` percent of the set. The linked set whose
extended prefix ends first then shares more than that many tokens of it, and the other one holds them
in its own; sets with fewer repeated tokens in their extended prefix cannot link and leave before any
candidate is formed. Candidates of too different sizes part in the index as well.

A token's class comes from a sketch: counts of all tokens of all documents, in cells whose number grows
with the input. It only steers how selective the index is; any classes give the same links.

Sets that share a combination are candidates of each other. Their group is named by its least member, and
groups of one name are one, so that the many combinations of a family of near copies fall together.
Pairs are never listed: a group's sets meet in one task, which counts what they share by inverted lists and
returns a forest of links. A group too large for a task is dealt in blocks, its least member in
each. Sets outside a group's largest component then meet the group's other blocks once more, so that
no link between two components is lost: the components are those of all links.

Defined cases: a null text, or one without words, has the empty set and links with nothing; with fewer
than five words the whole sequence is the only shingle; every row is a document of its own, also where ids
repeat; a component's id is the least of its rows, a null id comes last; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import bounded_batches, small, table
from kgspark.llm.shingles import scramble, shingle_sets
from kgspark.operators.components import connected_components
from kgspark.sources.scratch import drop, write_out

SHINGLE, PERCENT = 5, 80
#: The sketch has a cell for so many bytes of text, within these powers of two; a row of it holds SLICE cells.
CELL_BYTES, LEAST_BITS, MOST_BITS, SLICE = 256, 20, 24, 1 << 16
#: Tasks whose sketches are summed in one group before the last sum.
MERGED = 256
#: A cell is frequent when it holds this many tokens more than the mean cell could by chance.
FREQUENT = 24
#: A size step has one frequent class for so many tokens of a set.
CLASS_TOKENS = 20
#: Sets under this size link with equal sets only.
LEAST_SIZE = 4
#: Percent of a set by which a prefix of rare tokens is extended.
EXTRA = 10
#: Sets and tokens of a block of a group.
BLOCK_SETS, BLOCK_TOKENS = 384, 400_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
HEAD = np.dtype([("cls", "<i8"), ("n", "<i4"), ("free", "i1"), ("count", "<i4")])

def class_id(tokens: np.ndarray) -> int:
    """Identity of a set: a signed 64-bit hash of its sorted tokens."""
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def lost(size: int, percent: int = PERCENT) -> int:
    """Tokens that a set of this size may lack in a set it links with."""
    return size - -(-percent * size // 100)


def step(size: int) -> int:
    """Size step: sets that may link are in one step or in two adjacent ones."""
    return int(np.floor(np.log(size) / np.log(100 / PERCENT) + 1e-9))


def class_count(at: int) -> int:
    """Frequent classes of a size step."""
    return max(1, int((100 / PERCENT) ** at) // CLASS_TOKENS)


def is_frequent(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which tokens lie in a frequent cell; ``frequent`` holds a bit for each cell."""
    bits = (len(frequent) * 8).bit_length() - 1
    cell = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    return (frequent[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def extra(size: int) -> int:
    """Tokens by which a prefix is extended."""
    return size * EXTRA // 100


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Signatures of a sorted set: those of its prefix, the tokens of the extension, and whether the prefix has frequent ones."""
    if len(tokens) < LEAST_SIZE:
        return tokens[:0], tokens[:0], True
    need = lost(len(tokens)) + 1
    hot = is_frequent(tokens, frequent)
    rare = tokens[~hot]
    if len(rare) >= need + extra(len(tokens)):
        return rare[:need], rare[need : need + extra(len(tokens))], False
    if len(rare) >= need:
        return rare[:need], rare[need:], True
    found, hot = [rare], tokens[hot]
    for at in (step(len(tokens)), step(len(tokens)) + 1):
        kind = (scramble(hot ^ _MIX) % np.uint64(class_count(at))).astype(np.int64)
        first = np.zeros(len(hot), bool)
        first[np.unique(kind, return_index=True)[1]] = True
        strength = len(rare) + np.cumsum(~first)
        end = int(np.searchsorted(strength, need)) + 1
        order = np.argsort(kind[:end], kind="stable")
        some, kinds = hot[:end][order], kind[:end][order]
        apart = 1
        while apart < len(some) and (same := kinds[apart:] == kinds[:-apart]).any():
            x, y = some[:-apart][same], some[apart:][same]
            found.append(scramble(scramble(x * _MIX + y) + np.uint64(at)))
            apart += 1
    return np.unique(np.concatenate(found)), tokens[:0], True


def sketch_bits(docs: DataFrame, text_col: str = "text") -> int:
    """The power of two of the sketch's cells, by the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (size // CELL_BYTES).bit_length()))


def describe(docs: DataFrame, bits: int, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """Rows of two kinds: (id, key, n, cls) of each document; (slice, part, counts) of the sketch of each task."""
    bounded_batches(docs.sparkSession)
    names = ["id", "key", "n", "cls", "slice", "part", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def batch_of(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(rows, kind)) for name, kind in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(1 << bits, np.uint32), [], 0

        def count() -> None:
            cells = (np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64)
            if len(cells) > len(counts) // 4:
                counts[:] += np.bincount(cells, minlength=len(counts)).astype(np.uint32)
            else:
                np.add.at(counts, cells, np.uint32(1))
            held.clear()

        for batch in batches:
            sets = shingle_sets(batch.column(2), SHINGLE)
            held += sets
            size += sum(map(len, sets))
            if size >= 2_000_000:
                count()
                size = 0
            yield batch_of(len(sets), id=batch.column(0), key=batch.column(1), n=pa.array(list(map(len, sets)), pa.int64()), cls=pa.array(list(map(class_id, sets)), pa.int64()))
        if held:
            count()
        part = TaskContext.get().partitionId() // MERGED
        for k, some in enumerate(np.split(counts, len(counts) // SLICE)):
            if some.any():
                packed = zlib.compress(some.astype("<u4").tobytes(), 1)
                yield batch_of(1, slice=pa.array([k], pa.int32()), part=pa.array([part], pa.int32()), counts=pa.array([packed], pa.binary()))

    key = F.lit(None).cast("long") if key_col is None else F.col(key_col).cast("long")
    source = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, key long, n long, cls long, slice int, part int, counts binary")


def frequent_cells(described: DataFrame, total: int, bits: int) -> np.ndarray:
    """A bit for each cell of the summed sketch: whether its tokens count as frequent."""
    mean = total / (1 << bits)
    bound = mean + 6 * mean**0.5 + FREQUENT

    def add(rows: pa.Table) -> np.ndarray:
        return sum(np.frombuffer(zlib.decompress(c.as_py()), f"<u{4 if 'part' in rows.column_names else 8}").astype(np.uint64) for c in rows.column("counts"))

    def merge(rows: pa.Table) -> pa.Table:
        packed = zlib.compress(add(rows).astype("<u8").tobytes(), 1)
        return pa.table({"slice": pa.array([rows.column("slice")[0].as_py()], pa.int32()), "counts": pa.array([packed], pa.binary())})

    def mark(rows: pa.Table) -> pa.Table:
        marks = np.packbits(add(rows) > bound, bitorder="little").tobytes()
        return pa.table({"slice": pa.array([rows.column("slice")[0].as_py()], pa.int32()), "bits": pa.array([marks], pa.binary())})

    sketches = described.filter("slice IS NOT NULL").select("slice", "part", "counts")
    merged = sketches.groupBy("slice", "part").applyInArrow(merge, "slice int, counts binary")
    marked = merged.groupBy("slice").applyInArrow(mark, "slice int, bits binary").collect()  # at most 2^MOST_BITS bits
    out = np.zeros(((1 << bits) // SLICE, SLICE // 8), np.uint8)
    for r in marked:
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def index(docs: DataFrame, frequent: np.ndarray, text_col: str = "text") -> DataFrame:
    """What the classes of documents meet with, in rows of two kinds.

    grp null: (cls, n, met, free), how many of a class's signatures another class has too, in one bucket of
    signatures; free classes need no least number. Else (grp, cls, n): classes that share a signature of
    their prefixes and may link by their sizes, under the name of the least of them.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent)  # at most 2^MOST_BITS bits
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, classes, sizes, frees, sigs = 0, [], [], [], []

        def flush() -> pa.RecordBatch:
            """A row per bucket: signatures of 6 bytes, the lowest bit marking the prefix; classes with how many of them are theirs."""
            counts = [len(s) for s in sigs]
            sig = np.concatenate(sigs)
            owner = np.repeat(np.arange(len(sigs)), counts)
            bucket = (sig >> np.uint64(1)) % np.uint64(buckets)
            order = np.lexsort((owner, bucket))
            sig, owner, bucket = sig[order], owner[order], bucket[order].astype(np.int64)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            head = np.rec.fromarrays([np.array(classes, np.int64), np.array(sizes, np.int32), np.array(frees, np.int8), np.zeros(len(classes), np.int32)], dtype=HEAD)
            full = [k for k in range(buckets) if cut[k] < cut[k + 1]]
            packed, heads = [], []
            for k in full:
                part, own = sig[cut[k] : cut[k + 1]], owner[cut[k] : cut[k + 1]]
                mine, n = np.unique(own, return_counts=True)
                rows = head[mine]
                rows["count"] = n
                heads.append(rows.tobytes())
                packed.append(pack(part))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packed, pa.binary()), pa.array(heads, pa.binary())], names=["bucket", "sigs", "heads"])

        for batch in batches:
            for tokens in shingle_sets(batch.column(0), SHINGLE):
                base, more, free = signatures(tokens, shared.value)
                if len(base):
                    classes.append(class_id(tokens))
                    sizes.append(len(tokens))
                    frees.append(free)
                    marks = np.concatenate([np.ones(len(base), np.uint64), np.zeros(len(more), np.uint64)])
                    sigs.append((scramble(np.concatenate([base, more])) & np.uint64((1 << 48) - 2)) | marks)
                    held += len(sigs[-1])
                if held >= 500_000:
                    yield flush()
                    held, classes, sizes, frees, sigs = 0, [], [], [], []
        if held:
            yield flush()

    def meet(rows: pa.Table) -> pa.Table:
        sig = np.concatenate([unpack(s) for s in rows.column("sigs").to_pylist()])
        head = np.frombuffer(b"".join(rows.column("heads").to_pylist()), HEAD)
        owner = np.repeat(np.arange(len(head)), head["count"])
        cls, n, free = head["cls"][owner], head["n"][owner], head["free"][owner]
        key, base = sig >> np.uint64(1), (sig & np.uint64(1)).astype(bool)
        order = np.lexsort((cls, key))
        key, cls, n, free, base = key[order], cls[order], n[order], free[order], base[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls, n, free, base = key[new], cls[new], n[new], free[new], base[new]
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        again[:-1] |= again[1:]
        kept = again | (free == 1)
        each, first, place = np.unique(cls[kept], return_index=True, return_inverse=True)
        met = np.bincount(place, again[kept], len(each)).astype(np.int64)
        counted = {"grp": pa.nulls(len(each), pa.int64()), "cls": pa.array(each), "n": pa.array(n[kept][first].astype(np.int64)), "met": pa.array(met), "free": pa.array(free[kept][first].astype(np.int32))}
        k, c, m = key[again & base], cls[again & base], n[again & base].astype(np.int64)
        order = np.lexsort((c, m, k))
        k, c, m = k[order], c[order], m[order]
        # a group ends where the signature does, or where the next size is too large for all before it
        apart = (k[1:] != k[:-1]) | (m[:-1] * 100 < m[1:] * PERCENT)
        start = np.flatnonzero(np.r_[True, apart]) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(k)])
        name = np.repeat(np.minimum.reduceat(c, start) if len(k) else c, size)
        some = np.repeat(size > 1, size)
        pairs = np.unique(np.rec.fromarrays([name[some], c[some], m[some]], names="grp,cls,n"))
        nothing = len(pairs)
        grouped = {"grp": pa.array(pairs["grp"].copy()), "cls": pa.array(pairs["cls"].copy()), "n": pa.array(pairs["n"].copy()), "met": pa.nulls(nothing, pa.int64()), "free": pa.nulls(nothing, pa.int32())}
        return pa.concat_tables([pa.table(counted), pa.table(grouped)])

    emitted = docs.select(F.col(text_col).alias("text")).mapInArrow(emit, "bucket int, sigs binary, heads binary")
    return emitted.groupBy("bucket").applyInArrow(meet, "grp long, cls long, n long, met long, free int")


def pack(tokens: np.ndarray) -> bytes:
    """The lower six bytes of each."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(packed: bytes | memoryview) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64)[:, 0]


def candidate_groups(met: DataFrame) -> DataFrame:
    """(grp, cls, n): groups of at least two classes that meet others often enough to link."""
    # a linked set may be smaller by a fifth, and so may its extension be
    least = F.expr(f"((n * {PERCENT} + 99) div 100 * {EXTRA}) div 100 + 1")
    counts = met.filter("grp IS NULL").groupBy("cls").agg(F.max("n").alias("n"), F.sum("met").alias("met"), F.max("free").alias("free"))
    able = counts.filter((F.col("free") == 1) | (F.col("met") >= least)).select("cls")
    rows = met.filter("grp IS NOT NULL").select("grp", "cls", "n").distinct()
    return rows.join(able, "cls", "left_semi")


def token_sets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(cls, tokens binary) of documents, a token in six bytes; equal sets once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = {class_id(s): s for s in shingle_sets(batch.column(0), SHINGLE)}
            new = [c for c in found if c not in seen]
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([pack(found[c]) for c in new], pa.binary())], names=["cls", "tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "cls long, tokens binary")


def forest(sets: list[np.ndarray], label: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect, of sets given with component labels, all that links connect.

    Every pair of different components has an end outside the one that has most of the sets not yet asked
    for. So one of those is asked for at a time, against all sets, until there are none.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.r_[True, tokens[1:] != tokens[:-1]]
    start = np.flatnonzero(new)
    count = np.diff(np.r_[start, len(tokens)])
    list_of = np.cumsum(new) - 1
    shared = count[list_of] > 1
    mine = np.argsort(owner[shared], kind="stable")
    lists = list_of[shared][mine]
    cut = np.searchsorted(owner[shared][mine], np.arange(len(sets) + 1))
    label, asked, found = np.unique(label, return_inverse=True)[1], np.zeros(len(sets), bool), []
    while True:
        left = np.flatnonzero(~asked)
        if not len(left):
            break
        others = left[label[left] != np.bincount(label[left]).argmax()]
        if not len(others):
            break
        x = others[0]
        asked[x] = True
        some = lists[cut[x] : cut[x + 1]]
        each = count[some]
        at = np.repeat(start[some] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum()) if len(some) else some
        both = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((100 * both >= percent * (sizes[x] + sizes - both)) & (label != label[x]))
        if len(near):
            met, first = np.unique(label[near], return_index=True)
            found += [(int(x), int(y)) for y in near[first]]
            label[np.isin(label, met)] = label[x]
    return found


def verify(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """(grp, block, cls, n, label) with their token sets -> (a, b): links that connect the components of each block.

    Rows of a block come one after another, so a task holds one block at a time; labels name components known before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[bytes, int, int]] = {}
        now = None

        def links() -> tuple[list[int], list[int]]:
            if len(held) < 2 or len({x[2] for x in held.values()}) < 2:
                return [], []
            classes = list(held)
            pairs = forest([unpack(x[0]) for x in held.values()], np.array([x[2] for x in held.values()]), np.array([x[1] for x in held.values()], np.int64))
            return [classes[x] for x, _ in pairs], [classes[y] for _, y in pairs]

        for batch in batches:
            a, b = [], []
            for grp, block, cls, n, label, tokens in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
                if (grp, block) != now:
                    x, y = links()
                    a += x
                    b += y
                    held.clear()
                    now = (grp, block)
                held[cls] = (tokens.as_py(), n, label)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a, b = links()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = sets.join(dealt, "cls").select("grp", "block", "cls", "n", "label", "tokens")
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "cls").mapInArrow(run, "a long, b long")


def linked_classes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, component) of classes that link with others."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)).cast("int")
    groups = small(members.groupBy("grp").agg(F.count("*").alias("c"), F.min("cls").alias("least"), blocks.alias("blocks")).filter("c > 1"), "groups")
    dealt = members.join(groups, "grp").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    first = write_out(dealt, "dealt")
    everywhere = F.when(F.col("cls") == F.col("least"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    once = small(first.withColumn("block", F.explode(everywhere)).select("grp", "block", "cls", "n", F.col("cls").alias("label")), "once")
    links = write_out(verify(once, sets), "links")
    drop(once)
    parts = connected_components(links)
    wide = first.filter("blocks > 1")
    if not groups.filter("blocks > 1").limit(1).count():
        drop(first, groups)
        return parts
    labelled = wide.join(parts.withColumnRenamed("id", "cls"), "cls", "left").select("grp", "cls", "n", "blocks", "own", F.coalesce("component", "cls").alias("label"))
    labelled = write_out(labelled, "labelled")
    tally = labelled.groupBy("grp", "label").agg(F.count("*").alias("c"))
    most = tally.groupBy("grp").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("all"))
    # sets outside the largest component, in blocks of their own; each of them meets every block of the group
    rest = small(most.filter("all > most.c").select("grp", F.col("most.label").alias("main"), F.ceil((F.col("all") - F.col("most.c")) / BLOCK_SETS).cast("int").alias("outer")), "rest")
    both = labelled.join(rest, "grp")
    asks = (F.col("label") != F.col("main")).cast("int")
    mine = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("outer")).cast("int")
    as_other = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda k: k * F.col("blocks") + F.col("own"))
    as_asking = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: mine * F.col("blocks") + k)
    places = F.when(asks == 1, F.array_union(as_other, as_asking)).otherwise(as_other)
    again = small(both.withColumn("block", F.explode(places)).select("grp", "block", "cls", "n", "label"), "again")
    more = write_out(verify(again, sets).unionByName(parts.select(F.col("id").alias("a"), F.col("component").alias("b"))), "more")
    drop(first, groups, labelled, rest, again, links)
    return connected_components(more)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of every row; with ``key_col`` also it and ``component``, which tells components of equal or null ids apart."""
    bits = sketch_bits(docs, text_col)
    described = write_out(describe(docs, bits, id_col, text_col, key_col), "described")
    rows = described.filter("slice IS NULL").select("id", "key", "n", "cls")
    total = rows.agg(F.sum("n")).first()[0] or 0
    met = write_out(index(docs, frequent_cells(described, total, bits), text_col), "met")
    members = write_out(candidate_groups(met), "members")
    drop(met)
    classes = rows.filter("n > 0").groupBy("cls").agg(F.min("id").alias("rep"))
    # one document at least for each class that shares a signature with another
    wanted = small(members.select("cls").distinct().join(classes, "cls").select("rep").distinct(), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    sets = write_out(token_sets(texts.join(wanted, F.col("_id").eqNullSafe(F.col("rep")), "left_semi")), "sets")
    parts = write_out(linked_classes(members, sets), "parts")
    drop(members, wanted, sets)
    named = classes.join(parts.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    whole = named.join(least, "component").select("cls", "component", "component_id")
    mine = rows.join(whole, (rows["cls"] == whole["cls"]) & (rows["n"] > 0), "left")
    linked = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), linked.alias("component_id")]
    return mine.select(*out, *([] if key_col is None else [F.col("key").alias(key_col), "component"]))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents that share four fifths of their shingles."""
    return components(table(spark, sf_dir, "documents"))

"""Best-fit packing of documents into sequences of a fixed number of tokens.

Method: large-item matching. Pieces above a third of the capacity share a bin with at most one other
such piece and are matched greedily, the longest first, each with the longest partner that still fits;
smaller pieces then go, longest first, each into the smallest gap that holds it.

Lengths are whole numbers up to the capacity, so the plan needs only how many pieces have each length:
a histogram of at most ``capacity`` rows. The plan is a list of runs "pieces rank a to b of length l go
k to a bin from bin x on, at offset o". Its size depends on the capacity, not on the documents. Pieces
find their run by their rank among the pieces of their length; ranks are counted in salted groups.

Defined cases: a null or empty text is the end id alone, so a piece of length 1; repeated rows are
packed as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import bounded_batches, table
from kgspark.llm.tokens import END_ID, crc, default_tokenizer, encoder
from kgspark.sources.scratch import write_out

CAPACITY = 4096
#: Pieces of one length that are ranked in one sorted group, about.
GROUP_ROWS = 200_000


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids, cut only where it is over the capacity."""
    tokenizer = tokenizer or default_tokenizer()
    bounded_batches(docs.sparkSession)
    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in (id_col, "piece", "start", "length", "ids_crc32", "ids")}
            for key, ids in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1).to_pylist(), end_id), strict=True):
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for name, value in zip(out, (key, k, start, len(part), crc(part), part.astype("<u4").tobytes() if with_ids else None), strict=True):
                        out[name].append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = {name: pa.array(values, kind) for (name, values), kind in zip(out.items(), types, strict=True)}
            if not with_ids:
                del columns["ids"]
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first bin, pieces to a bin, offset in the bin)."""
    left = {n: c for n, c in counts.items() if c}
    ranks = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []
    bins = 0

    def place(length: int, first: int, n_bins: int, per_bin: int, offset: int) -> None:
        runs.append((length, ranks[length], ranks[length] + n_bins * per_bin, first, per_bin, offset))
        ranks[length] += n_bins * per_bin
        left[length] -= n_bins * per_bin

    def leave(gap: int, first: int, n_bins: int) -> None:
        if gap and n_bins:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, n_bins))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect_left(large, capacity - a + 1) - 1
            while at >= 0 and left[large[at]] < 1 + (large[at] == a):
                at -= 1
            if at < 0:
                n = left[a]
                place(a, bins, n, 1, 0)
                leave(capacity - a, bins, n)
            else:
                b = large[at]
                n = left[a] // 2 if a == b else min(left[a], left[b])
                place(a, bins, n, 1, 0)
                place(b, bins, n, 1, a)
                leave(capacity - a - b, bins, n)
            bins += n

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(open_gaps, n)
            if at == len(open_gaps):
                gap, first, count = capacity, bins, -(-left[n] // (capacity // n))
                bins += count
            else:
                gap = open_gaps[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
            per_bin = gap // n
            whole = min(count, left[n] // per_bin)
            if whole:
                place(n, first, whole, per_bin, capacity - gap)
                leave(gap - per_bin * n, first, whole)
                leave(gap, first + whole, count - whole)
            else:
                rest = left[n]
                place(n, first, 1, rest, capacity - gap)
                leave(gap - rest * n, first, 1)
                leave(gap, first + 1, count - 1)
    return runs




def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to (…, length); ``pieces`` should be a written table, it is read twice."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row per length, at most capacity
    runs = np.array(plan_bins(histogram, capacity) or [(0, 0, 0, 0, 1, 0)], np.int64)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = spark.sparkContext.broadcast(runs)  # bounded by the capacity
    salts = max(16, -(-sum(histogram.values()) // GROUP_ROWS))

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = (
        salted.withColumn("_within", within)
        .join(bases, ["length", "_salt"])
        .select(*pieces.columns, (F.col("_base") + F.col("_within")).cast("long").alias("_rank"))
    )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        shift = 1 << 48
        starts = known[:, 0] * shift + known[:, 1]
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            ranks = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            run = known[np.searchsorted(starts, lengths * shift + ranks, "right") - 1]
            inner = ranks - run[:, 1]
            added = (run[:, 3] + inner // run[:, 4], run[:, 5] + inner % run[:, 4] * lengths)
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(x, pa.int64()) for x in added], names=[*kept, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(settle, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return pack(write_out(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))

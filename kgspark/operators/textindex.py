"""A stored inverted index and exact top-k search over it that leaves out blocks by their largest impact.

Rows are numbered by length and cut into ranges of ``RANGE`` rows, so rows of one range weigh a term alike. A term's postings
of one range are one block: its rows, counts and lengths, and the largest impact that a unit of idf can have there.
Blocks lie in folders by the hash of the term; a search reads only the folders of its terms.

A search first reads the heads of its terms' blocks. The sum of the largest impacts bounds every row of a range. The ranges of
highest bound are scored first, which gives each query a k-th score; of the others only those are scored
whose bound reaches it.

A task builds the blocks of the ranges it holds, and a search sums bounds and scores of a run of ranges in one group, so neither words nor
(query, row) pairs are shuffled.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from kgspark.operators.bm25 import B, BLOCK, K1, NEAR, WORDS
from kgspark.operators.rankings import top_per_group
from kgspark.operators.search import terms
from kgspark.sources.scratch import write_out

#: Rows of a range; folders; ranges that each query scores before it has a k-th score.
RANGE, BUCKETS, FIRST = 64, 64, 4
#: Ranges of one group; (query, range) pairs scored at once, about.
RUN, PAIRS = 64, 1600


@dataclass(frozen=True)
class TextIndex:
    """Folder of an index, its number of rows, their mean length and the type of their ids."""

    path: str
    n: int
    average: float
    kind: str


def _bucket(term: str, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _blocks(size: int, average: float, id_type):
    """(id, len, w) in order of length: the blocks of the partition's ranges, whose numbers are its own."""
    batch_schema = pa.schema([("term", pa.string()), ("range", pa.int64()), ("rows", pa.int64()), ("most", pa.float64()), ("ids", pa.list_(to_arrow_type(id_type))), ("impacts", pa.list_(pa.float64()))])

    def blocks(batches):
        base, rest = TaskContext.get().partitionId() << 33, None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                whole, upto = rest, rest.num_rows if rest is not None else 0
            else:
                whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                upto = whole.num_rows // size * size
            while whole is not None and upto:
                step = min(upto, max(size, upto * WORDS // max(1, int(pc.sum(whole.slice(0, upto).column("len")).as_py() or 0)) // size * size))
                yield from _range_blocks(whole.slice(0, step).combine_chunks(), base, size, average, batch_schema)
                base += -(-step // size)
                whole, upto = whole.slice(step), upto - step
            rest = whole

    return blocks


def _range_blocks(rows: pa.Table, base: int, size: int, average: float, schema: pa.Schema):
    """Blocks of whole ranges, the first of which is number ``base``."""
    lists = rows.column("w").combine_chunks()
    words = pa.array(lists.flatten(), pa.string()).dictionary_encode()
    if not len(words):
        return
    names, lens = rows.column("id").combine_chunks().dictionary_encode("encode").indices.to_numpy(), rows.column("len").to_numpy()
    place = np.arange(rows.num_rows)
    new = np.concatenate([[True], (names[1:] != names[:-1]) | (lens[1:] != lens[:-1]) | (place[1:] % size == 0)])
    row = np.repeat(np.maximum.accumulate(np.where(new, place, 0)), lists.value_lengths().to_numpy())  # rows of one id and length in a range are one
    key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * rows.num_rows + row, return_counts=True)  # by term, then row
    term, row = key // rows.num_rows, key % rows.num_rows
    length = rows.column("len").to_numpy().astype(float)[row]
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
    at = row // size
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (at[1:] != at[:-1])]))
    offsets = pa.array(np.append(first, len(key)).astype(np.int32))
    ids = pa.ListArray.from_arrays(offsets, rows.column("id").combine_chunks().take(pa.array(row)))
    columns = [words.dictionary.take(pa.array(term[first])), pa.array(base + at[first]), pa.array(np.diff(np.append(first, len(key)))), pa.array(np.maximum.reduceat(impact, first)), ids, pa.ListArray.from_arrays(offsets, pa.array(impact))]
    yield from pa.table(columns, schema=schema).to_batches(max_chunksize=20_000)


def write_index(rows: DataFrame, id_col: str, text_col: str, path: str, size: int = RANGE, buckets: int = BUCKETS) -> TextIndex:
    """Writes the index of a text column to ``path``; null texts are rows without terms. Only the rows in order of length and the finished blocks are shuffled."""
    words = rows.select(F.col(id_col).alias("id"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).withColumn("len", F.size("w"))
    n, average = words.agg(F.count("*"), F.coalesce(F.avg("len"), F.lit(0.0))).first()
    placed = words.repartitionByRange("len", "id").sortWithinPartitions("len", "id").select("id", "len", "w")
    kind = words.schema["id"].dataType.simpleString()
    blocks = placed.mapInArrow(_blocks(size, average or 1.0, words.schema["id"].dataType), f"term string, range long, rows long, most double, ids array<{kind}>, impacts array<double>")
    blocks.withColumn("bucket", _bucket("term", buckets)).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    return TextIndex(path, n, average, kind)


def _stored(spark: SparkSession, index: TextIndex) -> DataFrame:
    kind = f"term string, range long, rows long, most double, ids array<{index.kind}>, impacts array<double>, bucket int"
    return spark.read.schema(kind).parquet(index.path)  # an index without words has no files


def read_index(spark: SparkSession, index: TextIndex, asked: DataFrame) -> DataFrame:
    """The blocks of the folders that hold one of the terms (term, bucket)."""
    folders = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most as many as there are folders
    return _stored(spark, index).filter(F.col("bucket").isin(folders))


def _weighed(asks: list[list[int]], idf: np.ndarray):
    """The (term, query) pairs by term: where each term's queries begin, and the queries."""
    ends = np.array([(t, q) for q, terms_ in enumerate(asks) for t in terms_], dtype=np.int64).reshape(-1, 2)
    ends = ends[np.argsort(ends[:, 0], kind="stable")]
    return np.searchsorted(ends[:, 0], np.arange(len(idf) + 1)), ends[:, 1]


def _spread(term: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries with terms: the entry of each (entry, query), and where the query stands."""
    times = start[term + 1] - start[term]
    entry = np.repeat(np.arange(len(term)), times)
    return entry, np.arange(len(entry)) + np.repeat(start[term] - (np.cumsum(times) - times), times)


def _bounds(start: np.ndarray, queries: np.ndarray, idf: np.ndarray, n_queries: int):
    """Of the heads (term, range, most) of a run of ranges: for each range the queries that have a block there, and their bounds."""

    def bounds(heads: pa.Table) -> pa.Table:
        term = heads.column("term").to_numpy()
        ranges, at = np.unique(heads.column("range").to_numpy(), return_inverse=True)
        entry, pos = _spread(term, start)
        found = np.bincount(at[entry] * n_queries + queries[pos], idf[term[entry]] * heads.column("most").to_numpy()[entry], len(ranges) * n_queries).reshape(len(ranges), n_queries)
        x, y = np.nonzero(found > 0)
        offsets = pa.array(np.searchsorted(x, np.arange(len(ranges) + 1)).astype(np.int32))
        return pa.table({"range": ranges, "queries": pa.ListArray.from_arrays(offsets, pa.array(y.astype(np.int32))), "bounds": pa.ListArray.from_arrays(offsets, pa.array(found[x, y]))})

    return bounds


def _left(kth: np.ndarray, early: list[tuple[int, int]]):
    """Of (range, queries, bounds): the queries whose k-th score the bound reaches, without the pairs (query, range) that were scored."""
    done = np.array(sorted((r, q) for q, r in early), dtype=np.int64).reshape(-1, 2)

    def left(batches):
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            row, query = np.repeat(np.arange(len(batch)), sizes), batch.column(1).flatten().to_numpy()
            keep = batch.column(2).flatten().to_numpy() + 1e-5 >= kth[query]
            for r, q in done[np.isin(done[:, 0], batch.column(0).to_numpy())]:
                keep &= (batch.column(0).to_numpy()[row] != r) | (query != q)
            offsets = pa.array(np.searchsorted(row[keep], np.arange(len(batch) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(query[keep].astype(np.int32)))], ["range", "asked"])

    return left


def _score_ranges(start: np.ndarray, queries: np.ndarray, idf: np.ndarray, n_queries: int, k: int):
    """Of a run's blocks (term, range, ids, impacts) and the queries that want its ranges (range, asked): rows that may be among a query's k best."""
    at_once = max(1, PAIRS // max(1, n_queries))

    def score(blocks: pa.Table, wanted: pa.Table) -> pa.Table:
        ranges, which = np.unique(wanted.column("range").to_numpy(), return_inverse=True)
        lists = wanted.column("asked").combine_chunks()
        asked = np.zeros((len(ranges), n_queries), bool)
        asked[np.repeat(which, lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
        blocks = blocks.filter(pc.is_in(blocks.column("range"), pa.array(ranges))).sort_by("range").combine_chunks()
        at = np.searchsorted(ranges, blocks.column("range").to_numpy())
        held, out = np.zeros((0, n_queries)), []
        empty = blocks.column("ids").combine_chunks().flatten().slice(0, 0)
        for g in range(0, len(ranges), at_once):
            a, b = np.searchsorted(at, [g, g + at_once])
            part = blocks.slice(a, b - a).combine_chunks()
            ids = part.column("ids").combine_chunks()
            sizes = ids.value_lengths().to_numpy()
            coded = ids.flatten().dictionary_encode("encode")  # a null id is a row like others
            row, known = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            term, place = np.repeat(part.column("term").to_numpy(), sizes), np.repeat(at[a:b], sizes)
            entry, pos = _spread(term, start)
            query = queries[pos]
            use = asked[place[entry], query]
            entry, query = entry[use], query[use]
            weight = idf[term[entry]] * part.column("impacts").combine_chunks().flatten().to_numpy()[entry]
            found = np.bincount(row[entry] * n_queries + query, weight, known * n_queries).reshape(known, n_queries)
            held = np.concatenate([held, found])
            held = np.partition(held, len(held) - k, axis=0)[len(held) - k :] if len(held) > k else held
            least = held.min(axis=0) - NEAR if len(held) >= k else np.zeros(n_queries)
            x, y = np.nonzero((found > 0) & (found >= least))
            out.append((y, coded.dictionary.take(pa.array(x)), found[x, y]))
        y, names, found = zip(*out) if out else ([np.empty(0, int)], [empty], [np.empty(0)])
        return pa.table({"q": np.concatenate(y).astype(np.int32), "id": pa.chunked_array(names), "score": np.concatenate(found)})

    return score


def _search_block(spark: SparkSession, index: TextIndex, block: DataFrame, kind, k: int, first: int, scored: list[int] | None) -> DataFrame:
    """(query_id, id, score) of a block of queries (query_id, term, bucket): at least the k best rows of each."""
    asks: dict = {}
    for r in block.collect():  # about a block
        asks.setdefault(r["query_id"], []).append((r["bucket"], r["term"]))
    asked = sorted({t for terms_ in asks.values() for t in terms_})
    number = {t: i for i, t in enumerate(asked)}
    names = spark.createDataFrame([(b, t, i) for (b, t), i in number.items()], "bucket int, word string, term int")
    found = read_index(spark, index, block).withColumnRenamed("term", "word").join(F.broadcast(names), ["bucket", "word"])  # at most a block's terms
    run = F.floor(F.col("range") / RUN).alias("run")
    df = np.zeros(len(asked))
    for r in found.groupBy("term").agg(F.sum("rows").alias("df")).collect():
        df[r["term"]] = r["df"]
    idf, n_queries = np.log(1 + (index.n - df + 0.5) / (df + 0.5)), len(asks)
    ends = [[number[t] for t in terms_] for terms_ in asks.values()]
    start, queries = _weighed(ends, idf)
    bounds = write_out(found.select(run, "term", "range", "most").groupBy("run").applyInArrow(_bounds(start, queries, idf, n_queries), "range long, queries array<int>, bounds array<double>"), "bounds")
    each = bounds.select("range", F.explode(F.arrays_zip("queries", "bounds")).alias("b")).select(F.col("b.queries").alias("q"), "range", F.col("b.bounds").alias("bound"))
    early = [(r["q"], r["range"]) for r in top_per_group(each, "q", "bound", first, ("range",)).collect()]  # a few for each query

    def score(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
        blocks = blocks.select(run, "term", "range", "ids", "impacts")
        kinds = f"q int, id {found.schema['ids'].dataType.elementType.simpleString()}, score double"
        rows = blocks.groupBy("run").cogroup(ranges.select(run, "range", "asked").groupBy("run")).applyInArrow(_score_ranges(start, queries, idf, n_queries, k), kinds)
        return rows.groupBy("q", "id").agg(F.sum("score").alias("score"))

    chosen = spark.createDataFrame([(r, [q]) for q, r in early], "range long, asked array<int>")
    some = write_out(score(chosen, found.join(F.broadcast(chosen.select("range").distinct()), "range", "left_semi")), "early")
    kth = np.full(n_queries, -np.inf)
    for r in top_per_group(some, "q", "score", k, ("id",)).filter(F.col("rank") == k).collect():  # one for each query
        kth[r["q"]] = r["score"]
    rest = write_out(bounds.mapInArrow(_left(kth, early), "range long, asked array<int>").filter("size(asked) > 0"), "rest")
    if scored is not None:
        scored += [each.count(), len(early) + (rest.agg(F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()[0])]
    out = some.unionByName(score(rest, found.join(rest.select("range"), "range", "left_semi")))
    query = spark.createDataFrame(list(enumerate(asks)), StructType([StructField("q", IntegerType()), StructField("query_id", kind)]))
    return out.groupBy("q", "id").agg(F.round(F.sum("score"), 6).alias("score")).join(F.broadcast(query), "q").select("query_id", "id", "score")


def indexed_search(spark: SparkSession, index: TextIndex, queries: DataFrame, k: int = 20, first: int = FIRST, buckets: int = BUCKETS, scored: list[int] | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best rows by BM25 of each query (query_id, query), as without an index.

    Queries go in blocks, since a block's terms are sent to every task. ``scored`` gets the number of (query, range) pairs that had a block, and how many of
    them were scored.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term")).distinct()
    wanted = write_out(wanted.withColumn("bucket", _bucket("term", buckets)), "wanted")
    several = -(-wanted.select("query_id").distinct().count() // BLOCK)
    out = None
    for b in range(several):
        block = wanted.filter(F.pmod(F.xxhash64("query_id"), F.lit(several)) == b)
        found = _search_block(spark, index, block, wanted.schema["query_id"].dataType, k, first, scored)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = wanted.select("query_id").join(_stored(spark, index).select(F.explode("ids").alias("id")).limit(0)).withColumn("score", F.lit(0.0)).limit(0)
    return top_per_group(out, "query_id", "score", k, ("id",))

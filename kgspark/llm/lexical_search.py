"""Ranked lexical search: accumulator-limited term-at-a-time scoring.

Documents stay where they were read: each task holds inverted lists of its own documents, in chunks of a
bounded number of postings, and answers every item of a block. An item's terms are taken rarest first. As
long as the terms that are left could still lift an unseen document to the k-th partial score, each posting
opens an accumulator; after that no accumulator is opened, those that cannot reach the k-th score any more
are closed, and the others are updated to the end, so their scores are exact. A chunk starts from the k-th
score of the chunks that the task has done. The k best of each task meet in one window per item.

Two passes: the first writes each document's length and its counts of the terms that are asked for; numbers of
documents, lengths and document frequencies come from that table; the second scores it. Items are asked
in blocks of about ``BLOCK_ITEMS``, since a block's terms are sent to every task.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased.
Weights and scores are whole numbers (see ``weight`` and ``impact``), so runs agree to the last digit.

Defined cases: a null or empty text has no terms, so such a document is never found and such an item finds
nothing; rows of one id are documents (or items) of their own; equal scores are ranked by id, a null id last;
fewer than k documents with a score above 0 give fewer rows; an empty table of either kind gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import bounded_batches, table
from kgspark.sources.scratch import write_out

#: A term in UTF-8: every byte of a character beyond ASCII is at least 80 (hex).
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Items whose terms are held at once, about; postings of a chunk, about.
BLOCK_ITEMS, CHUNK_POSTINGS = 2000, 1_000_000


def terms_of(text: bytes | None) -> list[bytes]:
    return TERM.findall(text.lower()) if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one weight unit of a term adds to the score of a document of n terms that has it tf times."""
    m = 100 - 75 + (75 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): each row's number of terms, and its counts of the terms of the vocabulary by their numbers."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, size, terms, tfs = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = terms_of(text.as_py())
                have = Counter(map(vocabulary.get, found))
                have.pop(None, None)
                n.append(len(found))
                terms += have.keys()
                tfs += have.values()
                size.append(len(terms))
            offsets = pa.array(size, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


class Lists:
    """Inverted lists of a chunk: for each term the documents that have it, ascending, and what it adds to them."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, terms: np.ndarray, docs: np.ndarray, adds: np.ndarray):
        order = np.argsort(terms, kind="stable")
        self.ids, self.null, self.docs, self.adds = ids, null, docs[order], adds[order]
        names, starts = np.unique(terms[order], return_index=True)
        self.at = dict(zip(names.tolist(), zip(starts.tolist(), [*starts.tolist()[1:], len(order)]), strict=True))

    def get(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at.get(term, (0, 0))
        return self.docs[a:b], self.adds[a:b]


def best_of_chunk(query: list[tuple[int, int]], lists: Lists, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the chunk that may be among the k best and score at least ``least``; all of those k are there.

    ``query`` has (term, weight times its occurrences in the item), rarest term first.
    """
    chunk = [(*lists.get(term), w) for term, w in query]
    chunk = [(docs, adds, w) for docs, adds, w in chunk if len(docs)]
    left = sum(w * int(adds.max()) for _, adds, w in chunk)
    score = np.zeros(len(lists.ids), dtype=np.int64)
    done, reached = 0, max(least, 1)
    for docs, adds, w in chunk:
        if left < reached:
            break
        score[docs] += w * adds
        left -= w * int(adds.max())
        done += 1
        if left < score.max() and len(score) >= k:
            reached = max(reached, int(np.partition(score, len(score) - k)[len(score) - k]))
    open_ = np.flatnonzero((score > 0) & (score + left >= reached))
    kept = score[open_]
    for docs, adds, w in chunk[done:]:
        place = np.minimum(np.searchsorted(docs, open_), len(docs) - 1)
        hit = docs[place] == open_
        kept[hit] += w * adds[place[hit]]
    if len(kept) > k:
        enough = kept >= np.partition(kept, len(kept) - k)[len(kept) - k]
        open_, kept = open_[enough], kept[enough]
    fit = kept >= reached
    return open_[fit], kept[fit]


def answer(counted: DataFrame, queries: list[list[tuple[int, int]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): of every task the k best documents for each query, by its number."""

    def merge(best: tuple, ids: np.ndarray, null: np.ndarray, scores: np.ndarray) -> tuple:
        ids, null, scores = (np.concatenate(x) for x in zip(best, (ids, null, scores), strict=True))
        first = np.lexsort((ids, null, -scores))[:k]
        return ids[first], null[first], scores[first]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Lists]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= CHUNK_POSTINGS:
                yield lists_of(held)
                held, size = [], 0
        if held:
            yield lists_of(held)

    def lists_of(held: list[pa.RecordBatch]) -> Lists:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, n, terms, tfs = (rows.column(c).combine_chunks() for c in range(4))
        length = terms.value_lengths().to_numpy(zero_copy_only=False)
        docs = np.repeat(np.arange(len(rows)), length)
        adds = impact(tfs.flatten().to_numpy(), n.to_numpy()[docs], n_docs, n_terms)
        return Lists(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), terms.flatten().to_numpy(), docs, adds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        best = [none] * len(queries)
        for lists in chunks(batches):
            for q, query in enumerate(queries):
                least = int(best[q][2][-1]) if len(best[q][2]) == k else 0
                docs, scores = best_of_chunk(query, lists, k, least)
                if len(docs):
                    best[q] = merge(best[q], lists.ids[docs], lists.null[docs], scores)
        for q, (ids, null, scores) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q), pa.int32()), pa.array(ids, mask=null), pa.array(scores)], ["item", "doc_id", "score"])

    return counted.mapInArrow(score, "item int, doc_id long, score long")


def _search_block(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {term: number for number, term in enumerate(dict.fromkeys(t for _, found in items for t in found))}
    counted = write_out(count_terms(docs, vocabulary), "terms")
    n_docs, n_terms = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect())  # one row a term of the block
    queries = []
    for _, found in items:
        asked = [(df[t], t, qtf) for t, qtf in Counter(vocabulary[x] for x in found).items() if t in df]
        queries.append([(t, qtf * w) for n, t, qtf in sorted(asked) if (w := weight(n_docs, n)) > 0])
    found = answer(counted, queries, n_docs, max(n_terms, 1), k)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(q, key) for q, (key, _) in enumerate(items)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text)."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    blocks = max(1, -(-asked.count() // block_items))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for b in range(blocks):
        rows = [(r["item_id"], terms_of(bytes(r["text"]) if r["text"] is not None else None)) for r in asked.filter(part == b).collect()]  # a block of the query set
        if not rows:
            continue
        found = _search_block(docs, rows, k)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_ranked_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
q AS (SELECT i, item_id, term, count(*) AS qtf FROM (SELECT i, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark)) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS length FROM d),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
x AS (SELECT i, item_id, r, doc_id, sum(qtf * w * ((1000000000::BIGINT * tf) // (1000 * tf + 8 * (100 - 75 + (75::BIGINT * n * docs) // length))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM x WHERE score > 0) WHERE rank <= 10
"""

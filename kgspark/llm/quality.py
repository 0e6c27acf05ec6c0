"""Quality classifier: supervised subword embeddings with a softmax, trained by numpy gradient descent.

A word's features are the hashed word and its hashed character n-grams; a word that repeats the one
before it adds a feature of its own, ``AGAIN_TIMES`` over. A document is the mean of the learned vectors
of all its features, and a softmax over that mean gives its classes. Training reads at
most ``sample_rows`` labelled documents (whole texts), taken in hash order of their ids. Scoring reads
every document; a word's vector enters a score only through one product, which is kept for each word.

Defined cases: a null or empty text has no features and scores as the bias alone; a null label is no
label, repeated labels of an id count as their mean; without labels every score is 0.5; a null id is
never held out and never trained on; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import bounded_batches, hash52, table

BUCKETS, DIM, GRAMS = 1 << 17, 16, (3, 4)
#: Bound on the labelled documents that a model is fitted on.
SAMPLE_ROWS = 3000
THRESHOLD = 0.7
REMEMBERED = 200_000
#: The feature of a repeated word lies behind the hashed ones and counts about as much as a word's n-grams.
AGAIN, AGAIN_TIMES = BUCKETS, 8


def features(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams."""
    raw = f"<{word}>"
    found = [zlib.crc32(raw.encode("utf-8", "surrogatepass")) % BUCKETS]
    for n in GRAMS:
        found += [zlib.crc32(raw[i : i + n].encode("utf-8", "surrogatepass"), n) % BUCKETS for i in range(len(raw) - n + 1)]
    return found


@dataclass
class Model:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def direction(self) -> np.ndarray:
        """What each feature adds to the log odds of class 1, before the mean."""
        return self.vectors @ (self.output[1] - self.output[0])

    def odds_bias(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 1.0, seed: int = 7) -> Model:
    """Gradient descent over (features, their shares, label) rows; the rate falls linearly to 0."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM))
    output, bias = random.normal(0, 0.3, (2, DIM)), np.zeros(2)
    if not rows:
        return Model(vectors, np.zeros((2, DIM)), bias)
    steps, at = epochs * len(rows), 0
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            ids, shares, label = rows[k]
            now = rate * (1 - at / steps)
            at += 1
            mean = shares @ vectors[ids]
            logits = output @ mean + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[label] -= 1
            back = chance @ output
            output -= now * np.outer(chance, mean)
            bias -= 0.1 * now * chance
            # the shares are small numbers; their root keeps the step of each vector at a useful length
            vectors[ids] -= now * np.outer(np.sqrt(shares), back)
    return Model(vectors, output, bias)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on labelled rows outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    marks = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
        .orderBy(hash52(F.col("_id").cast("string")), "_id")
        .limit(sample_rows)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or "").split()
                found = [f for w in words for f in features(w)]
                found += [AGAIN] * (AGAIN_TIMES * sum(map(str.__eq__, words, words[1:])))
                ids, n = np.unique(np.array(found, np.int32), return_counts=True)
                out.append({"id": key, "label": label, "ids": ids.tobytes(), "n": n.astype(np.int32).tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("id", pa.int64()), ("label", pa.int32()), ("ids", pa.binary()), ("n", pa.binary())]))

    # at most sample_rows ids are broadcast, and as many documents come back
    found = docs.select(F.col(id_col).cast("long").alias("_id"), "text").join(F.broadcast(marks), "_id")
    sampled = found.select("_id", "text", "_label").mapInArrow(count, "id long, label int, ids binary, n binary").dropDuplicates(["id"]).collect()
    rows = []
    for r in sorted(sampled, key=lambda r: r["id"]):
        n = np.frombuffer(r["n"], np.int32)
        if len(n):
            rows.append((np.frombuffer(r["ids"], np.int32), n / n.sum(), r["label"]))
    return train(rows)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """(id, score, predicted) of every document; with ``keep`` the columns of the input before them."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.direction(), model.odds_bias()))  # BUCKETS numbers
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")] if keep else [f for f in docs.schema.fields if f.name == id_col]
    names = [f.name for f in kept]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        known: dict[str, int] = {}
        sums, sizes = np.zeros(REMEMBERED), np.zeros(REMEMBERED)
        for batch in batches:
            scores = []
            for text in batch.column("_text").to_pylist():
                words = (text or "").split()
                total = size = 0.0
                last = None
                for at in range(0, len(words), REMEMBERED // 4):
                    some = words[at : at + REMEMBERED // 4]
                    new = dict.fromkeys(w for w in some if w not in known)
                    if len(known) + len(new) > REMEMBERED:
                        known.clear()
                        new = dict.fromkeys(some)
                    for w in new:
                        ids = features(w)
                        k = known[w] = len(known)
                        sums[k], sizes[k] = weights[ids].sum(), len(ids)
                    index = np.fromiter(map(known.__getitem__, some), np.int64, len(some))
                    again = AGAIN_TIMES * (int((index[1:] == index[:-1]).sum()) + (some[0] == last))
                    total, size = total + sums[index].sum() + again * weights[AGAIN], size + sizes[index].sum() + again
                    last = some[-1]
                scores.append(1 / (1 + np.exp(-np.clip(total / max(size, 1) + bias, -60, 60))))
            values = np.array(scores, np.float64)
            added = [pa.array(values), pa.array((values >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + added, names=[*names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*names, F.col("text").alias("_text")).mapInArrow(rate, f"{kinds}, score double, predicted int")


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document; a quarter of the ids is never trained on."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped for reading.

Layout of a folder, for each shard k of the documents in ascending id order:
``ids-k`` document ids (int64), ``tokens-k`` token ids (uint16 where the vocabulary fits, else uint32),
``lengths-k`` tokens of each document (uint64), ``offsets-k`` where each document starts in the whole
corpus (uint64, one more than documents); ``manifest`` is Parquet: shard, n_docs, n_tokens, base, width.
A shard's base is the prefix sum of the token counts of the shards before it.

Tasks write under a name of their own attempt and rename at the end, so a task that runs twice leaves
whole files. The folder must be one that all executors mount.

Defined cases: a null text is empty and gives the end id alone; a null id sorts first and comes back
null; repeated rows are written as often as they come; an empty table gives a manifest without rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.llm.common import bounded_batches, posix, single_thread_tokenizers, table
from kgspark.sources.scratch import new_folder

END_ID = 1
#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 400_000
#: Words of texts that are looked up together, about.
GROUP_WORDS = 100_000
NULL_ID = -(1 << 63)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Recent:
    """word -> bytes of the last one to two times ``REMEMBERED`` words that were new."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def missing(self, words: set[str]) -> list[str]:
        """Makes room, then moves known words to the front; returns the unknown ones."""
        if len(self.now) > REMEMBERED:
            self.now, self.before = {}, self.now
        before, out = self.before, []
        for word in words.difference(self.now):
            found = before.get(word)
            if found is None:
                out.append(word)
            else:
                self.now[word] = found
        return out


#: Texts on which an encoder must agree with its tokenizer before it is used.
PROBES = ("One two, three.", " two  blanks\nand a line ", "don't 12 345 x=y", "\u00e9t\u00e9 \u4e2d\u6587 \ud55c\uad6d", "")


class WordEncoder:
    """Ids of whole texts from a tokenizer whose pieces never reach across white space.

    The tokenizer's normaliser and splitter treat blank-separated words alone, so each distinct word is
    encoded once by the library and a text's ids are those of its words, end to end. New words are encoded
    many at a time, with one of the tokenizer's special tokens between them to tell them apart. A tokenizer
    that differs from this on ``PROBES`` is refused.
    """

    def __init__(self, path: str):
        single_thread_tokenizers()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized and not t.lstrip and not t.rstrip}
        self.special = list(special)
        self.between = special.popitem() if special else None
        self.known = Recent()
        for text, ids in zip(PROBES, self.encode_all(list(PROBES), None), strict=True):
            if ids.tolist() != self.tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"{path} joins pieces across white space; its texts cannot be encoded word by word")

    def _each(self, words: list[str]) -> None:
        for at in range(0, len(words), 1024):
            some = words[at : at + 1024]
            got = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.known.now.update((w, np.array(e.ids, self.dtype).tobytes()) for w, e in zip(some, got, strict=True))

    def _learn(self, words: set[str]) -> None:
        new = self.known.missing(words)
        odd = [] if self.between else new
        if self.between:
            text, mark = self.between
            if any(t in w for t in self.special for w in new):
                odd = [w for w in new if any(t in w for t in self.special)]
                new = list(set(new).difference(odd))
            for at in range(0, len(new), 1024):
                some = new[at : at + 1024]
                ids = np.array(self.tokenizer.encode_batch_fast([text.join(some)], add_special_tokens=False)[0].ids, self.dtype)
                raw, width = ids.tobytes(), self.dtype.itemsize
                ends = [*(np.flatnonzero(ids == mark) * width).tolist(), len(raw)]
                start = 0
                for word, end in zip(some, ends, strict=True):
                    self.known.now[word] = raw[start:end]
                    start = end + width
        self._each(odd)

    def encode_all(self, texts: list[str | None], end_id: int | None = END_ID) -> Iterator[np.ndarray]:
        """Ids of each text, in order; texts are taken in groups of a bounded number of words."""
        end = [] if end_id is None else [np.array([end_id], self.dtype).tobytes()]
        at = 0
        while at < len(texts):
            group, held = [], 0
            while at < len(texts) and held < GROUP_WORDS:
                group.append((texts[at] or "").replace("\n", " ").split(" "))
                held += len(group[-1])
                at += 1
            self._learn(set().union(*group))
            known = self.known.now
            for words in group:
                yield np.frombuffer(b"".join([*map(known.__getitem__, words), *end]), self.dtype)

    def encode(self, text: str | None, end_id: int | None = END_ID) -> np.ndarray:
        return next(self.encode_all([text], end_id))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder: tasks that run in one Python worker share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes the files and returns the manifest as read back."""
    spark = docs.sparkSession
    path, tokenizer = posix(folder), tokenizer or default_tokenizer()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    os.makedirs(path, exist_ok=True)
    bounded_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, context = encoder(tokenizer), TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        names = [f"{path}/{kind}-{shard:06d}" for kind in ("ids", "tokens", "lengths")]
        n_docs = n_tokens = 0
        files = None
        for batch in batches:
            if batch.num_rows and files is None:
                os.makedirs(path, exist_ok=True)
                files = [open(f"{name}.{attempt}", "wb") for name in names]
            for key, ids in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1).to_pylist(), end_id), strict=True):
                for file, values in zip(files, (np.int64(NULL_ID if key is None else key), ids, np.uint64(len(ids))), strict=True):
                    file.write(values.tobytes())
                n_docs, n_tokens = n_docs + 1, n_tokens + len(ids)
        if files:
            for file, name in zip(files, names, strict=True):
                file.close()
                os.replace(file.name, name)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_tokens": [n_tokens], "width": [words.dtype.itemsize]})

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = ordered.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    counts = ordered.mapInArrow(write, "shard long, n_docs long, n_tokens long, width long")
    counts.write.parquet(f"{folder}/counts")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = spark.read.parquet(f"{folder}/counts").withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{path}/offsets-{row['shard']:06d}"
                lengths = np.fromfile(f"{path}/lengths-{row['shard']:06d}", "<u8")
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8") + np.uint64(row["base"])
                mine = f"{name}.{TaskContext.get().taskAttemptId()}"
                offsets.tofile(mine)
                os.replace(mine, name)
            yield batch

    based.repartition(shards).mapInArrow(index, based.schema).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    path = posix(folder)
    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    manifest = spark.read.parquet(f"{folder}/manifest").select("shard", "n_tokens", "width", "n_docs")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, tokens = (
                    np.memmap(f"{path}/{kind}-{row['shard']:06d}", dtype, "r")
                    for kind, dtype in (("ids", "<i8"), ("offsets", "<u8"), ("tokens", f"<u{row['width']}"))
                )
                local = (offsets - offsets[0]).astype(np.int64)
                for at in range(0, len(ids), 256):
                    some = range(at, min(at + 256, len(ids)))
                    found = [np.asarray(tokens[local[i] : local[i + 1]]) for i in some]
                    columns = {
                        id_col: pa.array([None if ids[i] == NULL_ID else int(ids[i]) for i in some], pa.int64()),
                        "start": pa.array([int(offsets[i]) for i in some], pa.int64()),
                        "n_tokens": pa.array([len(x) for x in found], pa.int64()),
                        "ids_crc32": pa.array([crc(x) for x in found], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(width).mapInArrow(read, schema)


def op9_token_ids(spark, sf_dir: str) -> DataFrame:
    """Token files of all documents, written in ascending doc_id order and read back."""
    folder = new_folder(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder)

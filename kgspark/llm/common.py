"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.sources.scratch import write_out

#: Java, RE2 and Python spelling of a word, and of what separates words.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posix(path: str) -> str:
    """The path as files see it; the flat-file formats need a folder that every executor mounts."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"{path} is not a mounted folder; memory-mapped files need one")
    return "/" + path.removeprefix("file:").lstrip("/")


#: Rows up to which a table is broadcast; a larger one is joined by shuffle.
SMALL_ROWS = 200_000


def small(df: DataFrame, name: str, rows: int = SMALL_ROWS) -> DataFrame:
    """Written out; marked for broadcast only where it was counted to be small."""
    table = write_out(df, name)
    if table.count() > rows:
        return table
    marked = F.broadcast(table)
    marked.written_to = table.written_to
    return marked


#: Rows of an Arrow batch, the same for all operators, since plans that run later read the setting then.
BATCH_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Few rows in each Arrow batch, so that very long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def single_thread_tokenizers() -> None:
    """One thread per Python worker; Spark already runs one worker per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as empty. Each word shrinks to one mark, which is then counted."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), rf"{GAP}*+{WORD}+{GAP}*+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def hash52(value: Column) -> Column:
    """A uniform 52-bit integer from the MD5 of a string, the same in Spark and in DuckDB."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 13), 16, 10).cast("long")


HASH52_SQL = "('0x' || substr(md5({}), 1, 13))::BIGINT"

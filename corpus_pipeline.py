"""Corpus pipeline: quality, near duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result to the shared folder before the next one reads it.

Every row is a document of its own in every stage, also where ids are null or repeated: nothing is joined
by id alone. Null texts count as empty. Very long texts are read whole. An empty table gives an empty
result with the same columns. Further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import mixing, ngram_join, packing, quality, secrets
from kgspark.llm.common import n_words, small, table
from kgspark.sources.scratch import drop, write_out

READ = ("doc_id", "text", "source")


def _plain(docs: DataFrame) -> DataFrame:
    """The columns that the operators read under their names, all others under names that no operator uses."""
    return docs.toDF(*[name if name in READ else f"_kept{k}" for k, name in enumerate(docs.columns)])


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, from rows with the names of ``_plain``."""
    return rows.select(*[F.col(plain).alias(name) for plain, name in zip(_plain(docs).columns, docs.columns, strict=True)])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject.

    Empty and null texts are scored like others; equal texts have one score, hence stay or go together.
    """
    rows = _plain(docs)
    model = quality.fit(rows, table(spark, sf_dir, "labels"))
    return _named(quality.score(rows, model, keep=True).filter("predicted = 1"), docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one of least id, a null id last.

    Among rows of that id the one of least row hash stays, and one of equal rows. Texts without words have no
    duplicates: all stay, repeated rows too.
    """
    rows = _plain(docs)
    rows = rows.withColumn("_row", F.xxhash64(*rows.columns))
    found = ngram_join.components(rows, key_col="_row").filter("n_shingles > 0")
    each = write_out(found.groupBy("doc_id", "_row", "component").agg(F.count("*").alias("copies")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    stays = each.groupBy("component").agg(F.min(order).alias("stays"))
    marked = each.join(stays, "component").withColumn("stay", F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("_row") == F.col("stays._row")))
    gone = small(marked.filter("NOT stay OR copies > 1").select(F.col("doc_id").alias("_id"), F.col("_row").alias("_gone"), "stay"), "gone")
    drop(each)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_gone"))
    left = rows.join(gone.drop("stay"), same, "left_anti")
    repeated = gone.filter("stay").drop("stay")
    if repeated.limit(1).count():
        left = left.unionByName(rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_row"]))
    return _named(left, docs)


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the secret scan finds nothing; null and empty texts stay, equal rows stay or go together."""
    rows = _plain(docs)
    found = small(secrets.scan(rows).select(F.col("id").alias("_id"), F.col("h").alias("_hash")).distinct(), "found")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_hash"))
    return _named(rows.join(found, same, "left_anti"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: complete epochs, then the first ones by sampling key.

    A null source is a source of its own; texts without words have size 0 and come with the complete epochs; of
    repeated rows each is taken by itself.
    """
    rows = _plain(docs)
    mixed = mixing.mix_sources(rows, n_words(F.col("text")), mixing.quality_weight(F.col("text")), keep=tuple(c for c in rows.columns if c != "doc_id"))
    copies = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return _named(mixed.filter("copies > 0").withColumn("_copy", F.explode(copies)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place; a null or empty text is its end id alone, every row has its own place."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", drop_secrets),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Learned weights, shingle components and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_out(docs, f"stage{k}")
    return docs

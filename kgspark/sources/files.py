"""Reading and writing documents, artifacts, transcripts and portable graph bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.sources.graph import Graph
from kgspark.sources.scratch import shuffles_let_go

BUNDLE_FORMAT = "graph-bundle/1"
TABLES = ("entities", "projects", "project_collections", "project_directories", "mentions", "relations", "chains", "chain_links", "phases")
PLACEMENT = "directory string, project_name string, unique_id string, collection string, collection_is_new boolean"


def read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(doc_path, title, text) of .md and .txt files, byte order marks removed; and the paths of blank ones."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{md,txt}", recursiveFileLookup=True)
    rows = files.select(F.col("_metadata.file_path").alias("doc_path"), F.regexp_replace("value", "^﻿", "").alias("text"))
    rows = rows.withColumn("title", F.regexp_replace(F.regexp_extract("doc_path", r"([^/]+)$", 1), r"\.[^.]*$", ""))
    blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
    return rows.filter(~blank).select("doc_path", "title", "text"), rows.filter(blank).select("doc_path")


def read_artifacts(spark: SparkSession, folder: str, name: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """One kind of JSON artifact of all project folders below: (project_id, fields…), and (project_id, raw) of broken ones."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=name, recursiveFileLookup=True)
    rows = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("project_id"), F.col("value").alias("raw"))
    parsed = rows.withColumn("v", F.from_json("raw", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("v").isNotNull() & F.col("v._bad").isNull()
    good = parsed.filter(ok).select("project_id", "v.*").drop("_bad")
    return good, parsed.filter(~ok).select("project_id", "raw")


def missing_artifacts(projects: DataFrame, artifacts: DataFrame) -> DataFrame:
    return projects.select("project_id").join(artifacts.select("project_id"), "project_id", "left_anti")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(title, slug, text) of JSON arrays of videos; slugs have at most 50 signs, without one it is video- and the place in its file, from 1."""
    raw = spark.read.text(path, wholetext=True)
    videos = raw.select(F.posexplode(F.from_json("value", "array<struct<title string, transcript string>>")).alias("pos", "v")).select("pos", "v.*")
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 50)
    fallback = F.concat(F.lit("video-"), (F.col("pos") + 1).cast("string"))
    return videos.select("title", F.when(slug == "", fallback).otherwise(slug).alias("slug"), F.col("transcript").alias("text"))


def write_graph(g: Graph, folder: str, mode: str = "errorifexists") -> None:
    """One Parquet table for each part of the graph."""
    for name in TABLES:
        getattr(g, name).write.mode(mode).parquet(f"{folder}/{name}")


def read_graph(spark: SparkSession, folder: str) -> Graph:
    return Graph(**{name: spark.read.parquet(f"{folder}/{name}") for name in TABLES})


def checksum(df: DataFrame) -> DataFrame:
    """(n, checksum): one row that depends on the rows of a table, not on their order."""
    row = F.xxhash64(*[F.to_json(F.struct(F.col(c).alias("v"))) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))


def write_bundle(g: Graph, folder: str) -> DataFrame:
    """Portable bundle: gzipped JSON lines of each table and a manifest (table, n, checksum, format); returns the manifest.

    A table is written and summed before the next one, and its shuffle files are let go."""
    spark, sums = g.entities.sparkSession, []
    for name in TABLES:
        df = getattr(g, name)
        with shuffles_let_go(spark):
            df.write.json(f"{folder}/{name}", ignoreNullFields=False, compression="gzip")
            n, total = checksum(df).first()
        sums.append((name, n, total, BUNDLE_FORMAT, df.schema.json()))
    manifest = spark.createDataFrame(sums, "table string, n long, checksum string, format string, schema string")  # one row per table
    manifest.coalesce(1).write.json(f"{folder}/manifest")
    return manifest


def read_bundle(spark: SparkSession, folder: str) -> tuple[Graph, DataFrame]:
    """The tables of a bundle, and (table, ok) from counts and checksums. Another format is an error."""
    from pyspark.sql.types import StructType

    manifest = {r["table"]: r for r in spark.read.json(f"{folder}/manifest").collect()}  # one row per table
    if any(r["format"] != BUNDLE_FORMAT for r in manifest.values()) or set(manifest) != set(TABLES):
        raise ValueError(f"not a {BUNDLE_FORMAT} bundle")
    import json

    tables = {name: spark.read.schema(StructType.fromJson(json.loads(manifest[name]["schema"]))).json(f"{folder}/{name}") for name in TABLES}
    report = None
    for name, df in tables.items():
        row = checksum(df).select(F.lit(name).alias("table"), ((F.col("n") == manifest[name]["n"]) & (F.col("checksum") == manifest[name]["checksum"])).alias("ok"))
        report = row if report is None else report.unionByName(row)
    return Graph(**tables), report


def read_slug_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dialect that names things by slugs: (entities, mentions, chain links) of a JSON file with entities[].projectRoles and chains[].links."""
    schema = "entities array<struct<slug string, name string, category string, projectRoles array<struct<project string, role string>>>>, chains array<struct<slug string, project string, links array<struct<orderIndex int, source string, target string>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    e = raw.select(F.inline("entities"))
    mentions = e.select(F.col("slug").alias("entity_id"), F.inline("projectRoles")).select("entity_id", F.col("project").alias("project_id"), "role")
    links = raw.select(F.inline("chains")).select(F.col("slug").alias("chain_id"), F.inline("links")).select("chain_id", F.col("orderIndex").alias("order_index"), F.col("source").alias("src"), F.col("target").alias("dst"))
    return e.select(F.col("slug").alias("entity_id"), "name", "category"), mentions, links


def resolve_sources(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, path), (file) -> (project_id, html, missing): the stored path, else the one file named by the project's id; paths with . or .. steps never match."""
    clean = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), "^/+", "")
    safe = projects.withColumn("_p", F.when(~clean.rlike(r"(^|/)\.\.?(/|$)"), clean))
    listed = files.select("file", F.regexp_replace("file", "^/+", "").alias("_p"), F.regexp_extract("file", r"([^/]+)\.html?$", 1).alias("_stem"))
    exact = safe.join(listed.select("_p", F.col("file").alias("_exact")), "_p", "left")
    one = listed.filter("_stem <> ''").groupBy("_stem").agg(F.count("*").alias("c"), F.min("file").alias("_named")).filter("c = 1")
    out = exact.join(one.select(F.col("_stem").alias("project_id"), "_named"), "project_id", "left")
    html = F.when(F.col("_p").isNotNull(), F.coalesce("_exact", "_named"))
    return out.select("project_id", html.alias("html"), html.isNull().alias("missing"))


def write_artifacts(rows: DataFrame, folder: str) -> DataFrame:
    """(collection, project_id, …) rows in a folder per project; projects that are there already are left out and returned."""
    spark = rows.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    have = spark.read.parquet(folder).select(F.col("project_id").cast("string").alias("project_id")).distinct() if there else rows.select("project_id").limit(0)
    new = rows.join(have, "project_id", "left_anti")
    new.write.mode("append").partitionBy("collection", "project_id").parquet(folder)
    return rows.join(have, "project_id", "left_semi")

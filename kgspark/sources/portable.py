"""Bundles of one collection: tables that name things by name, their files with checksums, and a one-document JSON dialect."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EXPORT_FORMAT = "collection-export/1"


@dataclass(frozen=True)
class Bundle:
    """projects(project, name, summary, domain, subdomain, base_tags), entities(name, category, definition, aliases), mentions(
    entity, project, role), relations(rel_id, project, source, target, rel_type, causal, magnitude, evidence_strength, year), chains(
    chain, project, name), chain_links(chain, order_index, source, target), phases(project, phase_index, period), similar(a, b,
    similarity), vectors(name, kind, embedding), missing_sources(project).

    ``project`` is a project's own id; entities go by name. The kind of a vector is entity or project (its name is then the id)."""

    projects: DataFrame
    entities: DataFrame
    mentions: DataFrame
    relations: DataFrame
    chains: DataFrame
    chain_links: DataFrame
    phases: DataFrame
    similar: DataFrame
    vectors: DataFrame
    missing_sources: DataFrame


SECTIONS = tuple(f.name for f in fields(Bundle))


def content_sha256(df: DataFrame) -> DataFrame:
    """(n, sha256): one row that depends on the rows of a table and how often each comes, not on their order.

    SHA-256 of the count and of four sums of 64-bit parts of the rows' own SHA-256, so nothing is sorted or gathered."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)
    rows = df.select(digest.alias("d"))
    lanes = [F.sum(F.conv(F.substring("d", 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    sums = rows.agg(F.count("*").alias("n"), *[F.coalesce(lane, F.lit(0)).cast("string").alias(f"l{i}") for i, lane in enumerate(lanes)])
    return sums.select("n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[f"l{i}" for i in range(4)]).cast("binary"), 256).alias("sha256"))


def write_export(bundle: Bundle, folder: str, collection: str, include_embeddings: bool = True) -> DataFrame:
    """Writes each section, vectors as Parquet and the rest as JSON lines, then the manifest (section, n, sha256, format, collection, schema).

    The manifest comes last: a folder without one is an unfinished export. Without embeddings the vectors are an empty section."""
    manifest = None
    for name in SECTIONS:
        df = getattr(bundle, name)
        if name == "vectors":
            df = df if include_embeddings else df.limit(0)
            df.write.parquet(f"{folder}/{name}")
        else:
            df.write.json(f"{folder}/{name}", ignoreNullFields=False)
        # the sums are of what was written, so a section is computed once
        stored = _read_section(df.sparkSession, folder, name, df.schema)
        row = content_sha256(stored).select(
            F.lit(name).alias("section"), "n", "sha256", F.lit(EXPORT_FORMAT).alias("format"), F.lit(collection).alias("collection"), F.lit(df.schema.json()).alias("schema")
        )
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.coalesce(1).write.json(f"{folder}/manifest")
    return manifest.sparkSession.read.schema(manifest.schema).json(f"{folder}/manifest")


def _read_section(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}") if name == "vectors" else reader.json(f"{folder}/{name}")


def read_export(spark: SparkSession, folder: str) -> tuple[Bundle, DataFrame]:
    """The bundle, and (section, n, ok) from counts and checksums. Another format or a missing section is an error."""
    manifest = {r["section"]: r for r in spark.read.json(f"{folder}/manifest").collect()}  # one row per section
    if set(manifest) != set(SECTIONS) or any(r["format"] != EXPORT_FORMAT for r in manifest.values()):
        raise ValueError(f"not a {EXPORT_FORMAT} export")
    tables = {name: _read_section(spark, folder, name, StructType.fromJson(json.loads(manifest[name]["schema"]))) for name in SECTIONS}
    report = None
    for name, df in tables.items():
        same = (F.col("n") == manifest[name]["n"]) & (F.col("sha256") == manifest[name]["sha256"])
        row = content_sha256(df).select(F.lit(name).alias("section"), "n", same.alias("ok"))
        report = row if report is None else report.unionByName(row)
    return Bundle(**tables), report


# fixed values: the field names of the one-document dialect
GRAPH_DOCUMENT = """
projects array<struct<name string, uniqueId string, projectId string, domain string, subdomain string, summary string, tags array<string>, html_file string,
  temporal_phases array<struct<index int, label string, period string>>>>,
entities array<struct<name string, category string, definition string, role string, aliases array<string>, projects array<string>>>,
relationships array<struct<source string, target string, relType string, causalClassification string, evidenceStrength string, magnitude string, year string, projectId string>>,
causal_chains array<struct<name string, chainId string, project string, projectUniqueId string, links array<struct<source string, target string, order int>>>>,
similar_pairs array<struct<entity1 string, entity2 string, score double>>
"""
VECTOR_DOCUMENT = "embeddings array<struct<name string, type string, embedding array<double>>>"


def read_json_export(spark: SparkSession, folder: str, expected_format: str) -> Bundle:
    """A folder with manifest.json, graph.json and, if it has vectors, embeddings.json: each one JSON document, so read by one task.

    A manifest of another format is an error. A project's id is its uniqueId, else its projectId, else its name. A relation belongs to the project
    of its projectId, a chain to the one of its projectUniqueId, else of its project's name. Vectors of a project's name get its id.
    Missing sources are the projects without html_file."""
    formats = [r["format"] for r in spark.read.schema("format string").json(f"{folder}/manifest.json", multiLine=True).collect()]
    if formats != [expected_format]:
        raise ValueError(f"not a {expected_format} export")
    doc = spark.read.schema(GRAPH_DOCUMENT).json(f"{folder}/graph.json", multiLine=True)
    projects = doc.select(F.inline("projects")).withColumn("project", F.coalesce("uniqueId", "projectId", "name"))
    by_name = projects.groupBy("name").agg(F.min("project").alias("project"))
    by_id = projects.groupBy("projectId").agg(F.min("project").alias("project"))
    entities = doc.select(F.inline("entities"))
    listed = entities.select(F.col("name").alias("entity"), "role", F.explode("projects").alias("name"))
    rel = doc.select(F.posexplode("relationships").alias("pos", "r")).select(F.concat(F.lit("r"), F.col("pos").cast("string")).alias("rel_id"), "r.*")
    chains = doc.select(F.posexplode("causal_chains").alias("pos", "c")).select(F.concat(F.lit("c"), F.col("pos").cast("string")).alias("place"), "c.*").withColumn("chain", F.coalesce("chainId", "place"))
    unique = projects.select(F.col("project").alias("projectUniqueId")).distinct().withColumn("_unique", F.col("projectUniqueId"))
    owned = chains.join(unique, "projectUniqueId", "left").join(by_name.select(F.col("name").alias("_owner"), F.col("project").alias("_named")), F.col("project") == F.col("_owner"), "left")
    links = chains.select("chain", F.posexplode("links").alias("pos", "l")).select("chain", F.coalesce("l.order", "pos").alias("order_index"), "l.source", "l.target")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/embeddings.json")
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        read = spark.read.schema(VECTOR_DOCUMENT).json(f"{folder}/embeddings.json", multiLine=True).select(F.inline("embeddings"))
    else:
        read = spark.createDataFrame([], "name string, type string, embedding array<double>")
    kind = F.when(F.col("type") == "project", "project").otherwise("entity")
    vectors = read.join(by_name, "name", "left").select(F.when(kind == "project", F.coalesce("project", "name")).otherwise(F.col("name")).alias("name"), kind.alias("kind"), "embedding")
    return Bundle(
        projects=projects.select("project", "name", "summary", "domain", "subdomain", F.col("tags").alias("base_tags")),
        entities=entities.select("name", "category", "definition", "aliases"),
        mentions=listed.join(by_name, "name").select("entity", "project", "role"),
        relations=rel.join(by_id, "projectId", "left").select(
            "rel_id", "project", "source", "target", F.col("relType").alias("rel_type"), F.col("causalClassification").alias("causal"), "magnitude",
            F.col("evidenceStrength").alias("evidence_strength"), F.expr("try_cast(year AS int)").alias("year"),
        ),
        chains=owned.select("chain", F.coalesce("_unique", "_named", owned["project"]).alias("project"), owned["name"]),
        chain_links=links,
        phases=projects.select("project", F.inline("temporal_phases")).select("project", F.col("index").alias("phase_index"), "period"),
        similar=doc.select(F.inline("similar_pairs")).select(F.col("entity1").alias("a"), F.col("entity2").alias("b"), F.col("score").alias("similarity")),
        vectors=vectors,
        missing_sources=projects.filter("html_file IS NULL").select("project"),
    )

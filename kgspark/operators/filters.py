"""Searches, filters, facets and integrity checks over graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from kgspark.sources.graph import Graph


def search_rows(df: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Rows with the term, in any case, in one of the columns or in an element of an array column."""
    wanted = F.lit(term.strip().lower())
    hit = F.lit(False)
    for c in columns:
        if isinstance(df.schema[c].dataType, ArrayType):
            hit = hit | F.coalesce(F.exists(c, lambda x: F.lower(x).contains(wanted)), F.lit(False))
        else:
            hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(wanted), F.lit(False))
    return df.filter(hit)


def sort_rows(df: DataFrame, key: str, descending: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Numbers by value, texts by their lower case; nulls last."""
    value = F.lower(key) if df.schema[key].dataType.typeName() == "string" else F.col(key)
    return df.orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last(), *ties)


def filter_view(
    nodes: DataFrame, links: DataFrame, projects: list[str] | None = None, importance: tuple[float, float] = (0, 100),
    categories: list[str] | None = None, tiers: list[str] | None = None, edge_types: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Visible nodes (node_id, projects array, importance, category, tier) and the links between them.

    All conditions must hold; None means any, an empty list of projects hides everything.
    """
    keep = F.col("importance").between(*importance)
    if projects is not None:
        keep = keep & F.arrays_overlap("projects", F.array(*[F.lit(p) for p in projects]).cast("array<string>"))
    if categories is not None:
        keep = keep & F.col("category").isin(categories)
    if tiers is not None:
        keep = keep & F.col("tier").isin(tiers)
    shown = nodes.filter(F.coalesce(keep, F.lit(False)))
    allowed = F.lit(True)
    if projects is not None:
        allowed = allowed & (F.col("project_id").isNull() | F.col("project_id").isin(projects))
    if edge_types is not None:
        allowed = allowed & F.col("rel_type").isin(edge_types)
    ids = shown.select("node_id")
    kept = links.filter(allowed).join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return shown, kept


#: Fixed views: arguments of filter_view by name.
PRESETS = {"overview": {}, "bridges only": {"tiers": ["gold", "silver"]}, "high influence": {"importance": (70, 100)}}


def preset_view(nodes: DataFrame, links: DataFrame, preset: str) -> tuple[DataFrame, DataFrame]:
    return filter_view(nodes, links, **PRESETS[preset])


def facet_counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(facet, value, n): nodes by category and tier, links by type."""
    facets = [(nodes, "category"), (nodes, "tier"), (links, "rel_type")]
    out = None
    for df, c in facets:
        rows = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("facet"), "value", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def browse_tags(projects: DataFrame) -> DataFrame:
    """(level, parent, value, projects): domains, subdomains by domain, base tags."""
    domains = projects.groupBy(F.col("domain").alias("value")).agg(F.count("*").alias("projects")).select(F.lit("domain").alias("level"), F.lit(None).cast("string").alias("parent"), "value", "projects")
    subs = projects.groupBy(F.col("domain").alias("parent"), F.col("subdomain").alias("value")).agg(F.count("*").alias("projects")).select(F.lit("subdomain").alias("level"), "parent", "value", "projects")
    tags = projects.select("project_id", F.explode("base_tags").alias("value")).groupBy("value").agg(F.countDistinct("project_id").alias("projects")).select(F.lit("tag").alias("level"), F.lit(None).cast("string").alias("parent"), "value", "projects")
    return domains.unionByName(subs).unionByName(tags)


def browse_dates(projects: DataFrame, day: str | None = None) -> DataFrame:
    """Projects with their day, newest first, or those of one day."""
    dated = projects.withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    return (dated.filter(F.col("day") == day) if day else dated).orderBy(F.desc("created_at"), "project_id")


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, total)."""
    row = df.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns]))
    return row.select(pairs.alias("p"), "total").select("p.column", "p.filled", "total")


def label_overview(g: Graph) -> DataFrame:
    """(kind, value, n): rows of each table, relations by type."""
    tables = {"entities": g.entities, "projects": g.projects, "mentions": g.mentions, "relations": g.relations, "chains": g.chains, "chain_links": g.chain_links, "phases": g.phases}
    out = g.relations.groupBy(F.col("rel_type").alias("value")).agg(F.count("*").alias("n")).select(F.lit("relation type").alias("kind"), "value", "n")
    for name, df in tables.items():
        out = out.unionByName(df.agg(F.count("*").alias("n")).select(F.lit("table").alias("kind"), F.lit(name).alias("value"), "n"))
    return out


def orphans(g: Graph) -> DataFrame:
    """(kind, id): entities without mentions; phases and chains without a project."""
    lost = g.entities.join(g.mentions, "entity_id", "left_anti").select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"))
    chains = g.chains.join(g.projects, "project_id", "left_anti").select(F.lit("chain").alias("kind"), F.col("chain_id").alias("id"))
    phases = g.phases.join(g.projects, "project_id", "left_anti").select(F.lit("phase").alias("kind"), F.concat_ws("/", "project_id", "phase_index").alias("id"))
    return lost.unionByName(chains).unionByName(phases)


def stub_entities(entities: DataFrame, mark: str = "Imported stub") -> DataFrame:
    """Entities whose definition says that an import made them up."""
    return entities.filter(F.lower("definition").contains(mark.lower()))


def find_by_words(df: DataFrame, columns: list[str], words: list[str]) -> DataFrame:
    """Rows with one of the words in one of the columns, whole words in any case."""
    rx = r"\b(" + "|".join(w.lower() for w in words) + r")\b"
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).rlike(rx), F.lit(False))
    return df.filter(hit)

"""Result sets of an export, chain enrichment, cards, and merging of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.aggregates import bridge_tier, collection_relations, scope_entities
from kgspark.operators.joins import both_ways
from kgspark.operators.rankings import magnitude_rank, top_per_group
from kgspark.sources.graph import Graph


def export_rows(g: Graph, collection: str) -> dict[str, DataFrame]:
    """The result sets of one collection: projects, entities with roles, relations, chain steps, phases."""
    one = g.with_tables(project_collections=g.project_collections.filter(F.col("collection") == collection))
    ids = one.project_collections.select("project_id").distinct()
    mine = lambda df: df.join(ids, "project_id", "left_semi")
    roles = mine(g.mentions).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("project_id", "role"))).alias("roles"))
    return {
        "projects": mine(g.projects),
        "entities": g.entities.join(roles, "entity_id"),
        "relations": collection_relations(one).drop("collection").dropDuplicates(["rel_id"]),
        "chain_links": g.chain_links.join(mine(g.chains).select("chain_id", "project_id", "name"), "chain_id"),
        "phases": mine(g.phases).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("phase_index", "period"))).alias("phases")),
    }


def similar_pairs(similar: DataFrame) -> DataFrame:
    """Each unordered pair once, rounded to three places."""
    return similar.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.round(F.max("similarity"), 3).alias("similarity"))


def identify_projects(extracted: DataFrame, projects: DataFrame) -> DataFrame:
    """extracted (chain, project_id, project_name, …) with the project_id of ``projects``: its own where it is one of theirs, else that of the one project
    with its name. Rows that neither names are left out, and so are those whose name several projects have."""
    known = projects.select("project_id").distinct().withColumn("_known", F.col("project_id"))
    named = projects.groupBy(F.col("name").alias("project_name")).agg(F.countDistinct("project_id").alias("_n"), F.min("project_id").alias("_named")).filter("_n = 1").drop("_n")
    out = extracted.join(known, "project_id", "left").join(named, "project_name", "left").withColumn("project_id", F.coalesce("_known", "_named"))
    return out.filter("project_id IS NOT NULL").select(*extracted.columns)


def enrich_chains(links: DataFrame, extracted: DataFrame) -> DataFrame:
    """(chain, project_id, order_index, source, target): a chain's links are replaced where the extraction has the chain, by name and project."""
    have = extracted.select("chain", "project_id").distinct()
    columns = ["chain", "project_id", "order_index", "source", "target"]
    return links.select(*columns).join(have, ["chain", "project_id"], "left_anti").select(*columns).unionByName(extracted.select(*columns).join(links.select("chain", "project_id").distinct(), ["chain", "project_id"], "left_semi").select(*columns))


def export_summary(g: Graph, k: int = 15) -> DataFrame:
    """Per collection the k entities of most projects, with tier: the head of an export's summary."""
    counts = scope_entities(g).groupBy("collection", "entity_id").agg(F.countDistinct("project_id").alias("projects")).filter("projects >= 2")
    top = top_per_group(counts, "collection", "projects", k)
    return top.withColumn("tier", bridge_tier(F.col("projects")))


def entity_cards(g: Graph, keys: DataFrame) -> DataFrame:
    """(entity_id, name, projects, relations, first_relations): the relations of each key by magnitude, the first five named, and chains touched."""
    ends = both_ways(g.relations, "rel_id", "magnitude").join(keys.select("entity_id"), "entity_id", "left_semi")
    ordered = top_per_group(ends.withColumn("_m", -magnitude_rank(F.col("magnitude"))), "entity_id", "_m", 5, ("rel_id", "direction"))
    first = ordered.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rel_id"))), lambda r: r["rel_id"]), ",").alias("first_relations"))
    n = ends.groupBy("entity_id").agg(F.count("*").alias("relations"))
    chains = g.chain_links.select("chain_id", F.explode(F.array("src", "dst")).alias("entity_id")).distinct().groupBy("entity_id").agg(F.count("*").alias("chains"))
    projects = g.mentions.groupBy("entity_id").agg(F.countDistinct("project_id").alias("projects"))
    out = keys.select("entity_id").distinct().join(g.entities.select("entity_id", "name"), "entity_id")
    for branch in (projects, n, chains, first):
        out = out.join(branch, "entity_id", "left")
    return out.select("entity_id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("projects", "relations", "chains")], F.coalesce("first_relations", F.lit("")).alias("first_relations"))


def expand_one_hop(g: Graph, seeds: DataFrame) -> DataFrame:
    """Seeds and their neighbours, each once."""
    near = both_ways(g.relations).join(seeds.select("entity_id"), "entity_id", "left_semi").select(F.col("other").alias("entity_id"))
    return seeds.select("entity_id").unionByName(near).distinct()


def merge_search(first: DataFrame, second: DataFrame, scope: DataFrame, k: int = 20) -> DataFrame:
    """(name, id, rank): hits of the first list, then of the second, one per name, inside the scope of ids."""
    rows = first.select("id", "name", "rank", F.lit(0).alias("list")).unionByName(second.select("id", "name", "rank", F.lit(1).alias("list")))
    inside = rows.join(scope.select("id").distinct(), "id", "left_semi")
    best = inside.groupBy("name").agg(F.min(F.struct("list", "rank", "id")).alias("b"))
    return best.orderBy("b.list", "b.rank", "name").limit(k).select("name", F.col("b.id").alias("id"), F.col("b.list").alias("list"))


def set_differences(rows: DataFrame, wanted: list[str], column: str = "keys") -> DataFrame:
    """Adds missing and unexpected: the set differences of an array column and a list."""
    names = F.array(*[F.lit(w) for w in wanted])
    return rows.withColumn("missing", F.array_except(names, column)).withColumn("unexpected", F.array_except(column, names))

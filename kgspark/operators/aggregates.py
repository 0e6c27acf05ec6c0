"""Summaries of directories, collections, projects and entities.

Each branch counts on its own and is joined by key afterwards, so no count is fanned out by another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators.rankings import value_counts_upto
from kgspark.sources.graph import Graph

GOLD, SILVER, BRONZE_BETWEENNESS = 3, 2, 1000.0


def scope_entities(g: Graph) -> DataFrame:
    """(collection, entity_id, project_id, role): mentions of each collection's projects."""
    return g.mentions.join(g.project_collections, "project_id").select("collection", "entity_id", "project_id", "role").distinct()


def degrees(g: Graph) -> DataFrame:
    """(entity_id, degree): relation ends at the entity, parallel ones counted; 0 where there is none."""
    ends = g.relations.select(F.explode(F.array("src", "dst")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("degree"))
    return g.entities.select("entity_id").join(ends, "entity_id", "left").select("entity_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def project_counts_of_entities(g: Graph) -> DataFrame:
    return g.mentions.groupBy("entity_id").agg(F.countDistinct("project_id").alias("project_count"))


def entity_metrics(g: Graph) -> DataFrame:
    """(entity_id, name, category, degree, project_count)."""
    counts = project_counts_of_entities(g)
    return (
        g.entities.select("entity_id", "name", "category").join(degrees(g), "entity_id").join(counts, "entity_id", "left")
        .withColumn("project_count", F.coalesce("project_count", F.lit(0)))
    )


def bridge_tier(project_count: Column, betweenness: Column | None = None) -> Column:
    """gold, silver, bronze or none, by projects and, for single-project entities, betweenness."""
    single = (project_count == 1) & (F.coalesce(betweenness, F.lit(0.0)) > BRONZE_BETWEENNESS) if betweenness is not None else F.lit(False)
    return F.when(project_count >= GOLD, "gold").when(project_count == SILVER, "silver").when(single, "bronze").otherwise("none")


def view_tiers(nodes: DataFrame, share: float = 0.9) -> DataFrame:
    """Tiers of a view: bronze at or above the value at position floor(share * n) of single-project entities' betweenness, and above 0."""
    placed = value_counts_upto(nodes.filter("project_count = 1").select("betweenness"), "betweenness")
    exact = placed.filter(F.col("upto") > F.floor(F.col("n") * F.lit(share))).agg(F.min("betweenness").alias("cut"))
    bronze = (F.col("project_count") == 1) & (F.col("betweenness") >= F.col("cut")) & (F.col("betweenness") > 0)
    tier = F.when(F.col("project_count") >= GOLD, "gold").when(F.col("project_count") == SILVER, "silver").when(bronze, "bronze").otherwise("none")
    return nodes.crossJoin(F.broadcast(exact)).withColumn("tier", tier).drop("cut")  # one row


def directory_summary(g: Graph) -> DataFrame:
    """Per directory: distinct projects, collections and entities."""
    pd = g.project_directories
    projects = pd.groupBy("directory").agg(F.countDistinct("project_id").alias("projects"))
    collections = pd.join(g.project_collections, "project_id").groupBy("directory").agg(F.countDistinct("collection").alias("collections"))
    entities = pd.join(g.mentions, "project_id").select("directory", "entity_id").distinct().groupBy("directory").agg(F.count("*").alias("entities"))
    out = projects.join(collections, "directory", "left").join(entities, "directory", "left")
    return out.select("directory", "projects", F.coalesce("collections", F.lit(0)).alias("collections"), F.coalesce("entities", F.lit(0)).alias("entities"))


def collection_list(g: Graph) -> DataFrame:
    """Per collection: projects, entities, first directory."""
    base = g.project_collections.join(g.project_directories, "project_id", "left").groupBy("collection").agg(
        F.countDistinct("project_id").alias("projects"), F.min("directory").alias("directory")
    )
    entities = scope_entities(g).select("collection", "entity_id").distinct().groupBy("collection").agg(F.count("*").alias("entities"))
    return base.join(entities, "collection", "left").select("collection", "projects", F.coalesce("entities", F.lit(0)).alias("entities"), "directory")


def collection_overview(g: Graph) -> DataFrame:
    """Per collection: distinct entities and those in more than one of its projects."""
    per_entity = scope_entities(g).groupBy("collection", "entity_id").agg(F.countDistinct("project_id").alias("n"))
    return per_entity.groupBy("collection").agg(F.count("*").alias("entities"), F.count_if(F.col("n") > 1).alias("bridges"))


def workspace_totals(g: Graph) -> DataFrame:
    """Distinct documents, entities and relations of the whole workspace, one row."""
    parts = [(g.projects, "projects"), (g.entities, "entities"), (g.relations, "relations"), (g.chains, "chains")]
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n") for df, name in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def directory_collections(g: Graph, sample: int = 5) -> DataFrame:
    """Per directory and collection: project and entity counts, tags, and the entities of most projects."""
    members = g.project_directories.join(g.project_collections, "project_id")
    base = members.groupBy("directory", "collection").agg(F.countDistinct("project_id").alias("projects"))
    tags = members.join(g.projects.select("project_id", F.explode("base_tags").alias("tag")), "project_id").groupBy("directory", "collection").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    per_entity = members.join(g.mentions, "project_id").groupBy("directory", "collection", "entity_id").agg(F.countDistinct("project_id").alias("n"))
    order = Window.partitionBy("directory", "collection").orderBy(F.desc("n"), "entity_id")
    best = per_entity.withColumn("rank", F.row_number().over(order))
    entities = best.groupBy("directory", "collection").agg(
        F.count("*").alias("entities"), F.array_sort(F.collect_list(F.when(F.col("rank") <= sample, F.struct("rank", "entity_id")))).alias("best")
    )
    out = base.join(tags, ["directory", "collection"], "left").join(entities, ["directory", "collection"], "left")
    return out.select("directory", "collection", "projects", F.coalesce("entities", F.lit(0)).alias("entities"), F.array_join("tags", ",").alias("tags"), F.array_join(F.col("best.entity_id"), ",").alias("top_entities"))


def project_list(g: Graph) -> DataFrame:
    """Projects with entity count, collections, directory and date."""
    entities = g.mentions.groupBy("project_id").agg(F.countDistinct("entity_id").alias("entities"))
    collections = g.project_collections.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_set("collection")), ",").alias("collections"))
    directories = g.project_directories.groupBy("project_id").agg(F.min("directory").alias("directory"))
    out = g.projects.select("project_id", "name", "created_at").join(entities, "project_id", "left").join(collections, "project_id", "left").join(directories, "project_id", "left")
    return out.select("project_id", "name", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.coalesce("entities", F.lit(0)).alias("entities"), "collections", "directory")


def directory_entities(g: Graph) -> DataFrame:
    """Per directory and entity: projects there, collections, and the tier of its global project count."""
    members = g.mentions.join(g.project_directories, "project_id")
    local = members.groupBy("directory", "entity_id").agg(F.countDistinct("project_id").alias("projects_here"))
    named = members.join(g.project_collections, "project_id").groupBy("directory", "entity_id").agg(F.countDistinct("collection").alias("collections"))
    out = local.join(named, ["directory", "entity_id"], "left").join(project_counts_of_entities(g), "entity_id")
    return out.select("directory", "entity_id", "projects_here", F.coalesce("collections", F.lit(0)).alias("collections"), "project_count", bridge_tier(F.col("project_count")).alias("tier"))


def collection_summary(g: Graph) -> DataFrame:
    """Per collection: projects, entities, relations whose ends are both in scope, chains."""
    scope = scope_entities(g).select("collection", "entity_id").distinct()
    projects = g.project_collections.groupBy("collection").agg(F.countDistinct("project_id").alias("projects"))
    entities = scope.groupBy("collection").agg(F.count("*").alias("entities"))
    relations = collection_relations(g).groupBy("collection").agg(F.countDistinct("rel_id").alias("relations"))
    chains = g.chains.join(g.project_collections, "project_id").groupBy("collection").agg(F.countDistinct("chain_id").alias("chains"))
    out = projects
    for branch in (entities, relations, chains):
        out = out.join(branch, "collection", "left")
    return out.select("collection", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("projects", "entities", "relations", "chains")])


def collection_relations(g: Graph) -> DataFrame:
    """Relations of each collection: owned by one of its projects, both ends mentioned in it."""
    scope = scope_entities(g).select("collection", "entity_id").distinct()
    owned = g.relations.join(g.project_collections, "project_id")
    owned = owned.join(scope.withColumnRenamed("entity_id", "src"), ["collection", "src"], "left_semi")
    return owned.join(scope.withColumnRenamed("entity_id", "dst"), ["collection", "dst"], "left_semi")


def category_breakdown(g: Graph) -> DataFrame:
    """Distinct entities by collection and category, with subtotals and the total (null keys)."""
    members = scope_entities(g).select("collection", "entity_id").distinct().join(g.entities.select("entity_id", "category"), "entity_id")
    return members.rollup("collection", "category").agg(F.countDistinct("entity_id").alias("entities"))


def bridges(g: Graph, least: int = 2) -> DataFrame:
    """Per collection: entities in at least so many of its projects, with tier and connected entities inside those projects."""
    scope = scope_entities(g)
    many = scope.groupBy("collection", "entity_id").agg(F.countDistinct("project_id").alias("projects"), F.array_join(F.array_sort(F.collect_set("project_id")), ",").alias("project_ids")).filter(F.col("projects") >= least)
    inside = scope.join(many.select("collection", "entity_id"), ["collection", "entity_id"]).select("collection", "entity_id", "project_id")
    both = g.relations.select("project_id", F.col("src").alias("entity_id"), F.col("dst").alias("other")).unionByName(g.relations.select("project_id", F.col("dst").alias("entity_id"), F.col("src").alias("other")))
    connected = inside.join(both, ["project_id", "entity_id"]).groupBy("collection", "entity_id").agg(F.countDistinct("other").alias("connected"))
    out = many.join(connected, ["collection", "entity_id"], "left").join(g.entities.select("entity_id", "name"), "entity_id")
    return out.select("collection", "entity_id", "name", "projects", "project_ids", F.coalesce("connected", F.lit(0)).alias("connected"), bridge_tier(F.col("projects")).alias("tier"))


def group_relations(relations: DataFrame) -> DataFrame:
    """Relations by causal family (blank: Other) and type, with how many and the share of established evidence."""
    family = F.coalesce(F.nullif(F.trim("causal"), F.lit("")), F.lit("Other"))
    return relations.groupBy(family.alias("family"), "rel_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("evidence_strength") == "established").cast("double")), 6).alias("established"))


def group_chains(g: Graph) -> DataFrame:
    """Each chain with its steps in order, as one list of entities."""
    steps = g.chain_links.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "src", "dst"))).alias("s"))
    path = F.concat(F.array(F.element_at("s", 1)["src"]), F.col("s.dst"))
    return g.chains.join(steps, "chain_id").select("chain_id", "project_id", "link_count", F.array_join(path, ">").alias("path"))


def timeline(g: Graph, first_appearances: DataFrame) -> DataFrame:
    """Phases in order with how many entities first appear in each; (entity_id, project_id, phase_index) given."""
    first = first_appearances.groupBy("project_id", "phase_index").agg(F.countDistinct("entity_id").alias("entities"))
    return g.phases.join(first, ["project_id", "phase_index"], "left").select("project_id", "phase_index", "period", F.coalesce("entities", F.lit(0)).alias("entities"))


def project_counts(g: Graph) -> DataFrame:
    """Card counts of every project: entities, relations, chains, collections."""
    branches = [
        g.mentions.groupBy("project_id").agg(F.countDistinct("entity_id").alias("entities")),
        g.relations.groupBy("project_id").agg(F.countDistinct("rel_id").alias("relations")),
        g.chains.groupBy("project_id").agg(F.countDistinct("chain_id").alias("chains")),
        g.project_collections.groupBy("project_id").agg(F.countDistinct("collection").alias("collections")),
    ]
    out = g.projects.select("project_id")
    for branch in branches:
        out = out.join(branch, "project_id", "left")
    return out.select("project_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("entities", "relations", "chains", "collections")])


def metrics_report(metrics: DataFrame, names: tuple[str, ...] = ("degree", "project_count")) -> DataFrame:
    """Mean and largest value of each metric."""
    out = None
    for name in names:
        row = metrics.agg(F.lit(name).alias("metric"), F.round(F.avg(name), 6).alias("mean"), F.max(name).cast("double").alias("largest"))
        out = row if out is None else out.unionByName(row)
    return out


def merge_export_rows(rows: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, category, projects array) rows merged by name; relations made distinct."""
    merged = rows.groupBy("name").agg(F.min("category").alias("category"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("projects")))).alias("projects"))
    return merged, relations.dropDuplicates(["src", "dst", "rel_type", "project_id", "evidence_strength"])

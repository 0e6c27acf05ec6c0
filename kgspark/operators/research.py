"""Research analyses: divergence, chains across projects, thematic and temporal gaps, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators.joins import both_ways
from kgspark.sources.graph import Graph


def role_evolution(g: Graph, least: int = 2) -> DataFrame:
    """(entity_id, roles, n_projects, distinct_roles): the roles of entities of several projects, in project order."""
    grouped = g.mentions.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("project_id", "role"))).alias("r"), F.countDistinct("role").alias("distinct_roles"))
    return grouped.filter(F.size("r") >= least).select("entity_id", F.size("r").alias("n_projects"), "distinct_roles", F.array_join(F.col("r.role"), ",").alias("roles"))


def relation_divergence(g: Graph) -> DataFrame:
    """(entity_id, other, rel_type, present, absent): in how many of the entity's projects a relation is stated and in how many not."""
    stated = both_ways(g.relations, "rel_type", "project_id").groupBy("entity_id", "other", "rel_type").agg(F.countDistinct("project_id").alias("present"))
    total = g.mentions.groupBy("entity_id").agg(F.countDistinct("project_id").alias("n"))
    return stated.join(total, "entity_id").select("entity_id", "other", "rel_type", "present", (F.col("n") - F.col("present")).alias("absent")).filter("absent > 0")


def chain_nodes(g: Graph) -> DataFrame:
    return g.chain_links.select("chain_id", F.explode(F.array("src", "dst")).alias("entity_id")).distinct()


def chain_joins(g: Graph) -> DataFrame:
    """(first, second, entity_id): chains of different projects where the first one's last entity is the second one's first."""
    last = g.chain_links.groupBy("chain_id").agg(F.max_by("dst", "order_index").alias("last"), F.min_by("src", "order_index").alias("start")).join(g.chains.select("chain_id", "project_id"), "chain_id")
    a = last.select(F.col("chain_id").alias("first"), F.col("project_id").alias("pa"), F.col("last").alias("entity_id"))
    b = last.select(F.col("chain_id").alias("second"), F.col("project_id").alias("pb"), F.col("start").alias("entity_id"))
    return a.join(b, "entity_id").filter("pa <> pb").select("first", "second", "entity_id")


def short_chains(g: Graph, fewer_than: int = 3) -> DataFrame:
    return g.chains.filter(F.col("link_count") < fewer_than)


def thematic_gaps(g: Graph, below: float = 0.5) -> DataFrame:
    """(collection, tag, entities, share): tags whose entities are under a share of the collection's."""
    tagged = g.project_collections.join(g.projects.select("project_id", F.explode("base_tags").alias("tag")), "project_id").join(g.mentions, "project_id")
    counts = tagged.groupBy("collection", "tag").agg(F.countDistinct("entity_id").alias("entities"))
    total = tagged.groupBy("collection").agg(F.countDistinct("entity_id").alias("n"))
    return counts.join(total, "collection").withColumn("share", F.round(F.col("entities") / F.col("n"), 6)).filter(F.col("share") < below).drop("n")


def temporal_gaps(g: Graph) -> DataFrame:
    """(collection, after, before): month ranges that no phase of the collection covers, between its first and last one.

    A month is its number since year 0; phases are intervals that run on to the longest end seen so far.
    """
    number = lambda c: F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")
    spans = g.phases.join(g.project_collections, "project_id").select("collection", number("period").alias("m")).distinct()
    order = Window.partitionBy("collection").orderBy("m")
    reach = F.max("m").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("after", reach).filter(F.col("m") > F.col("after") + 1).select("collection", "after", F.col("m").alias("before"))


def thin_projects(g: Graph) -> DataFrame:
    """(collection, project_id, entities, mean): projects with fewer entities than their collection's mean."""
    counts = g.project_collections.join(g.mentions.groupBy("project_id").agg(F.countDistinct("entity_id").alias("entities")), "project_id", "left").withColumn("entities", F.coalesce("entities", F.lit(0)))
    mean = F.avg("entities").over(Window.partitionBy("collection"))
    return counts.withColumn("mean", F.round(mean, 6)).filter(F.col("entities") < F.col("mean"))


def missing_counterparts(g: Graph, first: Column, second: Column) -> DataFrame:
    """Entities that meet the first condition and have no neighbour that meets the second one."""
    good = g.entities.filter(second).select(F.col("entity_id").alias("other"))
    have = both_ways(g.relations).join(good, "other", "left_semi").select("entity_id")
    return g.entities.filter(first).join(have, "entity_id", "left_anti").select("entity_id", "name")


def inconsistent_names(g: Graph) -> DataFrame:
    """(name, categories, definitions): names with more than one category or definition."""
    by = g.entities.groupBy("name").agg(F.countDistinct("category").alias("categories"), F.countDistinct("definition").alias("definitions"))
    return by.filter("categories > 1 OR definitions > 1")


def near_names(names: DataFrame, most: int = 2) -> DataFrame:
    """(a, b, distance): all pairs of different names at most so many edits apart.

    A name is cut into most + 1 pieces of about equal length. Of two names at most that many edits apart, one piece of the longer
    one stands unchanged in the other, at a place shifted by at most the difference of edits; so pieces of a given
    number, of a name of a given length, meet equal parts of names of a length near it at the places near theirs. Names of at most ``most``
    letters have empty pieces: they meet all names within reach of their length.
    """
    n = names.select("name").filter("name IS NOT NULL").distinct().withColumn("len", F.length("name"))
    pieces = most + 1
    piece = F.sequence(F.lit(0), F.lit(most))
    starts = lambda i, length: F.floor(i * length / pieces).cast("int")
    long = n.filter(F.col("len") > most)
    index = long.select(F.col("name").alias("a"), F.col("len").alias("size"), F.explode(piece).alias("i")).withColumn("at", starts(F.col("i"), F.col("size"))).withColumn("upto", starts(F.col("i") + 1, F.col("size")))
    index = index.select("a", "size", "i", F.col("at"), F.expr("substring(a, at + 1, upto - at)").alias("part"))
    probes = long.select(F.col("name").alias("b"), "len", F.explode(F.sequence(F.col("len"), F.col("len") + most)).alias("size")).filter(F.col("size") > most)
    probes = probes.withColumn("i", F.explode(piece)).withColumn("at", starts(F.col("i"), F.col("size"))).withColumn("upto", starts(F.col("i") + 1, F.col("size")))
    shift = F.sequence(F.greatest(F.lit(0), F.col("at") - most), F.least(F.col("len") - (F.col("upto") - F.col("at")), F.col("at") + most))
    probes = probes.filter(F.col("len") - (F.col("upto") - F.col("at")) >= F.greatest(F.lit(0), F.col("at") - most)).withColumn("from", F.explode(shift))
    probes = probes.select("b", "size", "i", F.expr("substring(b, from + 1, upto - at)").alias("part")).distinct()
    met = index.join(probes, ["size", "i", "part"]).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tiny = n.filter(F.col("len") <= most).select(F.col("name").alias("x"), F.explode(F.sequence(F.lit(0), F.col("len") + most)).alias("len"))
    short = tiny.join(n.filter(F.col("len") <= 2 * most), "len").filter("x <> name").select(F.least("x", "name").alias("a"), F.greatest("x", "name").alias("b"))
    pairs = met.unionByName(short).distinct()
    return pairs.select("a", "b", F.levenshtein("a", "b").alias("distance")).filter(F.col("distance") <= most)


def chain_crossings(g: Graph) -> DataFrame:
    """(entity_id, chains, projects): entities that chains of two projects or more pass through."""
    placed = chain_nodes(g).join(g.chains.select("chain_id", "project_id"), "chain_id")
    return placed.groupBy("entity_id").agg(F.countDistinct("chain_id").alias("chains"), F.countDistinct("project_id").alias("projects")).filter("projects >= 2")


def crossed_chains(g: Graph) -> DataFrame:
    """(chain_id, project_id, entities, meetings): chains that share entities with chains of other projects; meetings are counted for each shared entity.

    A chain meets, at an entity, all chains there less those of its own project, so no pair of chains is listed."""
    placed = chain_nodes(g).join(g.chains.select("chain_id", "project_id"), "chain_id")
    own = placed.groupBy("entity_id", "project_id").agg(F.count("*").alias("_own"))
    every = own.groupBy("entity_id").agg(F.sum("_own").alias("_all"))
    others = own.join(every, "entity_id").select("entity_id", "project_id", (F.col("_all") - F.col("_own")).alias("_others")).filter("_others > 0")
    met = placed.join(others, ["entity_id", "project_id"])
    return met.groupBy("chain_id", "project_id").agg(F.count("*").alias("entities"), F.sum("_others").alias("meetings"))


def year_gaps(g: Graph) -> DataFrame:
    """(collection, after, before): years that neither a relation nor a phase of the collection covers, between its first and last one.

    A relation covers its year; a phase the years from the least to the largest number of four digits in its period, nothing without one."""
    years = F.transform(F.regexp_extract_all("period", F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))
    phases = g.phases.select("project_id", years.alias("y")).filter(F.size("y") > 0).select("project_id", F.array_min("y").alias("start"), F.array_max("y").alias("end"))
    relations = g.relations.filter("year IS NOT NULL").select("project_id", F.col("year").cast("int").alias("start"), F.col("year").cast("int").alias("end"))
    # one row for a first year: as many rows as there are years
    spans = phases.unionByName(relations).join(g.project_collections, "project_id").groupBy("collection", "start").agg(F.max("end").alias("end"))
    reach = F.max("end").over(Window.partitionBy("collection").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("after", reach).filter(F.col("start") > F.col("after") + 1).select("collection", "after", F.col("start").alias("before"))


def sparse_projects(g: Graph) -> DataFrame:
    """(collection, project_id, density, mean): projects with fewer relations for each entity than their collection's mean; without entities it is 0."""
    entities = g.mentions.groupBy("project_id").agg(F.countDistinct("entity_id").alias("e"))
    relations = g.relations.groupBy("project_id").agg(F.count("*").alias("r"))
    counts = g.project_collections.join(entities, "project_id", "left").join(relations, "project_id", "left")
    dense = counts.select("collection", "project_id", F.when(F.col("e") > 0, F.coalesce("r", F.lit(0)) / F.col("e")).otherwise(0.0).alias("density"))
    means = dense.groupBy("collection").agg(F.avg("density").alias("mean"))
    return dense.join(means, "collection").select("collection", "project_id", F.round("density", 6).alias("density"), F.round("mean", 6).alias("mean")).filter("density < mean")


def uneven_bridges(g: Graph) -> DataFrame:
    """(entity_id, projects, least, most): entities of two projects or more whose relations are not equally many in each of them."""
    ends = g.relations.select("project_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("entity_id")).groupBy("project_id", "entity_id").agg(F.count("*").alias("r"))
    placed = g.mentions.select("entity_id", "project_id").distinct().join(ends, ["project_id", "entity_id"], "left").withColumn("r", F.coalesce("r", F.lit(0)))
    spread = placed.groupBy("entity_id").agg(F.count("*").alias("projects"), F.min("r").alias("least"), F.max("r").alias("most"))
    return spread.filter("projects >= 2 AND most > least")

"""Registered set-based changes of the order graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import build as M
from kgspark.plans.summaries import _graph_query

LAST = ", ur AS (SELECT DISTINCT project_id FROM pc WHERE collection = (SELECT max(collection) FROM pc))\n"


def _last(g):
    last = g.project_collections.agg(F.max("collection").alias("collection"))
    return g.project_collections.join(F.broadcast(last), "collection", "left_semi").select("project_id").distinct()


_graph_query(
    "resolve_entities", lambda g: M.resolve_entities(g.entities.filter("category = 'Brand#11'").select(F.concat("name", F.lit(" new")).alias("name"), F.array("name").alias("aliases")), g.entities.filter("category <> 'Brand#11'").withColumn("aliases", F.array().cast("array<string>"))).select("name", F.when(~F.col("is_new"), F.col("entity_id")).alias("entity_id"), "is_new"),
    """, nw AS (SELECT DISTINCT name || ' new' AS name, name AS alias FROM entities WHERE category = 'Brand#11')
    SELECT nw.name, min(e.entity_id) AS entity_id, min(e.entity_id) IS NULL AS is_new FROM nw LEFT JOIN entities e ON e.category <> 'Brand#11' AND e.name IN (nw.name, nw.alias) GROUP BY nw.name""",
)
_graph_query("resolve_closure", lambda g: M.resolve_closure(g.entities.withColumn("aliases", F.array().cast("array<string>"))), "SELECT entity_id, min(entity_id) OVER (PARTITION BY name) AS canonical FROM entities")
_graph_query(
    "upsert_projects", lambda g: M.upsert(g.projects.select("project_id", "name", "domain"), _last(g).select("project_id", F.lit("renamed").alias("name")).unionByName(_last(g).select(F.concat(F.lit("x"), "project_id").alias("project_id"), F.lit("added").alias("name"))), "project_id")[0].groupBy("name", "domain").agg(F.count("*").alias("n")).filter("n > 1 OR name = 'added'"),
    LAST + """, up AS (SELECT CASE WHEN ur.project_id IS NULL THEN name ELSE 'renamed' END AS name, domain FROM projects LEFT JOIN ur USING (project_id) UNION ALL SELECT 'added', NULL FROM ur)
    SELECT name, domain, count(*) AS n FROM up GROUP BY ALL HAVING count(*) > 1 OR name = 'added'""",
)
_graph_query(
    "upsert_mentions", lambda g: M.upsert_mentions(g.mentions, g.mentions.join(_last(g), "project_id", "left_semi").select("entity_id", "project_id", F.lit("new").alias("role"), F.lit(1).alias("seq")))[0].groupBy("role").agg(F.count("*").alias("n")),
    LAST + "SELECT CASE WHEN ur.project_id IS NULL THEN role ELSE 'new' END AS role, count(*) AS n FROM mentions LEFT JOIN ur USING (project_id) GROUP BY 1",
)


def _named_relations(g):
    names = g.entities.select("entity_id", F.col("entity_id").alias("name"))
    raw = g.relations.select(F.col("src").alias("source"), F.when(F.col("year") % 2 == 0, F.col("dst")).otherwise(F.lit("nobody")).alias("target"), "rel_id", F.lit(None).cast("string").alias("magnitude"), F.lit(None).cast("string").alias("evidence_strength"))
    return M.append_relations(raw, names)


_graph_query("append_relations", lambda g: _named_relations(g)[0].select("rel_id", "src", "dst", "magnitude", "evidence_strength"), "SELECT rel_id, src, dst, 'significant' AS magnitude, 'established' AS evidence_strength FROM relations WHERE year % 2 = 0")
_graph_query("unresolved_relations", lambda g: _named_relations(g)[1].groupBy("missing").agg(F.count("*").alias("n")), "SELECT 'target' AS missing, count(*) AS n FROM relations WHERE year % 2 <> 0 HAVING count(*) > 0")
_graph_query("merge_relations", lambda g: M.merge_relations(g.relations.filter("year % 2 = 0"), g.relations.filter("year % 2 <> 0")).select("rel_id", "src", "dst", "rel_type"), "SELECT rel_id, src, dst, rel_type FROM relations QUALIFY row_number() OVER (PARTITION BY src, dst, rel_type ORDER BY year % 2 <> 0, rel_id) = 1")


def _chains(g):
    links = g.chain_links.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("order_index", F.col("src").alias("source"), F.col("dst").alias("target")))).alias("links"))
    raw = g.chains.select("chain_id", "project_id", "name").join(links, "chain_id").drop("chain_id")
    return M.append_chains(raw, g.entities.filter("category <> 'Brand#11'").select("entity_id", F.col("entity_id").alias("name")))


_graph_query(
    "append_chains", lambda g: _chains(g)[0].select("project_id", "link_count"),
    """SELECT c.project_id, count(s.entity_id) FILTER (t.entity_id IS NOT NULL) AS link_count FROM chains c JOIN chain_links l USING (chain_id)
    LEFT JOIN entities s ON s.entity_id = l.src AND s.category <> 'Brand#11' LEFT JOIN entities t ON t.entity_id = l.dst AND t.category <> 'Brand#11' GROUP BY c.project_id, c.chain_id""",
)
_graph_query(
    "link_first_appearance", lambda g: M.link_first_appearance(g.mentions.select("entity_id", "project_id", F.length("role").alias("first_appearance_index")), g.phases).groupBy("phase_index").agg(F.count("*").alias("n")),
    "SELECT length(role)::INT AS phase_index, count(*) AS n FROM mentions m JOIN phases p ON p.project_id = m.project_id AND p.phase_index = length(role) GROUP BY 1",
)
_graph_query(
    "change_membership", lambda g: M.change_membership(g.project_collections, _last(g).select("project_id", F.lit("extra").alias("collection"), F.lit("add").alias("op")).unionByName(g.project_collections.withColumn("op", F.lit("remove"))))[0].groupBy("collection").agg(F.count("*").alias("n")),
    LAST + "SELECT CASE WHEN ur.project_id IS NULL THEN collection ELSE 'extra' END AS collection, count(*) AS n FROM pc LEFT JOIN ur USING (project_id) GROUP BY 1",
)
_graph_query(
    "delete_directories", lambda g: M.delete_empty_directories(g.project_directories.select("directory").distinct(), g.project_directories.filter("directory <> 'BUILDING'"), g.project_directories.select("directory").distinct())[1],
    "SELECT DISTINCT directory, directory = 'BUILDING' AS deleted FROM project_directories",
)
_graph_query("delete_collections", lambda g: M.delete_collections(g, g.project_collections.filter("collection >= '1998-01'").select("collection").distinct())[1], "SELECT project_id FROM pc GROUP BY project_id HAVING min(collection) >= '1998-01'")
_graph_query(
    "delete_projects_report", lambda g: M.delete_projects(g, _last(g))[1],
    LAST + """, dm AS (SELECT DISTINCT entity_id FROM mentions JOIN ur USING (project_id))
    SELECT 'projects' AS kind, count(*) AS n FROM projects JOIN ur USING (project_id) UNION ALL SELECT 'mentions', count(*) FROM mentions JOIN ur USING (project_id) UNION ALL SELECT 'relations', count(*) FROM relations JOIN ur USING (project_id)
    UNION ALL SELECT 'chains', count(*) FROM chains JOIN ur USING (project_id) UNION ALL SELECT 'phases', count(*) FROM phases JOIN ur USING (project_id) UNION ALL SELECT 'chain_links', count(*) FROM chain_links JOIN chains USING (chain_id) JOIN ur USING (project_id)
    UNION ALL SELECT 'entities', count(*) FROM dm WHERE entity_id NOT IN (SELECT entity_id FROM mentions WHERE project_id NOT IN (SELECT project_id FROM ur))""",
)
_graph_query("delete_projects", lambda g: M.delete_projects(g, _last(g))[0].relations.groupBy("rel_type").agg(F.count("*").alias("n")), LAST + "SELECT rel_type, count(*) AS n FROM relations WHERE project_id NOT IN (SELECT project_id FROM ur) GROUP BY 1")
_graph_query(
    "dedupe_collections", lambda g: M.dedupe_collections(g.project_collections.select(F.col("collection").alias("collection_id"), F.substring("collection", 1, 4).alias("name")).distinct(), g.project_collections.withColumnRenamed("collection", "collection_id"))[1].groupBy("collection_id").agg(F.count("*").alias("n")),
    ", k AS (SELECT substr(collection, 1, 4) AS y, min(collection) AS keep FROM pc GROUP BY 1) SELECT keep AS collection_id, count(DISTINCT project_id) AS n FROM pc JOIN k ON y = substr(collection, 1, 4) GROUP BY 1",
)
_graph_query("purge", lambda g: M.purge(g.entities, g.mentions, F.col("name").startswith("small"))[1].groupBy("role").agg(F.count("*").alias("n")), "SELECT role, count(*) AS n FROM mentions JOIN entities USING (entity_id) WHERE name NOT LIKE 'small%' GROUP BY 1")
_graph_query(
    "import_entities", lambda g: M.import_entities(g.entities.filter("category < 'Brand#2'"), g.relations.select(F.col("src").alias("name")), g.entities.limit(0)).groupBy("stub", "category").agg(F.count("*").alias("n")),
    """, b AS (SELECT * FROM entities WHERE category < 'Brand#2') SELECT false AS stub, category, count(*) AS n FROM b GROUP BY 2
    UNION ALL SELECT true, 'Other', count(DISTINCT src) FROM relations WHERE src NOT IN (SELECT name FROM b)""",
)
_graph_query(
    "import_conflicts", lambda g: M.import_conflicts(g.with_tables(projects=g.projects.filter("domain = '1-URGENT'")), g),
    "SELECT 'projects' AS kind, count(DISTINCT name) AS n FROM projects WHERE domain = '1-URGENT' UNION ALL SELECT 'entities', count(DISTINCT name) FROM entities UNION ALL SELECT 'collections', count(DISTINCT collection) FROM pc",
)
_graph_query(
    "merge_attributes", lambda g: M.merge_attributes(g.entities.select("entity_id", F.when(F.col("category") == "Brand#11", "").otherwise(F.col("name")).alias("name"), F.length("name").alias("n")), g.entities.select("entity_id", F.lit("imported").alias("name"), F.lit(9).alias("n"))),
    "SELECT entity_id, CASE WHEN category = 'Brand#11' THEN 'imported' ELSE name END AS name, greatest(length(name), 9)::INT AS n FROM entities",
)
_graph_query(
    "verify_import", lambda g: M.verify_import({"entities": g.entities, "relations": g.relations, "projects": g.projects}, {"entities": g.entities.filter("category <> 'Brand#11'"), "relations": g.relations, "projects": g.projects}),
    """SELECT 'entities' AS "table", count(*) AS expected, count(*) FILTER (category <> 'Brand#11') AS actual, count(*) = count(*) FILTER (category <> 'Brand#11') AS complete FROM entities
    UNION ALL SELECT 'relations', count(*), count(*), true FROM relations UNION ALL SELECT 'projects', count(*), count(*), true FROM projects""",
)

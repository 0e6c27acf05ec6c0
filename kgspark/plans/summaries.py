"""Registered summaries of the order graph, each with its SQL."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from kgspark.operators import aggregates as A
from kgspark.registry import register
from kgspark.sources.graph import ORDER_SQL, order_graph


def _graph_query(name: str, operator, sql: str | None = None):
    where = sys._getframe(1).f_globals["__name__"]
    register(name, ORDER_SQL + sql if sql else None, where)(lambda spark, sf_dir: operator(order_graph(spark, sf_dir)))


TIER = "CASE WHEN {0} >= 3 THEN 'gold' WHEN {0} = 2 THEN 'silver' ELSE 'none' END"

_graph_query("scope_entities", A.scope_entities, "SELECT collection, entity_id, project_id, role FROM scoped")
_graph_query("degrees", A.degrees, "SELECT entity_id, degree FROM degrees")
_graph_query("entity_metrics", A.entity_metrics, "SELECT entity_id, name, category, degree, project_count FROM metrics")
_graph_query(
    "directory_summary",
    A.directory_summary,
    """SELECT directory, count(DISTINCT project_id) AS projects, count(DISTINCT collection) AS collections, count(DISTINCT entity_id) AS entities
    FROM project_directories LEFT JOIN pc USING (project_id) LEFT JOIN mentions USING (project_id) GROUP BY directory""",
)
_graph_query(
    "collection_list",
    A.collection_list,
    """SELECT collection, count(DISTINCT project_id) AS projects, count(DISTINCT entity_id) AS entities, min(directory) AS directory
    FROM pc LEFT JOIN project_directories USING (project_id) LEFT JOIN mentions USING (project_id) GROUP BY collection""",
)
_graph_query(
    "collection_overview",
    A.collection_overview,
    """SELECT collection, count(*) AS entities, count(*) FILTER (n > 1) AS bridges
    FROM (SELECT collection, entity_id, count(DISTINCT project_id) AS n FROM scoped GROUP BY ALL) GROUP BY collection""",
)
_graph_query(
    "workspace_totals",
    A.workspace_totals,
    """SELECT 'projects' AS kind, count(*) AS n FROM projects UNION ALL SELECT 'entities', count(*) FROM entities
    UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'chains', count(*) FROM chains""",
)
_graph_query(
    "directory_collections",
    A.directory_collections,
    """, mem AS (SELECT * FROM project_directories JOIN pc USING (project_id)),
    pe AS (SELECT directory, collection, entity_id, count(DISTINCT project_id) AS n FROM mem JOIN mentions USING (project_id) GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY directory, collection ORDER BY n DESC, entity_id) AS rank FROM pe),
    en AS (SELECT directory, collection, count(*) AS entities, string_agg(entity_id, ',' ORDER BY rank) FILTER (rank <= 5) AS top_entities FROM rk GROUP BY ALL),
    tg AS (SELECT directory, collection, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT directory, collection, unnest(base_tags) AS tag FROM mem JOIN projects USING (project_id)) GROUP BY ALL)
    SELECT directory, collection, count(DISTINCT project_id) AS projects, coalesce(any_value(entities), 0) AS entities, any_value(tags) AS tags, any_value(top_entities) AS top_entities
    FROM mem LEFT JOIN tg USING (directory, collection) LEFT JOIN en USING (directory, collection) GROUP BY directory, collection""",
)
_graph_query(
    "project_list",
    A.project_list,
    """SELECT p.project_id, p.name, strftime(created_at, '%Y-%m-%d') AS created,
    coalesce((SELECT count(DISTINCT entity_id) FROM mentions m WHERE m.project_id = p.project_id), 0) AS entities,
    (SELECT string_agg(DISTINCT collection, ',' ORDER BY collection) FROM pc WHERE pc.project_id = p.project_id) AS collections,
    (SELECT min(directory) FROM project_directories d WHERE d.project_id = p.project_id) AS directory FROM projects p""",
)
_graph_query(
    "directory_entities",
    A.directory_entities,
    f"""SELECT directory, entity_id, count(DISTINCT project_id) AS projects_here, count(DISTINCT collection) AS collections, any_value(project_count) AS project_count,
    {TIER.format('any_value(project_count)')} AS tier FROM mentions JOIN project_directories USING (project_id) LEFT JOIN pc USING (project_id) JOIN counts USING (entity_id) GROUP BY directory, entity_id""",
)
IN_SCOPE = """, sc AS (SELECT DISTINCT collection, entity_id FROM scoped),
    cr AS (SELECT collection, r.* FROM relations r JOIN pc USING (project_id) JOIN sc a USING (collection) JOIN sc b USING (collection) WHERE a.entity_id = r.src AND b.entity_id = r.dst)
"""
_graph_query("collection_relations", lambda g: A.collection_relations(g).select("collection", "rel_id", "src", "dst", "rel_type"), IN_SCOPE + "SELECT collection, rel_id, src, dst, rel_type FROM cr")
_graph_query(
    "collection_summary",
    A.collection_summary,
    IN_SCOPE
    + """SELECT collection, projects, coalesce(entities, 0) AS entities, coalesce(relations, 0) AS relations, coalesce(chains, 0) AS chains
    FROM (SELECT collection, count(DISTINCT project_id) AS projects FROM pc GROUP BY 1)
    LEFT JOIN (SELECT collection, count(*) AS entities FROM sc GROUP BY 1) USING (collection)
    LEFT JOIN (SELECT collection, count(DISTINCT rel_id) AS relations FROM cr GROUP BY 1) USING (collection)
    LEFT JOIN (SELECT collection, count(DISTINCT chain_id) AS chains FROM chains JOIN pc USING (project_id) GROUP BY 1) USING (collection)""",
)
_graph_query(
    "category_breakdown",
    A.category_breakdown,
    "SELECT collection, category, count(DISTINCT entity_id) AS entities FROM scoped JOIN entities USING (entity_id) GROUP BY ROLLUP (collection, category)",
)
BRIDGES = f""", many AS (SELECT collection, entity_id, count(DISTINCT project_id) AS projects, string_agg(DISTINCT project_id, ',' ORDER BY project_id) AS project_ids
      FROM scoped GROUP BY ALL HAVING count(DISTINCT project_id) >= 2),
    ends AS (SELECT project_id, src AS entity_id, dst AS other FROM relations UNION ALL SELECT project_id, dst, src FROM relations),
    con AS (SELECT s.collection, s.entity_id, count(DISTINCT other) AS connected FROM scoped s JOIN many USING (collection, entity_id) JOIN ends e ON s.project_id = e.project_id AND s.entity_id = e.entity_id GROUP BY ALL),
    br AS (SELECT collection, m.entity_id, name, projects, project_ids, coalesce(connected, 0) AS connected, {TIER.format('projects')} AS tier
      FROM many m LEFT JOIN con USING (collection, entity_id) JOIN entities USING (entity_id))
"""
_graph_query("bridges", A.bridges, BRIDGES + "SELECT * FROM br")
_graph_query(
    "group_relations",
    lambda g: A.group_relations(g.relations),
    "SELECT coalesce(nullif(trim(causal), ''), 'Other') AS family, rel_type, count(*) AS n, round(avg((evidence_strength = 'established')::INT), 6) AS established FROM relations GROUP BY ALL",
)
_graph_query(
    "group_chains",
    A.group_chains,
    """SELECT chain_id, project_id, any_value(link_count) AS link_count, any_value(first_src) || '>' || string_agg(dst, '>' ORDER BY order_index) AS path
    FROM chains JOIN (SELECT *, first_value(src) OVER (PARTITION BY chain_id ORDER BY order_index) AS first_src FROM chain_links) USING (chain_id) GROUP BY chain_id, project_id""",
)


def _first_appearances(g):
    """Each entity of a project in the first phase it is mentioned in: here its lowest chain position, as the phase index, where there is such a phase."""
    ends = g.chain_links.select("chain_id", "order_index", F.col("src").alias("entity_id"))
    return ends.join(g.chains.select("chain_id", "project_id"), "chain_id").groupBy("entity_id", "project_id").agg(F.min("order_index").alias("phase_index"))


_graph_query(
    "timeline",
    lambda g: A.timeline(g, _first_appearances(g)),
    """, fa AS (SELECT src AS entity_id, project_id, min(order_index) AS phase_index FROM chain_links JOIN chains USING (chain_id) GROUP BY ALL)
    SELECT project_id, phase_index, period, count(DISTINCT entity_id) AS entities FROM phases LEFT JOIN fa USING (project_id, phase_index) GROUP BY ALL""",
)
_graph_query(
    "project_counts",
    A.project_counts,
    """SELECT p.project_id, coalesce(e.n, 0) AS entities, coalesce(r.n, 0) AS relations, coalesce(c.n, 0) AS chains, coalesce(o.n, 0) AS collections FROM projects p
    LEFT JOIN (SELECT project_id, count(DISTINCT entity_id) AS n FROM mentions GROUP BY 1) e USING (project_id)
    LEFT JOIN (SELECT project_id, count(DISTINCT rel_id) AS n FROM relations GROUP BY 1) r USING (project_id)
    LEFT JOIN (SELECT project_id, count(DISTINCT chain_id) AS n FROM chains GROUP BY 1) c USING (project_id)
    LEFT JOIN (SELECT project_id, count(DISTINCT collection) AS n FROM pc GROUP BY 1) o USING (project_id)""",
)
_graph_query(
    "metrics_report",
    lambda g: A.metrics_report(A.entity_metrics(g)),
    """SELECT 'degree' AS metric, round(avg(degree), 6) AS mean, max(degree)::DOUBLE AS largest FROM metrics
    UNION ALL SELECT 'project_count', round(avg(project_count), 6), max(project_count)::DOUBLE FROM metrics""",
)


def _export_rows(g):
    rows = g.mentions.join(g.entities.select("entity_id", "name", "category"), "entity_id").select("name", "category", F.array("project_id").alias("projects"))
    merged, _ = A.merge_export_rows(rows, g.relations)
    return merged.select("name", "category", F.size("projects").alias("n_projects"), F.array_join("projects", ",").alias("project_ids"))


_graph_query(
    "merge_export_entities",
    _export_rows,
    """SELECT name, min(category) AS category, count(DISTINCT project_id) AS n_projects, string_agg(DISTINCT project_id, ',' ORDER BY project_id) AS project_ids
    FROM mentions JOIN entities USING (entity_id) GROUP BY name""",
)
_graph_query(
    "merge_export_relations",
    lambda g: A.merge_export_rows(g.mentions.select(F.col("entity_id").alias("name"), F.lit("").alias("category"), F.array("project_id").alias("projects")), g.relations)[1].groupBy("project_id").agg(F.count("*").alias("relations")),
    """SELECT project_id, count(*) AS relations FROM (SELECT DISTINCT src, dst, rel_type, project_id, evidence_strength FROM relations) GROUP BY 1""",
)

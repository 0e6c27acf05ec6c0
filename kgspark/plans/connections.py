"""Registered views, profiles and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import aggregates as A
from kgspark.operators import joins as J
from kgspark.plans.summaries import IN_SCOPE, _graph_query
from kgspark.sources.scratch import write_out


def _suggested(g):
    """Degrees and related pairs come from relations that are derived once."""
    g = g.with_tables(relations=write_out(g.relations.select("src", "dst"), "relations"))
    return J.suggest_links(g, A.degrees(g).select("entity_id", F.col("degree").alias("score")), g.projects, 10.0)


_graph_query(
    "collection_graph", lambda g: J.collection_graph(g),
    IN_SCOPE + "SELECT collection, entity_id, dst AS target, rel_id, rel_type FROM sc LEFT JOIN (SELECT collection, src AS entity_id, dst, rel_id, rel_type FROM cr) USING (collection, entity_id)",
)
_graph_query(
    "project_graph", J.project_graph,
    """SELECT m.project_id, m.entity_id, target, rel_id FROM mentions m LEFT JOIN (SELECT r.project_id, src AS entity_id, dst AS target, rel_id FROM relations r JOIN mentions t ON t.project_id = r.project_id AND t.entity_id = r.dst) r
    ON m.project_id = r.project_id AND m.entity_id = r.entity_id""",
)
_graph_query(
    "bridge_graph", J.bridge_graph,
    IN_SCOPE + """, mn AS (SELECT collection, entity_id FROM scoped GROUP BY ALL HAVING count(DISTINCT project_id) >= 2)
    SELECT mn.collection, mn.entity_id, dst AS target, rel_id FROM mn LEFT JOIN (SELECT cr.* FROM cr JOIN mn t ON t.collection = cr.collection AND t.entity_id = cr.dst) x ON x.collection = mn.collection AND x.src = mn.entity_id""",
)
_graph_query("membership_edges", lambda g: A.scope_entities(g).groupBy("collection", "role").agg(F.count("*").alias("n")), "SELECT collection, role, count(*) AS n FROM scoped GROUP BY ALL")
ENDS = ", en AS (SELECT src AS entity_id, dst AS other, 'out' AS direction FROM relations UNION ALL SELECT dst, src, 'in' FROM relations)\n"
_graph_query(
    "entity_profiles",
    lambda g: J.entity_profiles(g).select("entity_id", "name", "category", F.array_join("project_ids", ",").alias("project_ids"), "n_out", "n_in", F.array_join("others", ",").alias("others"), F.array_join("chain_ids", ",").alias("chain_ids")),
    ENDS + """SELECT entity_id, name, category, coalesce(ps, '') AS project_ids, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(os, '') AS others, coalesce(cs, '') AS chain_ids FROM entities
    LEFT JOIN (SELECT entity_id, string_agg(DISTINCT project_id, ',' ORDER BY project_id) AS ps FROM mentions GROUP BY 1) USING (entity_id)
    LEFT JOIN (SELECT entity_id, count(*) FILTER (direction = 'out') AS n_out, count(*) FILTER (direction = 'in') AS n_in, string_agg(DISTINCT other, ',' ORDER BY other) AS os FROM en GROUP BY 1) USING (entity_id)
    LEFT JOIN (SELECT entity_id, string_agg(DISTINCT chain_id, ',' ORDER BY chain_id) AS cs FROM (SELECT src AS entity_id, chain_id FROM chain_links UNION ALL SELECT dst, chain_id FROM chain_links) GROUP BY 1) USING (entity_id)""",
)
_graph_query(
    "project_profiles",
    lambda g: J.project_profiles(g).select("project_id", "name", F.array_join("entity_ids", ",").alias("entity_ids"), F.array_join(F.transform("phases", lambda p: F.concat_ws("=", p["phase_index"].cast("string"), p["period"])), ",").alias("phases"), F.array_join("chain_ids", ",").alias("chain_ids"), F.array_join("collections", ",").alias("collections"), F.array_join("directories", ",").alias("directories")),
    """SELECT project_id, name, es AS entity_ids, ps AS phases, cs AS chain_ids, os AS collections, ds AS directories FROM projects
    LEFT JOIN (SELECT project_id, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS es FROM mentions GROUP BY 1) USING (project_id)
    LEFT JOIN (SELECT project_id, string_agg(phase_index || '=' || period, ',' ORDER BY phase_index) AS ps FROM phases GROUP BY 1) USING (project_id)
    LEFT JOIN (SELECT project_id, string_agg(DISTINCT chain_id, ',' ORDER BY chain_id) AS cs FROM chains GROUP BY 1) USING (project_id)
    LEFT JOIN (SELECT project_id, string_agg(DISTINCT collection, ',' ORDER BY collection) AS os FROM pc GROUP BY 1) USING (project_id)
    LEFT JOIN (SELECT project_id, string_agg(DISTINCT directory, ',' ORDER BY directory) AS ds FROM project_directories GROUP BY 1) USING (project_id)""",
)


def _asked(g):
    """A stated query set: every 20th project."""
    return g.projects.filter(F.substring("project_id", 2, 20).cast("long") % 20 == 0)


SHARED = ", sh AS (SELECT a.project_id AS p1, b.project_id AS p2, a.entity_id FROM (SELECT * FROM mentions WHERE substr(project_id, 2)::BIGINT % 20 = 0) a JOIN mentions b ON a.entity_id = b.entity_id AND a.project_id <> b.project_id)\n"
_graph_query("shared_entities", lambda g: J.shared_entities(g, _asked(g)).groupBy("p1", "p2").agg(F.count("*").alias("shared")), SHARED + "SELECT p1, p2, count(*) AS shared FROM sh GROUP BY ALL")
_graph_query(
    "related_projects", lambda g: J.related_projects(g, _asked(g)).select("p1", "p2", "shared", F.array_join("entity_ids", ",").alias("entity_ids"), "rank"),
    SHARED + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p1 ORDER BY shared DESC, p2) AS rank
      FROM (SELECT p1, p2, count(DISTINCT entity_id) AS shared, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS entity_ids FROM sh GROUP BY ALL)) WHERE rank <= 10""",
)
_graph_query(
    "recommend_projects", lambda g: J.recommend_projects(g, g.project_collections.select("collection").distinct()),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY shared DESC, project_id) AS rank FROM (
      SELECT s.collection, m.project_id, count(DISTINCT m.entity_id) AS shared FROM (SELECT DISTINCT collection, entity_id FROM scoped) s JOIN mentions m USING (entity_id)
      LEFT JOIN pc o ON o.project_id = m.project_id AND o.collection = s.collection WHERE o.project_id IS NULL GROUP BY ALL)) WHERE rank <= 10""",
)
_graph_query(
    "suggest_collections", lambda g: J.suggest_collections(g, g.entities.filter("category = 'Brand#11'").select("name")),
    """SELECT collection, count(DISTINCT entity_id) AS matches, count(DISTINCT project_id) AS projects FROM scoped WHERE entity_id IN (SELECT entity_id FROM entities WHERE name IN (SELECT name FROM entities WHERE category = 'Brand#11'))
    GROUP BY collection ORDER BY matches DESC, collection LIMIT 5""",
)
_graph_query(
    "search_collections_by_project", lambda g: J.search_collections(g, "BUILDING", "order 12"),
    """SELECT collection, count(DISTINCT p.project_id) AS matches FROM pc JOIN project_directories d USING (project_id) JOIN projects p USING (project_id) WHERE directory = 'BUILDING' AND lower(p.name) LIKE '%order 12%' GROUP BY collection""",
)
_graph_query(
    "search_collections_by_entity", lambda g: J.search_collections(g, None, "a", "entity"),
    "SELECT collection, count(DISTINCT entity_id) AS matches FROM scoped JOIN entities USING (entity_id) WHERE lower(name) LIKE '%a%' GROUP BY collection",
)
_graph_query(
    "suggest_links", _suggested,
    """, gd AS (SELECT project_id, entity_id, degree AS score FROM mentions JOIN degrees USING (entity_id) WHERE degree > 10),
    jn AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM relations)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, a, b) AS rank FROM (
      SELECT x.project_id, x.entity_id AS a, y.entity_id AS b, x.score + y.score AS score FROM gd x JOIN gd y ON x.project_id = y.project_id AND x.entity_id < y.entity_id
      LEFT JOIN jn ON jn.a = x.entity_id AND jn.b = y.entity_id WHERE jn.a IS NULL)) WHERE rank <= 20""",
)
_graph_query(
    "typed_pairs", lambda g: J.typed_pairs(g, F.col("category") == "Brand#11", F.col("category") == "Brand#22"),
    ENDS + "SELECT DISTINCT en.entity_id AS a, other AS b FROM en JOIN entities x ON x.entity_id = en.entity_id JOIN entities y ON y.entity_id = other WHERE x.category = 'Brand#11' AND y.category = 'Brand#22'",
)
_graph_query(
    "compare_neighbors", lambda g: J.compare_neighbors(g, g.entities.filter("category = 'Brand#11'")),
    ENDS + """, nr AS (SELECT DISTINCT entity_id, other FROM en WHERE entity_id <> other), dg AS (SELECT entity_id, count(*) AS d FROM nr GROUP BY 1),
    rl AS (SELECT entity_id, other, count(*) AS relations FROM en GROUP BY ALL),
    fc AS (SELECT nr.* FROM nr JOIN entities USING (entity_id) WHERE category = 'Brand#11'),
    sd AS (SELECT f.entity_id, f.other, count(*) AS shared FROM fc f JOIN nr x ON x.entity_id = f.entity_id JOIN nr y ON y.entity_id = f.other AND y.other = x.other GROUP BY ALL)
    SELECT f.entity_id, f.other, relations, coalesce(shared, 0) AS shared, dg.d - coalesce(shared, 0) AS own FROM fc f JOIN rl USING (entity_id, other) LEFT JOIN sd USING (entity_id, other) JOIN dg ON dg.entity_id = f.other""",
)
_graph_query("project_bridges", lambda g: J.project_bridges(g, g.projects), "SELECT project_id, entity_id, project_count - 1 AS other_projects FROM mentions JOIN counts USING (entity_id) WHERE project_count > 1")
_graph_query(
    "explain_pairs", lambda g: J.explain_pairs(g, g.relations.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()),
    """, pr AS (SELECT DISTINCT src AS a, dst AS b FROM relations),
    fw AS (SELECT src AS a, dst AS b, count(*) AS n FROM relations GROUP BY ALL),
    sp AS (SELECT pr.a, pr.b, count(DISTINCT x.project_id) AS n FROM pr JOIN mentions x ON x.entity_id = a JOIN mentions y ON y.entity_id = b AND y.project_id = x.project_id GROUP BY ALL)
    SELECT pr.a, pr.b, coalesce(f.n, 0) AS forward, coalesce(r.n, 0) AS backward, coalesce(sp.n, 0) AS projects, coalesce(f.n, 0) + coalesce(r.n, 0) > 0 AS connected
    FROM pr LEFT JOIN fw f ON f.a = pr.a AND f.b = pr.b LEFT JOIN fw r ON r.a = pr.b AND r.b = pr.a LEFT JOIN sp ON sp.a = pr.a AND sp.b = pr.b""",
)
_graph_query(
    "view_nodes", lambda g: J.build_view(g)[0].select("node_id", "kind", "name", "category", F.size("projects").alias("n_projects")),
    "SELECT entity_id AS node_id, 'entity' AS kind, name, category, coalesce(project_count, 0)::INT AS n_projects FROM metrics UNION ALL SELECT project_id, 'project', name, NULL, 1 FROM projects",
)
_graph_query(
    "view_links", lambda g: J.build_view(g)[1],
    """SELECT min(rel_id) AS rel_id, src, dst, rel_type, project_id FROM relations GROUP BY src, dst, rel_type, causal, project_id
    UNION ALL SELECT 'm-' || entity_id || '-' || project_id, entity_id, project_id, 'MENTIONED_IN', project_id FROM mentions""",
)

#: The view of the collection of one month, by the graph of its projects.
IN_VIEW = """, vp AS (SELECT project_id FROM pc WHERE collection = '1995-03'), ve AS (SELECT entity_id, count(*) AS n FROM mentions WHERE project_id IN (SELECT project_id FROM vp) GROUP BY 1 HAVING count(*) >= {least}),
vr AS (SELECT min(rel_id) AS rel_id, src, dst, rel_type, project_id FROM relations WHERE project_id IN (SELECT project_id FROM vp) AND src IN (SELECT entity_id FROM ve) AND dst IN (SELECT entity_id FROM ve) GROUP BY src, dst, rel_type, causal, project_id)
"""
VIEW_LINKS = """SELECT rel_id, src, dst, rel_type, project_id FROM vr
UNION ALL SELECT 'm-' || entity_id || '-' || project_id, entity_id, project_id, 'MENTIONED_IN', project_id FROM mentions WHERE project_id IN (SELECT project_id FROM vp) AND entity_id IN (SELECT entity_id FROM ve)"""
_graph_query(
    "collection_view_nodes", lambda g: J.load_collection_view(g, "1995-03")[0].select("node_id", "kind", "name", "category", F.size("projects").alias("n_projects")),
    IN_VIEW.format(least=1) + "SELECT entity_id AS node_id, 'entity' AS kind, name, category, n::INT AS n_projects FROM ve JOIN entities USING (entity_id) UNION ALL SELECT project_id, 'project', name, NULL, 1 FROM projects WHERE project_id IN (SELECT project_id FROM vp)",
)
_graph_query("collection_view_links", lambda g: J.load_collection_view(g, "1995-03")[1], IN_VIEW.format(least=1) + VIEW_LINKS)
_graph_query("bridge_view_links", lambda g: J.load_bridge_view(g, "1995-03")[1], IN_VIEW.format(least=2) + VIEW_LINKS)

"""Registered rankings, filters, facets and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import aggregates as A
from kgspark.operators import filters as V
from kgspark.operators import rankings as W
from kgspark.plans.summaries import TIER, _graph_query

_graph_query("entity_importance", lambda g: W.importance_ranking(A.entity_metrics(g), "degree", 20), "SELECT * FROM metrics ORDER BY degree DESC, name, entity_id LIMIT 20")
_graph_query(
    "top_per_category",
    lambda g: W.top_per_group(A.entity_metrics(g), "category", "degree", 3),
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY degree DESC, entity_id) AS rank FROM metrics) WHERE rank <= 3",
)
_graph_query(
    "structural_bridges",
    lambda g: A.entity_metrics(g).filter("degree >= 50").orderBy(F.desc("degree"), "name", "entity_id").limit(20),
    "SELECT * FROM metrics WHERE degree >= 50 ORDER BY degree DESC, name, entity_id LIMIT 20",
)
COMPOSITE = """, rg AS (SELECT min(degree)::DOUBLE AS dl, max(degree)::DOUBLE AS dh, max(project_count)::DOUBLE AS ph FROM metrics),
    cw AS (SELECT m.*, round(0.0::DOUBLE + 0.20::DOUBLE * ((degree::DOUBLE - dl) / CASE WHEN dh - dl = 0 THEN 1.0::DOUBLE ELSE dh - dl END)
      + 0.20::DOUBLE * ((project_count::DOUBLE - 1.0) / CASE WHEN ph - 1.0 = 0 THEN 1.0::DOUBLE ELSE ph - 1.0::DOUBLE END), 9) AS importance_raw FROM metrics m, rg),
    ci AS (SELECT *, floor(100.0::DOUBLE * (count(*) OVER (ORDER BY importance_raw RANGE UNBOUNDED PRECEDING)) / (count(*) OVER ()) + 0.5)::BIGINT AS importance FROM cw)
"""
_graph_query("composite_importance", lambda g: W.composite_importance(A.entity_metrics(g)), COMPOSITE + "SELECT * FROM ci")
_graph_query(
    "size_levels",
    lambda g: W.composite_importance(A.entity_metrics(g)).select("entity_id", W.size_level(F.col("importance")).alias("level"), W.radius(F.col("importance")).alias("radius")),
    COMPOSITE + """SELECT entity_id, lv AS level, [4, 6, 8, 11, 15, 20][lv + 1] AS radius FROM
      (SELECT entity_id, (importance >= 20)::INT + (importance >= 40)::INT + (importance >= 60)::INT + (importance >= 80)::INT + (importance >= 95)::INT AS lv FROM ci)""",
)
_graph_query(
    "percentile_rank",
    lambda g: W.percentile_rank(A.entity_metrics(g).select("entity_id", "degree"), "degree"),
    "SELECT entity_id, degree, round((rank() OVER (ORDER BY degree) - 1) / count(*) OVER ()::DOUBLE, 6) AS share_below FROM metrics",
)
_graph_query(
    "parallel_edges",
    lambda g: W.parallel_edges(g.relations.select("rel_id", "src", "dst")),
    """SELECT rel_id, src, dst, round((row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY rel_id) - 1
      - (count(*) OVER (PARTITION BY least(src, dst), greatest(src, dst)) - 1) / 2.0) * 0.2, 6)::DOUBLE AS curvature FROM relations""",
)
_graph_query(
    "top_entities_of_collections",
    lambda g: W.top_per_group(A.scope_entities(g).select("collection", "entity_id").distinct().join(A.entity_metrics(g), "entity_id"), "collection", "degree", 10).select("collection", "entity_id", "name", "degree", "rank"),
    """SELECT * FROM (SELECT collection, entity_id, name, degree, row_number() OVER (PARTITION BY collection ORDER BY degree DESC, entity_id) AS rank
      FROM (SELECT DISTINCT collection, entity_id FROM scoped) JOIN metrics USING (entity_id)) WHERE rank <= 10""",
)
_graph_query(
    "relations_by_magnitude",
    lambda g: g.relations.select("project_id", "rel_id", "magnitude", F.row_number().over(W.Window.partitionBy("project_id").orderBy(W.magnitude_rank(F.col("magnitude")), "rel_id")).alias("position")),
    """SELECT project_id, rel_id, magnitude, row_number() OVER (PARTITION BY project_id ORDER BY CASE magnitude WHEN 'foundational' THEN 0 WHEN 'significant' THEN 1 WHEN 'marginal' THEN 2 ELSE 3 END, rel_id) AS position FROM relations""",
)
_graph_query("search_rows", lambda g: V.search_rows(g.entities, ["name", "definition", "aliases"], "widget").select("entity_id", "name"), "SELECT entity_id, name FROM entities WHERE lower(name) LIKE '%widget%' OR lower(definition) LIKE '%widget%'")
_graph_query(
    "sort_rows",
    lambda g: V.sort_rows(A.entity_metrics(g), "name", ties=("entity_id",)).select("entity_id", "name"),
    "SELECT entity_id, name FROM metrics ORDER BY lower(name), entity_id",
)


def _view(g):
    """Nodes and links of the whole graph."""
    projects = g.mentions.groupBy("entity_id").agg(F.array_sort(F.collect_set("project_id")).alias("projects"))
    nodes = W.composite_importance(A.entity_metrics(g)).join(projects, "entity_id", "left")
    return nodes.withColumnRenamed("entity_id", "node_id").withColumn("tier", A.bridge_tier(F.col("project_count"))), g.relations


VIEW = COMPOSITE + f""", vw AS (SELECT ci.*, {TIER.format('project_count')} AS tier FROM ci)
"""
_graph_query(
    "filter_view_nodes",
    lambda g: V.filter_view(*_view(g), importance=(40, 90), tiers=["gold"])[0].select("node_id", "category", "importance", "tier"),
    VIEW + "SELECT entity_id AS node_id, category, importance, tier FROM vw WHERE importance BETWEEN 40 AND 90 AND tier = 'gold'",
)
_graph_query(
    "filter_view_links",
    lambda g: V.filter_view(*_view(g), importance=(40, 90), edge_types=["O"])[1].select("rel_id", "src", "dst"),
    VIEW + """, ok AS (SELECT entity_id FROM vw WHERE importance BETWEEN 40 AND 90)
    SELECT rel_id, src, dst FROM relations WHERE rel_type = 'O' AND src IN (SELECT entity_id FROM ok) AND dst IN (SELECT entity_id FROM ok)""",
)
_graph_query(
    "preset_high_influence",
    lambda g: V.preset_view(*_view(g), "high influence")[1].groupBy("rel_type").agg(F.count("*").alias("n")),
    VIEW + """, ok AS (SELECT entity_id FROM vw WHERE importance BETWEEN 70 AND 100)
    SELECT rel_type, count(*) AS n FROM relations WHERE src IN (SELECT entity_id FROM ok) AND dst IN (SELECT entity_id FROM ok) GROUP BY 1""",
)
_graph_query(
    "facet_counts",
    lambda g: V.facet_counts(*_view(g)),
    VIEW + "SELECT 'category' AS facet, category AS value, count(*) AS n FROM vw GROUP BY 2 UNION ALL SELECT 'tier', tier, count(*) FROM vw GROUP BY 2 UNION ALL SELECT 'rel_type', rel_type, count(*) FROM relations GROUP BY 2",
)
_graph_query(
    "browse_tags",
    lambda g: V.browse_tags(g.projects),
    """SELECT 'domain' AS level, NULL::VARCHAR AS parent, domain AS value, count(*) AS projects FROM projects GROUP BY domain
    UNION ALL SELECT 'subdomain', domain, subdomain, count(*) FROM projects GROUP BY domain, subdomain
    UNION ALL SELECT 'tag', NULL, tag, count(DISTINCT project_id) FROM (SELECT project_id, unnest(base_tags) AS tag FROM projects) GROUP BY tag""",
)
_graph_query("browse_dates", lambda g: V.browse_dates(g.projects).groupBy("day").agg(F.count("*").alias("projects")), "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS projects FROM projects GROUP BY 1")
_graph_query(
    "coverage",
    lambda g: V.coverage(g.entities.join(A.project_counts_of_entities(g), "entity_id", "left"), ["name", "category", "definition", "project_count"]),
    """, cv AS (SELECT * FROM entities LEFT JOIN counts USING (entity_id))
    SELECT 'name' AS "column", count(name) AS filled, count(*) AS total FROM cv UNION ALL SELECT 'category', count(category), count(*) FROM cv
    UNION ALL SELECT 'definition', count(definition), count(*) FROM cv UNION ALL SELECT 'project_count', count(project_count), count(*) FROM cv""",
)
_graph_query(
    "label_overview",
    V.label_overview,
    "SELECT 'relation type' AS kind, rel_type AS value, count(*) AS n FROM relations GROUP BY 2"
    + "".join(f" UNION ALL SELECT 'table', '{t}', count(*) FROM {t}" for t in ("entities", "projects", "mentions", "relations", "chains", "chain_links", "phases")),
)
_graph_query(
    "orphans",
    V.orphans,
    """SELECT 'entity' AS kind, entity_id AS id FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM mentions)
    UNION ALL SELECT 'chain', chain_id FROM chains WHERE project_id NOT IN (SELECT project_id FROM projects)
    UNION ALL SELECT 'phase', project_id || '/' || phase_index FROM phases WHERE project_id NOT IN (SELECT project_id FROM projects)""",
)
_graph_query("stub_entities", lambda g: V.stub_entities(g.entities, "economy").select("entity_id", "definition"), "SELECT entity_id, definition FROM entities WHERE lower(definition) LIKE '%economy%'")
_graph_query("find_by_words", lambda g: V.find_by_words(g.entities, ["name", "definition"], ["ring", "bolt"]).select("entity_id"), r"SELECT entity_id FROM entities WHERE regexp_matches(lower(name), '\b(ring|bolt)\b') OR regexp_matches(lower(definition), '\b(ring|bolt)\b')")
_graph_query(
    "dead_ends",
    lambda g: g.relations.select(F.col("dst").alias("entity_id")).join(g.relations.select(F.col("src").alias("entity_id")), "entity_id", "left_anti").withColumn("kind", F.lit("sink"))
    .unionByName(g.relations.select(F.col("src").alias("entity_id")).join(g.relations.select(F.col("dst").alias("entity_id")), "entity_id", "left_anti").withColumn("kind", F.lit("source"))).distinct(),
    """SELECT DISTINCT dst AS entity_id, 'sink' AS kind FROM relations WHERE dst NOT IN (SELECT src FROM relations)
    UNION SELECT src, 'source' FROM relations WHERE src NOT IN (SELECT dst FROM relations)""",
)

"""Registered export result sets, cards and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import aggregates as A
from kgspark.operators import exports as E
from kgspark.operators.neighbors import nearest_lists
from kgspark.operators.search import similar_by_embedding
from kgspark.operators import filters as V
from kgspark.operators.build import quick_ingest
from kgspark.plans.networks import SIMILAR, _similar
from kgspark.plans.summaries import TIER, _graph_query
from kgspark.registry import register
from kgspark.sources.graph import read_table

MONTH = "1995-03"
ONE = f", one AS (SELECT project_id FROM pc WHERE collection = '{MONTH}')\n"
_graph_query(
    "export_entities", lambda g: E.export_rows(g, MONTH)["entities"].select("entity_id", "name", F.array_join(F.transform("roles", lambda r: F.concat_ws("=", r["project_id"], r["role"])), ",").alias("roles")),
    ONE + "SELECT entity_id, name, string_agg(project_id || '=' || role, ',' ORDER BY project_id) AS roles FROM mentions JOIN one USING (project_id) JOIN entities USING (entity_id) GROUP BY entity_id, name",
)
_graph_query(
    "export_relations", lambda g: E.export_rows(g, MONTH)["relations"].select("rel_id", "src", "dst"),
    ONE + "SELECT rel_id, src, dst FROM relations JOIN one USING (project_id) WHERE src IN (SELECT entity_id FROM mentions JOIN one USING (project_id)) AND dst IN (SELECT entity_id FROM mentions JOIN one USING (project_id))",
)
_graph_query("export_chain_links", lambda g: E.export_rows(g, MONTH)["chain_links"].select("chain_id", "order_index", "src", "dst"), ONE + "SELECT chain_id, order_index, src, dst FROM chain_links JOIN chains USING (chain_id) JOIN one USING (project_id)")
_graph_query(
    "export_phases", lambda g: E.export_rows(g, MONTH)["phases"].select("project_id", F.array_join("phases.period", ",").alias("periods")),
    ONE + "SELECT project_id, string_agg(period, ',' ORDER BY phase_index) AS periods FROM phases JOIN one USING (project_id) GROUP BY 1",
)
_graph_query("similar_pairs", lambda g: E.similar_pairs(_similar(g)), SIMILAR + "SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(similarity), 3) AS similarity FROM ns GROUP BY 1, 2")


def _named_links(g):
    return g.chain_links.join(g.chains.select("chain_id", "project_id"), "chain_id").select(F.col("chain_id").alias("chain"), "project_id", "order_index", F.col("src").alias("source"), F.col("dst").alias("target"))


_graph_query(
    "enrich_chains", lambda g: E.enrich_chains(_named_links(g), _named_links(g).filter("order_index = 0").withColumn("target", F.lit("replaced"))),
    "SELECT chain_id AS chain, project_id, order_index, src AS source, 'replaced' AS target FROM chain_links JOIN chains USING (chain_id) WHERE order_index = 0",
)
def _told(g):
    """Chains as an extraction tells them: odd years' projects by id, the others by name only."""
    odd = F.year("created_at") % 2 == 1
    p = g.projects.select("project_id", F.when(odd, F.col("project_id")).otherwise("unknown").alias("told"), F.col("name").alias("project_name"))
    return _named_links(g).join(p, "project_id").filter("order_index > 0").select("chain", F.col("told").alias("project_id"), "project_name", "order_index", "source", F.lit("replaced").alias("target"))


_graph_query(
    "enrich_chains_by_name", lambda g: E.enrich_chains(_named_links(g), E.identify_projects(_told(g), g.projects)),
    """, lk AS (SELECT chain_id AS chain, project_id, order_index, src AS source, dst AS target, max(order_index) OVER (PARTITION BY chain_id) AS last FROM chain_links JOIN chains USING (chain_id))
    SELECT chain, project_id, order_index, source, CASE WHEN last > 0 THEN 'replaced' ELSE target END AS target FROM lk WHERE order_index > 0 OR last = 0""",
)
_graph_query(
    "export_summary", E.export_summary,
    f"SELECT *, {TIER.format('projects')} AS tier FROM (SELECT collection, entity_id, count(DISTINCT project_id) AS projects, row_number() OVER (PARTITION BY collection ORDER BY count(DISTINCT project_id) DESC, entity_id) AS rank FROM scoped GROUP BY collection, entity_id HAVING count(DISTINCT project_id) >= 2) WHERE rank <= 15",
)
_graph_query(
    "entity_cards", lambda g: E.entity_cards(g, g.entities.filter("category = 'Brand#11'")),
    """, en AS (SELECT src AS entity_id, rel_id, magnitude, 'out' AS direction FROM relations UNION ALL SELECT dst, rel_id, magnitude, 'in' FROM relations),
    rk AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CASE magnitude WHEN 'foundational' THEN 0 WHEN 'significant' THEN 1 WHEN 'marginal' THEN 2 ELSE 3 END, rel_id, direction) AS k FROM en)
    SELECT e.entity_id, e.name, coalesce(project_count, 0) AS projects, coalesce(r.n, 0) AS relations, coalesce(c.n, 0) AS chains, coalesce(r.f, '') AS first_relations FROM entities e LEFT JOIN counts USING (entity_id)
    LEFT JOIN (SELECT entity_id, count(*) AS n, string_agg(rel_id, ',' ORDER BY k) FILTER (k <= 5) AS f FROM rk GROUP BY 1) r USING (entity_id)
    LEFT JOIN (SELECT entity_id, count(DISTINCT chain_id) AS n FROM (SELECT src AS entity_id, chain_id FROM chain_links UNION ALL SELECT dst, chain_id FROM chain_links) GROUP BY 1) c USING (entity_id) WHERE category = 'Brand#11'""",
)
_graph_query(
    "expand_one_hop", lambda g: E.expand_one_hop(g, g.entities.filter("category = 'Brand#11'")),
    ", sd AS (SELECT entity_id FROM entities WHERE category = 'Brand#11') SELECT entity_id FROM sd UNION SELECT dst FROM relations WHERE src IN (SELECT entity_id FROM sd) UNION SELECT src FROM relations WHERE dst IN (SELECT entity_id FROM sd)",
)


def _hits(g, term):
    found = V.search_rows(A.entity_metrics(g), ["name"], term)
    return found.select(F.col("entity_id").alias("id"), "name", F.lit(0).alias("rank"))


_graph_query(
    "merge_search", lambda g: E.merge_search(_hits(g, "ring"), _hits(g, "small"), g.mentions.select(F.col("entity_id").alias("id"))),
    """, hi AS (SELECT entity_id AS id, name, 0 AS list FROM entities WHERE lower(name) LIKE '%ring%' UNION ALL SELECT entity_id, name, 1 FROM entities WHERE lower(name) LIKE '%small%')
    SELECT name, id, list FROM (SELECT name, id, list, row_number() OVER (PARTITION BY name ORDER BY list, id) AS k FROM hi WHERE id IN (SELECT entity_id FROM mentions)) WHERE k = 1 ORDER BY list, name LIMIT 20""",
)
_graph_query(
    "set_differences", lambda g: E.set_differences(g.projects.select("project_id", F.col("base_tags").alias("keys")), ["1-URGENT", "status F"]).select("project_id", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected")),
    """SELECT project_id, array_to_string(list_filter(['1-URGENT', 'status F'], lambda x: NOT list_contains(base_tags, x)), ',') AS missing, array_to_string(list_filter(base_tags, lambda x: x NOT IN ('1-URGENT', 'status F')), ',') AS unexpected FROM projects""",
)


@register(
    "knn_graph",
    """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM u),
    e AS (SELECT vec_id, list_transform(v, lambda x: x / l) AS v FROM n WHERE l > 0),
    s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(q.v, e.v), 6) AS score FROM e q JOIN e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.1) WHERE rank <= 5""", __name__,
)
def knn(spark, sf_dir):
    """Exact edges of a stated query set: every 20th vector."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return similar_by_embedding(vectors, vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5, 0.1)


@register("knn_lists", None, __name__)
def knn_lists(spark, sf_dir):
    """Edges of every vector, by refined lists; longer ones than usual, since these vectors have hardly any structure."""
    return nearest_lists(read_table(spark, sf_dir, "embeddings"), 5, 0.1, lists=20)


@register("quick_ingest", "SELECT c.role AS name, count(DISTINCT conv_id) AS projects FROM conversations c GROUP BY 1", __name__)
def ingest(spark, sf_dir):
    """Conversations as payloads: their roles are the entities."""
    c = read_table(spark, sf_dir, "conversations")
    none = F.array().cast("array<struct<target:string,type:string>>")
    payloads = c.groupBy(F.col("conv_id").cast("string").alias("payload_id")).agg(F.collect_set("role").alias("roles")).select(
        "payload_id", F.col("payload_id").alias("title"), F.array(F.lit("chat")).alias("tags"), F.array(F.lit("chats")).alias("collections"), F.transform("roles", lambda r: F.struct(r.alias("name"), none.alias("relations"))).alias("entities")
    )
    new = quick_ingest(payloads)
    return new["mentions"].join(new["entities"], "entity_id").groupBy("name").agg(F.countDistinct("project_id").alias("projects"))


@register(
    "scalar_functions",
    """SELECT event_id, upper(event_type) AS kind, strftime(ts, '%Y-%m-%d') AS day, year(ts) AS y, month(ts) AS m, day(ts) AS d, abs(round(value, 1) - 10) AS away, coalesce(nullif(event_type, 'click'), 'other') AS family,
    props ->> '$.k' AS k, sha256(event_id || '|' || event_type) AS content_id FROM events""", __name__,
)
def scalars(spark, sf_dir):
    """Text, date, number, conditional, JSON and id functions over events."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.upper("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"), F.abs(F.round("value", 1) - 10).alias("away"),
        F.coalesce(F.nullif("event_type", F.lit("click")), F.lit("other")).alias("family"), F.get_json_object("props", "$.k").alias("k"), F.sha2(F.concat_ws("|", "event_id", "event_type").cast("binary"), 256).alias("content_id"),
    )

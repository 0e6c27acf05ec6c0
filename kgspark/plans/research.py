"""Registered searches and research analyses."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from kgspark.operators import research as B
from kgspark.operators import search as R
from kgspark.operators import textindex as I
from kgspark.plans.summaries import _graph_query
from kgspark.registry import register
from kgspark.sources.graph import order_graph, read_table
from kgspark.sources.scratch import new_folder

_graph_query(
    "role_evolution", B.role_evolution,
    """SELECT entity_id, count(*)::INT AS n_projects, count(DISTINCT role) AS distinct_roles, string_agg(role, ',' ORDER BY project_id) AS roles FROM mentions GROUP BY entity_id HAVING count(*) >= 2""",
)
_graph_query(
    "relation_divergence", B.relation_divergence,
    """, en AS (SELECT src AS entity_id, dst AS other, rel_type, project_id FROM relations UNION ALL SELECT dst, src, rel_type, project_id FROM relations)
    SELECT * FROM (SELECT entity_id, other, rel_type, count(DISTINCT project_id) AS present, any_value(project_count) - count(DISTINCT project_id) AS absent FROM en JOIN counts USING (entity_id) GROUP BY entity_id, other, rel_type) WHERE absent > 0""",
)
_graph_query(
    "chain_joins", lambda g: B.chain_joins(g).groupBy("entity_id").agg(F.count("*").alias("n")),
    """, ls AS (SELECT chain_id, arg_max(dst, order_index) AS last, arg_min(src, order_index) AS start FROM chain_links GROUP BY 1)
    SELECT a.last AS entity_id, count(*) AS n FROM ls a JOIN ls b ON a.last = b.start AND a.chain_id <> b.chain_id GROUP BY 1""",
)
_graph_query("short_chains", lambda g: B.short_chains(g).select("chain_id", "link_count"), "SELECT chain_id, link_count FROM chains WHERE link_count < 3")
_graph_query(
    "thematic_gaps", B.thematic_gaps,
    """, tg AS (SELECT collection, unnest(base_tags) AS tag, entity_id FROM pc JOIN projects USING (project_id) JOIN mentions USING (project_id)),
    tt AS (SELECT collection, count(DISTINCT entity_id) AS n FROM tg GROUP BY 1)
    SELECT * FROM (SELECT collection, tag, count(DISTINCT entity_id) AS entities, round(count(DISTINCT entity_id) / any_value(n)::DOUBLE, 6) AS share FROM tg JOIN tt USING (collection) GROUP BY collection, tag) WHERE share < 0.5""",
)
_graph_query(
    "temporal_gaps", B.temporal_gaps,
    """, mo AS (SELECT DISTINCT collection, substr(period, 1, 4)::INT * 12 + substr(period, 6, 2)::INT AS m FROM phases JOIN pc USING (project_id)),
    rc AS (SELECT collection, m, max(m) OVER (PARTITION BY collection ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM mo)
    SELECT collection, after, m AS before FROM rc WHERE m > after + 1""",
)
_graph_query(
    "thin_projects", B.thin_projects,
    """, ct AS (SELECT collection, project_id, count(DISTINCT entity_id) AS entities FROM pc LEFT JOIN mentions USING (project_id) GROUP BY ALL)
    SELECT * FROM (SELECT *, round(avg(entities) OVER (PARTITION BY collection), 6) AS mean FROM ct) WHERE entities < mean""",
)
_graph_query(
    "missing_counterparts", lambda g: B.missing_counterparts(g, F.col("category") == "Brand#11", F.col("category") == "Brand#2"),
    """SELECT entity_id, name FROM entities WHERE category = 'Brand#11' AND entity_id NOT IN (SELECT src FROM relations JOIN entities ON dst = entity_id WHERE category = 'Brand#2' UNION SELECT dst FROM relations JOIN entities ON src = entity_id WHERE category = 'Brand#2')""",
)
_graph_query("inconsistent_names", B.inconsistent_names, "SELECT * FROM (SELECT name, count(DISTINCT category) AS categories, count(DISTINCT definition) AS definitions FROM entities GROUP BY name) WHERE categories > 1 OR definitions > 1")
_graph_query(
    "near_names", lambda g: B.near_names(g.entities, 4),
    """, nn AS (SELECT DISTINCT name FROM entities)
    SELECT * FROM (SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name)::INT AS distance FROM nn a JOIN nn b ON a.name < b.name) WHERE distance <= 4""",
)


def _questions(benchmark):
    """The benchmark items as queries."""
    return benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


BM25 = """WITH qs AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS q FROM benchmark),
tk AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM tk),
po AS (SELECT id, len(w) AS len, unnest(w) AS term FROM tk), pt AS (SELECT id, len, term, count(*) AS tf FROM po GROUP BY ALL),
"""
BM25_END = """df AS (SELECT query_id, q, count(*) AS df FROM ht GROUP BY ALL),
sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))), 6)::DOUBLE AS score FROM ht JOIN df USING (query_id, q), st GROUP BY query_id, id)
"""
TOP20 = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 20"


def _named(name, sql=None):
    return register(name, sql, sys._getframe(0).f_globals["__name__"])


@_named("fulltext_search", BM25 + "ht AS (SELECT query_id, q, id, len, sum(tf) AS tf FROM pt JOIN qs ON term = q GROUP BY ALL)," + BM25_END + TOP20)
def fulltext(spark, sf_dir):
    return R.fulltext_search(read_table(spark, sf_dir, "documents"), _questions(read_table(spark, sf_dir, "benchmark")), "doc_id", "text")


@_named("prefix_search", BM25 + "mt AS MATERIALIZED (SELECT query_id, q, term FROM (SELECT DISTINCT term FROM pt) JOIN qs ON length(q) >= 3 AND starts_with(term, q)), ht AS (SELECT query_id, q, id, len, sum(tf) AS tf FROM pt JOIN mt USING (term) GROUP BY ALL)," + BM25_END + TOP20)
def prefix(spark, sf_dir):
    return R.fulltext_search(read_table(spark, sf_dir, "documents"), _questions(read_table(spark, sf_dir, "benchmark")), "doc_id", "text", prefix=True)


@_named("indexed_search", BM25 + "ht AS (SELECT query_id, q, id, len, sum(tf) AS tf FROM pt JOIN qs ON term = q GROUP BY ALL)," + BM25_END + TOP20)
def indexed(spark, sf_dir):
    """The text search over an index that is written first."""
    index = I.write_index(read_table(spark, sf_dir, "documents"), "doc_id", "text", new_folder(spark, "index"))
    return I.indexed_search(spark, index, _questions(read_table(spark, sf_dir, "benchmark")))


def _vector_queries(vectors):
    """A stated query set: ids divisible by 20, against all vectors."""
    return vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@_named(
    "similar_by_embedding",
    """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM u),
    e AS (SELECT vec_id, list_transform(v, lambda x: x / l) AS v FROM n WHERE l > 0),
    s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(q.v, e.v), 6) AS score FROM e q JOIN e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.2) WHERE rank <= 10""",
)
def similar(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    return R.similar_by_embedding(vectors, _vector_queries(vectors), 10, 0.2)


@_named("hybrid_search")
def hybrid(spark, sf_dir):
    docs, asked = read_table(spark, sf_dir, "documents"), _questions(read_table(spark, sf_dir, "benchmark"))
    text = R.fulltext_search(docs, asked, "doc_id", "text")
    return R.hybrid_merge(text, R.semantic_search(docs, asked, "doc_id", "text"), 20)


@_named("semantic_search")
def semantic(spark, sf_dir):
    return R.semantic_search(read_table(spark, sf_dir, "documents"), _questions(read_table(spark, sf_dir, "benchmark")), "doc_id", "text")


@_named("recall")
def recall(spark, sf_dir):
    g = order_graph(spark, sf_dir)
    questions = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id"), F.concat_ws(" ", F.lit("small ring economy"), "r_name").alias("query"))
    return R.recall(g, questions)
_graph_query(
    "chain_crossings", B.chain_crossings,
    """, cn AS (SELECT src AS entity_id, chain_id FROM chain_links UNION SELECT dst, chain_id FROM chain_links)
    SELECT entity_id, count(DISTINCT chain_id) AS chains, count(DISTINCT project_id) AS projects FROM cn JOIN chains USING (chain_id) GROUP BY 1 HAVING count(DISTINCT project_id) >= 2""",
)
_graph_query(
    "crossed_chains", B.crossed_chains,
    """, cn AS (SELECT entity_id, chain_id, project_id FROM (SELECT src AS entity_id, chain_id FROM chain_links UNION SELECT dst, chain_id FROM chain_links) JOIN chains USING (chain_id))
    SELECT a.chain_id, a.project_id, count(DISTINCT a.entity_id) AS entities, count(*) AS meetings FROM cn a JOIN cn b ON a.entity_id = b.entity_id AND a.project_id <> b.project_id GROUP BY ALL""",
)
_graph_query(
    "year_gaps",  # each entity as a collection of the relations that it starts
    lambda g: B.year_gaps(g.with_tables(project_collections=g.entities.select(F.col("entity_id").alias("project_id"), F.col("entity_id").alias("collection")), relations=g.relations.withColumn("project_id", F.col("src")))),
    """, ys AS (SELECT DISTINCT src AS collection, year AS y FROM relations)
    SELECT * FROM (SELECT collection, lag(y) OVER (PARTITION BY collection ORDER BY y)::INT AS after, y::INT AS before FROM ys) WHERE before > after + 1""",
)
_graph_query(
    "sparse_projects", B.sparse_projects,
    """, en AS (SELECT project_id, count(*) AS e FROM mentions GROUP BY 1), rn AS (SELECT project_id, count(*) AS r FROM relations GROUP BY 1),
    dn AS (SELECT collection, project_id, coalesce(coalesce(r, 0)::DOUBLE / e, 0.0) AS d FROM pc LEFT JOIN en USING (project_id) LEFT JOIN rn USING (project_id))
    SELECT collection, project_id, round(d, 6) AS density, round(m, 6) AS mean FROM dn JOIN (SELECT collection, avg(d) AS m FROM dn GROUP BY 1) USING (collection) WHERE round(d, 6) < round(m, 6)""",
)
_graph_query(
    "uneven_bridges", B.uneven_bridges,
    """, en AS (SELECT project_id, e AS entity_id, count(*) AS r FROM (SELECT project_id, src AS e FROM relations UNION ALL SELECT project_id, dst FROM relations WHERE dst <> src) GROUP BY ALL)
    SELECT entity_id, count(*) AS projects, min(coalesce(r, 0)) AS least, max(coalesce(r, 0)) AS most FROM mentions LEFT JOIN en USING (project_id, entity_id) GROUP BY 1 HAVING count(*) >= 2 AND max(coalesce(r, 0)) > min(coalesce(r, 0))""",
)


@_named("recall_summary")
def recall_summary(spark, sf_dir):
    """The questions of ``recall`` with what it finds for them in words."""
    g = order_graph(spark, sf_dir)
    questions = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id"), F.concat_ws(" ", F.lit("small ring economy"), "r_name").alias("query"))
    return R.recall_summary(g, questions, R.recall(g, questions))

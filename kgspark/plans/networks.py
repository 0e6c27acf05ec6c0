"""Registered graph algorithms and traversals. Where an iteration can be unrolled, SQL repeats its rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import aggregates as A
from kgspark.operators import algorithms as G
from kgspark.operators import communities as C
from kgspark.operators import paths as P
from kgspark.operators import search as R
from kgspark.operators import traversal as T
from kgspark.operators.components import connected_components
from kgspark.operators.joins import build_view
from kgspark.plans.summaries import _graph_query
from kgspark.registry import register
from kgspark.sources.graph import ORDER_SQL, order_graph, read_table

EDGES = """, pe AS (SELECT src AS a, dst AS b FROM relations UNION ALL SELECT dst, src FROM relations), se AS MATERIALIZED (SELECT DISTINCT a, b FROM pe WHERE a <> b)
"""
_graph_query("project_edges", lambda g: G.project_edges(g.relations).groupBy("a").agg(F.count("*").alias("ends"), F.countDistinct("b").alias("neighbors")), EDGES + "SELECT a, count(*) AS ends, count(DISTINCT b) AS neighbors FROM pe GROUP BY a")


def _pagerank_sql(rounds: int) -> str:
    sql = EDGES + ", w AS MATERIALIZED (SELECT a, b, count(*) / (sum(count(*)) OVER (PARTITION BY a))::DOUBLE AS share FROM pe GROUP BY a, b), r0 AS (SELECT entity_id, 0.15::DOUBLE AS pr FROM entities)"
    for k in range(rounds):
        sql += f", r{k + 1} AS MATERIALIZED (SELECT entity_id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(g, 0) AS pr FROM entities LEFT JOIN (SELECT b, sum(pr * share) AS g FROM w JOIN r{k} ON a = entity_id GROUP BY b) ON b = entity_id)"
    return sql + f" SELECT entity_id, round(pr, 6) AS page_rank FROM r{rounds}"


_graph_query("pagerank", lambda g: G.pagerank(g.entities, g.relations).select("entity_id", F.round("page_rank", 6).alias("page_rank")), _pagerank_sql(G.ROUNDS))
SIMILAR = EDGES + """, sz AS (SELECT a, count(*) AS n FROM se GROUP BY a), ov AS (SELECT x.a AS a, y.a AS b, count(*) AS i FROM se x JOIN se y ON x.b = y.b AND x.a <> y.a GROUP BY ALL),
    sm AS (SELECT ov.a, ov.b, round(i / (p.n + q.n - i)::DOUBLE, 6) AS similarity FROM ov JOIN sz p ON p.a = ov.a JOIN sz q ON q.a = ov.b WHERE i / (p.n + q.n - i)::DOUBLE >= 0.05),
    ns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM sm) WHERE rank <= 5)
"""


def _similar(g):
    return G.node_similarity(g.relations, 0.05, 5)


_graph_query("node_similarity", _similar, SIMILAR + "SELECT * FROM ns")
_graph_query(
    "similar_entities", lambda g: G.similar_entities(_similar(g), g.entities.filter("category = 'Brand#11'"), 5),
    SIMILAR + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM (
      SELECT a, b, max(similarity) AS similarity FROM (SELECT a, b, similarity FROM ns UNION ALL SELECT b, a, similarity FROM ns) GROUP BY a, b) WHERE a IN (SELECT entity_id FROM entities WHERE category = 'Brand#11')) WHERE rank <= 5""",
)
_graph_query("overlaps", lambda g: G.overlaps(_similar(g), 0.1, 30), SIMILAR + "SELECT least(a, b) AS a, greatest(a, b) AS b, max(similarity) AS similarity FROM ns WHERE similarity >= 0.1 GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 30")


def _labels_sql(rounds: int) -> str:
    sql = EDGES + ", w AS MATERIALIZED (SELECT a, b, count(*) AS w FROM pe GROUP BY a, b), l0 AS (SELECT entity_id, entity_id AS community FROM entities)"
    for k in range(rounds):
        sql += f""", l{k + 1} AS MATERIALIZED (SELECT l.entity_id, coalesce(n.community, l.community) AS community FROM l{k} l LEFT JOIN (SELECT b, community FROM (
          SELECT b, community, row_number() OVER (PARTITION BY b ORDER BY sum(w) DESC, community) AS k FROM w JOIN l{k} ON a = entity_id GROUP BY b, community) WHERE k = 1) n ON n.b = l.entity_id)"""
    return sql + f" SELECT entity_id, community FROM l{rounds}"


_graph_query("communities", lambda g: G.label_propagation(g.entities, g.relations), _labels_sql(10))
_graph_query(
    "community_sizes", lambda g: G.label_propagation(g.entities, g.relations).groupBy("community").agg(F.count("*").alias("members")),
    _labels_sql(10).replace("SELECT entity_id, community FROM l10", "SELECT community, count(*) AS members FROM l10 GROUP BY community"),
)


def _modular_sql(last: str) -> str:
    sql = EDGES + ", w0 AS MATERIALIZED (SELECT a, b, count(*) AS w FROM pe WHERE a <> b GROUP BY a, b), kk AS (SELECT a, sum(w)::BIGINT AS k FROM w0 GROUP BY a), tt AS (SELECT coalesce(sum(k), 0)::BIGINT AS total FROM kk), n0 AS (SELECT entity_id AS e, coalesce(k, 0) AS k FROM entities LEFT JOIN kk ON a = entity_id)"
    for v in range(C.LEVELS):
        sql += f", l{v}_0 AS MATERIALIZED (SELECT e, e AS c, k, ('0x' || substr(md5(e), 1, 8))::BIGINT % {C.CLASSES} AS cl FROM n{v})"
        for t in range(C.ROUNDS * C.CLASSES):
            x = f"{v}_{t}"
            sql += f""", m{x} AS (SELECT e AS a, c AS own, k FROM l{x} WHERE cl = {t % C.CLASSES}), s{x} AS (SELECT c, sum(k)::BIGINT AS size FROM l{x} GROUP BY c),
            o{x} AS (SELECT a, own, k, c, sum(w)::BIGINT AS w FROM (SELECT m.a, own, m.k, l.c, w FROM m{x} m JOIN w{v} USING (a) JOIN l{x} l ON l.e = b UNION ALL SELECT a, own, k, own, 0 FROM m{x}) GROUP BY ALL),
            b{x} AS (SELECT a, c FROM (SELECT a, c, row_number() OVER (PARTITION BY a ORDER BY w * total - k * (size - CASE WHEN c = own THEN k ELSE 0 END) DESC, c) AS rank FROM o{x} JOIN s{x} USING (c), tt) WHERE rank = 1),
            l{v}_{t + 1} AS MATERIALIZED (SELECT e, coalesce(b.c, l.c) AS c, k, cl FROM l{x} l LEFT JOIN b{x} b ON b.a = l.e)"""
        end = f"l{v}_{C.ROUNDS * C.CLASSES}"
        sql += f""", w{v + 1} AS MATERIALIZED (SELECT x.c AS a, y.c AS b, sum(w)::BIGINT AS w FROM w{v} JOIN {end} x ON x.e = a JOIN {end} y ON y.e = b WHERE x.c <> y.c GROUP BY 1, 2), n{v + 1} AS (SELECT c AS e, sum(k)::BIGINT AS k FROM {end} GROUP BY c),
        f{v} AS MATERIALIZED (""" + (f"SELECT e, c FROM {end})" if not v else f"SELECT f.e, x.c FROM f{v - 1} f JOIN {end} x ON x.e = f.c)")
    return sql + f", lb AS (SELECT e AS entity_id, c AS community FROM f{C.LEVELS - 1}) " + last


def _modular(g):
    return C.modular_communities(g.entities, g.relations)


_graph_query("modular_communities", _modular, _modular_sql("SELECT * FROM lb"))
_graph_query(
    "community_detail", lambda g: C.community_detail(_modular(g), g.entities, g.relations)["relations"],
    _modular_sql("""SELECT community, rank, rel_id, src, dst FROM (SELECT x.community, rel_id, src, dst, row_number() OVER (PARTITION BY x.community ORDER BY CASE magnitude WHEN 'foundational' THEN 0 WHEN 'significant' THEN 1
      WHEN 'marginal' THEN 2 ELSE 3 END, rel_id) AS rank FROM relations JOIN lb x ON x.entity_id = src JOIN lb y ON y.entity_id = dst AND y.community = x.community) WHERE rank <= 50"""),
)
_graph_query("gaps", lambda g: G.gaps(g.entities, A.degrees(g), 30), "SELECT entity_id, CASE WHEN degree = 0 THEN 'isolated' ELSE 'under-connected' END AS kind, degree FROM degrees WHERE degree <= 30")
_graph_query(
    "triangles", lambda g: G.triangles(g.relations),
    EDGES + """, dg AS (SELECT a, count(*) AS d FROM se GROUP BY a), tr AS (SELECT x.a, count(*) // 2 AS t FROM se x JOIN se y ON x.b = y.a JOIN se z ON z.a = y.b AND z.b = x.a WHERE y.b <> x.a GROUP BY x.a)
    SELECT dg.a AS entity_id, coalesce(t, 0)::BIGINT AS triangles, CASE WHEN d > 1 THEN round(2 * coalesce(t, 0)::DOUBLE / (d * (d - 1)), 6) ELSE 0.0::DOUBLE END AS clustering FROM dg LEFT JOIN tr ON tr.a = dg.a""",
)
_graph_query("core_numbers", lambda g: G.core_numbers(g.relations))
_graph_query("knowledge_islands", lambda g: connected_components(g.relations.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
_graph_query(
    "link_scores", lambda g: G.unlinked_scores(g.relations, g.mentions),
    EDGES + """, dg AS (SELECT a, count(*) AS d FROM se GROUP BY a), up AS (SELECT DISTINCT m.entity_id AS a, n.entity_id AS b FROM mentions m JOIN mentions n ON m.project_id = n.project_id AND m.entity_id < n.entity_id), ul AS (SELECT up.* FROM up LEFT JOIN se USING (a, b) WHERE se.a IS NULL)
    SELECT ul.a, ul.b, count(*) AS common, round(sum(1 / ln(d)), 6) AS adamic_adar, round(sum(1 / d::DOUBLE), 6) AS resource_allocation FROM ul JOIN se x ON x.a = ul.a JOIN se y ON y.a = ul.b AND y.b = x.b JOIN dg ON dg.a = x.b GROUP BY ul.a, ul.b""",
)


def _betweenness_sql(levels: int) -> str:
    """Brandes from all nodes, unrolled; the last level must be empty for the result to be whole."""
    sql = EDGES + """, nd AS MATERIALIZED (SELECT a AS id, row_number() OVER (ORDER BY a)::INTEGER AS a FROM (SELECT DISTINCT a FROM se)),
    ne AS MATERIALIZED (SELECT x.a, y.a AS b FROM se JOIN nd x ON x.id = se.a JOIN nd y ON y.id = se.b), f0 AS MATERIALIZED (SELECT a AS s, a AS x, 1::DOUBLE AS p FROM nd)"""
    for k in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT s, x FROM f{j}" for j in range(max(0, k - 2), k))
        sql += f", f{k} AS MATERIALIZED (SELECT g.* FROM (SELECT s, b AS x, sum(p) AS p FROM f{k - 1} JOIN ne ON ne.a = x GROUP BY s, b) g LEFT JOIN ({seen}) z ON z.s = g.s AND z.x = g.x WHERE z.s IS NULL)"
    sql += f", d{levels} AS MATERIALIZED (SELECT *, 0::DOUBLE AS d FROM f{levels})"
    for k in range(levels - 1, 0, -1):
        sql += f""", d{k} AS MATERIALIZED (SELECT f.s, f.x, f.p, f.p * coalesce(sum((1 + d.d) / d.p), 0) AS d FROM f{k} f
          LEFT JOIN (SELECT s, b, p, d FROM d{k + 1} JOIN ne ON ne.a = x) d ON d.s = f.s AND d.b = f.x GROUP BY f.s, f.x, f.p)"""
    every = " UNION ALL ".join(f"SELECT x, d FROM d{k}" for k in range(1, levels + 1))
    return sql + f""", al AS (SELECT x, sum(d) AS d FROM ({every}) GROUP BY x)
    SELECT id AS entity_id, round(coalesce(d, 0) * 0.5, 6) AS betweenness FROM nd LEFT JOIN al ON x = a"""


_graph_query("betweenness", lambda g: P.betweenness(g.relations), _betweenness_sql(7))
_graph_query("closeness", lambda g: P.closeness(g.relations))


def _seeds(g):
    """A stated query set: every 20th part."""
    return g.entities.filter(F.substring("entity_id", 2, 20).cast("long") % 20 == 0).select("entity_id")


SEEDS = EDGES + ", sd AS (SELECT 'e' || p_partkey AS entity_id, 'e' || (p_partkey + 1) AS after FROM part WHERE p_partkey % 20 = 0)\n"
_graph_query(
    "neighborhood", lambda g: T.neighborhood(g.relations, _seeds(g), 2).groupBy("seed", "distance").agg(F.count("*").alias("n"), F.min("entity_id").alias("least")),
    SEEDS + """, n1 AS (SELECT DISTINCT entity_id AS seed, b FROM sd JOIN se ON a = entity_id), n2 AS (SELECT DISTINCT seed, se.b FROM n1 JOIN se ON se.a = n1.b WHERE se.b <> seed AND (seed, se.b) NOT IN (SELECT (seed, b) FROM n1)),
    al AS (SELECT entity_id AS seed, entity_id AS x, 0 AS distance FROM sd UNION ALL SELECT seed, b, 1 FROM n1 UNION ALL SELECT seed, b, 2 FROM n2)
    SELECT seed, distance, count(*) AS n, min(x) AS least FROM al GROUP BY ALL""",
)
_graph_query(
    "neighborhood_limited", lambda g: T.neighborhood(g.relations, _seeds(g), 1, 10),
    SEEDS + """SELECT seed, entity_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, entity_id) AS k FROM (
      SELECT entity_id AS seed, entity_id, 0 AS distance FROM sd UNION ALL SELECT DISTINCT entity_id, b, 1 FROM sd JOIN se ON a = entity_id)) WHERE k <= 10""",
)


def _pairs(g):
    """A stated query set: every 20th part and the one after it."""
    key = F.substring("entity_id", 2, 20).cast("long")
    return _seeds(g).select(F.col("entity_id").alias("a"), F.concat(F.lit("e"), (key + 1).cast("string")).alias("b"))


def _paths_sql(hops: int) -> str:
    sql = SEEDS + ", f0 AS (SELECT entity_id AS a, entity_id AS node, NULL::VARCHAR AS parent FROM sd), s0 AS (SELECT * FROM f0)"
    for k in range(1, hops + 1):
        sql += f""", f{k} AS MATERIALIZED (SELECT f.a, se.b AS node, min(f.node) AS parent FROM f{k - 1} f JOIN se ON se.a = f.node LEFT JOIN s{k - 1} s ON s.a = f.a AND s.node = se.b WHERE s.a IS NULL GROUP BY f.a, se.b)
        , s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM f{k})"""
    found = " UNION ALL ".join(f"SELECT a, node, parent, {k} AS hops FROM f{k}" for k in range(1, hops + 1))
    sql += f", fd AS (SELECT sd.entity_id AS a, after AS b, parent AS q0, hops FROM sd JOIN ({found}) x ON x.a = sd.entity_id AND x.node = after)"
    joins = "".join(f" LEFT JOIN s{hops} p{k} ON p{k}.a = fd.a AND p{k}.node = " + ("q0" if k == 1 else f"p{k - 1}.parent") for k in range(1, hops))
    steps = ["q0", *[f"p{k}.parent" for k in range(1, hops)]][::-1]
    return sql + f" SELECT fd.a, b, hops, concat_ws('>', {', '.join(steps)}, b) AS path FROM fd{joins}"


#: How far a path may lead, as in the reference (``shortestPath`` of ``*..8``).
FARTHEST = 8


def _next_parts(g):
    """Every part and the one after it."""
    key = F.substring("entity_id", 2, 20).cast("long")
    return g.entities.select(F.col("entity_id").alias("a"), F.concat(F.lit("e"), (key + 1).cast("string")).alias("b"))


def _next_paths_sql(hops: int) -> str:
    """ps(a, b, hops, path): as ``_paths_sql`` from every part; levels grow only around pairs that are still open, and the last one is not made."""
    sql = EDGES + """, nd AS MATERIALIZED (SELECT a AS id, row_number() OVER (ORDER BY a)::INTEGER AS n FROM (SELECT DISTINCT a FROM se)), ne AS MATERIALIZED (SELECT x.n AS a, y.n AS b FROM se JOIN nd x ON x.id = a JOIN nd y ON y.id = b),
    o0 AS MATERIALIZED (SELECT x.n AS a, y.n AS b FROM part JOIN nd x ON x.id = 'e' || p_partkey JOIN nd y ON y.id = 'e' || (p_partkey + 1)), f0 AS MATERIALIZED (SELECT a, a AS node, NULL::INTEGER AS parent FROM o0)"""
    for k in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT a, node FROM f{j}" for j in range(max(0, k - 2), k))
        sql += f""", m{k} AS MATERIALIZED (SELECT o.a, o.b, min(f.node) AS q0 FROM o{k - 1} o JOIN ne ON ne.a = o.b JOIN f{k - 1} f ON f.a = o.a AND f.node = ne.b GROUP BY o.a, o.b),
        o{k} AS MATERIALIZED (SELECT o.a, o.b FROM o{k - 1} o LEFT JOIN m{k} m ON m.a = o.a WHERE m.a IS NULL)"""
        if k < hops:
            sql += f""", f{k} AS MATERIALIZED (SELECT g.* FROM (SELECT f.a, ne.b AS node, min(f.node) AS parent FROM f{k - 1} f JOIN o{k} o ON o.a = f.a JOIN ne ON ne.a = f.node GROUP BY f.a, ne.b) g
            LEFT JOIN ({seen}) z ON z.a = g.a AND z.node = g.node WHERE z.a IS NULL)"""
    sql += f""", fd AS MATERIALIZED ({' UNION ALL '.join(f'SELECT a, b, q0, {k} AS hops FROM m{k}' for k in range(1, hops + 1))}), st AS MATERIALIZED (SELECT s.* FROM ({' UNION ALL '.join(f'SELECT * FROM f{k}' for k in range(1, hops))}) s SEMI JOIN fd ON fd.a = s.a)"""
    steps, joins = ["b"], ""
    for k in range(hops):
        steps.insert(0, "q0" if not k else f"p{k}.parent")
        joins += f" LEFT JOIN st p{k} ON p{k}.a = fd.a AND p{k}.node = {steps[1]}" if k else ""
    names = "".join(f" LEFT JOIN nd n{k} ON n{k}.n = {step}" for k, step in enumerate(steps))
    return sql + f", ps AS (SELECT x.id AS a, n{hops}.id AS b, hops, concat_ws('>', {', '.join(f'n{k}.id' for k in range(hops + 1))}) AS path FROM fd JOIN nd x ON x.n = fd.a{joins}{names})"


_graph_query(
    "shortest_paths", lambda g: T.shortest_paths(g.relations, _next_parts(g), FARTHEST).select("a", "b", "hops", F.array_join("path", ">").alias("path")),
    _next_paths_sql(FARTHEST) + " SELECT a, b, hops, path FROM ps",
)
_graph_query(
    "all_paths", lambda g: T.all_paths(g.relations, _pairs(g), 3, 10).select("a", "b", "hops", F.array_join("path", ">").alias("path"), "rank"),
    EDGES + """, pr AS (SELECT 'e' || p_partkey AS a, 'e' || (p_partkey + 1) AS b FROM part WHERE p_partkey % 20 = 0),
    ap AS (SELECT pr.a, pr.b, 1 AS hops, [pr.a, pr.b] AS p FROM pr JOIN se ON se.a = pr.a AND se.b = pr.b
      UNION ALL SELECT pr.a, pr.b, 2, [pr.a, x.b, pr.b] FROM pr JOIN se x ON x.a = pr.a JOIN se y ON y.a = x.b AND y.b = pr.b WHERE x.b <> pr.b
      UNION ALL SELECT pr.a, pr.b, 3, [pr.a, x.b, y.b, pr.b] FROM pr JOIN se x ON x.a = pr.a JOIN se y ON y.a = x.b JOIN se z ON z.a = y.b AND z.b = pr.b WHERE x.b <> pr.b AND y.b <> pr.b AND y.b <> pr.a)
    SELECT a, b, hops, array_to_string(p, '>') AS path, rank FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY hops, p) AS rank FROM ap) WHERE rank <= 10""",
)
_graph_query(
    "paths_across_projects", lambda g: T.projects_of_paths(T.shortest_paths(g.relations, _next_parts(g), FARTHEST), g.mentions).select("a", "b", "hops", "projects"),
    _next_paths_sql(FARTHEST)
    + """, ex AS (SELECT a, b, unnest(string_split(path, '>')) AS entity_id FROM ps), ct AS (SELECT a, b, count(DISTINCT project_id) AS projects FROM ex JOIN mentions USING (entity_id) GROUP BY ALL)
    SELECT a, b, hops, coalesce(projects, 0) AS projects FROM ps LEFT JOIN ct USING (a, b)""",
)
_graph_query(
    "highlight_set", lambda g: T.highlight_set(build_view(g)[1], _seeds(g).select(F.col("entity_id").alias("node_id")), 1).groupBy("seed", "distance").agg(F.count("*").alias("n"), F.min("node_id").alias("least")),
    SEEDS + """, al AS (SELECT entity_id AS seed, entity_id AS x, 0 AS distance FROM sd UNION ALL SELECT DISTINCT entity_id, b, 1 FROM sd JOIN se ON a = entity_id
      UNION ALL SELECT entity_id, project_id, 1 FROM sd JOIN mentions USING (entity_id))
    SELECT seed, distance, count(*) AS n, min(x) AS least FROM al GROUP BY ALL""",
)


def _some_pairs(g):
    """A stated query set: every 20th part and the one after it, and the first relation's other end of every 20th part."""
    first = g.relations.join(_seeds(g).select(F.col("entity_id").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("a")).agg(F.min("dst").alias("b"))
    return _pairs(g).unionByName(first).distinct()


SOME_PAIRS = ", sp AS (SELECT DISTINCT * FROM (SELECT 'e' || p_partkey AS a, 'e' || (p_partkey + 1) AS b FROM part WHERE p_partkey % 20 = 0 UNION ALL SELECT src, min(dst) FROM relations WHERE substr(src, 2)::BIGINT % 20 = 0 GROUP BY src))\n"
_graph_query(
    "explain_connections", lambda g: T.explain_connections(g, _some_pairs(g))[0].select("a", "b", "forward", "backward", "projects", "hops", F.array_join("path", ">").alias("path"), "connected"),
    _paths_sql(3).replace(" SELECT fd.a, b, hops, concat_ws", ", ps AS (SELECT fd.a, b, hops, concat_ws", 1) + ")" + SOME_PAIRS
    + """, dr AS (SELECT sp.a, sp.b, count(r.src) FILTER (r.src = sp.a AND r.dst = sp.b) AS forward, count(r.src) FILTER (r.src = sp.b AND r.dst = sp.a) AS backward FROM sp LEFT JOIN relations r ON (r.src = sp.a AND r.dst = sp.b) OR (r.src = sp.b AND r.dst = sp.a) GROUP BY sp.a, sp.b),
    sj AS (SELECT sp.a, sp.b, count(DISTINCT x.project_id) AS n FROM sp JOIN mentions x ON x.entity_id = a JOIN mentions y ON y.entity_id = b AND y.project_id = x.project_id GROUP BY ALL)
    SELECT dr.a, dr.b, forward, backward, coalesce(n, 0) AS projects, CASE WHEN forward + backward = 0 THEN hops END AS hops, CASE WHEN forward + backward = 0 THEN path END AS path,
      forward + backward + coalesce(n, 0) > 0 OR hops IS NOT NULL AS connected FROM dr LEFT JOIN sj ON sj.a = dr.a AND sj.b = dr.b LEFT JOIN ps ON ps.a = dr.a AND ps.b = dr.b""",
)
_graph_query(
    "connection_evidence", lambda g: T.direct_evidence(g, _some_pairs(g)),
    SEEDS.split(", sd AS")[0] + SOME_PAIRS + """SELECT sp.a, sp.b, rel_id, 'outgoing' AS direction, rel_type, evidence_strength FROM sp JOIN relations ON src = sp.a AND dst = sp.b
    UNION ALL SELECT sp.a, sp.b, rel_id, 'incoming', rel_type, evidence_strength FROM sp JOIN relations ON src = sp.b AND dst = sp.a""",
)


NEAR = """, kv AS (SELECT 'e' || vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), kn AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM kv),
ke AS (SELECT id, list_transform(v, lambda x: x / l) AS v FROM kn WHERE l > 0), cat AS (SELECT entity_id FROM entities WHERE category = 'Brand#11'),
st AS (SELECT a, b, max(similarity) AS similarity FROM (SELECT a, b, similarity FROM ns WHERE similarity >= 0.2 UNION ALL SELECT b, a, similarity FROM ns WHERE similarity >= 0.2) WHERE a IN (SELECT entity_id FROM cat) GROUP BY a, b),
nr AS (SELECT q.id AS a, e.id AS b, round(list_dot_product(q.v, e.v), 6) AS similarity FROM ke q JOIN ke e ON q.id IN (SELECT entity_id FROM cat) AND q.id NOT IN (SELECT a FROM st) AND q.id <> e.id)
SELECT * FROM (SELECT a, b, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank, 'stored' AS source FROM st) WHERE rank <= 5
UNION ALL SELECT * FROM (SELECT a, b, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank, 'vector' FROM nr WHERE similarity >= 0.1) WHERE rank <= 5"""


@register("similar_or_nearest", ORDER_SQL + SIMILAR + NEAR, __name__)
def similar_or_nearest(spark, sf_dir):
    """Entities of one category: their stored pairs of 0.2 and more, else their nearest vectors."""
    g = order_graph(spark, sf_dir)
    vectors = read_table(spark, sf_dir, "embeddings").select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("entity_id"), "embedding")
    return R.similar_or_nearest(_similar(g).filter("similarity >= 0.2"), g.entities.filter("category = 'Brand#11'"), vectors, 5, 0.1)

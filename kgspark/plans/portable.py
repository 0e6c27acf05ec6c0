"""Registered exports and imports of a collection, their verification, and vectors embedded again."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import portable as P
from kgspark.plans.exporting import MONTH
from kgspark.plans.summaries import TIER, _graph_query
from kgspark.registry import register
from kgspark.sources import portable as S
from kgspark.sources.graph import ORDER_SQL, order_graph, read_table
from kgspark.sources.scratch import new_folder, write_out

DIM = 64
STORED = ("mentions", "relations", "chains", "chain_links")
NAMED = f"""{ORDER_SQL}, one AS (SELECT project_id FROM pc WHERE collection = '{MONTH}'), om AS (SELECT m.* FROM mentions m JOIN one USING (project_id)),
rl AS (SELECT r.* FROM relations r JOIN one USING (project_id)), ol AS (SELECT l.*, c.project_id FROM chain_links l JOIN chains c USING (chain_id) JOIN one USING (project_id)),
oc AS (SELECT c.* FROM chains c JOIN one USING (project_id)), oph AS (SELECT f.* FROM phases f JOIN one USING (project_id)),
ob AS (SELECT entity_id, count(*) AS projects FROM om GROUP BY 1 HAVING count(*) >= 2),
ov AS (SELECT DISTINCT entity_id || '-' AS name, entity_id, embedding FROM om JOIN embeddings ON 'e' || vec_id = entity_id WHERE embedding IS NOT NULL),
away AS (SELECT DISTINCT entity_id FROM mentions WHERE project_id NOT IN (SELECT project_id FROM one)),
tgt AS (SELECT entity_id, CASE WHEN category = 'Brand#11' AND entity_id IN (SELECT entity_id FROM away) THEN 'new ' ELSE '' END || name || ' ' || entity_id AS name FROM entities)
"""


def _named(spark, sf_dir, stored=()):
    """The order graph with names that tell entities apart, without aliases."""
    g = order_graph(spark, sf_dir)
    # read several times by each import, so the lines are put in order once
    g = g.with_tables(**{name: write_out(getattr(g, name), name) for name in stored})
    return g.with_tables(entities=g.entities.withColumn("name", F.concat_ws(" ", "name", "entity_id")).withColumn("aliases", F.array().cast("array<string>")))


def _vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("entity_id"), F.col("embedding"), "label")


def _bundle(spark, sf_dir):
    return P.export_collection(_named(spark, sf_dir), MONTH, _vectors(spark, sf_dir))


def _imported(spark, sf_dir, g=None, bundle=None):
    """The month deleted and brought back from its bundle into a graph where one category has new names and the old ones as aliases."""
    g = g or _named(spark, sf_dir, STORED)
    rest, _ = P.purge_collection(g, MONTH)
    renamed = F.col("category") == "Brand#11"
    entities = rest.entities.select(
        "entity_id", F.when(renamed, F.concat(F.lit("new "), F.col("name"))).otherwise(F.col("name")).alias("name"), "category", "definition", F.when(renamed, F.array("name")).otherwise(F.col("aliases")).alias("aliases")
    )
    vectors = _vectors(spark, sf_dir)
    return P.import_bundle(bundle or P.export_collection(g, MONTH, vectors), rest.with_tables(entities=entities), "imports", MONTH, dim=DIM)


@register(
    "export_stats",
    NAMED + """SELECT 'projects' AS section, count(*) AS n FROM one UNION ALL SELECT 'entities', count(DISTINCT entity_id) FROM om UNION ALL SELECT 'mentions', count(*) FROM om UNION ALL SELECT 'relations', count(*) FROM rl
    UNION ALL SELECT 'chains', count(*) FROM oc UNION ALL SELECT 'chain_links', count(*) FROM ol UNION ALL SELECT 'phases', count(*) FROM oph UNION ALL SELECT 'similar', 0 UNION ALL SELECT 'vectors', count(*) FROM ov
    UNION ALL SELECT 'missing_sources', 0 UNION ALL SELECT 'bridges', count(*) FROM ob""", __name__,
)
def export_stats(spark, sf_dir):
    return P.bundle_stats(_bundle(spark, sf_dir))


@register("export_vectors", NAMED + "SELECT e.name || ' ' || e.entity_id AS name, 'entity' AS kind, len(ov.embedding) AS dim, ov.embedding[1]::DOUBLE AS first, ov.embedding[-1]::DOUBLE AS last FROM ov JOIN entities e USING (entity_id)", __name__)
def export_vectors(spark, sf_dir):
    v = _bundle(spark, sf_dir).vectors
    return v.select("name", "kind", F.size("embedding").cast("long").alias("dim"), F.element_at("embedding", 1).alias("first"), F.element_at("embedding", -1).alias("last"))


@register("export_bridges", NAMED + f"SELECT name || ' ' || entity_id AS name, category, projects, {TIER.format('projects')} AS tier FROM ob JOIN entities USING (entity_id)", __name__)
def export_bridges(spark, sf_dir):
    return P.bundle_bridges(_bundle(spark, sf_dir))


@register("export_project_lines", NAMED + "SELECT project_id AS project, name, domain, subdomain, CASE WHEN length(summary) > 8 THEN summary[:8] || '...' ELSE summary END AS summary FROM projects JOIN one USING (project_id)", __name__)
def export_project_lines(spark, sf_dir):
    """Summaries here are short, so they are cut at 8 signs."""
    return P.project_lines(_bundle(spark, sf_dir), 8)


@register(
    "export_round_trip",
    NAMED + """SELECT 'relations' AS section, count(*) AS n, true AS ok FROM rl UNION ALL SELECT 'mentions', count(*), true FROM om UNION ALL SELECT 'vectors', count(*), true FROM ov UNION ALL SELECT 'chain_links', count(*), true FROM ol
    UNION ALL SELECT 'projects', count(*), true FROM one UNION ALL SELECT 'entities', count(DISTINCT entity_id), true FROM om UNION ALL SELECT 'chains', count(*), true FROM oc UNION ALL SELECT 'phases', count(*), true FROM oph
    UNION ALL SELECT 'similar', 0, true UNION ALL SELECT 'missing_sources', 0, true""", __name__,
)
def export_round_trip(spark, sf_dir):
    """A month written with its vectors and read back."""
    folder = new_folder(spark, "export")
    S.write_export(_bundle(spark, sf_dir), folder, MONTH)
    return S.read_export(spark, folder)[1]


@register("import_mentions", NAMED + "SELECT t.name, project_id, role FROM mentions JOIN tgt t USING (entity_id)", __name__)
def import_mentions(spark, sf_dir):
    """All mentions after the import, by the names that entities then have."""
    g = _imported(spark, sf_dir).graph
    return g.mentions.join(g.entities.select("entity_id", "name"), "entity_id").select("name", "project_id", "role")


@register("import_relations", NAMED + "SELECT s.name AS source, t.name AS target, project_id, rel_type, causal, magnitude, year FROM relations JOIN tgt s ON src = s.entity_id JOIN tgt t ON dst = t.entity_id", __name__)
def import_relations(spark, sf_dir):
    g = _imported(spark, sf_dir).graph
    name = lambda c, new: g.entities.select(F.col("entity_id").alias(c), F.col("name").alias(new))
    return g.relations.join(name("src", "source"), "src").join(name("dst", "target"), "dst").select("source", "target", "project_id", "rel_type", "causal", "magnitude", "year")


@register("import_chain_links", NAMED + "SELECT project_id, link_count, order_index, s.name AS source, t.name AS target FROM chain_links JOIN chains USING (chain_id) JOIN tgt s ON src = s.entity_id JOIN tgt t ON dst = t.entity_id", __name__)
def import_chain_links(spark, sf_dir):
    g = _imported(spark, sf_dir).graph
    name = lambda c, new: g.entities.select(F.col("entity_id").alias(c), F.col("name").alias(new))
    return g.chain_links.join(g.chains, "chain_id").join(name("src", "source"), "src").join(name("dst", "target"), "dst").select("project_id", "link_count", "order_index", "source", "target")


@register("import_names", NAMED + "SELECT DISTINCT e.name || ' ' || e.entity_id AS name, om.entity_id NOT IN (SELECT entity_id FROM away) AS is_new, false AS stub FROM om JOIN entities e USING (entity_id)", __name__)
def import_names(spark, sf_dir):
    """The names that the month's projects use: found in the graph, by name or alias, or new."""
    return _imported(spark, sf_dir).names.select("name", "is_new", "stub")


@register(
    "import_verified",
    NAMED + """SELECT 'projects' AS section, count(*) AS expected, count(*) AS found, true AS complete FROM one UNION ALL SELECT 'entities', count(DISTINCT entity_id), count(DISTINCT entity_id), true FROM om
    UNION ALL SELECT 'mentions', count(*), count(*), true FROM om UNION ALL SELECT 'relations', count(*), count(*), true FROM (SELECT DISTINCT project_id, src, dst, rel_type FROM rl)
    UNION ALL SELECT 'chain_links', count(*), count(*), true FROM ol UNION ALL SELECT 'phases', count(*), count(*), true FROM oph""", __name__,
)
def import_verified(spark, sf_dir):
    g = _named(spark, sf_dir, STORED)
    bundle = P.export_collection(g, MONTH, _vectors(spark, sf_dir))
    after = _imported(spark, sf_dir, g, bundle).graph
    # each table is looked into once, so only the names, which five sections look up, are stored
    return P.verify_bundle(bundle, after.with_tables(entities=write_out(after.entities, "entities")))


_graph_query(
    "label_counts", P.label_counts,
    """SELECT 'Entity' AS label, count(*) AS n FROM entities UNION ALL SELECT 'Project', count(*) FROM projects UNION ALL SELECT 'Collection', count(DISTINCT collection) FROM pc
    UNION ALL SELECT 'Directory', count(DISTINCT directory) FROM project_directories UNION ALL SELECT 'CausalChain', count(*) FROM chains UNION ALL SELECT 'TemporalEvent', count(*) FROM phases""",
)
_graph_query("top_bridges", P.top_bridges, "SELECT entity_id, name, category, project_count AS projects FROM counts JOIN entities USING (entity_id) WHERE project_count >= 2 ORDER BY project_count DESC, entity_id LIMIT 10")
_graph_query(
    "purge_collection", lambda g: P.purge_collection(g, MONTH)[0].mentions.groupBy("role").agg(F.count("*").alias("n")),
    f"SELECT role, count(*) AS n FROM mentions WHERE project_id NOT IN (SELECT project_id FROM pc WHERE collection = '{MONTH}') GROUP BY 1",
)


@register(
    "repair_embeddings",
    ORDER_SQL + """, v AS (SELECT 'e' || vec_id AS entity_id, label FROM embeddings)
    SELECT entity_id, v.label IS NULL OR v.label = 3 AS refilled, 64::BIGINT AS dim FROM entities LEFT JOIN v USING (entity_id) UNION ALL SELECT entity_id, false, 64 FROM v WHERE label <> 3 AND entity_id NOT IN (SELECT entity_id FROM entities)""",
    __name__,
)
def repair_embeddings(spark, sf_dir):
    """Entities without a vector, and those of one label whose vectors are made zero, get one from their texts."""
    zero = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    vectors = _vectors(spark, sf_dir).select("entity_id", F.when(F.col("label") == 3, zero).otherwise(F.col("embedding")).alias("embedding"))
    rows = order_graph(spark, sf_dir).entities.select("entity_id", F.concat_ws(" ", "name", "definition").alias("text"))
    return P.repair_embeddings(rows, vectors, "entity_id", DIM)[0].select("entity_id", "refilled", F.size("embedding").cast("long").alias("dim"))

"""Registered validation rules over the order graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import validation as V
from kgspark.plans.summaries import _graph_query


def _entities(g):
    """Entities of each project as an extraction states them; first appearance by the length of the role and category."""
    return g.mentions.join(g.entities, "entity_id").select("project_id", "name", "category", "definition", F.length("category").alias("first_appearance_index"), "entity_id")


def _relations(g):
    return g.relations.select("project_id", F.col("src").alias("source"), F.col("dst").alias("target"), "rel_type", "causal", "evidence_strength", "magnitude", F.when(F.col("year") != 1995, F.col("year").cast("string")).otherwise("").alias("year"))


def _names(g):
    return g.mentions.filter("role <> 'A'").select("project_id", F.col("entity_id").alias("name"))


def _count(violations):
    return violations.groupBy("rule", "severity").agg(F.count("*").alias("n"))


ENT = ", ex AS (SELECT project_id, name, category, definition, length(category)::INT AS fai, entity_id FROM mentions JOIN entities USING (entity_id))\n"
_graph_query(
    "check_entities", lambda g: _count(V.check_entities(g.projects, _entities(g), g.phases, ["Brand#11", "Brand#22"])),
    ENT + """SELECT 'ENTITY_CATEGORY' AS rule, 'error' AS severity, count(*) AS n FROM ex WHERE category NOT IN ('Brand#11', 'Brand#22') HAVING count(*) > 0
    UNION ALL SELECT 'ENTITY_PHASE_MAP', 'error', count(*) FROM ex LEFT JOIN phases p ON p.project_id = ex.project_id AND p.phase_index = fai WHERE p.project_id IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'ENTITY_DUPLICATE', 'error', count(*) FROM (SELECT row_number() OVER (PARTITION BY project_id, name) AS c FROM ex) WHERE c > 1 HAVING count(*) > 0
    UNION ALL SELECT 'ENTITY_COUNT_MIN', 'error', count(*) FROM projects WHERE project_id NOT IN (SELECT project_id FROM ex) HAVING count(*) > 0""",
)
REL = ", nm AS (SELECT project_id, entity_id FROM mentions WHERE role <> 'A'), rl AS (SELECT r.*, s.entity_id AS s, t.entity_id AS t FROM relations r LEFT JOIN nm s ON s.project_id = r.project_id AND s.entity_id = r.src LEFT JOIN nm t ON t.project_id = r.project_id AND t.entity_id = r.dst)\n"
_graph_query(
    "check_relations", lambda g: _count(V.check_relations(g.projects, _relations(g), _names(g), ["enabling", "reversing"], ["established", "suggestive"])),
    REL + """SELECT 'EXTRACT_CAUSAL_CLASS' AS rule, 'error' AS severity, count(*) AS n FROM rl WHERE causal = '' HAVING count(*) > 0
    UNION ALL SELECT 'EXTRACT_ENTITY_MATCH', 'error', count(*) FILTER (s IS NULL) + count(*) FILTER (t IS NULL) FROM rl HAVING count(*) FILTER (s IS NULL) + count(*) FILTER (t IS NULL) > 0
    UNION ALL SELECT 'YEAR_MISSING', 'warning', count(*) FROM rl WHERE year = 1995 HAVING count(*) > 0
    UNION ALL SELECT 'EXTRACT_REL_COUNT', 'error', count(*) FROM projects WHERE project_id NOT IN (SELECT project_id FROM relations) HAVING count(*) > 0""",
)
_graph_query(
    "check_chains", lambda g: _count(V.check_chains(g.chain_links.join(g.chains.select("chain_id", "project_id"), "chain_id").select("project_id", F.col("chain_id").alias("chain"), F.col("src").alias("source"), F.col("dst").alias("target")), _relations(g).filter("magnitude <> 'marginal'"), _names(g))),
    REL + """, cl AS (SELECT c.project_id, l.src, l.dst FROM chain_links l JOIN chains c USING (chain_id)), rr AS (SELECT DISTINCT project_id, src, dst FROM relations WHERE magnitude <> 'marginal')
    SELECT 'EXTRACT_CHAIN_MATCH' AS rule, 'error' AS severity, count(*) FILTER (s.entity_id IS NULL) + count(*) FILTER (t.entity_id IS NULL) AS n FROM cl LEFT JOIN nm s ON s.project_id = cl.project_id AND s.entity_id = cl.src LEFT JOIN nm t ON t.project_id = cl.project_id AND t.entity_id = cl.dst WHERE s.entity_id IS NULL OR t.entity_id IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'EXTRACT_CHAIN_EVIDENCE', 'error', count(*) FROM cl LEFT JOIN rr USING (project_id, src, dst) WHERE rr.src IS NULL HAVING count(*) > 0""".replace("LEFT JOIN rr USING (project_id, src, dst) WHERE rr.src IS NULL", "WHERE NOT EXISTS (SELECT 1 FROM rr WHERE rr.project_id = cl.project_id AND rr.src = cl.src AND rr.dst = cl.dst)"),
)
_graph_query(
    "validation_report", lambda g: V.validation_report(g.projects, V.check_relations(g.projects, _relations(g), _names(g), ["enabling", "reversing", ""], ["established", "suggestive"])).groupBy("rules", "valid").agg(F.count("*").alias("projects")),
    REL + """, vi AS (SELECT project_id, 'EXTRACT_ENTITY_MATCH' AS rule FROM rl WHERE s IS NULL OR t IS NULL UNION ALL SELECT project_id, 'YEAR_MISSING' FROM rl WHERE year = 1995
      UNION ALL SELECT project_id, 'EXTRACT_REL_COUNT' FROM projects WHERE project_id NOT IN (SELECT project_id FROM relations)),
    rp AS (SELECT p.project_id, coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule), '') AS rules, coalesce(bool_or(rule <> 'YEAR_MISSING'), false) AS bad FROM projects p LEFT JOIN vi USING (project_id) GROUP BY p.project_id)
    SELECT rules, NOT bad AS valid, count(*) AS projects FROM rp GROUP BY ALL""",
)
_graph_query(
    "gate", lambda g: V.gate(g.projects, V.check_relations(g.projects, _relations(g), _names(g), ["enabling", "reversing", ""], ["established", "suggestive"]))[0].groupBy("domain").agg(F.count("*").alias("n")),
    REL + "SELECT domain, count(*) AS n FROM projects WHERE project_id IN (SELECT project_id FROM relations) AND project_id NOT IN (SELECT project_id FROM rl WHERE s IS NULL OR t IS NULL) GROUP BY 1",
)


def _raw(g):
    """Extractions as JSON; some domains lack a part or hold one of another type, and some ids differ from the placement's."""
    whole = F.to_json(F.struct(
        F.struct(
            "name", F.when(F.col("subdomain") == "P", F.concat("project_id", F.lit("x"))).otherwise(F.col("project_id")).alias("unique_id"),
            F.when(F.col("subdomain") == "F", F.lit(" ")).otherwise(F.col("summary")).alias("summary"),
            F.when(F.col("domain") == "4-NOT SPECIFIED", F.array(F.lit("a"), F.lit(""))).otherwise(F.array(F.lit("a"))).alias("narrative_flow"),
            F.struct("domain", "subdomain", F.when(F.col("domain") != "5-LOW", F.col("base_tags")).alias("base_tags")).alias("tags"),
        ).alias("project"),
        F.array().cast("array<string>").alias("relationships"), F.array().cast("array<string>").alias("causal_chains"),
    ))
    cut = F.when(F.col("domain") == "1-URGENT", F.lit('{"project": [], "relationships": {}}')).when(F.col("domain") == "2-HIGH", F.lit('{"project": ')).otherwise(whole)
    return g.projects.select("project_id", cut.alias("raw"))


_graph_query(
    "check_project", lambda g: _count(V.check_project(_raw(g), g.projects.select("project_id", F.col("project_id").alias("unique_id")))),
    """, u AS (SELECT count(*) FILTER (domain = '1-URGENT') AS urgent, count(*) FILTER (domain = '2-HIGH') AS high, count(*) FILTER (domain = '5-LOW') AS low, count(*) FILTER (domain = '4-NOT SPECIFIED') AS open,
      count(*) FILTER (subdomain = 'P' AND domain NOT IN ('1-URGENT', '2-HIGH')) AS other, count(*) FILTER (subdomain = 'F' AND domain NOT IN ('1-URGENT', '2-HIGH')) AS blank FROM projects)
    SELECT rule, 'error' AS severity, n FROM (SELECT unnest([{'rule': 'JSON_PARSE', 'n': high}, {'rule': 'EXTRACT_TOPLEVEL', 'n': urgent}, {'rule': 'EXTRACT_PROJECT', 'n': urgent + blank}, {'rule': 'EXTRACT_ID_MATCH', 'n': other},
      {'rule': 'CROSS_ID', 'n': other}, {'rule': 'EXTRACT_NARRATIVE', 'n': open}, {'rule': 'EXTRACT_TAGS', 'n': low}, {'rule': 'EXTRACT_REL_COUNT', 'n': urgent}], recursive := true) FROM u) WHERE n > 0""",
)


def _placements(g):
    """Placements as JSON; some domains have a flag, a name or a key of another type."""
    first = g.project_collections.groupBy("project_id").agg(F.min("collection").alias("collection"))
    name = F.struct(F.col("domain").alias("directory"), F.col("project_id").alias("project_name"), F.col("project_id").alias("unique_id"), "collection", F.lit(True).alias("collection_is_new"))
    raw = F.to_json(name)
    raw = F.when(F.col("domain") == "1-URGENT", F.replace(raw, F.lit("true"), F.lit('"true"'))).when(F.col("domain") == "2-HIGH", F.regexp_replace(raw, '"project_name":"[^"]*"', '"project_name":5')).otherwise(
        F.when(F.col("domain") == "5-LOW", F.replace(raw, F.lit('"directory"'), F.lit('"name"'))).otherwise(raw))
    return g.projects.join(first, "project_id").select("project_id", raw.alias("raw"))


_graph_query(
    "check_placement", lambda g: _count(V.check_placement(_placements(g))),
    """, c AS (SELECT domain, count(*) AS n FROM projects GROUP BY 1), x AS (SELECT * FROM (VALUES ('1-URGENT', 'PLACEMENT_BOOL'), ('2-HIGH', 'PLACEMENT_TYPES'), ('2-HIGH', 'PLACEMENT_ID_MATCH'), ('5-LOW', 'PLACEMENT_FIELDS'), ('5-LOW', 'PLACEMENT_FIELD_NAMES'), ('5-LOW', 'PLACEMENT_TYPES')) v(domain, rule))
    SELECT rule, 'error' AS severity, sum(n)::BIGINT AS n FROM c JOIN x USING (domain) GROUP BY rule""",
)


def _entity_files(g):
    """Entity files as JSON from each project's mentions and phases; a whole number, a list and a text are something else in some domains."""
    one = F.struct(F.col("entity_id").alias("name"), "aliases", "category", "definition", "role", F.length("role").alias("first_appearance_index"))
    entities = g.mentions.join(g.entities, "entity_id").groupBy("project_id").agg(F.to_json(F.collect_list(one)).alias("e"))
    phases = g.phases.groupBy("project_id").agg(F.to_json(F.collect_list(F.struct(F.col("phase_index").alias("index"), F.col("period").alias("label"), "period"))).alias("p"))
    raw = F.concat(F.lit('{"entities":'), F.coalesce("e", F.lit("[]")), F.lit(',"temporal_phases":'), F.coalesce("p", F.lit("[]")), F.lit("}"))
    changed = F.when(F.col("domain") == "1-URGENT", F.replace(raw, F.lit('"first_appearance_index":1'), F.lit('"first_appearance_index":true'))).when(
        F.col("domain") == "2-HIGH", F.regexp_replace(raw, r'"aliases":\[[^\]]*\]', '"aliases":"none"')).when(F.col("domain") == "5-LOW", F.regexp_replace(raw, '"role":"[^"]*"', '"role":null')).otherwise(raw)
    return g.projects.join(entities, "project_id", "left").join(phases, "project_id", "left").select("project_id", changed.alias("raw"))


_graph_query(
    "check_entity_file", lambda g: _count(V.check_entity_file(_entity_files(g), ["Brand#11", "Brand#22"])),
    """, m AS (SELECT m.project_id, domain, category, EXISTS (SELECT 1 FROM phases p WHERE p.project_id = m.project_id AND p.phase_index = 1) AS known FROM mentions m JOIN entities USING (entity_id) JOIN projects p ON p.project_id = m.project_id)
    SELECT rule, 'error' AS severity, n FROM (SELECT 'ENTITY_CATEGORY' AS rule, count(*) FILTER (category NOT IN ('Brand#11', 'Brand#22')) AS n FROM m UNION ALL SELECT 'ENTITY_PHASE_MAP', count(*) FILTER (domain = '1-URGENT' OR NOT known) FROM m
      UNION ALL SELECT 'ENTITY_FIELDS', count(*) FILTER (domain IN ('2-HIGH', '5-LOW')) FROM m UNION ALL SELECT 'ENTITY_COUNT_MIN', count(*) FROM projects WHERE project_id NOT IN (SELECT project_id FROM mentions)) WHERE n > 0""",
)

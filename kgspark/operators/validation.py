"""Validation rules over extraction artifacts. Every check returns violations(project_id, file, rule, message, severity).

A rule is a name, a condition that marks bad rows and a message, all columns; ``check_rows`` runs many rules
over a table in one pass.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entity categories, causal classes, evidence strengths, magnitudes, required files, fields of a placement, of an entity and of an extraction.
CATEGORIES = ["Person", "Organization", "Place", "Event", "Concept", "System", "Process", "Technology", "Law", "Agreement", "Metric", "Document", "Resource", "Other"]
CAUSAL_CLASSES = [
    "CAUSES", "ENABLES", "BLOCKS", "INFLUENCES", "DEPENDS_ON", "CONTRADICTS", "SUPPORTS", "PRECEDES",
    "COMPETES_WITH", "COOPERATES_WITH", "REGULATES", "TRANSFORMS", "PRODUCES", "CONSUMES", "IMPLEMENTS",
]
STRENGTHS = ["established", "claimed", "disputed", "speculative"]
MAGNITUDES = ["foundational", "significant", "marginal"]
FILES = ["01_html.html", "02_placement.json", "03_nlp_entities.json", "04_all_entities.json", "05_embeddings.json", "06_extraction.json"]
PLACEMENT_FIELDS = ["directory", "project_name", "unique_id", "collection", "collection_is_new"]
PLACEMENT_BAD_NAMES = ["collection_name", "name", "projectName"]
ENTITY_FIELDS = ["name", "aliases", "category", "definition", "role", "first_appearance_index"]
TOP_LEVEL = ["project", "relationships", "causal_chains"]
PROJECT_FIELDS = ["name", "unique_id", "summary", "narrative_flow", "tags"]
KEBAB = "^[a-z0-9]+(-[a-z0-9]+)*$"

Rule = tuple[str, Column, Column | str]


def check_rows(rows: DataFrame, file: str, rules: Iterable[Rule], severity: str = "error") -> DataFrame:
    """Violations of each rule by the rows of a table with project_id."""
    marks = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("rule"), (F.lit(said) if isinstance(said, str) else said).alias("message"))) for name, bad, said in rules]
    found = rows.select("project_id", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m"))
    return found.select("project_id", F.lit(file).alias("file"), "m.rule", F.coalesce("m.message", F.lit("")).alias("message"), F.lit(severity).alias("severity"))


def _blank(column: str) -> Column:
    return F.coalesce(F.trim(column) == "", F.lit(True))


def check_files(projects: DataFrame, files: DataFrame, importing: bool = False) -> DataFrame:
    """(project_id), (project_id, file): DIR_EMPTY without any file, FILE_MISSING for each required one; imports need no NLP file."""
    needed = [f for f in FILES if not (importing and f == "03_nlp_entities.json")]
    have = files.select("project_id").distinct()
    empty = projects.select("project_id").join(have, "project_id", "left_anti").select("project_id", F.lit("").alias("file"), F.lit("DIR_EMPTY").alias("rule"), F.lit("no files").alias("message"), F.lit("error").alias("severity"))
    expected = projects.select("project_id").join(have, "project_id", "left_semi").withColumn("file", F.explode(F.array(*[F.lit(f) for f in needed])))
    missing = expected.join(files.select("project_id", "file"), ["project_id", "file"], "left_anti")
    return empty.unionByName(missing.select("project_id", "file", F.lit("FILE_MISSING").alias("rule"), F.concat(F.col("file"), F.lit(" is missing")).alias("message"), F.lit("error").alias("severity")))


def _kind(value: Column) -> Column:
    """The JSON type of a variant: OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, … or missing."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit("missing"))


def _at(value: str | Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, F.lit(path), kind)


def _said(value: str | Column, path: str) -> Column:
    """A text that is not blank, else null; a number or a boolean is no text."""
    text = F.when(_kind(_at(value, path)) == "STRING", _at(value, path, "string"))
    return F.when(F.trim(text) != "", text)


def _parsed(files: DataFrame) -> DataFrame:
    return files.withColumn("_v", F.try_parse_json("raw")).withColumn("_keys", F.json_object_keys("raw"))


def check_placement(placements: DataFrame) -> DataFrame:
    """(project_id, raw JSON): parse, key set, names that belong elsewhere, texts, kebab-case id, id equal to the name, boolean flag; types as JSON has them."""
    p = _parsed(placements)
    wanted = F.array(*[F.lit(k) for k in PLACEMENT_FIELDS])
    whole = F.col("_v").isNotNull() & F.col("_keys").isNotNull()
    unknown, absent = F.array_except("_keys", wanted), F.array_except(wanted, "_keys")
    named = F.array_intersect("_keys", F.array(*[F.lit(k) for k in PLACEMENT_BAD_NAMES]))
    uid, name = _at("_v", "$.unique_id", "string"), _at("_v", "$.project_name", "string")
    return check_rows(p, "02_placement.json", [
        ("JSON_PARSE", F.col("_v").isNull(), "not JSON"),
        ("JSON_PARSE", F.col("_v").isNotNull() & F.col("_keys").isNull(), "not an object"),
        ("PLACEMENT_FIELDS", whole & (F.size(absent) + F.size(unknown) > 0), F.concat_ws(", ", absent, unknown)),
        ("PLACEMENT_FIELD_NAMES", whole & (F.size(named) > 0), F.array_join(named, ", ")),
        *[("PLACEMENT_TYPES", whole & _said("_v", f"$.{k}").isNull(), f"{k} is no text") for k in PLACEMENT_FIELDS[:4]],
        ("PLACEMENT_ID", whole & (_kind(_at("_v", "$.unique_id")) == "STRING") & ~uid.rlike(KEBAB), uid),
        ("PLACEMENT_ID_MATCH", whole & (uid != "") & (name != "") & ((uid != name) | (_kind(_at("_v", "$.unique_id")) != _kind(_at("_v", "$.project_name")))), uid),
        ("PLACEMENT_BOOL", whole & (_kind(_at("_v", "$.collection_is_new")) != "BOOLEAN"), F.concat(F.lit("collection_is_new is "), _kind(_at("_v", "$.collection_is_new")))),
    ])


def check_nlp_file(files: DataFrame) -> DataFrame:
    """(project_id, raw JSON): an object with a list of candidates, each an object with a text; an empty list is fine."""
    whole = F.col("_v").isNotNull() & F.col("_keys").isNotNull()
    kind = _kind(_at("_v", "$.entity_candidates"))
    bad = F.exists(_at("_v", "$.entity_candidates", "array<variant>"), lambda x: _said(x, "$.text").isNull())
    return check_rows(_parsed(files), "03_nlp_entities.json", [
        ("JSON_PARSE", F.col("_v").isNull(), "not JSON"),
        ("NLP_CANDIDATES", F.col("_v").isNotNull() & F.col("_keys").isNull(), "not an object"),
        ("NLP_CANDIDATES", whole & (kind != "ARRAY"), F.concat(F.lit("entity_candidates is "), kind)),
        ("NLP_CANDIDATES", whole & (kind == "ARRAY") & bad, "candidate without text"),
    ])


def _items(parsed: DataFrame, path: str) -> DataFrame:
    """(project_id, pos, x): the items of a list of each file."""
    return parsed.filter("_keys IS NOT NULL").select("project_id", F.posexplode(_at("_v", path, "array<variant>")).alias("pos", "x"))


def entity_names(files: DataFrame) -> DataFrame:
    """(project_id, name): the distinct names of the entities in the files (project_id, raw)."""
    names = _items(_parsed(files), "$.entities").select("project_id", _said("x", "$.name").alias("name"))
    return names.filter("name IS NOT NULL").distinct()


def check_entity_file(files: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """(project_id, raw JSON): both lists; of phases whole, unique indices and texts; of entities the six fields, their types, category, phase and unique names."""
    file, parsed = "04_all_entities.json", _parsed(files)
    whole = F.col("_v").isNotNull() & F.col("_keys").isNotNull()
    kind = lambda path: _kind(_at("_v", path))
    found = check_rows(parsed, file, [
        ("JSON_PARSE", F.col("_v").isNull(), "not JSON"),
        ("ENTITY_ARRAY", F.col("_v").isNotNull() & F.col("_keys").isNull(), "not an object"),
        ("ENTITY_PHASES", whole & (kind("$.temporal_phases") != "ARRAY"), F.concat(F.lit("temporal_phases is "), kind("$.temporal_phases"))),
        ("ENTITY_ARRAY", whole & (kind("$.entities") != "ARRAY"), F.concat(F.lit("entities is "), kind("$.entities"))),
        ("ENTITY_COUNT_MIN", whole & (F.size(_at("_v", "$.entities", "array<variant>")) == 0), "no entities"),
    ])
    index = F.when(_kind(_at("x", "$.index")) == "BIGINT", _at("x", "$.index", "bigint"))
    phases = _items(parsed, "$.temporal_phases").withColumn("index", F.when(index >= 0, index))
    again = F.row_number().over(Window.partitionBy("project_id", "index").orderBy("pos")) > 1
    one = _kind(F.col("x")) == "OBJECT"
    found = found.unionByName(check_rows(phases.withColumn("again", again), file, [
        ("ENTITY_PHASE_FIELDS", ~one, "phase is no object"),
        ("ENTITY_PHASE_FIELDS", one & F.col("index").isNull(), "index is no whole number of 0 or more"),
        ("ENTITY_PHASE_FIELDS", one & F.col("index").isNotNull() & F.col("again"), F.concat(F.lit("index twice: "), F.col("index").cast("string"))),
        *[("ENTITY_PHASE_FIELDS", one & _said("x", f"$.{c}").isNull(), f"{c} is no text") for c in ("label", "period")],
    ]))
    known = phases.filter("index IS NOT NULL").select("project_id", F.col("index").alias("first"), F.lit(True).alias("known")).distinct()
    given = _kind(_at("x", "$.first_appearance_index"))
    entities = _items(parsed, "$.entities").withColumn("name", _said("x", "$.name")).withColumn("first", F.when(given == "BIGINT", _at("x", "$.first_appearance_index", "bigint")))
    entities = entities.withColumn("again", F.row_number().over(Window.partitionBy("project_id", "name").orderBy("pos")) > 1).join(known, ["project_id", "first"], "left")
    absent = F.filter(F.array(*[F.when(_at("x", f"$.{c}").isNull(), F.lit(c)) for c in ENTITY_FIELDS]), lambda c: c.isNotNull())
    aliases = _at("x", "$.aliases", "array<variant>")
    category = F.when(_kind(_at("x", "$.category")) == "STRING", _at("x", "$.category", "string"))
    return found.unionByName(check_rows(entities, file, [
        ("ENTITY_FIELDS", ~one, "entity is no object"),
        ("ENTITY_FIELDS", one & (F.size(absent) > 0), F.concat(F.lit("missing "), F.array_join(absent, ", "))),
        ("ENTITY_FIELDS", one & ((_kind(_at("x", "$.aliases")) != "ARRAY") | F.exists(aliases, lambda a: _said(a, "$").isNull())), "aliases is no list of texts"),
        *[("ENTITY_FIELDS", one & _said("x", f"$.{c}").isNull(), f"{c} is no text") for c in ("name", "definition", "role")],
        ("ENTITY_CATEGORY", one & ~F.coalesce(category.isin(categories or CATEGORIES), F.lit(False)), F.coalesce(category, F.lit(""))),
        ("ENTITY_PHASE_MAP", one & ~given.isin("missing", "VOID") & F.col("known").isNull(), F.concat(F.lit("no phase "), F.coalesce(F.col("first").cast("string"), given))),
        ("ENTITY_DUPLICATE", F.col("name").isNotNull() & F.col("again"), F.col("name")),
    ]))


def check_embedding_entries(files: DataFrame, entities: DataFrame, placements: DataFrame, dim: int = 384) -> DataFrame:
    """(project_id, raw JSON), names of entities (project_id, name), (project_id, unique_id): each vector's types, size and values; names that are
    twice, missing or unexpected; the project's id as the last name and as no entity's; their number."""
    file = "05_embeddings.json"
    items = _items(_parsed(files), "$.embeddings").withColumn("name", _said("x", "$.name"))
    last = F.max("pos").over(Window.partitionBy("project_id"))
    names = entities.select("project_id", "name").distinct()
    rows = items.withColumn("again", F.row_number().over(Window.partitionBy("project_id", "name").orderBy("pos")) > 1).withColumn("last", F.col("pos") == last)
    rows = rows.join(names.withColumn("known", F.lit(True)), ["project_id", "name"], "left").join(placements.select("project_id", "unique_id"), "project_id", "left")
    one, vector = _kind(F.col("x")) == "OBJECT", _at("x", "$.embedding", "array<variant>")
    listed = one & (_kind(_at("x", "$.embedding")) == "ARRAY")
    number = lambda v: _kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") & ~F.coalesce(F.abs(F.try_variant_get(v, F.lit("$"), "double")) == float("inf"), F.lit(True))
    numbers = F.forall(vector, number)
    own, has = _at("x", "$.dimensions"), F.col("unique_id").isNotNull()
    found = check_rows(rows, file, [
        ("EMBED_FIELDS", ~one, "entry is no object"),
        ("EMBED_FIELDS", one & F.col("name").isNull(), "name is no text"),
        ("EMBED_FIELDS", one & ~listed, "embedding is no list"),
        ("EMBED_DIMENSIONS", listed & (F.size(vector) != dim), F.col("name")),
        ("EMBED_FIELDS", listed & ~numbers, F.col("name")),
        ("EMBED_ZERO", listed & numbers & (F.size(vector) > 0) & F.forall(vector, lambda v: F.try_variant_get(v, F.lit("$"), "double") == 0), F.col("name")),
        ("EMBED_DIMENSIONS", one & own.isNotNull() & ~((_kind(own) == "BIGINT") & F.coalesce(_at("x", "$.dimensions", "bigint") == dim, F.lit(False))), F.col("name")),
        ("EMBED_DUPLICATE", F.col("name").isNotNull() & F.col("again"), F.col("name")),
        ("EMBED_ENTITY_MATCH", has & F.col("name").isNotNull() & ~F.col("again") & F.col("known").isNull() & (F.col("name") != F.col("unique_id")), F.col("name")),
        ("EMBED_PROJECT", has & F.col("last") & ~F.coalesce(F.col("name") == F.col("unique_id"), F.lit(False)), F.col("name")),
    ])
    with_any = items.filter("name IS NOT NULL").select("project_id").distinct()
    missing = names.join(items.select("project_id", "name"), ["project_id", "name"], "left_anti").join(with_any, "project_id", "left_semi")
    found = found.unionByName(check_rows(missing, file, [("EMBED_ENTITY_MATCH", F.lit(True), F.concat(F.lit("none for "), F.col("name")))]))
    same = names.join(with_any, "project_id", "left_semi").join(placements.select("project_id", F.col("unique_id").alias("name")), ["project_id", "name"], "left_semi")
    found = found.unionByName(check_rows(same, file, [("EMBED_PROJECT_NAME", F.lit(True), F.col("name"))]))
    listed_files = _parsed(files).filter("_keys IS NOT NULL").select("project_id", F.size(_at("_v", "$.embeddings", "array<variant>")).alias("v")).filter("v >= 0")
    count = listed_files.join(names.groupBy("project_id").agg(F.count("*").alias("e")), "project_id")
    return found.unionByName(check_rows(count, file, [("EMBED_COUNT", F.col("v") != F.col("e") + 1, F.concat_ws(" of ", "v", F.col("e") + 1))]))


def check_nlp(candidates: DataFrame) -> DataFrame:
    """(project_id, candidates array<struct<text>>): a list, every text non-blank; an empty list is fine."""
    return check_rows(candidates, "03_nlp_entities.json", [
        ("NLP_CANDIDATES", F.col("candidates").isNull(), "not a list"),
        ("NLP_CANDIDATES", F.exists("candidates", lambda c: F.coalesce(F.trim(c["text"]) == "", F.lit(True))), "candidate without text"),
    ])


def check_phases(phases: DataFrame) -> DataFrame:
    """(project_id, phase_index, label, period): index there, at least 0 and unique; texts non-blank."""
    n = F.count("*").over(Window.partitionBy("project_id", "phase_index"))
    rows = phases.withColumn("_n", n)
    return check_rows(rows, "04_all_entities.json", [
        ("ENTITY_PHASES", F.col("phase_index").isNull() | (F.col("phase_index") < 0), "phase index"),
        ("ENTITY_PHASES", F.col("phase_index").isNotNull() & (F.col("_n") > 1), "phase index twice"),
        ("ENTITY_PHASE_FIELDS", F.coalesce(F.trim("label") == "", F.lit(True)) | F.coalesce(F.trim("period") == "", F.lit(True)), "blank label or period"),
    ])


def check_entities(projects: DataFrame, entities: DataFrame, phases: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """(project_id, name, category, definition, first_appearance_index): at least one; fields, category, a given phase must exist, each repetition of a name."""
    none = projects.select("project_id").join(entities, "project_id", "left_anti")
    known = phases.select("project_id", F.col("phase_index").alias("first_appearance_index")).distinct().withColumn("_known", F.lit(True))
    n = F.row_number().over(Window.partitionBy("project_id", "name").orderBy("category", "definition"))
    rows = entities.withColumn("_n", n).join(known, ["project_id", "first_appearance_index"], "left")
    found = check_rows(rows, "04_all_entities.json", [
        ("ENTITY_FIELDS", F.coalesce(F.trim("name") == "", F.lit(True)) | F.coalesce(F.trim("definition") == "", F.lit(True)), "blank name or definition"),
        ("ENTITY_CATEGORY", ~F.coalesce(F.col("category").isin(categories or CATEGORIES), F.lit(False)), F.col("category")),
        ("ENTITY_PHASE_MAP", F.col("first_appearance_index").isNotNull() & F.col("_known").isNull(), F.concat(F.lit("no phase "), F.col("first_appearance_index").cast("string"))),
        ("ENTITY_DUPLICATE", (F.col("_n") > 1) & (F.trim("name") != ""), F.col("name")),
    ])
    return found.unionByName(check_rows(none, "04_all_entities.json", [("ENTITY_COUNT_MIN", F.lit(True), "no entities")]))


def check_relations(projects: DataFrame, relations: DataFrame, entities: DataFrame, families: list[str] | None = None, strengths: list[str] | None = None) -> DataFrame:
    """(project_id, source, target, rel_type, causal, evidence_strength, magnitude, year[, description, evidence]); also the warning YEAR_MISSING.

    Columns source_entity and target_entity, where there are any, must be null.
    """
    none = projects.select("project_id").join(relations, "project_id", "left_anti")
    names = entities.select("project_id", "name").distinct()
    rows = relations.join(names.select("project_id", F.col("name").alias("source"), F.lit(True).alias("_s")), ["project_id", "source"], "left").join(names.select("project_id", F.col("name").alias("target"), F.lit(True).alias("_t")), ["project_id", "target"], "left")
    found = check_rows(rows, "06_extraction.json", [
        *[("EXTRACT_REL_FIELDS", _blank(c), f"blank {c}") for c in ("source", "target", "rel_type", "description", "evidence") if c in relations.columns],
        ("EXTRACT_REL_FIELDS", F.col("year").isNull(), "no year"),
        *[("EXTRACT_REL_NAMES", F.col(c).isNotNull(), f"{c} in place of {c.removesuffix('_entity')}") for c in ("source_entity", "target_entity") if c in relations.columns],
        ("EXTRACT_CAUSAL_CLASS", ~F.coalesce(F.col("causal").isin(families or CAUSAL_CLASSES), F.lit(False)), F.col("causal")),
        ("EXTRACT_EVIDENCE", ~F.coalesce(F.col("evidence_strength").isin(strengths or STRENGTHS), F.lit(False)), F.col("evidence_strength")),
        ("EXTRACT_MAGNITUDE", ~F.coalesce(F.col("magnitude").isin(MAGNITUDES), F.lit(False)), F.col("magnitude")),
        ("EXTRACT_ENTITY_MATCH", ~_blank("source") & F.col("_s").isNull(), F.col("source")),
        ("EXTRACT_ENTITY_MATCH", ~_blank("target") & F.col("_t").isNull(), F.col("target")),
    ])
    years = check_rows(relations, "06_extraction.json", [("YEAR_MISSING", F.trim(F.col("year").cast("string")) == "", "empty year")], "warning")
    return found.unionByName(years).unionByName(check_rows(none, "06_extraction.json", [("EXTRACT_REL_COUNT", F.lit(True), "no relations")]))


def check_evidence(relations: DataFrame, sources: DataFrame) -> DataFrame:
    """A quote, white space collapsed, must stand in its project's source, collapsed alike; projects without source are skipped."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rows = relations.select("project_id", flat("evidence").alias("_q")).join(sources.select("project_id", flat("text").alias("_t")), "project_id")
    return check_rows(rows, "06_extraction.json", [("EXTRACT_EVIDENCE_SOURCE", (F.col("_q") != "") & ~F.col("_t").contains(F.col("_q")), F.substring("_q", 1, 80))])


def check_chains(links: DataFrame, relations: DataFrame, entities: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """(project_id, chain, source, target[, explanation]): texts, ends are entities, and each link is a directed relation of the project.

    ``chains`` (project_id, chain, name[, description]): a chain has a name and at least one link, and no blank description.
    """
    names = entities.select("project_id", "name").distinct()
    rels = relations.select("project_id", "source", "target").distinct().withColumn("_r", F.lit(True))
    rows = links.join(names.select("project_id", F.col("name").alias("source"), F.lit(True).alias("_s")), ["project_id", "source"], "left").join(names.select("project_id", F.col("name").alias("target"), F.lit(True).alias("_t")), ["project_id", "target"], "left").join(rels, ["project_id", "source", "target"], "left")
    found = check_rows(rows, "06_extraction.json", [
        *[("EXTRACT_CHAIN_FIELDS", _blank(c), f"blank {c}") for c in ("source", "target", "explanation") if c in links.columns],
        ("EXTRACT_CHAIN_MATCH", ~_blank("source") & F.col("_s").isNull(), F.col("source")),
        ("EXTRACT_CHAIN_MATCH", ~_blank("target") & F.col("_t").isNull(), F.col("target")),
        ("EXTRACT_CHAIN_EVIDENCE", ~_blank("source") & ~_blank("target") & F.col("_r").isNull(), F.concat_ws(" > ", "source", "target")),
    ])
    if chains is None:
        return found
    linked = links.select("project_id", "chain").distinct().withColumn("_l", F.lit(True))
    said = [("EXTRACT_CHAIN_FIELDS", F.trim("description") == "", "blank description")] if "description" in chains.columns else []
    return found.unionByName(check_rows(chains.join(linked, ["project_id", "chain"], "left"), "06_extraction.json", [
        ("EXTRACT_CHAIN_FIELDS", _blank("name"), "blank name"),
        ("EXTRACT_CHAIN_FIELDS", F.col("_l").isNull(), F.concat(F.lit("no links in "), F.coalesce("name", F.lit("")))),
        *said,
    ]))


def check_project(extractions: DataFrame, placements: DataFrame) -> DataFrame:
    """(project_id, raw JSON of an extraction), (project_id, unique_id): keys, the project's fields, its id, narrative and tags; types of the three parts."""
    rows = extractions.join(placements.select("project_id", F.col("unique_id").alias("_placed")), "project_id", "left").withColumn("_v", F.try_parse_json("raw"))
    part = lambda path: F.try_variant_get("_v", F.lit(path), "variant")
    kind = lambda path: F.coalesce(F.regexp_extract(F.schema_of_variant(part(path)), "^[A-Z]+", 0), F.lit("missing"))
    text = lambda path: F.when(kind(path) == "STRING", F.trim(F.try_variant_get("_v", F.lit(path), "string")))
    empty = lambda path: F.coalesce(text(path) == "", F.lit(True))
    odd = lambda path: F.exists(F.try_variant_get("_v", F.lit(path), "array<variant>"), lambda x: F.coalesce((F.schema_of_variant(x) != "STRING") | (F.trim(F.try_variant_get(x, F.lit("$"), "string")) == ""), F.lit(True)))
    keys = F.json_object_keys("raw")
    whole = F.coalesce(F.col("_v").isNotNull() & keys.isNotNull(), F.lit(False))
    project = whole & (kind("$.project") == "OBJECT")
    tags = project & (kind("$.project.tags") == "OBJECT")
    wanted = F.array(*[F.lit(k) for k in TOP_LEVEL])
    lacks = F.array_except(F.array(*[F.lit(k) for k in PROJECT_FIELDS]), F.json_object_keys(F.get_json_object("raw", "$.project")))
    differs = project & (text("$.project.unique_id") != "") & (F.col("_placed") != "") & (text("$.project.unique_id") != F.trim("_placed"))
    narrative, base = "$.project.narrative_flow", "$.project.tags.base_tags"
    found = check_rows(rows, "06_extraction.json", [
        ("JSON_PARSE", F.col("_v").isNull(), "not JSON"),
        ("EXTRACT_TOPLEVEL", F.col("_v").isNotNull() & keys.isNull(), "not an object"),
        ("EXTRACT_TOPLEVEL", whole & ((F.size(F.array_except(wanted, keys)) > 0) | (F.size(F.array_except(keys, wanted)) > 0)), F.concat_ws(", ", F.array_except(wanted, keys), F.array_except(keys, wanted))),
        ("EXTRACT_PROJECT", whole & ~project, F.concat(F.lit("project is "), kind("$.project"))),
        ("EXTRACT_PROJECT", project & (F.size(lacks) > 0), F.concat(F.lit("missing "), F.array_join(lacks, ", "))),
        *[("EXTRACT_PROJECT", project & empty(f"$.project.{c}"), f"{c} is no text") for c in ("name", "unique_id", "summary")],
        ("EXTRACT_ID_MATCH", differs, text("$.project.unique_id")),
        ("EXTRACT_NARRATIVE", project & (kind(narrative) != "ARRAY"), F.concat(F.lit("narrative_flow is "), kind(narrative))),
        ("EXTRACT_NARRATIVE", project & (kind(narrative) == "ARRAY") & odd(narrative), "an item of narrative_flow is no text"),
        ("EXTRACT_TAGS", project & ~tags, F.concat(F.lit("tags is "), kind("$.project.tags"))),
        *[("EXTRACT_TAGS", tags & empty(f"$.project.tags.{c}"), f"{c} is no text") for c in ("domain", "subdomain")],
        ("EXTRACT_TAGS", tags & ((kind(base) != "ARRAY") | F.coalesce(F.size(F.try_variant_get("_v", F.lit(base), "array<variant>")) == 0, F.lit(True)) | F.coalesce(odd(base), F.lit(False))), "base_tags holds no texts"),
        ("EXTRACT_REL_COUNT", whole & ~kind("$.relationships").isin("ARRAY", "missing"), F.concat(F.lit("relationships is "), kind("$.relationships"))),
        ("EXTRACT_CHAIN_COUNT", whole & ~kind("$.causal_chains").isin("ARRAY", "missing"), F.concat(F.lit("causal_chains is "), kind("$.causal_chains"))),
    ])
    return found.unionByName(check_rows(rows, "CROSS", [("CROSS_ID", differs, text("$.project.unique_id"))]))


def check_embedding_file(files: DataFrame, dim: int = 384) -> DataFrame:
    """(project_id, raw JSON): the object, its list, its model and dimensions."""
    rows = files.withColumn("_v", F.try_parse_json("raw")).withColumn("_keys", F.json_object_keys("raw"))
    kind = lambda path: F.coalesce(F.regexp_extract(F.schema_of_variant(F.try_variant_get("_v", F.lit(path), "variant")), "^[A-Z]+", 0), F.lit("missing"))
    whole = F.coalesce(F.col("_v").isNotNull() & F.col("_keys").isNotNull(), F.lit(False))
    listed = whole & (kind("$.embeddings") == "ARRAY")
    model = (kind("$.model") == "STRING") & (F.trim(F.try_variant_get("_v", F.lit("$.model"), "string")) != "")
    size = (kind("$.dimensions") == "BIGINT") & (F.try_variant_get("_v", F.lit("$.dimensions"), "bigint") == dim)
    return check_rows(rows, "05_embeddings.json", [
        ("JSON_PARSE", F.col("_v").isNull(), "not JSON"),
        ("EMBED_STRUCTURE", F.col("_v").isNotNull() & F.col("_keys").isNull(), "not an object"),
        ("EMBED_STRUCTURE", whole & F.arrays_overlap("_keys", F.array(F.lit("entity_embeddings"), F.lit("project_embedding"))), "use the key embeddings"),
        ("EMBED_STRUCTURE", whole & ~listed, F.concat(F.lit("embeddings is "), kind("$.embeddings"))),
        ("EMBED_STRUCTURE", listed & ~F.coalesce(model & size, F.lit(False)), "model or dimensions"),
    ])


def check_embeddings(vectors: DataFrame, entities: DataFrame, dim: int) -> DataFrame:
    """(project_id, pos, name, embedding): numbers, size, not zero, no name twice, one for each entity and the project's last."""
    same = Window.partitionBy("project_id", "name")
    last = F.max("pos").over(Window.partitionBy("project_id"))
    names = entities.select("project_id", "name").distinct().withColumn("_e", F.lit(True))
    rows = vectors.withColumn("_n", F.count("*").over(same)).withColumn("_last", F.col("pos") == last).join(names, ["project_id", "name"], "left")
    found = check_rows(rows, "05_embeddings.json", [
        ("EMBED_FIELDS", F.col("embedding").isNull() | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.col("name")),
        ("EMBED_DIMENSIONS", F.size("embedding") != dim, F.col("name")),
        ("EMBED_ZERO", F.forall("embedding", lambda x: x == 0), F.col("name")),
        ("EMBED_DUPLICATE", F.col("_n") > 1, F.col("name")),
        ("EMBED_ENTITY_MATCH", F.col("_e").isNull() & ~F.col("_last"), F.col("name")),
        ("EMBED_PROJECT", F.col("_last") & (F.col("name") != F.col("project_id")), F.col("name")),
    ])
    count = vectors.groupBy("project_id").agg(F.count("*").alias("v")).join(names.groupBy("project_id").agg(F.count("*").alias("e")), "project_id", "full_outer")
    return found.unionByName(check_rows(count, "05_embeddings.json", [("EMBED_COUNT", F.coalesce("v", F.lit(0)) != F.coalesce("e", F.lit(0)) + 1, F.concat_ws(" of ", "v", F.col("e") + 1))]))


def validation_report(projects: DataFrame, violations: DataFrame) -> DataFrame:
    """(project_id, errors, warnings, rules, valid)."""
    by = violations.groupBy("project_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    out = projects.select("project_id").join(by, "project_id", "left")
    return out.select("project_id", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), F.coalesce("rules", F.lit("")).alias("rules"), (F.coalesce("errors", F.lit(0)) == 0).alias("valid"))


def gate(projects: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects without an error, and those with one."""
    bad = violations.filter("severity = 'error'").select("project_id").distinct()
    return projects.join(bad, "project_id", "left_anti"), projects.join(bad, "project_id", "left_semi")

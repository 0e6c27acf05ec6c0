"""Export of a collection as a bundle, import of a bundle into a graph, its verification, and vectors embedded again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import hashed_vectors
from kgspark.operators.aggregates import bridge_tier
from kgspark.operators.build import broken_embeddings, counted_small, delete_projects, new_id, resolve_entities
from kgspark.sources.graph import Graph
from kgspark.sources.portable import SECTIONS, Bundle
from kgspark.sources.scratch import write_out

RELATION_FIELDS = ("rel_type", "causal", "magnitude", "evidence_strength", "year")
TEXTS = "array<string>"


def _members(g: Graph, collection: str) -> DataFrame:
    return g.project_collections.filter(F.lower("collection") == collection.lower()).select("project_id").distinct()


def _inside(g: Graph, ids: DataFrame, mentions: DataFrame) -> DataFrame:
    """Relations of the projects, or of none, whose two ends one of the projects mentions.

    Most ends meet in the relation's own project, which two equal-key joins show; only the others look for a shared project."""
    pairs = mentions.select("project_id", "entity_id").distinct()
    end = lambda side: pairs.select("project_id", F.col("entity_id").alias(side), F.lit(True).alias(f"_{side}"))
    owned = g.relations.join(ids, "project_id", "left_semi").unionByName(g.relations.filter("project_id IS NULL"))
    seen = owned.join(end("src"), ["project_id", "src"], "left").join(end("dst"), ["project_id", "dst"], "left")
    together = F.col("_src").isNotNull() & F.col("_dst").isNotNull()
    rest = seen.filter(~together).join(pairs.select(F.col("project_id").alias("_p"), F.col("entity_id").alias("src")), "src")
    rest = rest.join(pairs.select(F.col("project_id").alias("_p"), F.col("entity_id").alias("dst")), ["_p", "dst"], "left_semi").dropDuplicates(["rel_id"])
    return seen.filter(together).select(*g.relations.columns).unionByName(rest.select(*g.relations.columns))


def export_collection(
    g: Graph, collection: str, entity_vectors: DataFrame | None = None, project_vectors: DataFrame | None = None, similar: DataFrame | None = None, missing_sources: DataFrame | None = None
) -> Bundle:
    """The bundle of a collection (in any case): its projects and all that they hold, by name.

    Entities of one name become one, with the attributes of the least id and the aliases of all; those without a name are left out, with what
    refers to them. Inputs beside the graph: vectors (entity_id or project_id, embedding), similar (a, b, similarity) by id, of which
    pairs inside the collection are kept once, rounded to three places, and missing_sources (project_id)."""
    spark = g.entities.sparkSession
    ids = counted_small(write_out(_members(g, collection), "members"))
    mine = lambda df: df.join(ids, "project_id", "left_semi")
    mentions = write_out(mine(g.mentions), "export_mentions")  # sections that others follow from are made once
    every = g.entities.filter("name IS NOT NULL").select("entity_id", "name")
    named = g.entities.filter("name IS NOT NULL").join(mentions.select("entity_id").distinct(), "entity_id", "left_semi")
    names = named.select("entity_id", "name")
    first = lambda c: F.min_by(c, "entity_id").alias(c)
    aliases = F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases")  # the few entities of one name
    called = lambda df, column, new: df.join(every.select(F.col("entity_id").alias(column), F.col("name").alias(new)), column)
    relations = write_out(called(called(_inside(g, ids, mentions), "src", "source"), "dst", "target"), "export_relations")
    chains = write_out(mine(g.chains).select(F.col("chain_id").alias("chain"), F.col("project_id").alias("project"), "name"), "export_chains")
    links = g.chain_links.withColumnRenamed("chain_id", "chain").join(chains.select("chain").distinct(), "chain", "left_semi")
    links = write_out(called(called(links, "src", "source"), "dst", "target"), "export_links")
    if similar is None:
        pairs = spark.createDataFrame([], "a string, b string, similarity double")
    else:
        both = similar.join(names.select(F.col("entity_id").alias("a"), F.col("name").alias("x")), "a").join(names.select(F.col("entity_id").alias("b"), F.col("name").alias("y")), "b").filter("x <> y")
        pairs = both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.round(F.max("similarity"), 3).alias("similarity"))
    vectors = spark.createDataFrame([], "name string, kind string, embedding array<double>")
    if entity_vectors is not None:
        of = entity_vectors.filter("embedding IS NOT NULL").join(names, "entity_id").groupBy("name").agg(F.min_by("embedding", "entity_id").cast("array<double>").alias("embedding"))
        vectors = vectors.unionByName(of.withColumn("kind", F.lit("entity")))
    if project_vectors is not None:
        of = mine(project_vectors.filter("embedding IS NOT NULL")).select(F.col("project_id").alias("name"), F.lit("project").alias("kind"), F.col("embedding").cast("array<double>").alias("embedding"))
        vectors = vectors.unionByName(of.dropDuplicates(["name"]))
    gone = mine(missing_sources).select(F.col("project_id").alias("project")).distinct() if missing_sources is not None else spark.createDataFrame([], "project string")
    return Bundle(
        projects=mine(g.projects).select(F.col("project_id").alias("project"), "name", "summary", "domain", "subdomain", "base_tags"),
        entities=named.groupBy("name").agg(first("category"), first("definition"), aliases),
        mentions=mentions.join(names, "entity_id").groupBy(F.col("name").alias("entity"), F.col("project_id").alias("project")).agg(F.min("role").alias("role")),
        relations=relations.select("rel_id", F.col("project_id").alias("project"), "source", "target", *RELATION_FIELDS),
        chains=chains,
        chain_links=links.select("chain", "order_index", "source", "target"),
        phases=mine(g.phases).select(F.col("project_id").alias("project"), "phase_index", "period"),
        similar=pairs,
        vectors=vectors,
        missing_sources=gone,
    )


def bundle_bridges(bundle: Bundle) -> DataFrame:
    """(name, category, projects, tier) of the entities that two projects or more mention."""
    many = bundle.mentions.groupBy(F.col("entity").alias("name")).agg(F.countDistinct("project").alias("projects")).filter("projects >= 2")
    return many.join(bundle.entities.select("name", "category"), "name").select("name", "category", "projects", bridge_tier(F.col("projects")).alias("tier"))


def bundle_stats(bundle: Bundle) -> DataFrame:
    """(section, n): rows of every section and of the bridges."""
    out = None
    for name, df in [(s, getattr(bundle, s)) for s in SECTIONS] + [("bridges", bundle_bridges(bundle))]:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def project_lines(bundle: Bundle, longest: int = 300) -> DataFrame:
    """(project, name, domain, subdomain, summary): summaries beyond the length end in three dots; null ones are empty."""
    summary = F.coalesce("summary", F.lit(""))
    cut = F.when(F.length(summary) > longest, F.concat(F.substring(summary, 1, longest), F.lit("..."))).otherwise(summary)
    return bundle.projects.select("project", "name", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("subdomain", F.lit("")).alias("subdomain"), cut.alias("summary"))


def repair_embeddings(rows: DataFrame, vectors: DataFrame, id_col: str, dim: int, encoder=hashed_vectors, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """(id, text), (id, embedding) -> (id, embedding, refilled), and (id) of those that stay without a vector.

    Vectors that are missing, zero, hold null or non-finite values or have another length are made anew from the text; the others stay. Of several sound
    vectors of an id the least stays. ``whole`` gives the encoder all rows, as the built-in one weighs words by all of them; a model that reads each text
    alone needs only those that lack a vector. A text without words, or a broken vector without a text, stays without."""
    sized = vectors.select(id_col, F.when(F.size("embedding") == dim, F.col("embedding").cast("array<double>")).alias("embedding")).withColumn("_row", F.monotonically_increasing_id())
    broken = broken_embeddings(sized)
    sound = sized.join(broken.select("_row"), "_row", "left_anti").filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("embedding").alias("embedding"))
    texts = rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    asked = texts.select(id_col).unionByName(broken.filter(F.col(id_col).isNotNull()).select(id_col)).distinct().join(sound.select(id_col), id_col, "left_anti")
    made = encoder(texts if whole else texts.join(asked, id_col, "left_semi"), dim, id_col).join(asked, id_col, "left_semi")
    made = made.select(id_col, F.col("embedding").cast("array<double>").alias("embedding"))
    return sound.withColumn("refilled", F.lit(False)).unionByName(made.withColumn("refilled", F.lit(True))), asked.join(made.select(id_col), id_col, "left_anti")


@dataclass(frozen=True)
class Import:
    """What an import gives: the graph after it, vectors (entity_id or project_id, embedding), names(name, entity_id, is_new, stub) that the imported
    projects use, skipped(project) that the graph has already, and dropped(rel_id) of relations with an unknown end."""

    graph: Graph
    entity_vectors: DataFrame
    project_vectors: DataFrame
    names: DataFrame
    skipped: DataFrame
    dropped: DataFrame


def new_projects(bundle: Bundle, g: Graph) -> DataFrame:
    """The bundle's projects, one row for an id, whose id and name the graph does not have."""
    one = bundle.projects.filter("project IS NOT NULL").dropDuplicates(["project"])
    fresh = one.join(g.projects.select(F.col("project_id").alias("project")), "project", "left_anti")
    return fresh.join(g.projects.select("name"), "name", "left_anti")


def import_bundle(
    bundle: Bundle, g: Graph, directory: str, collection: str, entity_vectors: DataFrame | None = None, project_vectors: DataFrame | None = None, dim: int = 384, encoder=hashed_vectors
) -> Import:
    """Adds a bundle's projects to a graph, under a directory and a collection; projects that are there already are skipped with all they hold.

    A name that a project mentions, or that its relations or chain links refer to, is the bundle's entity of that name, else the one with that alias (the
    least name of several), else a stub of category Other. Entities meet the graph's by name or alias on either side, the least id wins; there, texts that are
    not blank stay and aliases are united. Referenced names are mentioned too, with the role ``referenced``. Relations without project
    come along where imported projects use both ends; otherwise they are dropped and reported. Ids of relations and chains follow from
    content, so nothing is added twice. Sound vectors of the graph stay, then come the bundle's, then new ones from the entities' texts."""
    spark = g.entities.sparkSession
    projects = write_out(new_projects(bundle, g), "import_projects")
    ids = projects.select("project")
    mine = lambda df: df.join(ids, "project", "left_semi")
    relations, chains, mentions = mine(bundle.relations), mine(bundle.chains).dropDuplicates(["chain", "project"]), mine(bundle.mentions)
    links = bundle.chain_links.join(chains.select("chain", "project"), "chain")
    ends = lambda df: df.select("project", F.explode(F.array("source", "target")).alias("entity"))
    referenced = ends(relations).unionByName(ends(links))
    used = mentions.select(F.col("entity").alias("name")).unionByName(referenced.select(F.col("entity").alias("name"))).filter("name IS NOT NULL").distinct()

    aliases = F.coalesce("aliases", F.array().cast(TEXTS))
    known = bundle.entities.filter("name IS NOT NULL").groupBy("name").agg(F.min("category").alias("category"), F.min("definition").alias("definition"), F.flatten(F.collect_list(aliases)).alias("aliases"))
    by_alias = known.select(F.col("name").alias("_other"), F.explode("aliases").alias("name")).groupBy("name").agg(F.min("_other").alias("_other"))
    canon = used.join(known.select("name", F.col("name").alias("_own")), "name", "left").join(by_alias, "name", "left")
    canon = canon.select("name", F.coalesce("_own", "_other", "name").alias("canonical"), F.coalesce("_own", "_other").isNull().alias("stub"))
    told = F.concat("name", F.lit(" is referred to by relations or chains of an import that does not define it."))
    wanted = canon.select(F.col("canonical").alias("name"), "stub").distinct().join(known, "name", "left")
    wanted = wanted.select("name", F.when(F.col("stub"), "Other").otherwise(F.col("category")).alias("category"), F.when(F.col("stub"), told).otherwise(F.col("definition")).alias("definition"), aliases.alias("aliases"))
    found = resolve_entities(wanted, g.entities)
    names = canon.join(found.withColumnRenamed("name", "canonical"), "canonical").select("name", "canonical", "entity_id", "is_new", "stub")
    names = write_out(names, "import_names")

    # entities: the new ones, and what the bundle adds to those that are there
    rows = wanted.join(names.select(F.col("canonical").alias("name"), "entity_id", "is_new").distinct(), "name")
    added = rows.filter("is_new").select("entity_id", "name", "category", "definition", "aliases")
    text = lambda c: F.min(F.when(F.trim(c) != "", F.col(c))).alias(f"_{c}")
    more = rows.filter("NOT is_new").groupBy("entity_id").agg(text("category"), text("definition"), F.concat(F.collect_list("name"), F.flatten(F.collect_list("aliases"))).alias("_aliases"))
    kept = g.entities.join(more, "entity_id", "left")
    united = F.array_except(F.array_union(F.coalesce("aliases", F.array().cast(TEXTS)), F.array_sort("_aliases")), F.array("name"))
    stay = lambda c: F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.col(f"_{c}"), F.col(c)).alias(c)
    changed = {"category": stay("category"), "definition": stay("definition"), "aliases": F.when(F.col("_aliases").isNull(), F.col("aliases")).otherwise(united).alias("aliases")}
    entities = _plus(kept.select(*[changed.get(c, F.col(c)) for c in g.entities.columns]), added)

    to_id = lambda df, name, new: df.join(names.select(F.col("name").alias(name), F.col("entity_id").alias(new)), name)
    said = mentions.select("entity", "project", F.struct(F.lit(0).alias("o"), F.col("role").alias("role")).alias("r"))
    referred = referenced.select("entity", "project", F.struct(F.lit(1).alias("o"), F.lit("referenced").alias("role")).alias("r"))
    mentioned = to_id(said.unionByName(referred), "entity", "entity_id").groupBy("entity_id", F.col("project").alias("project_id")).agg(F.min("r")["role"].alias("role"))

    loose = bundle.relations.filter("project IS NULL")
    every = to_id(to_id(relations.unionByName(loose), "source", "src"), "target", "dst")
    every = every.withColumn("rel_id", new_id(F.lit("relation"), F.coalesce("project", F.lit("")), "rel_id", "source", "target"))
    fresh = every.withColumnRenamed("project", "project_id").join(g.relations.select("rel_id"), "rel_id", "left_anti").dropDuplicates(["rel_id"])
    sure = names.select("name").distinct()
    both = loose.join(sure.withColumnRenamed("name", "source"), "source", "left_semi").join(sure.withColumnRenamed("name", "target"), "target", "left_semi")
    endless = relations.filter("source IS NULL OR target IS NULL").select("rel_id")
    dropped = loose.join(both.select("rel_id"), "rel_id", "left_anti").select("rel_id").unionByName(endless)

    key = new_id(F.lit("chain"), "project", "chain")
    steps = to_id(to_id(links, "source", "src"), "target", "dst").select(key.alias("chain_id"), "order_index", "src", "dst")
    counted = steps.groupBy("chain_id").agg(F.count("*").alias("link_count"))
    headed = chains.select(key.alias("chain_id"), F.col("project").alias("project_id"), "name").join(counted, "chain_id", "left").fillna(0, ["link_count"])
    graph = Graph(
        entities=entities,
        projects=_plus(g.projects, projects.withColumnRenamed("project", "project_id")),
        project_collections=_plus(g.project_collections, ids.select(F.col("project").alias("project_id"), F.lit(collection).alias("collection"))),
        project_directories=_plus(g.project_directories, ids.select(F.col("project").alias("project_id"), F.lit(directory).alias("directory"))),
        mentions=_plus(g.mentions, mentioned),
        relations=_plus(g.relations, fresh),
        chains=_plus(g.chains, headed),
        chain_links=_plus(g.chain_links, steps),
        phases=_plus(g.phases, mine(bundle.phases).withColumnRenamed("project", "project_id").distinct()),
    )
    none = lambda column: spark.createDataFrame([], f"{column} string, embedding array<double>")
    have = entity_vectors if entity_vectors is not None else none("entity_id")
    theirs = bundle.vectors.filter("kind = 'entity'").join(names.select(F.col("canonical").alias("name"), "entity_id").distinct(), "name").select("entity_id", "embedding")
    vectors = _vectors(graph.entities.select("entity_id", F.concat_ws(" ", "name", "definition").alias("text")), have, theirs, names.select("entity_id").distinct(), "entity_id", dim, encoder)
    have = project_vectors if project_vectors is not None else none("project_id")
    theirs = bundle.vectors.filter("kind = 'project'").withColumnRenamed("name", "project_id").select("project_id", "embedding")
    wanted_ids = ids.select(F.col("project").alias("project_id"))
    of_projects = _vectors(graph.projects.select("project_id", F.concat_ws(" ", "name", "summary").alias("text")), have, theirs.join(wanted_ids, "project_id", "left_semi"), wanted_ids, "project_id", dim, encoder)
    skipped = bundle.projects.select("project").distinct().join(ids, "project", "left_anti")
    return Import(graph, vectors, of_projects, names.drop("canonical"), skipped, dropped)


def _plus(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows added with the columns and types of the table; columns that they lack are null."""
    typed = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields]
    return table.unionByName(rows.select(*typed))


def _vectors(texts: DataFrame, have: DataFrame, theirs: DataFrame, ids: DataFrame, id_col: str, dim: int, encoder) -> DataFrame:
    """The vectors there are, and for the ids without a sound one those that come along or are made from the texts."""
    have = have.select(id_col, F.col("embedding").cast("array<double>").alias("embedding"))
    sized = lambda df: df.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")))
    healthy = sized(have).join(broken_embeddings(sized(have)).select(id_col).distinct(), id_col, "left_anti")
    came = theirs.join(healthy.select(id_col), id_col, "left_anti")
    repaired, _ = repair_embeddings(texts, healthy.join(ids, id_col, "left_semi").unionByName(came), id_col, dim, encoder)
    return have.join(ids, id_col, "left_anti").unionByName(repaired.join(ids, id_col, "left_semi").select(id_col, "embedding"))


def verify_bundle(bundle: Bundle, g: Graph) -> DataFrame:
    """(section, expected, found, complete): each distinct row of a bundle looked for in a graph by what it says, not by counts.

    Entities are found by name or alias; mentions, relations and links by the entities that their names lead to. Relations without
    project count where the graph knows both ends. Projects are found by id or by name, and what a project of the bundle holds is looked for under its own id."""
    keys = g.entities.select("entity_id", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast(TEXTS))))).alias("key")).filter("key IS NOT NULL").distinct()
    at = lambda df, column, new: df.join(keys.select(F.col("key").alias(column), F.col("entity_id").alias(new)), column)
    known = keys.select("key").distinct()
    sure = lambda df: df.join(known.withColumnRenamed("key", "source"), "source", "left_semi").join(known.withColumnRenamed("key", "target"), "target", "left_semi")
    projects = bundle.projects.select("project", "name").dropDuplicates(["project"])
    there = projects.join(g.projects.select(F.col("project_id").alias("project")), "project", "left_semi").unionByName(projects.join(g.projects.select("name"), "name", "left_semi").select("project", "name"))
    mentions = bundle.mentions.select("entity", "project").distinct()
    of = F.coalesce("project", F.lit(""))
    relations = bundle.relations.filter("project IS NOT NULL").unionByName(sure(bundle.relations.filter("project IS NULL")).select(*bundle.relations.columns)).select(of.alias("project"), "source", "target", "rel_type").distinct()
    stored = g.relations.select(F.coalesce("project_id", F.lit("")).alias("project"), "src", "dst", F.coalesce("rel_type", F.lit("")).alias("_type"))
    links = bundle.chain_links.join(bundle.chains.select("chain", "project", "name"), "chain").select("project", "name", "order_index", "source", "target").distinct()
    steps = g.chain_links.join(g.chains.select("chain_id", F.col("project_id").alias("project"), "name"), "chain_id").select("project", "name", "order_index", "src", "dst")
    phases = bundle.phases.select("project", "phase_index", "period").distinct()
    checks = {
        "projects": (projects, there.select("project").distinct()),
        "entities": (bundle.entities.select("name").distinct(), bundle.entities.select("name").distinct().join(known.withColumnRenamed("key", "name"), "name", "left_semi")),
        "mentions": (mentions, at(mentions, "entity", "entity_id").join(g.mentions.select(F.col("project_id").alias("project"), "entity_id"), ["project", "entity_id"], "left_semi").select("entity", "project").distinct()),
        "relations": (
            relations,
            at(at(relations.withColumn("_type", F.coalesce("rel_type", F.lit(""))), "source", "src"), "target", "dst").join(stored, ["project", "src", "dst", "_type"], "left_semi").select("project", "source", "target", "rel_type").distinct(),
        ),
        "chain_links": (links, at(at(links, "source", "src"), "target", "dst").join(steps, ["project", "name", "order_index", "src", "dst"], "left_semi").select("project", "name", "order_index", "source", "target").distinct()),
        "phases": (phases, phases.join(g.phases.select(F.col("project_id").alias("project"), "phase_index", "period"), ["project", "phase_index", "period"], "left_semi")),
    }
    out = None
    for name, sides in checks.items():
        for side, df in zip(("expected", "found"), sides):
            row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), F.lit(side).alias("side"), "n")
            out = row if out is None else out.unionByName(row)
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(s)
    return out.groupBy("section").agg(side("expected"), side("found")).withColumn("complete", F.col("found") == F.col("expected"))


def label_counts(g: Graph) -> DataFrame:
    """(label, n): how many of each kind a graph holds."""
    kinds = {
        "Entity": g.entities, "Project": g.projects, "Collection": g.project_collections.select("collection").distinct(), "Directory": g.project_directories.select("directory").distinct(),
        "CausalChain": g.chains, "TemporalEvent": g.phases,
    }
    out = None
    for label, df in kinds.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def top_bridges(g: Graph, k: int = 10) -> DataFrame:
    """(entity_id, name, category, projects) of the k entities that most projects, and two at least, mention; ties by id."""
    many = g.mentions.groupBy("entity_id").agg(F.countDistinct("project_id").alias("projects")).filter("projects >= 2")
    best = many.join(g.entities.select("entity_id", "name", "category"), "entity_id").orderBy(F.desc("projects"), "entity_id").limit(k)
    return best.select("entity_id", "name", "category", "projects")


def purge_collection(g: Graph, collection: str) -> tuple[Graph, DataFrame]:
    """A collection (in any case) deleted with its projects and all that only they hold; also (kind, n) of the rows deleted."""
    return delete_projects(g, _members(g, collection))

"""Building and changing graph tables as sets: resolution, upserts, appends, deletions, imports.

Nothing is changed in place: each operator returns the new table or the rows to add, and reports as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators.components import connected_components
from kgspark.sources.graph import Graph
from kgspark.sources.scratch import write_out


def _first(df: DataFrame, keys: list[str | Column], order: list) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def new_id(*parts: Column | str) -> Column:
    """A repeatable id from content."""
    return F.concat(F.lit("n"), F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 16))


def resolve_entities(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, aliases) against (entity_id, name, aliases) -> (name, entity_id, is_new).

    Matches are case-sensitive: any of a row's name and aliases equal to any of the other's. The smallest
    matching id wins; without one the id is made from the name. Rows of one batch are not matched with each other.
    """
    keys = lambda df, *c: df.select(*c, F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("key"))
    held = keys(existing, "entity_id").groupBy("key").agg(F.min("entity_id").alias("entity_id"))  # of each key one row on either side
    found = keys(new.select("name", "aliases"), F.col("name")).distinct().join(held, "key").groupBy("name").agg(F.min("entity_id").alias("entity_id"))
    out = new.select("name").distinct().join(found, "name", "left")
    return out.select("name", F.coalesce("entity_id", new_id("name")).alias("entity_id"), F.col("entity_id").isNull().alias("is_new"))


def resolve_closure(rows: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """(entity_id, name, aliases) -> (entity_id, canonical): aliases matched transitively, the least id of each group.

    Each key names its least holder; a hot alias so gives one edge per holder, not per pair.
    """
    keys = rows.select(id_col, F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("key"))
    least = keys.groupBy("key").agg(F.min(id_col).alias("b"))
    parts = connected_components(keys.join(least, "key").select(F.col(id_col).alias("a"), "b"))
    return rows.select(id_col).distinct().join(parts.withColumnRenamed("id", id_col), id_col, "left").select(id_col, F.coalesce("component", id_col).alias("canonical"))


def upsert(existing: DataFrame, new: DataFrame, key: str, mode: str = "merge") -> tuple[DataFrame, DataFrame]:
    """(table, rejects). merge: non-null new values win; create_only: existing keys are rejected."""
    if mode == "create_only":
        rejects = new.join(existing.select(key), key, "left_semi")
        return existing.unionByName(new.join(existing.select(key), key, "left_anti"), allowMissingColumns=True), rejects
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key])
    merged = existing.join(n, key, "full_outer")
    columns = [F.coalesce(f"_n_{c}", c).alias(c) if f"_n_{c}" in merged.columns else F.col(c) for c in existing.columns if c != key]
    return merged.select(key, *columns), new.limit(0)


def upsert_named(existing: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, rejects): adds names (name column), trimmed, that are not there; rows with a null or blank name are rejected."""
    blank = F.coalesce(F.trim("name") == "", F.lit(True))
    wanted = names.filter(~blank).select(F.trim("name").alias("name")).distinct().join(existing.select("name"), "name", "left_anti")
    return existing.unionByName(wanted, allowMissingColumns=True), names.filter(blank)


def upsert_mentions(mentions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_id, project_id, role, seq): the last role of each pair wins; also (entity_id, project_count) anew."""
    every = mentions.select("entity_id", "project_id", "role", F.lit(-1).cast("long").alias("seq")).unionByName(new.select("entity_id", "project_id", "role", F.col("seq").cast("long").alias("seq")))
    kept = _first(every, ["entity_id", "project_id"], [F.desc("seq"), "role"]).drop("seq")
    return kept, kept.groupBy("entity_id").agg(F.countDistinct("project_id").alias("project_count"))


def append_relations(relations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, target, …) with names resolved by (name, entity_id): the rows to append, and the unresolved ones."""
    s, t = names.select(F.col("name").alias("source"), F.col("entity_id").alias("src")), names.select(F.col("name").alias("target"), F.col("entity_id").alias("dst"))
    both = relations.join(s, "source", "left").join(t, "target", "left")
    good = both.filter("src IS NOT NULL AND dst IS NOT NULL")
    filled = good.withColumn("evidence_strength", F.coalesce("evidence_strength", F.lit("established"))).withColumn("magnitude", F.coalesce("magnitude", F.lit("significant")))
    return filled.drop("source", "target"), both.filter("src IS NULL OR dst IS NULL").select("source", "target", F.when(F.col("src").isNull(), "source").otherwise("target").alias("missing"))


def merge_relations(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("src", "dst", "rel_type"), order: str = "rel_id") -> DataFrame:
    """The first relation of each key stays; existing ones come before new ones."""
    every = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return _first(every, list(keys), ["_new", order]).drop("_new")


def append_chains(chains: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project_id, name, links array<struct<source, target>>) -> chains with link_count, links numbered from 0; unresolved links are skipped."""
    rows = chains.withColumn("chain_id", new_id("project_id", "name")).select("chain_id", "project_id", "name", F.posexplode("links").alias("pos", "l"))
    s, t = names.select(F.col("name").alias("source"), F.col("entity_id").alias("src")), names.select(F.col("name").alias("target"), F.col("entity_id").alias("dst"))
    known = rows.select("chain_id", "project_id", F.col("name").alias("chain"), "pos", F.col("l.source").alias("source"), F.col("l.target").alias("target")).join(s, "source").join(t, "target")
    links = known.select("chain_id", (F.row_number().over(Window.partitionBy("chain_id").orderBy("pos")) - 1).alias("order_index"), "src", "dst")
    counts = known.groupBy("chain_id").agg(F.count("*").alias("link_count"))
    heads = chains.select(new_id("project_id", "name").alias("chain_id"), "project_id", "name").join(counts, "chain_id", "left").withColumn("link_count", F.coalesce("link_count", F.lit(0)))
    return heads, links


def link_first_appearance(entities: DataFrame, phases: DataFrame) -> DataFrame:
    """(entity_id, project_id, phase_index) of entities whose first_appearance_index is a phase of their project."""
    return entities.select("entity_id", "project_id", F.col("first_appearance_index").alias("phase_index")).join(phases.select("project_id", "phase_index"), ["project_id", "phase_index"], "left_semi")


def store_embeddings(vectors: DataFrame, names: DataFrame, mentions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(project_id, name, embedding): entity vectors by (name, entity_id), the rest are their project's; also coverage per project.

    With ``mentions`` (entity_id, project_id) coverage also has ``expected``, the project's entities and one, and ``complete``.
    """
    joined = vectors.join(names.select("name", "entity_id").distinct(), "name", "left")
    stored = joined.select("project_id", "entity_id", F.when(F.col("entity_id").isNull(), "project").otherwise("entity").alias("kind"), "embedding")
    coverage = stored.groupBy("project_id").agg(F.count_if(F.col("kind") == "entity").alias("entities"), F.count_if(F.col("kind") == "project").alias("projects"))
    if mentions is not None:
        wanted = mentions.groupBy("project_id").agg((F.countDistinct("entity_id") + 1).alias("expected"))
        coverage = wanted.join(coverage, "project_id", "left").select("project_id", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("projects", F.lit(0)).alias("projects"), "expected")
        coverage = coverage.withColumn("complete", (F.col("entities") + F.col("projects") == F.col("expected")) & (F.col("projects") == 1))
    return stored, coverage


def quick_ingest(payloads: DataFrame) -> dict[str, DataFrame]:
    """(payload_id, title, tags, collections, entities array<struct<name, relations array<struct<target, type>>>>) -> new rows by table."""
    e = payloads.select("payload_id", F.explode("entities").alias("e")).select("payload_id", "e.name", "e.relations")
    entities = e.groupBy("name").agg(F.min("payload_id").alias("first")).select(new_id("name").alias("entity_id"), "name")
    relations = e.select("payload_id", F.col("name").alias("source"), F.explode("relations").alias("r")).select(
        new_id("source").alias("src"), new_id("r.target").alias("dst"), F.coalesce("r.type", F.lit("Associative")).alias("rel_type"), F.lit("Moderate").alias("evidence_strength"), F.lit("Medium").alias("magnitude"), F.lit(None).cast("string").alias("project_id"),
    )
    return {
        "projects": payloads.select(F.col("payload_id").alias("project_id"), F.col("title").alias("name"), F.col("tags").alias("base_tags")),
        "project_collections": payloads.select(F.col("payload_id").alias("project_id"), F.explode("collections").alias("collection")),
        "entities": entities,
        "mentions": e.select(new_id("name").alias("entity_id"), F.col("payload_id").alias("project_id")).distinct(),
        "relations": relations.distinct(),
    }


def change_membership(members: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project_id, collection) and changes (…, op add or remove): adds all; removes only where another membership of the project stays.

    Of several removals that would leave a project without membership, the last in collection order is refused.
    """
    added = members.unionByName(changes.filter("op = 'add'").select("project_id", "collection")).distinct()
    asked = changes.filter("op = 'remove'").select("project_id", "collection").distinct().withColumn("asked", F.lit(True))
    marked = added.join(asked, ["project_id", "collection"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    whole = Window.partitionBy("project_id")
    last = F.row_number().over(whole.orderBy(F.desc("collection"))) == 1
    removed = F.col("asked") & ~(F.min(F.col("asked").cast("int")).over(whole).cast("boolean") & last)
    done = marked.withColumn("removed", removed)
    return done.filter("NOT removed").select("project_id", "collection"), done.filter("asked").select("project_id", "collection", "removed")


def rename(existing: DataFrame, updates: DataFrame, key: str = "name") -> DataFrame:
    """updates (old, new): renamed where the new name is free."""
    free = updates.join(existing.select(F.col(key).alias("new")), "new", "left_anti").groupBy("new").agg(F.min("old").alias("old"))
    return existing.join(free, existing[key] == free["old"], "left").withColumn(key, F.coalesce("new", key)).drop("old", "new")


def describe(existing: DataFrame, updates: DataFrame, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """(table, rejects): updates (old, new name or null, new description or null) change a row's name where it is free, and its description;
    a null keeps what is there. Rejected: an unknown or repeated old name, a blank new one, one that another row has or wants."""
    known = existing.select(F.col(key).alias("old"), F.lit(True).alias("_known"))
    taken = existing.select(F.col(key).alias("name"), F.lit(True).alias("_taken"))
    u = updates.join(known, "old", "left").join(taken, "name", "left")
    u = u.withColumn("_times", F.count("*").over(Window.partitionBy("old"))).withColumn("_wants", F.count("name").over(Window.partitionBy("name")))
    moves = F.col("name").isNotNull() & (F.col("name") != F.col("old"))
    bad = F.col("_known").isNull() | (F.col("_times") > 1) | (F.trim("name") == "") | (moves & (F.col("_taken").isNotNull() | (F.col("_wants") > 1)))
    u = u.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    good = u.filter("NOT _bad").select(F.col("old").alias(key), F.col("name").alias("_name"), F.col("description").alias("_description"))
    others = [c for c in existing.columns if c not in (key, "description")]
    done = existing.join(good, key, "left").select(F.coalesce("_name", key).alias(key), F.coalesce("_description", "description").alias("description"), *others)
    return done.select(*existing.columns), u.filter("_bad").select("old", "name", "description")


def delete_empty_directories(directories: DataFrame, project_directories: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletes named directories that hold no project; also (directory, deleted)."""
    used = project_directories.select("directory").distinct()
    asked = names.select("directory").distinct()
    gone = asked.join(used, "directory", "left_anti")
    report = asked.join(gone.withColumn("deleted", F.lit(True)), "directory", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    return directories.join(gone, "directory", "left_anti"), report


def delete_collections(g: Graph, names: DataFrame) -> tuple[Graph, DataFrame]:
    """Drops the collections' memberships; projects stay. Also the projects left without any collection."""
    kept = g.project_collections.join(names.select("collection"), "collection", "left_anti").select("project_id", "collection")
    orphans = g.project_collections.select("project_id").distinct().join(kept.select("project_id").distinct(), "project_id", "left_anti")
    return g.with_tables(project_collections=kept), orphans


#: Ids that are sent to every task; more are joined by shuffle.
SENT = 1_000_000


def counted_small(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast where it has few rows."""
    return F.broadcast(ids) if ids.count() <= SENT else ids


def delete_projects(g: Graph, ids: DataFrame) -> tuple[Graph, DataFrame]:
    """Without the projects and what only they hold; also (kind, n) of deleted rows, which is the preview too.

    Relations go by their own project, entities only where no mention of another project is left.
    """
    gone = counted_small(write_out(ids.select("project_id").distinct(), "gone"))
    by_project = {t: getattr(g, t).join(gone, "project_id", "left_anti") for t in ("projects", "project_collections", "project_directories", "mentions", "relations", "chains", "phases")}
    chains = g.chains.join(gone, "project_id", "left_semi").select("chain_id")
    links = g.chain_links.join(chains, "chain_id", "left_anti")
    touched = g.mentions.join(gone, "project_id", "left_semi").select("entity_id").distinct()
    lost = write_out(touched.join(by_project["mentions"].select("entity_id"), "entity_id", "left_anti"), "lost")
    entities = g.entities.join(lost, "entity_id", "left_anti")
    report = None
    for name, df in [(t, getattr(g, t).join(gone, "project_id", "left_semi")) for t in ("projects", "mentions", "relations", "chains", "phases")] + [("chain_links", g.chain_links.join(chains, "chain_id", "left_semi")), ("entities", lost)]:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        report = row if report is None else report.unionByName(row)
    return g.with_tables(entities=entities, chain_links=links, **by_project), report


def dedupe_collections(collections: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(collection_id, name), (project_id, collection_id): one collection per name, memberships moved to it."""
    first = collections.groupBy("name").agg(F.min("collection_id").alias("keep"))
    moved = collections.join(first, "name").select("collection_id", "keep")
    return collections.join(first.select(F.col("keep").alias("collection_id")), "collection_id", "left_semi"), members.join(moved, "collection_id").select("project_id", F.col("keep").alias("collection_id")).distinct()


def purge(entities: DataFrame, mentions: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """Entities that do not meet the condition, and their mentions."""
    kept = entities.filter(~F.coalesce(where, F.lit(False)))
    return kept, mentions.join(kept.select("entity_id"), "entity_id", "left_semi")


def broken_embeddings(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is missing, empty, zero, or holds null or non-finite values: those to embed again."""
    v = F.col(column)
    fine = (F.size(v) > 0) & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(~F.coalesce(fine, F.lit(False)))


def import_entities(bundle: DataFrame, referenced: DataFrame, existing: DataFrame) -> DataFrame:
    """Bundle entities (name, category, aliases) and names referenced by relations: resolved by name, then alias, else stubs of category Other."""
    named = bundle.select("name", "category", "aliases", F.lit(False).alias("stub"))
    alias = bundle.select(F.explode("aliases").alias("name")).distinct()
    stubs = referenced.select("name").distinct().join(bundle.select("name"), "name", "left_anti").join(alias, "name", "left_anti").join(existing.select("name"), "name", "left_anti")
    return named.unionByName(stubs.select("name", F.lit("Other").alias("category"), F.array().cast("array<string>").alias("aliases"), F.lit(True).alias("stub")))


def import_conflicts(bundle: Graph, g: Graph) -> DataFrame:
    """(kind, n): projects, entity names and collections that both have; collections in any case."""
    pairs = [
        ("projects", bundle.projects.select("name").distinct().join(g.projects.select("name").distinct(), "name", "left_semi")),
        ("entities", bundle.entities.select("name").distinct().join(g.entities.select("name").distinct(), "name", "left_semi")),
        ("collections", bundle.project_collections.select(F.lower("collection").alias("c")).distinct().join(g.project_collections.select(F.lower("collection").alias("c")).distinct(), "c", "left_semi")),
    ]
    out = None
    for kind, df in pairs:
        row = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def merge_attributes(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """By entity_id: existing texts that are not blank stay, numbers take the larger value."""
    n = imported.select("entity_id", *[F.col(c).alias(f"_n_{c}") for c in imported.columns if c != "entity_id"])
    joined = existing.join(n, "entity_id", "left")
    columns = []
    for f in existing.schema.fields:
        if f.name == "entity_id" or f"_n_{f.name}" not in joined.columns:
            columns.append(F.col(f.name))
        elif f.dataType.typeName() == "string":
            columns.append(F.coalesce(F.nullif(f.name, F.lit("")), F.col(f"_n_{f.name}")).alias(f.name))
        else:
            columns.append(F.greatest(f.name, f"_n_{f.name}").alias(f.name))
    return joined.select(*columns)


def verify_import(expected: dict[str, DataFrame], actual: dict[str, DataFrame]) -> DataFrame:
    """(table, expected, actual, complete): rows of a bundle's tables against those of the graph after its import."""
    counts = None
    for side, tables in (("expected", expected), ("actual", actual)):
        for name, rows in sorted(tables.items()):
            one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(side).alias("side"), "n")
            counts = one if counts is None else counts.unionByName(one)
    side = lambda name: F.coalesce(F.sum(F.when(F.col("side") == name, F.col("n"))), F.lit(0)).alias(name)
    return counts.groupBy("table").agg(side("expected"), side("actual")).withColumn("complete", F.col("actual") >= F.col("expected"))

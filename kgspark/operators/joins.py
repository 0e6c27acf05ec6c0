"""Scoped graph views, profiles, recommendations and pair comparisons. Keys come as DataFrames, so one job serves many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators.aggregates import collection_relations, scope_entities
from kgspark.operators.rankings import top_per_group
from kgspark.sources.graph import Graph
from kgspark.sources.scratch import write_out


def both_ways(relations: DataFrame, *more: str) -> DataFrame:
    """(entity_id, other, direction, …): each relation from either end."""
    out = relations.select(F.col("src").alias("entity_id"), F.col("dst").alias("other"), F.lit("out").alias("direction"), *more)
    return out.unionByName(relations.select(F.col("dst").alias("entity_id"), F.col("src").alias("other"), F.lit("in").alias("direction"), *more))


def collection_graph(g: Graph) -> DataFrame:
    """Per collection every entity in scope, with its outgoing relations inside the collection (null where none)."""
    scope = scope_entities(g).select("collection", "entity_id").distinct()
    inside = collection_relations(g).select("collection", F.col("src").alias("entity_id"), F.col("dst").alias("target"), "rel_id", "rel_type")
    return scope.join(inside, ["collection", "entity_id"], "left")


def project_graph(g: Graph) -> DataFrame:
    """Per project every entity with its outgoing relations of that project to entities of that project."""
    scope = g.mentions.select("project_id", "entity_id")
    own = g.relations.select("project_id", F.col("src").alias("entity_id"), F.col("dst").alias("target"), "rel_id")
    own = own.join(scope.withColumnRenamed("entity_id", "target"), ["project_id", "target"], "left_semi")
    return scope.join(own, ["project_id", "entity_id"], "left")


def bridge_graph(g: Graph, least: int = 2) -> DataFrame:
    """collection_graph between entities of at least so many projects of the collection."""
    many = scope_entities(g).groupBy("collection", "entity_id").agg(F.countDistinct("project_id").alias("n")).filter(F.col("n") >= least).select("collection", "entity_id")
    inside = collection_relations(g).select("collection", F.col("src").alias("entity_id"), F.col("dst").alias("target"), "rel_id")
    inside = inside.join(many.withColumnRenamed("entity_id", "target"), ["collection", "target"], "left_semi")
    return many.join(inside, ["collection", "entity_id"], "left")


def entity_profiles(g: Graph) -> DataFrame:
    """Each entity with its projects, relations by direction, other entities and chains, as one row.

    Every branch is aggregated on its own and joined by entity, so branches do not multiply.
    """
    projects = g.mentions.groupBy("entity_id").agg(F.array_sort(F.collect_set("project_id")).alias("project_ids"))
    ends = both_ways(g.relations, "rel_id")
    relations = ends.groupBy("entity_id").agg(F.count_if(F.col("direction") == "out").alias("n_out"), F.count_if(F.col("direction") == "in").alias("n_in"), F.array_sort(F.collect_set("other")).alias("others"))
    links = g.chain_links.select(F.explode(F.array("src", "dst")).alias("entity_id"), "chain_id").distinct()
    chains = links.groupBy("entity_id").agg(F.array_sort(F.collect_set("chain_id")).alias("chain_ids"))
    out = g.entities.select("entity_id", "name", "category").join(projects, "entity_id", "left").join(relations, "entity_id", "left").join(chains, "entity_id", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "entity_id", "name", "category", F.coalesce("project_ids", none).alias("project_ids"), F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"),
        F.coalesce("others", none).alias("others"), F.coalesce("chain_ids", none).alias("chain_ids"),
    )


def project_profiles(g: Graph) -> DataFrame:
    """Each project with its entities, phases, chains, collections and directories."""
    branches = [
        g.mentions.groupBy("project_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids")),
        g.phases.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("phase_index", "period"))).alias("phases")),
        g.chains.groupBy("project_id").agg(F.array_sort(F.collect_set("chain_id")).alias("chain_ids")),
        g.project_collections.groupBy("project_id").agg(F.array_sort(F.collect_set("collection")).alias("collections")),
        g.project_directories.groupBy("project_id").agg(F.array_sort(F.collect_set("directory")).alias("directories")),
    ]
    out = g.projects.select("project_id", "name")
    for branch in branches:
        out = out.join(branch, "project_id", "left")
    return out


def shared_entities(g: Graph, projects: DataFrame | None = None) -> DataFrame:
    """(p1, p2, entity_id) with p1 < p2: entities that two projects mention; projects limits p1."""
    m = g.mentions.select("entity_id", "project_id")
    left = m if projects is None else m.join(projects.select("project_id"), "project_id", "left_semi")
    pairs = left.withColumnRenamed("project_id", "p1").join(m.withColumnRenamed("project_id", "p2"), "entity_id")
    return pairs.filter("p1 <> p2" if projects is not None else "p1 < p2")


def related_projects(g: Graph, keys: DataFrame, k: int = 10) -> DataFrame:
    """For each key project the k others with most shared entities."""
    counts = shared_entities(g, keys).groupBy("p1", "p2").agg(F.countDistinct("entity_id").alias("shared"), F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    return top_per_group(counts, "p1", "shared", k, ("p2",))


#: Collections that one row of an entity's list of them can name.
LISTED = 512


def recommend_projects(g: Graph, collections: DataFrame, k: int = 10) -> DataFrame:
    """For each collection the k projects outside it with most of its entities.

    Collections are numbered; a mention takes along the list of its entity's collections, two bytes each, so no row is made for each
    collection that an entity and a project meet in. Each task counts them project by project and keeps its own k best of each collection.
    """
    names = write_out(collections.select("collection").filter("collection IS NOT NULL").distinct().orderBy("collection").select("collection", F.monotonically_increasing_id().alias("_m")), "collections")
    part = F.shiftright("_m", 33)
    sizes = names.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row for each range
    bases = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    number = names.withColumn("_p", part).join(bases, "_p").select("collection", (F.col("_m") - F.shiftleft("_p", 33) + F.col("_base")).alias("number"))
    number = write_out(number.select("collection", F.floor(F.col("number") / LISTED).cast("int").alias("block"), (F.col("number") % LISTED).cast("int").alias("at")), "numbers")
    m = g.mentions.select("entity_id", "project_id").filter("project_id IS NOT NULL").distinct()
    placed = g.project_collections.join(number, "collection").select("project_id", "block", "at")
    of_entity = m.join(placed, "project_id").groupBy("entity_id", "block").agg(F.collect_set("at").alias("list"))
    of_project = placed.groupBy("project_id", "block").agg(F.collect_set("at").alias("list"))
    short = F.col("list").cast("array<smallint>").alias("list")
    rows = m.join(of_entity, "entity_id").select("project_id", "block", short, F.lit(False).alias("own"))
    rows = rows.unionByName(of_project.select("project_id", "block", short, F.lit(True).alias("own")))
    rows = rows.repartition("project_id", "block").sortWithinPartitions("block", "project_id")

    def count(batches):
        held, block, best = [], None, {}

        def take(table, final):
            """Counts of whole projects of one block enter the lists of the k best; the last project may go on in the next batch."""
            ids, lists, own = table.column(0).combine_chunks().dictionary_encode(), table.column(2).combine_chunks(), table.column(3).to_numpy()
            place = ids.indices.to_numpy()  # in the order of the rows, which are sorted
            if not final:
                n = int(np.searchsorted(place, place[-1])) if len(place) else 0
                rest, table = table.slice(n), table.slice(0, n)
                lists, own, place = lists.slice(0, n), own[:n], place[:n]
            else:
                rest = table.slice(len(place))
            if len(place):
                at, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(place)), lists.value_lengths().to_numpy())
                top = int(place[-1]) + 1
                key = place[row].astype(np.int64) * LISTED + at
                counts = np.bincount(key[~own[row]], minlength=top * LISTED).reshape(top, LISTED)
                counts[place[row][own[row]], at[own[row]]] = 0
                for c in np.flatnonzero(counts.any(axis=0)):
                    some = best.setdefault(int(c), [])
                    least = some[-1][0] if len(some) >= k else 0
                    found = np.flatnonzero(counts[:, c] > -least)  # ids ascend, so equal ones are behind
                    if len(found) > k:
                        found = found[np.argsort(-counts[found, c], kind="stable")[:k]]
                    some += [(-int(counts[p, c]), ids.dictionary[int(p)].as_py()) for p in found]
                    some.sort(key=lambda x: (x[0], x[1].encode()))
                    del some[k:]
            return rest

        def out():
            flat = [(block, c, p, -n) for c, some in best.items() for n, p in some]
            best.clear()
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat), (pa.int32(), pa.int32(), pa.string(), pa.int64()))], ["block", "at", "project_id", "shared"])

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            blocks = table.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    block = int(blocks[s])
                    rest = take(table.slice(s, e - s), e < len(blocks))
                    if e < len(blocks):
                        yield from out()
        if rest is not None and rest.num_rows:
            take(rest, True)
        yield from out()

    counts = rows.mapInArrow(count, "block int, at int, project_id string, shared long").join(number, ["block", "at"]).select("collection", "project_id", "shared")
    return top_per_group(counts, "collection", "shared", k, ("project_id",))


def suggest_collections(g: Graph, names: DataFrame, k: int = 5) -> DataFrame:
    """The k collections with most of the named entities (name column)."""
    wanted = g.entities.select("entity_id", "name").join(names.select("name").distinct(), "name", "left_semi")
    found = scope_entities(g).join(wanted.select("entity_id"), "entity_id", "left_semi").groupBy("collection").agg(F.countDistinct("entity_id").alias("matches"), F.countDistinct("project_id").alias("projects"))
    return found.orderBy(F.desc("matches"), "collection").limit(k)


def search_collections(g: Graph, directory: str | None, term: str, by: str = "project") -> DataFrame:
    """Collections of a directory (None: any) that hold a project, or mention an entity, whose name contains the term."""
    members = g.project_collections
    if directory is not None:
        members = members.join(g.project_directories.filter(F.col("directory") == directory).select("project_id"), "project_id", "left_semi")
    if by == "project":
        hits = members.join(g.projects.filter(F.lower("name").contains(term.lower())).select("project_id", F.col("project_id").alias("hit")), "project_id")
    else:
        named = g.entities.filter(F.lower("name").contains(term.lower())).select("entity_id")
        hits = members.join(g.mentions.join(named, "entity_id", "left_semi").select("project_id", F.col("entity_id").alias("hit")), "project_id")
    return hits.groupBy("collection").agg(F.countDistinct("hit").alias("matches"))


#: Parts of a project's entities that are sorted on their own first; a project of at most so many times k pairs lists all.
SALTS, WHOLE = 16, 16


def suggest_links(g: Graph, scores: DataFrame, projects: DataFrame, least: float, k: int = 20, listed: list[int] | None = None) -> DataFrame:
    """Per project the k pairs of entities, both scored above ``least``, that no relation joins in either direction.

    Entities of a project are ranked by score, then id. The pair of ranks (i, j) comes after all pairs (i', j') with i' <= i and j' <= j,
    i j - i (i + 1) / 2 pairs with itself. So if x of the pairs with such a number up to c are related, and c is k + x or more, the k best are
    among them. c begins with k and grows for the projects where it is too small; no project lists all its pairs unless it
    has hardly more. Projects of few pairs list all at once, without rounds. ``listed`` gets the number of their pairs and of
    those of each round.
    """
    good = g.mentions.select("project_id", "entity_id").distinct().join(projects.select("project_id").distinct(), "project_id", "left_semi").join(scores.filter(F.col("score") > least), "entity_id").select("project_id", "entity_id", "score")
    order = [F.desc("score"), "entity_id"]
    good = write_out(good, "good")
    pairs_of = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    sizes = good.groupBy("project_id").agg(F.count("*").alias("n")).filter("n > 1").withColumn("all", pairs_of)
    joined = g.relations.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    one, two = (good.select("project_id", F.col("entity_id").alias(e), F.col("score").alias(s)) for e, s in (("a", "sa"), ("b", "sb")))
    few = sizes.filter(F.col("all") <= WHOLE * k).select("project_id").join(one, "project_id").join(two, "project_id").filter("a < b").select("project_id", "a", "b", (F.col("sa") + F.col("sb")).alias("score"))
    if listed is not None:
        listed.append(few.count())
    out = few.join(joined, ["a", "b"], "left_anti").select("project_id", "a", "b", "score")
    open_ = write_out(sizes.filter(F.col("all") > WHOLE * k).select("project_id", F.lit(k).cast("long").alias("c"), "all", "n"), "open")
    if open_.isEmpty():
        return top_per_group(out, "project_id", "score", k, ("a", "b"))
    joined = write_out(joined.withColumn("related", F.lit(1)), "related")
    salt = F.pmod(F.xxhash64("entity_id"), F.lit(SALTS))
    good = good.join(open_.select("project_id", "n"), "project_id").withColumn("part", F.row_number().over(Window.partitionBy("project_id", salt).orderBy(*order)))
    good, open_ = write_out(good, "large"), open_.drop("n")
    while not open_.isEmpty():
        leaders = good.join(open_, "project_id").filter(F.col("part") <= F.col("c") + 1)  # rank 1 meets c others at most
        ranked = leaders.withColumn("i", F.row_number().over(Window.partitionBy("project_id").orderBy(*order)))
        ranked = write_out(ranked.filter(F.col("i") <= F.col("c") + 1).select("project_id", "entity_id", "score", "i", "c", "n"), "ranked")
        last = F.least(F.floor(F.col("c") / F.col("i") + (F.col("i") + 1) / 2), F.col("n"))
        first = ranked.filter(last > F.col("i")).select("project_id", F.col("entity_id").alias("x"), F.col("score").alias("sx"), F.explode(F.sequence(F.col("i").cast("long") + 1, last)).alias("i"))
        second = ranked.select("project_id", F.col("entity_id").alias("y"), F.col("score").alias("sy"), F.col("i").cast("long").alias("i"))
        pairs = first.join(second, ["project_id", "i"]).select("project_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("sx") + F.col("sy")).alias("score"))
        pairs = write_out(pairs.join(joined, ["a", "b"], "left"), "pairs")
        if listed is not None:
            listed.append(pairs.count())
        related = pairs.groupBy("project_id").agg(F.count("related").alias("x"))
        state = write_out(open_.join(related, "project_id", "left").withColumn("need", F.lit(k) + F.coalesce("x", F.lit(0))), "state")
        open_ = state.filter("c < need AND c < all").select("project_id", F.col("need").alias("c"), "all")
        ended = state.filter("c >= need OR c >= all").select("project_id")
        found = pairs.filter("related IS NULL").join(ended, "project_id", "left_semi").select("project_id", "a", "b", "score")
        out = out.unionByName(found)
    return top_per_group(out, "project_id", "score", k, ("a", "b"))


def typed_pairs(g: Graph, first: Column, second: Column) -> DataFrame:
    """(a, b): related entities where a meets the first and b the second condition on the entity's columns."""
    a = g.entities.filter(first).select(F.col("entity_id").alias("a"))
    b = g.entities.filter(second).select(F.col("entity_id").alias("b"))
    ends = both_ways(g.relations).select(F.col("entity_id").alias("a"), F.col("other").alias("b"))
    return ends.join(a, "a", "left_semi").join(b, "b", "left_semi").distinct()


def compare_neighbors(g: Graph, focus: DataFrame) -> DataFrame:
    """For each focus entity and each of its neighbours: relations between them, shared neighbours, the neighbour's own ones."""
    near = both_ways(g.relations).select("entity_id", "other").filter("entity_id <> other").distinct()
    sets = near.groupBy("entity_id").agg(F.collect_set("other").alias("near"))
    mine = near.join(focus.select("entity_id"), "entity_id", "left_semi")
    direct = both_ways(g.relations).groupBy("entity_id", "other").agg(F.count("*").alias("relations"))
    out = mine.join(direct, ["entity_id", "other"]).join(sets, "entity_id").join(sets.select(F.col("entity_id").alias("other"), F.col("near").alias("theirs")), "other")
    return out.select("entity_id", "other", "relations", F.size(F.array_intersect("near", "theirs")).alias("shared"), F.size(F.array_except("theirs", "near")).alias("own"))


def project_bridges(g: Graph, projects: DataFrame) -> DataFrame:
    """Per given project: its entities that other projects mention too, with how many. An entity's projects are counted once, no pairs are listed."""
    m = g.mentions.select("entity_id", "project_id").distinct()
    counts = m.groupBy("entity_id").agg((F.count("*") - 1).alias("other_projects")).filter("other_projects > 0")
    return m.join(projects.select("project_id"), "project_id", "left_semi").join(counts, "entity_id").select("project_id", "entity_id", "other_projects")


def shared_counts(mentions: DataFrame, pairs: DataFrame, most: float = 8.0) -> DataFrame:
    """(a, b, projects): distinct projects that mention both, of the pairs that share one.

    Each project lists its own pairs where these are few for each mention, as counted. Otherwise each pair meets the projects of its end with fewer.
    """
    m = write_out(mentions.select("entity_id", "project_id").filter("entity_id IS NOT NULL AND project_id IS NOT NULL").distinct(), "mentions")
    asked = pairs.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct().select("a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    sums = m.groupBy("project_id").agg(F.count("*").cast("double").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") + 1) / 2).alias("listed")).first()
    if (sums["listed"] or 0) <= most * (sums["rows"] or 0):
        met = m.withColumnRenamed("entity_id", "x").join(m.withColumnRenamed("entity_id", "y"), "project_id").filter("x <= y")
    else:
        degree = m.groupBy("entity_id").agg(F.count("*").alias("n"))
        at = lambda end, n: degree.select(F.col("entity_id").alias(end), F.col("n").alias(n))
        first = F.col("nx") <= F.col("ny")
        few = asked.select("x", "y").distinct().join(at("x", "nx"), "x").join(at("y", "ny"), "y")
        few = few.select("x", "y", F.when(first, F.col("x")).otherwise(F.col("y")).alias("entity_id"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("other"))
        met = few.join(m, "entity_id").join(m.withColumnRenamed("entity_id", "other"), ["other", "project_id"], "left_semi")
    counts = met.groupBy("x", "y").agg(F.count("*").alias("projects"))
    return asked.join(counts, ["x", "y"]).select("a", "b", "projects")


def explain_pairs(g: Graph, pairs: DataFrame) -> DataFrame:
    """(a, b) pairs with the relations each way and the projects they share."""
    ab = g.relations.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count("*").alias("forward"))
    ba = ab.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("forward").alias("backward"))
    shared = shared_counts(g.mentions, pairs)
    out = pairs.join(ab, ["a", "b"], "left").join(ba, ["a", "b"], "left").join(shared, ["a", "b"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("a", "b", zero("forward"), zero("backward"), zero("projects")).withColumn("connected", F.col("forward") + F.col("backward") > 0)


def build_view(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes (entities and projects) and links (relations without repeats, and memberships)."""
    lists = g.mentions.groupBy("entity_id").agg(F.array_sort(F.collect_set("project_id")).alias("projects"))
    entities = g.entities.dropDuplicates(["entity_id"]).join(lists, "entity_id", "left").select(F.col("entity_id").alias("node_id"), F.lit("entity").alias("kind"), "name", "category", F.coalesce("projects", F.array().cast("array<string>")).alias("projects"))
    projects = g.projects.select(F.col("project_id").alias("node_id"), F.lit("project").alias("kind"), "name", F.lit(None).cast("string").alias("category"), F.array("project_id").alias("projects"))
    first = Window.partitionBy("src", "dst", "rel_type", "causal", "project_id").orderBy("rel_id")
    relations = g.relations.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select("rel_id", "src", "dst", "rel_type", "project_id")
    members = g.mentions.select(F.concat_ws("-", F.lit("m"), "entity_id", "project_id").alias("rel_id"), F.col("entity_id").alias("src"), F.col("project_id").alias("dst"), F.lit("MENTIONED_IN").alias("rel_type"), "project_id")
    return entities.unionByName(projects), relations.unionByName(members)


def _part(g: Graph, projects: DataFrame, entities: DataFrame | None = None) -> Graph:
    """The graph of some projects, and of some entities (None: those they mention)."""
    keep = lambda df: df.join(projects, "project_id", "left_semi")
    mentions = keep(g.mentions)
    inside = (mentions if entities is None else entities).select("entity_id").distinct()
    relations = keep(g.relations).join(inside.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(inside.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")
    return g.with_tables(projects=keep(g.projects), mentions=mentions.join(inside, "entity_id", "left_semi"), relations=relations.select(*g.relations.columns), entities=g.entities.join(inside, "entity_id", "left_semi"))


def load_collection_view(g: Graph, collection: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a collection's projects."""
    return build_view(_part(g, g.project_collections.filter(F.col("collection") == collection).select("project_id")))


def load_project_view(g: Graph, collection: str, project_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of one project, which must be in the collection."""
    own = g.project_collections.filter((F.col("collection") == collection) & (F.col("project_id") == project_id)).select("project_id")
    if not own.limit(1).count():
        raise ValueError(f"project {project_id} is not in collection {collection}")
    return build_view(_part(g, own))


def load_bridge_view(g: Graph, collection: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a collection's entities of at least so many of its projects."""
    projects = g.project_collections.filter(F.col("collection") == collection).select("project_id")
    many = g.mentions.join(projects, "project_id", "left_semi").groupBy("entity_id").agg(F.countDistinct("project_id").alias("n")).filter(F.col("n") >= least)
    return build_view(_part(g, projects, many))

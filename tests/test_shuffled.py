"""What a query shuffles and writes, as counted by Spark on a small graph."""

import random

from kgspark import registry
from kgspark.operators import communities as C
from kgspark.operators import joins as J
from kgspark.operators import traversal as T
from kgspark.sources.graph import Graph


def test_communities_send_packed_edges(spark, monkeypatch):
    """A turn sends the labels of the nodes; no table of one row for each edge is written but the first one of half the edges."""
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(6000)] + [("n1", "gone"), ("gone", "n2"), ("n3", None)]
    entities = spark.createDataFrame([(f"n{k}",) for k in range(300)], "entity_id string")
    relations = spark.createDataFrame(pairs, "src string, dst string")
    rows, plain = [], C.write_out

    def counted(df, name):
        table = plain(df, name)
        rows.append((name, table.count()))
        return table

    monkeypatch.setattr(C, "write_out", counted)
    labels = C.modular_communities(entities, relations)
    assert labels.count() == 300
    large = [(name, n) for name, n in rows if n > 600 and name != "contracted"]
    assert len(large) == 1 and large[0][0] == "half", large


def test_shared_counts_both_ways(spark):
    """Counts by project and by pair agree with sets; of pairs with a project of all entities only the smaller end's projects are met."""
    rng = random.Random(8)
    mentions = {(f"e{rng.randrange(30)}", f"p{rng.randrange(40)}") for _ in range(300)} | {(f"e{k}", "all") for k in range(30)}
    pairs = [(f"e{rng.randrange(33)}", f"e{rng.randrange(33)}") for _ in range(200)] + [("e1", "e1")]
    of = {}
    for e, p in mentions:
        of.setdefault(e, set()).add(p)
    want = {(a, b): n for a, b in pairs if (n := len(of.get(a, set()) & of.get(b, set())))}
    m, asked = spark.createDataFrame([*mentions, *list(mentions)[:50]], "entity_id string, project_id string"), spark.createDataFrame(pairs, "a string, b string")
    for most in (0.0, 1e9):
        rows = J.shared_counts(m, asked, most).collect()
        assert {(r["a"], r["b"]): r["projects"] for r in rows} == want and len(rows) == len(want)


def test_recommended_projects_with_many_collections(spark, monkeypatch):
    """Several rows of collections to an entity, batches that cut a project, own projects left out; ties by id."""
    monkeypatch.setattr(J, "LISTED", 4)
    rng = random.Random(6)
    mentions = {(f"e{rng.randrange(40)}", f"p{rng.randrange(60)}") for _ in range(500)}
    members = {(f"p{k}", f"c{rng.randrange(11)}") for k in range(60) for _ in range(2)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        none = spark.createDataFrame([], "x int")
        g = Graph(none, none, spark.createDataFrame([*members], "project_id string, collection string"), none, spark.createDataFrame([(*x, "r") for x in mentions], "entity_id string, project_id string, role string"), none, none, none, none)
        got = {(r["collection"], r["rank"]): (r["project_id"], r["shared"]) for r in J.recommend_projects(g, g.project_collections.select("collection").distinct(), 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for c in {c for _, c in members}:
        scope = {e for e, p in mentions if (p, c) in members}
        counts = {p: sum(1 for e, q in mentions if q == p and e in scope) for p in {p for _, p in mentions} if (p, c) not in members}
        for rank, (p, n) in enumerate(sorted(((p, n) for p, n in counts.items() if n), key=lambda x: (-x[1], x[0]))[:3], 1):
            want[c, rank] = (p, n)
    assert got == want


def test_shortest_paths_in_slices(spark, monkeypatch):
    """Levels cut into slices of four nodes, a hub, loops and parallel relations; no table has a row for each node of a level."""
    monkeypatch.setattr(T, "SLICE_BITS", 2)
    rng = random.Random(12)
    edges = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)} | {("hub", f"n{k}") for k in range(0, 60, 7)}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    pairs = [(f"n{k}", f"n{(7 * k + 3) % 60}") for k in range(60)] + [("n1", "gone"), ("n2", "n2")]

    def least(a, b, most):
        far, at, k = {a: 0}, [a], 0
        while at and k < most:
            k += 1
            at = [y for y in {z for x in at for z in near.get(x, ())} if y not in far]
            far.update(dict.fromkeys(at, k))
        if b not in far or a == b or a not in near:
            return None
        path = [b]
        while path[0] != a:
            path.insert(0, min(x for x in near[path[0]] if far.get(x, 99) == far[path[0]] - 1))
        return path

    got = {(r["a"], r["b"]): r["path"] for r in T.shortest_paths(spark.createDataFrame([*edges, *edges], "src string, dst string"), spark.createDataFrame(pairs, "a string, b string"), 5).collect()}
    assert got == {p: path for p in pairs if (path := least(*p, 5))} and max(map(len, got.values())) >= 5


def test_imports_order_the_lines_once(spark):
    """The tables of an import are stored ones: its plan holds no window over the lines."""
    df = registry.queries()["import_relations"](spark, "/root/testdata/sf0.001")
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()

"""Similar nodes and link scores against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kgspark.operators import twosteps as T
from kgspark.operators.algorithms import link_scores, node_similarity


@pytest.fixture(scope="module")
def hub():
    """Edges of a random graph with a hub that is joined to all others, repeats and a loop."""
    r = random.Random(7)
    edges = [("v0", f"v{k}") for k in range(1, 60)] + [(f"v{r.randrange(60)}", f"v{r.randrange(60)}") for _ in range(400)]
    return edges + edges[:5] + [("v3", "v3")]


def near(edges):
    sets = {}
    for a, b in edges:
        if a != b:
            sets.setdefault(a, set()).add(b)
            sets.setdefault(b, set()).add(a)
    return sets


@pytest.mark.parametrize("cutoff", [0.05, 0.125, 0.3])
def test_similar_nodes_around_a_hub(spark, hub, monkeypatch, cutoff):
    monkeypatch.setattr(T, "CHUNK", 7)
    monkeypatch.setattr(T, "ENTRIES", 500)
    sets = near(hub)
    wanted = set()
    for a in sets:
        found = sorted((-round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6), b) for b in sets if b != a and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= cutoff)
        wanted |= {(a, b, -s, k) for k, (s, b) in enumerate(found[:5], 1)}
    got = node_similarity(spark.createDataFrame(hub, "src string, dst string"), cutoff, 5)
    assert {(r["a"], r["b"], r["similarity"], r["rank"]) for r in got.collect()} == wanted


def test_lists_are_shorter_than_pairs(spark, hub):
    """A member is one row with those after it: rows follow the edges, entries half of the pairs in both directions."""
    _, edges = T.numbered(spark.createDataFrame(hub, "src string, dst string"))
    members = edges.select(F.col("a").alias("z"), F.col("n").alias("d"), F.col("b").alias("a")).join(T.sizes(edges), "a")
    sets = near(hub)
    for chunk in (7, 1024):
        rows = T.two_steps(members, chunk).agg(F.count("*"), F.sum(F.size("others")), F.max(F.size("others"))).first()
        assert rows[1] == sum(math.comb(len(s), 2) for s in sets.values())
    assert rows[0] == sum(len(s) - 1 for s in sets.values())


def test_link_scores_around_a_hub(spark, hub, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 7)
    monkeypatch.setattr(T, "ENTRIES", 500)
    sets = near(hub)
    asked = [(a, b) for a, b in itertools.product(sorted(sets), repeat=2) if (int(a[1:]) + int(b[1:])) % 3 == 0] + [("v1", "away")]
    wanted = {}
    for a, b in asked:
        if b in sets and (common := sets[a] & sets[b]):
            wanted[a, b] = (len(common), sum(1 / math.log(len(sets[z])) for z in common), sum(1 / len(sets[z]) for z in common))
    got = link_scores(spark.createDataFrame(hub, "src string, dst string"), spark.createDataFrame(asked + asked[:3], "a string, b string")).collect()
    assert len(got) == len(wanted)
    for r in got:
        assert (r["common"], r["adamic_adar"], r["resource_allocation"]) == pytest.approx(wanted[r["a"], r["b"]], abs=2e-6)


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert not node_similarity(none, 0.05).collect()
    assert not link_scores(none, spark.createDataFrame([("a", "b")], "a string, b string")).collect()


def test_evidence_looks_for_no_path(spark, monkeypatch):
    from kgspark.operators import traversal
    from kgspark.plans import all_modules
    from kgspark.registry import queries

    all_modules()
    monkeypatch.setattr(traversal, "shortest_paths", None)
    assert queries()["connection_evidence"](spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("wave", [T.WAVE, 60])
def test_triangles_in_lists(spark, hub, monkeypatch, wave):
    """Waves and chunks; no table has a row for each open pair of neighbours."""
    from kgspark.operators.algorithms import triangles

    rows, plain = [], T.write_out

    def counted(df, name):
        table = plain(df, name)
        rows.append((name, table.count()))
        return table

    monkeypatch.setattr(T, "CHUNK", 3)
    monkeypatch.setattr(T, "WAVE", wave)
    monkeypatch.setattr(T, "write_out", counted)
    sets = near(hub)
    want = {a: sum(1 for b, c in itertools.combinations(sorted(s), 2) if c in sets[b]) for a, s in sets.items()}
    got = {r["entity_id"]: (r["triangles"], r["clustering"]) for r in triangles(spark.createDataFrame(hub, "src string, dst string")).collect()}
    assert got == {a: (t, round(2 * t / (len(sets[a]) * (len(sets[a]) - 1)), 6) if len(sets[a]) > 1 else 0.0) for a, t in want.items()}
    assert sum(name == "triangles" for name, _ in rows) >= (1 if wave == T.WAVE else 2) and "out" in dict(rows)
    assert triangles(spark.createDataFrame([], "src string, dst string")).count() == 0


@pytest.mark.parametrize("wave", [T.WAVE, 300])
def test_unlinked_scores_of_projects(spark, hub, monkeypatch, wave):
    """Chunks, buckets and waves; a project of many, one of one, entities without relations; no table has a row for each pair."""
    from kgspark.operators import algorithms as G

    rows = []
    for module in (T, G):
        monkeypatch.setattr(module, "write_out", lambda df, name, plain=module.write_out: (table := plain(df, name), rows.append((name, table.count())))[0])
    monkeypatch.setattr(T, "CHUNK", 7)
    monkeypatch.setattr(T, "ENTRIES", 100)
    monkeypatch.setattr(T, "WAVE", wave)
    r, sets = random.Random(9), near(hub)
    mentions = {(f"v{r.randrange(64)}", f"p{r.randrange(9)}") for _ in range(60)} | {(f"v{k}", "all") for k in range(40)} | {("v5", "own"), ("alone", "all")}
    pairs = {(min(a, b), max(a, b)) for (a, p), (b, q) in itertools.combinations(mentions, 2) if p == q and a != b}
    wanted = {}
    for a, b in pairs:
        if b not in sets.get(a, ()) and (common := sets.get(a, set()) & sets.get(b, set())):
            wanted[a, b] = (len(common), sum(1 / math.log(len(sets[z])) for z in common), sum(1 / len(sets[z]) for z in common))
    got = G.unlinked_scores(spark.createDataFrame(hub, "src string, dst string"), spark.createDataFrame([*mentions, *list(mentions)[:20]], "entity_id string, project_id string")).collect()
    assert len(got) == len(wanted)
    for x in got:
        assert (x["common"], x["adamic_adar"], x["resource_allocation"]) == pytest.approx(wanted[x["a"], x["b"]], abs=2e-6)
    assert max(n for name, n in rows if name not in ("scored", "edges", "ends")) < len(pairs)
    assert sum(name == "scored" for name, _ in rows) >= (1 if wave == T.WAVE else 5)

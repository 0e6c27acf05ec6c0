"""Operators that SQL cannot express, against brute force on small inputs; and rules, files and streams."""

import itertools
import json
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.functions import text as N
from kgspark.operators import algorithms as G
from kgspark.operators import build as M
from kgspark.operators import communities as C
from kgspark.operators import joins as J
from kgspark.operators import neighbors as NN
from kgspark.operators import paths as P
from kgspark.operators import rankings as W
from kgspark.operators import research as B
from kgspark.operators import search as R
from kgspark.operators import textindex as I
from kgspark.operators import traversal as T
from kgspark.operators import validation as V
from kgspark.operators.components import connected_components
from kgspark.sources import files as S
from kgspark.sources.graph import order_graph
from kgspark.streaming import keyed as K
from kgspark.streaming import streams as X

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph():
    r = random.Random(3)
    nodes = [f"n{k}" for k in range(18)]
    edges = sorted({(a, b) for a, b in itertools.product(nodes, nodes) if a < b and r.random() < 0.16})
    return nodes, edges


@pytest.fixture(scope="module")
def relations(spark, graph):
    return spark.createDataFrame([(f"r{k}", a, b) for k, (a, b) in enumerate(graph[1])], "rel_id string, src string, dst string")


def adjacency(graph):
    near = {n: set() for n in graph[0]}
    for a, b in graph[1]:
        near[a].add(b)
        near[b].add(a)
    return near


def distances(near, source):
    seen, queue = {source: 0}, deque([source])
    while queue:
        n = queue.popleft()
        for m in near[n]:
            if m not in seen:
                seen[m] = seen[n] + 1
                queue.append(m)
    return seen


def shortest(near, a, b):
    """All shortest paths from a to b."""
    d = distances(near, a)
    if b not in d:
        return []
    paths = [[b]]
    for _ in range(d[b]):
        paths = [[m, *p] for p in paths for m in near[p[0]] if d.get(m) == d[p[0]] - 1]
    return paths


def by_hand_betweenness(near):
    want = dict.fromkeys(near, 0.0)
    for a, b in itertools.permutations(near, 2):
        paths = shortest(near, a, b)
        for p in paths:
            for n in p[1:-1]:
                want[n] += 0.5 / len(paths)
    return want


@pytest.mark.parametrize("batch", [64, 5])
def test_betweenness(graph, relations, batch):
    want = by_hand_betweenness(adjacency(graph))
    got = {r["entity_id"]: r["betweenness"] for r in P.betweenness(relations, batch=batch).collect()}
    assert set(got) == {n for n, v in adjacency(graph).items() if v}
    assert all(abs(v - want[n]) < 1e-5 for n, v in got.items())


def test_betweenness_of_a_hub_and_of_nothing(spark):
    """A hub of 300 leaves, one of which carries a path: every pair of leaves goes through the hub."""
    rows = [("hub", f"leaf{k}") for k in range(300)] + [("leaf0", "x"), ("x", "y"), ("y", "x"), ("y", "y")]
    got = {r["entity_id"]: r["betweenness"] for r in P.betweenness(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert got["hub"] == 300 * 299 / 2 + 2 * 299 and got["leaf0"] == 2 * 300 and got["x"] == 301 and got["y"] == 0
    assert P.betweenness(spark.createDataFrame([], "src string, dst string")).count() == 0
    assert P.betweenness(spark.createDataFrame([("a", "a")], "src string, dst string")).count() == 0


def test_betweenness_of_a_sample(spark):
    rng = random.Random(3)
    rows = [(f"n{rng.randint(0, 149)}", f"n{int(150 * rng.random() ** 2)}") for _ in range(500)]
    relations = spark.createDataFrame(rows, "src string, dst string")
    exact = {r["entity_id"]: r["betweenness"] for r in P.betweenness(relations, batch=200).collect()}
    some = {r["entity_id"]: r["betweenness"] for r in P.betweenness(relations, sample=40).collect()}
    assert set(some) == set(exact) and max(abs(some[n] - v) for n, v in exact.items()) <= P.sampling_error(len(exact), 40)
    top = sorted(exact, key=exact.get)[-5:]
    assert all(0.4 * exact[n] < some[n] < 2.5 * exact[n] for n in top)


def test_vector_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 30)
    r = np.random.default_rng(2)
    rows = r.integers(-2, 3, size=(200, 4)).astype(float).tolist() + [[0.0] * 4, None, [1.0, 2.0], [2.0, 4.1], [1.0, None, 1.0, 1.0]]
    frame = spark.createDataFrame([(f"v{i}", x) for i, x in enumerate(rows)] + [(None, rows[0])], "id string, v array<double>")
    asked = frame.filter("id IS NULL OR substr(id, 2) % 2 = 0").selectExpr("id AS query_id", "v AS vector")
    got = R.similar_by_embedding(frame, asked, 5, 0.3, "id", "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    unit = {f"v{i}": np.array(x) / np.linalg.norm(x) for i, x in enumerate(rows) if x and None not in x and any(x)}
    want = set()
    for q in unit:
        if int(q[1:]) % 2 == 0:
            scored = sorted((-round(float(unit[q] @ x), 6), i) for i, x in unit.items() if i != q and len(x) == len(unit[q]) and round(float(unit[q] @ x), 6) >= 0.3)
            want |= {(q, i, -s, k + 1) for k, (s, i) in enumerate(scored[:5])}
    assert {tuple(x) for x in got.collect()} == want and len(want) > 300


def test_index_search(spark, tmp_path):
    """The same rows as the search without an index, from fewer ranges, and from the folders of the asked terms only."""
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 3) for k in range(400)]
    rows = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.choice([3, 10, 40, 200])))) for k in range(1500)] + [(9000, None), (9001, ""), (None, "w1 w2"), (9002, "w399 " * 3000)]
    queries = [(k, " ".join(rng.choices(vocabulary, k=3))) for k in range(12)] + [(50, "nothing here"), (51, None), (52, "w0 w1 w2 w3")]
    docs, asked = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(queries, "query_id int, query string")
    index = I.write_index(docs, "id", "text", f"file://{tmp_path}/index", size=16, buckets=16)
    scored = []
    got = I.indexed_search(spark, index, asked, 5, buckets=16, scored=scored)
    want = R.fulltext_search(docs, asked, "id", "text", 5)
    assert sorted(map(tuple, got.select("query_id", "id", "score", "rank").collect()), key=str) == sorted(map(tuple, want.select("query_id", "id", "score", "rank").collect()), key=str)
    assert scored[1] < 0.7 * scored[0], scored
    one = I.read_index(spark, index, spark.createDataFrame([("w7",)], "term string").withColumn("bucket", I._bucket("term", 16)))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_modular_communities(spark):
    """Planted groups are found again; the graph's modularity is near that of the plant."""
    rng = random.Random(9)
    rows = []
    for a in range(240):
        rows += [(f"n{a}", f"n{8 * rng.randint(0, 29) + a % 8}") for _ in range(6)] + [(f"n{a}", f"n{rng.randint(0, 239)}")]
    rows = [(f"r{k}", a, b, "significant") for k, (a, b) in enumerate(rows)]
    relations = spark.createDataFrame(rows, "rel_id string, src string, dst string, magnitude string")
    entities = spark.createDataFrame([(f"n{k}", f"name {k}", "x") for k in range(240)] + [("alone", "alone", "y")], "entity_id string, name string, category string")
    labels = C.modular_communities(entities, relations)
    found = {r["entity_id"]: r["community"] for r in labels.collect()}
    planted = spark.createDataFrame([(f"n{k}", str(k % 8)) for k in range(240)] + [("alone", "alone")], "entity_id string, community string")
    best, got = (C.modularity(x, relations).first() for x in (planted, labels))
    assert got["modularity"] >= 0.9 * best["modularity"] > 0.5 and 8 <= got["communities"] <= 14, (got, best)
    assert found["alone"] == "alone" and len(found) == 241
    detail = C.community_detail(labels, entities, relations, 3)
    assert detail["members"].count() == 241
    inside = detail["relations"].collect()
    assert all(found[r["src"]] == found[r["dst"]] == r["community"] and r["rank"] <= 3 for r in inside) and len(inside) >= 20
    loops = spark.createDataFrame([("r", "n1", "n1", "significant")], relations.schema)
    assert {r["community"] for r in C.modular_communities(entities, loops, 1, 2, 1).collect()} == {f"n{k}" for k in range(240)} | {"alone"}


@pytest.mark.parametrize("most", [1, 2, 3])
def test_near_names(spark, most):
    """All pairs, also with an edit in the first letters, of every length."""
    rng = random.Random(most)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    names = {"", "a", "ab", "abc", "b", "xbc", "Alpha", "alpha", "lpha", "Alphabet", "ü", "üb"}
    while len(names) < 140:
        old = list(rng.choice(sorted(names)))
        for _ in range(rng.randint(1, 3)):
            old.insert(rng.randint(0, len(old)), rng.choice("abcx"))
            if rng.random() < 0.5 and old:
                del old[rng.randrange(len(old))]
        names.add("".join(old))
    got = {tuple(r) for r in B.near_names(spark.createDataFrame([(n,) for n in [*names, None, "alpha"]], "name string"), most).collect()}
    want = {(min(a, b), max(a, b), edits(a, b)) for a, b in itertools.combinations(names, 2) if edits(a, b) <= most}
    assert got == want and any(a[:1] != b[:1] and len(a) > 3 for a, b, _ in want)


def test_shortest_paths_from_both_ends(spark):
    """Least path from the end back, as one-sided search has it; fewer rows; paths through projects."""
    rng = random.Random(12)
    names = [f"n{k:03}" for k in range(300)]
    rows = list({(a, b) for a, b in (rng.sample(names, 2) for _ in range(480))}) + [(f"c{k}", f"c{k + 1}") for k in range(9)] + [("n001", "c0")]
    near = defaultdict(set)
    for a, b in rows:
        near[a].add(b)
        near[b].add(a)
    pairs = [tuple(rng.sample(names, 2)) for _ in range(40)] + [("c0", "c5"), ("c0", "c9"), ("n001", "n001"), ("n001", "nobody"), ("nobody", "n002"), ("c1", "n001")]
    want = {}
    for a, b in set(pairs):
        d = distances(near, a)
        if a != b and d.get(b, 99) <= 6:
            path = [b]
            while path[0] != a:
                path.insert(0, min(m for m in near[path[0]] if d.get(m) == d[path[0]] - 1))
            want[a, b] = path
    relations, asked = spark.createDataFrame(rows, "src string, dst string"), spark.createDataFrame(pairs, "a string, b string")
    grown = []
    got = {(r["a"], r["b"]): r["path"] for r in T.shortest_paths(relations, asked, 6, grown=grown).collect()}
    assert got == want and len(want) > 30
    one_sided = sum(1 for a in {a for a, _ in pairs} for d in distances(near, a).values() if 0 < d <= max(len(p) - 1 for p in want.values()))
    assert sum(grown) < 0.5 * one_sided, (sum(grown), one_sided)
    mentions = spark.createDataFrame([("x", "p1"), ("y", "p1"), ("y", "p2"), ("z", "p2")], "entity_id string, project_id string")
    through = T.shortest_paths(relations, spark.createDataFrame([("x", "z")], "a string, b string"), 6, mentions).first()
    assert through["path"] == ["x", "p1", "y", "p2", "z"] and through["hops"] == 4
    assert T.shortest_paths(relations, asked.limit(0)).count() == 0


def test_suggest_links_lists_few_pairs(spark):
    """A large project, ties, and leaders that are all related: the same pairs as from a listing of all."""
    rng = random.Random(13)
    people = {"big": [f"e{k}" for k in range(400)], "tied": [f"t{k}" for k in range(60)], "two": ["e1", "e2"], "one": ["e3"], "dense": [f"d{k}" for k in range(12)]}
    score = {e: float(rng.randint(1, 30)) for who in people.values() for e in who} | {f"t{k}": 5.0 for k in range(60)}
    best = sorted(people["big"], key=lambda e: (-score[e], e))[:25]
    rel = [(a, b) for a, b in itertools.combinations(best, 2) if rng.random() < 0.8] + list(itertools.combinations(people["dense"], 2)) + [("t0", "t1"), ("t3", "t0"), ("e9", "e9")]
    related = {tuple(sorted(p)) for p in rel}
    g = order_graph(spark, SMALL).with_tables(
        mentions=spark.createDataFrame([(e, p, "r") for p, who in people.items() for e in who], "entity_id string, project_id string, role string"),
        relations=spark.createDataFrame(rel, "src string, dst string"), projects=spark.createDataFrame([(p,) for p in people], "project_id string"),
    )
    listed = []
    found = J.suggest_links(g, spark.createDataFrame(list(score.items()), "entity_id string, score double"), g.projects, 1.0, 7, listed)
    got = {(r["project_id"], r["a"], r["b"], r["score"], r["rank"]) for r in found.collect()}
    want = set()
    for p, who in people.items():
        pairs = sorted((-(score[a] + score[b]), *sorted((a, b))) for a, b in itertools.combinations([e for e in who if score[e] > 1], 2) if tuple(sorted((a, b))) not in related)
        want |= {(p, a, b, -s, k + 1) for k, (s, a, b) in enumerate(pairs[:7])}
    assert got == want
    assert sum(listed) < 0.1 * 400 * 399 / 2, listed


@pytest.mark.parametrize("head, part", [(1000, 2000), (15, 40)])
def test_alias_groups_of_a_large_document(spark, head, part):
    """One document in many small groups gives the greedy groups of the whole."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((25, 6))
    rows = [(1, f"name {k:03}", int(rng.integers(0, 300)), (centres[k % 25] + 0.25 * rng.standard_normal(6)).tolist()) for k in range(260)]
    rows += [(2, f"other {k}", k, centres[k % 3].tolist()) for k in range(9)] + [(3, "alone", 1, [1.0] * 6), (3, "zero", 2, [0.0] * 6), (4, "null", 1, None)]
    want = set()
    for doc in (1, 2, 3):
        own = sorted(((p, n, np.array(v) / max(np.linalg.norm(v), 1e-12)) for d, n, p, v in rows if d == doc), key=lambda x: x[:2])
        free = [True] * len(own)
        for i, (_, name, v) in enumerate(own):
            if free[i]:
                took = [j for j in range(i + 1, len(own)) if free[j] and v @ own[j][2] > 0.9]
                for j in took:
                    free[j] = False
                free[i] = False
                want |= {(doc, name, own[j][1]) for j in [i, *took]} if took else set()
    got = N.alias_groups(spark.createDataFrame(rows, "doc_id long, name string, pos int, embedding array<double>"), 0.9, head=head, part=part)
    assert {tuple(r) for r in got.collect()} == want and want


def test_nearest_lists(spark):
    """Recall of 0.9 and more with under a tenth of the pairs; a hot group of near copies, odd vectors."""
    rng = np.random.default_rng(7)
    points = rng.standard_normal((8000, 5)) @ rng.standard_normal((5, 24)) + 0.02 * rng.standard_normal((8000, 24))
    points[:400] = points[0] + 1e-3 * rng.standard_normal((400, 24))
    rows = [(k, x) for k, x in enumerate(points.tolist())] + [(9001, None), (9002, [0.0] * 24), (9003, [1.0, None] * 12), (None, points[0].tolist()), (9004, [1.0, 2.0]), (9005, [2.0, 4.1]), (9006, [])]
    met = []
    got = NN.nearest_lists(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 0.5, met=met).collect()
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -1)
    found = defaultdict(dict)
    for r in got:
        found[r["query_id"]][r["id"]] = r["score"]
    assert found.pop(9004) == {9005: pytest.approx(0.99997, abs=1e-4)} and found.pop(9005)
    assert all(k < 8000 and len(v) <= 5 and all(abs(cosine[k, m] - s) < 1e-5 for m, s in v.items()) for k, v in found.items())
    fifth = np.round(np.sort(cosine, axis=1)[:, -5], 6)
    right = [sum(s >= fifth[k] - 1e-6 for s in found[k].values()) for k in range(8000)]
    assert sum(right) >= 0.9 * 5 * 8000
    assert sum(met) < 0.1 * 8000 * 7999 / 2, sum(met) / (8000 * 7999 / 2)


def test_closeness(spark, graph, relations):
    """Small sets are counted exactly by a sketch; larger ones within a few per cent."""
    rng = random.Random(8)
    rows = [(f"n{rng.randint(0, 2999)}", f"n{rng.randint(0, 2999)}") for _ in range(6000)] + [("hub", f"n{k}") for k in range(1000)] + [(f"p{k}", f"p{k + 1}") for k in range(12)]
    for near, edges, error in ((adjacency(graph), relations, 1e-4), (None, spark.createDataFrame(rows, "src string, dst string"), 0.08)):
        if near is None:
            near = defaultdict(set)
            for a, b in rows:
                if a != b:
                    near[a].add(b)
                    near[b].add(a)
        got = {r["entity_id"]: r for r in P.closeness(edges).collect()}
        assert set(got) == {n for n, v in near.items() if v}
        some = list(got)[:40] + [n for n in ("hub", "p0", "p6") if n in got]
        for n in some:
            far = [d for d in distances(near, n).values() if d]
            assert got[n]["reached"] == pytest.approx(len(far), rel=error)
            assert got[n]["harmonic"] == pytest.approx(sum(1 / d for d in far), rel=error)
            assert got[n]["closeness"] == pytest.approx(len(far) / sum(far), rel=error)


def test_core_numbers(graph, relations):
    near = adjacency(graph)
    want, left, k = {}, {n: set(v) for n, v in near.items() if v}, 0
    while left:
        low = [n for n, v in left.items() if len(v) <= k]
        if not low:
            k += 1
        for n in low:
            want[n] = k
            for m in left.pop(n):
                if m in left:
                    left[m].discard(n)
    assert {r["entity_id"]: r["core"] for r in G.core_numbers(relations).collect()} == want


def test_shortest_paths_and_neighborhood(spark, graph, relations):
    near = adjacency(graph)
    pairs = [(a, b) for a in graph[0][:6] for b in graph[0]]
    got = {(r["a"], r["b"]): r["path"] for r in T.shortest_paths(relations, spark.createDataFrame(pairs, "a string, b string"), 4).collect()}
    for a, b in pairs:
        paths = [p for p in shortest(near, a, b) if len(p) <= 5] if a != b else []
        assert (got.get((a, b)) in paths) if paths else (a, b) not in got
    seeds = spark.createDataFrame([(n,) for n in graph[0][:4]], "entity_id string")
    reached = {(r["seed"], r["entity_id"]): r["distance"] for r in T.neighborhood(relations, seeds, 2).collect()}
    assert reached == {(s, n): d for s in graph[0][:4] for n, d in distances(near, s).items() if d <= 2}


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 100 for k in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pagerank_of_isolated_node(spark, relations):
    nodes = spark.createDataFrame([("lonely",)], "entity_id string")
    assert G.pagerank(nodes, relations, rounds=2).first()["page_rank"] == pytest.approx(0.15)


def test_percentiles(spark):
    nodes = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0)], "entity_id string, page_rank double")
    got = {r["entity_id"]: r["importance"] for r in W.composite_importance(nodes).collect()}
    assert got == {"a": 67, "b": 67, "c": 100}


def test_cut_text():
    assert N.cut_text("a b c", 100, "\n\n") == ["a b c"]
    assert [len(x) for x in N.cut_text("x" * 405, 100, "\n\n")] == [100, 100, 100, 100, 5]
    long = "Document words " * 100
    assert all(len(x) <= 100 for x in N.cut_text(long, 100, "\n\n")) and " ".join(N.cut_text(long, 100, "\n\n")).split() == long.split()
    assert N.cut_text("one\n\ntwo\n\nthree", 9, "\n\n") == ["one\n\ntwo", "three"]
    with pytest.raises(ValueError):
        N.cut_text("a", 0, "\n\n")


def test_sections_with_headings(spark):
    docs = spark.createDataFrame([(1, "# One\nfirst\n\nmore\n\n## Two\n\nlast"), (2, ""), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["section_id"], r["heading"], r["text"]) for r in N.sections(docs).collect())
    assert got == [(1, 0, "One", "first"), (1, 1, "One", "more"), (1, 2, "Two", "last"), (2, 0, "", ""), (3, 0, "", "")]


def test_alias_groups(spark):
    rows = [(1, "a", 0, [1.0, 0.0]), (1, "b", 1, [0.99, 0.1]), (1, "c", 2, [0.0, 1.0]), (2, "d", 0, [1.0, 0.0])]
    got = N.alias_groups(spark.createDataFrame(rows, "doc_id long, name string, pos int, embedding array<double>")).collect()
    assert sorted((r["leader"], r["member"]) for r in got) == [("a", "a"), ("a", "b")]


def test_parse_model_json(spark):
    rows = spark.createDataFrame([(1, '```json\n{"k": 3}\n```'), (2, "not json"), (3, None)], "id int, answer string")
    good, bad = N.parse_model_json(rows, "k int")
    assert [(r["id"], r["parsed"]["k"]) for r in good.collect()] == [(1, 3)]
    assert sorted(r["id"] for r in bad.collect()) == [2, 3]


def rules(df):
    return sorted(r["rule"] for r in df.collect())


GOOD = {
    "project": {"name": "n", "unique_id": "p", "summary": "s", "narrative_flow": ["one"], "tags": {"domain": "d", "subdomain": "e", "base_tags": ["t"]}},
    "relationships": [], "causal_chains": [],
}


@pytest.mark.parametrize(
    ("change", "rules"),
    [
        ({}, []),
        ({"more": 1}, ["EXTRACT_TOPLEVEL"]),
        ({"project": []}, ["EXTRACT_PROJECT"]),
        ({"project": {**GOOD["project"], "summary": 3}}, ["EXTRACT_PROJECT"]),
        ({"project": {**GOOD["project"], "unique_id": "q"}}, ["CROSS_ID", "EXTRACT_ID_MATCH"]),
        ({"project": {**GOOD["project"], "narrative_flow": "x"}}, ["EXTRACT_NARRATIVE"]),
        ({"project": {**GOOD["project"], "narrative_flow": []}}, []),
        ({"project": {**GOOD["project"], "narrative_flow": ["a", 1]}}, ["EXTRACT_NARRATIVE"]),
        ({"project": {**GOOD["project"], "tags": {"domain": "d", "subdomain": "", "base_tags": []}}}, ["EXTRACT_TAGS", "EXTRACT_TAGS"]),
        ({"project": {k: v for k, v in GOOD["project"].items() if k != "tags"}}, ["EXTRACT_PROJECT", "EXTRACT_TAGS"]),
        ({"relationships": "x", "causal_chains": {}}, ["EXTRACT_CHAIN_COUNT", "EXTRACT_REL_COUNT"]),
    ],
)
def test_check_project(spark, change, rules):
    raw = json.dumps(GOOD | change)
    found = V.check_project(spark.createDataFrame([("p", raw)], "project_id string, raw string"), spark.createDataFrame([("p", "p")], "project_id string, unique_id string"))
    assert sorted(r["rule"] for r in found.collect()) == rules


def test_validation_defaults(spark):
    projects = spark.createDataFrame([("p",)], "project_id string")
    entities = spark.createDataFrame([("p", f"e{k}", c, "d", None) for k, c in enumerate(V.CATEGORIES)] + [("p", "x", "Group", "d", 4), ("p", "e0", "Person", "d", None)], "project_id string, name string, category string, definition string, first_appearance_index int")
    phases = spark.createDataFrame([("p", 0)], "project_id string, phase_index int")
    assert sorted(r["rule"] for r in V.check_entities(projects, entities, phases).collect()) == ["ENTITY_CATEGORY", "ENTITY_DUPLICATE", "ENTITY_PHASE_MAP"]
    rels = [("p", "e0", "e1", "t", "d", "q", c, s, "marginal", "ongoing", None) for c, s in zip(V.CAUSAL_CLASSES, V.STRENGTHS * 4, strict=False)]
    rels += [("p", "e0", "e1", "t", "d", "", "CAUSES", "supported", "marginal", "", "e0")]
    relations = spark.createDataFrame(rels, "project_id string, source string, target string, rel_type string, description string, evidence string, causal string, evidence_strength string, magnitude string, year string, source_entity string")
    assert sorted(r["rule"] for r in V.check_relations(projects, relations, entities).collect()) == ["EXTRACT_EVIDENCE", "EXTRACT_REL_FIELDS", "EXTRACT_REL_NAMES", "YEAR_MISSING"]
    links = spark.createDataFrame([("p", "c", "e0", "e1", ""), ("p", "c", "e1", "e0", "x"), ("p", "c", "e0", "zz", "x")], "project_id string, chain string, source string, target string, explanation string")
    chains = spark.createDataFrame([("p", "c", "n", "d"), ("p", "d", "", " ")], "project_id string, chain string, name string, description string")
    assert sorted(r["rule"] for r in V.check_chains(links, relations, entities, chains).collect()) == ["EXTRACT_CHAIN_EVIDENCE"] * 2 + ["EXTRACT_CHAIN_FIELDS"] * 4 + ["EXTRACT_CHAIN_MATCH"]
    files = [json.dumps({"model": "m", "dimensions": 384, "embeddings": []}), "[]", "{", json.dumps({"model": "m", "dimensions": "384", "embeddings": []}), json.dumps({"project_embedding": 1})]
    found = V.check_embedding_file(spark.createDataFrame([(str(k), f) for k, f in enumerate(files)], "project_id string, raw string")).collect()
    assert sorted((r["project_id"], r["rule"]) for r in found) == [("1", "EMBED_STRUCTURE"), ("2", "JSON_PARSE"), ("3", "EMBED_STRUCTURE"), ("4", "EMBED_STRUCTURE"), ("4", "EMBED_STRUCTURE")]


def test_validation_of_broken_artifacts(spark):
    projects = spark.createDataFrame([("p",)], "project_id string")
    good = json.dumps({"directory": "d", "project_name": "p", "unique_id": "p", "collection": "c", "collection_is_new": True})
    check = lambda raw: rules(V.check_placement(spark.createDataFrame([("p", raw)], "project_id string, raw string")))
    assert check(good) == []
    assert check("{") == check("[]") == check(None) == ["JSON_PARSE"]
    assert check(good.replace('"unique_id": "p"', '"unique_id": "Bad Id"')) == ["PLACEMENT_ID", "PLACEMENT_ID_MATCH"]
    assert check(good.replace("true", '"true"')) == check(good.replace("true", "1")) == ["PLACEMENT_BOOL"]
    assert check(good.replace('"project_name": "p"', '"project_name": 5')) == ["PLACEMENT_ID_MATCH", "PLACEMENT_TYPES"]
    assert check(good.replace('"directory"', '"name"')) == ["PLACEMENT_FIELDS", "PLACEMENT_FIELD_NAMES", "PLACEMENT_TYPES"]
    assert check(good.replace('"directory": "d"', '"directory": " "')) == ["PLACEMENT_TYPES"]
    entities = spark.createDataFrame([("p", "A"), ("p", "B")], "project_id string, name string")
    vectors = lambda rows: rules(V.check_embeddings(spark.createDataFrame([("p", k, n, v) for k, (n, v) in enumerate(rows)], "project_id string, pos int, name string, embedding array<double>"), entities, 2))
    assert vectors([("A", [1.0, 0.0]), ("B", [0.0, 1.0]), ("p", [1.0, 1.0])]) == []
    assert vectors([("A", [0.0, 0.0]), ("B", [0.0, 1.0]), ("p", [1.0, 1.0])]) == ["EMBED_ZERO"]
    assert vectors([("A", [1.0, 0.0]), ("A", [0.0, 1.0]), ("p", [1.0, float("nan")])]) == ["EMBED_DUPLICATE", "EMBED_DUPLICATE", "EMBED_FIELDS"]
    assert vectors([("p", [1.0, 0.0]), ("A", [0.0, 1.0]), ("B", [1.0])]) == ["EMBED_DIMENSIONS", "EMBED_ENTITY_MATCH", "EMBED_PROJECT"]
    quotes = spark.createDataFrame([("p", "two  short\nsentences"), ("p", "never said")], "project_id string, evidence string")
    sources = spark.createDataFrame([("p", "Here are two short sentences.")], "project_id string, text string")
    assert rules(V.check_evidence(quotes, sources)) == ["EXTRACT_EVIDENCE_SOURCE"]
    files = spark.createDataFrame([("p", f) for f in V.FILES[:-1]], "project_id string, file string")
    assert rules(V.check_files(projects, files)) == ["FILE_MISSING"]
    phases = spark.createDataFrame([("p", 0, "a", "b"), ("p", 0, "", "b"), ("p", None, "a", "b")], "project_id string, phase_index int, label string, period string")
    assert rules(V.check_phases(phases)) == ["ENTITY_PHASES"] * 3 + ["ENTITY_PHASE_FIELDS"]


def test_validation_of_raw_files(spark):
    """Types as JSON has them, one change at a time."""
    frame_of = lambda raw: spark.createDataFrame([("p", raw if raw is None or isinstance(raw, str) else json.dumps(raw))], "project_id string, raw string")
    nlp = lambda raw: rules(V.check_nlp_file(frame_of(raw)))
    assert nlp({"entity_candidates": []}) == nlp({"entity_candidates": [{"text": "a"}]}) == []
    for raw in ({"error": "none"}, [], {"entity_candidates": {}}, {"entity_candidates": [{"text": " "}]}, {"entity_candidates": [{"text": 1}]}, {"entity_candidates": ["a"]}):
        assert nlp(raw) == ["NLP_CANDIDATES"]
    person = {"name": "Mira", "aliases": ["M"], "category": "Person", "definition": "d", "role": "r", "first_appearance_index": None}
    phase = {"index": 1, "label": "l", "period": "p"}
    check = lambda entities, phases=(), **more: rules(V.check_entity_file(frame_of({"entities": entities, "temporal_phases": list(phases)} | more)))
    assert check([person]) == check([person | {"first_appearance_index": 1}], [phase]) == []
    assert check([]) == ["ENTITY_COUNT_MIN"] and check({}) == ["ENTITY_ARRAY"] and check([person], temporal_phases=None) == ["ENTITY_PHASES"]
    assert rules(V.check_entity_file(frame_of([]))) == ["ENTITY_ARRAY"] and rules(V.check_entity_file(frame_of("{"))) == ["JSON_PARSE"]
    for index in (1, True, "0", 0.5):
        assert check([person | {"first_appearance_index": index}]) == ["ENTITY_PHASE_MAP"]
    assert check([person | {"first_appearance_index": True}], [phase]) == ["ENTITY_PHASE_MAP"]
    assert check([person, person]) == ["ENTITY_DUPLICATE"]
    for change in ({"category": []}, {"category": "Group"}, {"category": None}):
        assert check([person | change]) == ["ENTITY_CATEGORY"]
    for change in ({"aliases": "M"}, {"aliases": ["M", ""]}, {"aliases": [1]}, {"role": " "}, {"definition": 7}):
        assert check([person | change]) == ["ENTITY_FIELDS"]
    assert check(["Mira"]) == ["ENTITY_FIELDS"] and check([{k: v for k, v in person.items() if k != "role"}]) == ["ENTITY_FIELDS"] * 2
    for change in ({"index": -1}, {"index": "1"}, {"index": None}, {"label": ""}, {"period": 3}):
        assert check([person], [phase | change]) == ["ENTITY_PHASE_FIELDS"]
    assert check([person], [phase, phase]) == ["ENTITY_PHASE_FIELDS"] and check([person], ["x"]) == ["ENTITY_PHASE_FIELDS"]

    vector = lambda name, values=(0.5, 1): {"name": name, "embedding": list(values)}
    entities, placement = spark.createDataFrame([("p", "Mira"), ("p", "Atlas")], "project_id string, name string"), spark.createDataFrame([("p", "note")], "project_id string, unique_id string")
    vectors = lambda rows, names=entities: rules(V.check_embedding_entries(frame_of({"embeddings": rows}), names, placement, 2))
    good = [vector("Mira"), vector("Atlas"), vector("note")]
    assert vectors(good) == [] and V.entity_names(frame_of({"entities": [person, person]})).collect() == [("p", "Mira")]
    assert vectors(good[1:]) == ["EMBED_COUNT", "EMBED_ENTITY_MATCH"]
    assert vectors(good[::-1]) == ["EMBED_PROJECT"]
    assert vectors([good[0], good[0], good[2]]) == ["EMBED_DUPLICATE", "EMBED_ENTITY_MATCH"]
    assert vectors([good[0], vector("Unknown"), good[2]]) == ["EMBED_ENTITY_MATCH"] * 2
    assert vectors([good[0], good[2]], spark.createDataFrame([("p", "Mira"), ("p", "note")], entities.schema)) == ["EMBED_COUNT", "EMBED_PROJECT_NAME"]
    assert vectors([vector("Mira", [0, 0.0]), *good[1:]]) == ["EMBED_ZERO"] and vectors([]) == ["EMBED_COUNT"]
    assert vectors([vector("Mira", [1]), *good[1:]]) == ["EMBED_DIMENSIONS"] and vectors([good[0] | {"dimensions": "2"}, *good[1:]]) == ["EMBED_DIMENSIONS"]
    for value in (True, "0.1", None, [1]):
        assert vectors([vector("Mira", [value, 1]), *good[1:]]) == ["EMBED_FIELDS"]
    assert vectors([{"name": "Mira", "embedding": "x"}, *good[1:]]) == ["EMBED_FIELDS"]


def test_quick_ingest_and_purge(spark):
    rows = [("i1", "T", ["t"], ["c"], [("A", [("B", None)]), ("B", [])])]
    new = M.quick_ingest(spark.createDataFrame(rows, "payload_id string, title string, tags array<string>, collections array<string>, entities array<struct<name string, relations array<struct<target string, type string>>>>"))
    assert new["relations"].first()["rel_type"] == "Associative"
    assert sorted(r["name"] for r in new["entities"].collect()) == ["A", "B"]
    broken = M.broken_embeddings(spark.createDataFrame([(1, [1.0]), (2, [0.0]), (3, None), (4, [float("nan")])], "id int, embedding array<double>"))
    assert sorted(r["id"] for r in broken.collect()) == [2, 3, 4]


def test_documents_and_sources(spark, tmp_path):
    for name, text in (("a.md", "﻿Hello"), ("b.txt", " \n"), ("c.pdf", "x")):
        (tmp_path / name).write_text(text)
    good, blank = S.read_documents(spark, str(tmp_path))
    assert [(r["title"], r["text"]) for r in good.collect()] == [("a", "Hello")]
    assert blank.count() == 1
    projects = spark.createDataFrame([("p1", "x/p1.html"), ("p2", "../secret.html"), ("p3", "gone.html")], "project_id string, path string")
    files = spark.createDataFrame([("/x/p1.html",), ("/secret.html",), ("/other/p3.html",)], "file string")
    assert {r["project_id"]: r["html"] for r in S.resolve_sources(projects, files).collect()} == {"p1": "/x/p1.html", "p2": None, "p3": "/other/p3.html"}


def test_graph_round_trip(spark, tmp_path):
    g = order_graph(spark, SMALL)
    S.write_graph(g, str(tmp_path / "g"))
    back = S.read_graph(spark, str(tmp_path / "g"))
    assert S.checksum(back.relations).first() == S.checksum(g.relations).first()


def test_stream_ingest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("some words")
    (source / "b.txt").write_text("x")
    stream = X.stream_documents(spark, str(source))
    query = X.ingest(stream, lambda df: df.withColumn("n", F.length("text")), lambda df: df.withColumn("ok", F.col("n") > 3), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_stream_counts_and_requests(spark, tmp_path):
    rows = [("a", "f", "2024-01-01 00:00:01"), ("a", "f", "2024-01-01 00:00:02"), ("a", "g", "2024-01-01 00:20:00")]
    spark.createDataFrame(rows, "request_id string, fingerprint string, t string").withColumn("ts", F.to_timestamp("t")).write.parquet(str(tmp_path / "rows"))
    schema = "request_id string, fingerprint string, t string, ts timestamp"
    for name, build in (("counts", lambda s: X.windowed_counts(s, "request_id", "10 minutes")), ("once", lambda s: X.dedupe_requests(s))):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "rows"))
        query = build(stream).writeStream.format("memory").queryName(f"seen_{name}").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert spark.table("seen_once").count() == 2


def test_view_tiers_and_running_counts(spark):
    from kgspark.operators.aggregates import view_tiers
    from kgspark.operators.rankings import value_counts_upto

    r = random.Random(9)
    rows = [(k, r.choice([1, 1, 1, 2, 3, 5]), r.paretovariate(0.4) - 1 if k % 3 else 0.0) for k in range(700)]
    nodes = spark.createDataFrame(rows, "k int, project_count int, betweenness double")
    counts = value_counts_upto(nodes, "betweenness").collect()
    values = sorted(b for _, _, b in rows)
    assert {(c["betweenness"], c["below"], c["upto"], c["n"]) for c in counts} == {(b, sum(x < b for x in values), sum(x <= b for x in values), 700) for b in values}
    singles = sorted(b for _, n, b in rows if n == 1)
    cut = singles[int(len(singles) * 0.9)]
    want = {k: "gold" if n >= 3 else "silver" if n == 2 else "bronze" if b >= cut and b > 0 else "none" for k, n, b in rows}
    assert {x["k"]: x["tier"] for x in view_tiers(nodes).collect()} == want


def test_project_view_must_be_in_the_collection(spark):
    from kgspark.operators.joins import load_project_view
    from kgspark.sources.graph import order_graph

    g = order_graph(spark, "/root/testdata/sf0.001")
    own = g.project_collections.orderBy("project_id").first()
    nodes, links = load_project_view(g, own["collection"], own["project_id"])
    assert {x["node_id"] for x in nodes.filter("kind = 'project'").collect()} == {own["project_id"]}
    assert {x["project_id"] for x in links.collect()} <= {own["project_id"]}
    with pytest.raises(ValueError):
        load_project_view(g, "1900-01", own["project_id"])


def test_extracted_relations_are_checked(spark):
    candidates = spark.createDataFrame([(1, "Ann", [0], ["Ann met Bob"]), (1, "Bob", [0], ["Ann met Bob"])], "doc_id long, text string, sections array<long>, contexts array<string>")
    made = lambda c: spark.createDataFrame([(1, "Ann", "Bob", "MET", "Ann met Bob", 1.0), (1, "Ann", "Ann", "IS", "q", 1.0), (1, "Ann", "Cy", "MET", "q", 1.0), (1, "Ann", "Bob", "MET", " ", 1.0)], "doc_id long, source string, target string, rel_type string, evidence string, weight double")
    good, bad = N.extract_relations(candidates, made)
    assert [(r["source"], r["target"]) for r in good.collect()] == [("Ann", "Bob")]
    assert sorted(r["reason"] for r in bad.collect()) == ["blank", "loop", "unknown end"]
    assert [(r["source"], r["target"], r["evidence"]) for r in N.extract_relations(candidates)[0].collect()] == [("Ann", "Bob", "Ann met Bob")]


def _arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def _stream(spark, folder):
    found = spark.read.parquet(str(folder / "in"))
    return spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def test_mention_counts_in_a_stream(spark, tmp_path):
    """Repeated mentions count once, late ones inside the watermark count, later ones do not; a restart goes on."""
    schema = "entity_id string, project_id string, t string"
    run = lambda: K.run_to_end(K.mention_counts(_stream(spark, tmp_path), "10 minutes", 4), "update", f"{tmp_path}/out", f"{tmp_path}/check")
    totals = lambda: {r["entity_id"]: r["projects"] for r in K.mention_totals(spark.read.parquet(f"{tmp_path}/out")).collect()}
    _arrive(spark, tmp_path, [("a", f"p{k % 5}", "2024-01-01 12:00:00") for k in range(40)] + [("b", "p1", "2024-01-01 12:00:01"), (None, "p1", "2024-01-01 12:00:01"), ("b", None, "2024-01-01 12:00:01")], schema)
    run()
    assert totals() == {"a": 5, "b": 1}
    _arrive(spark, tmp_path, [("a", "p7", "2024-01-01 12:30:00"), ("a", "p1", "2024-01-01 12:30:00")], schema)
    run()
    assert totals() == {"a": 6, "b": 1}
    _arrive(spark, tmp_path, [("b", "p2", "2024-01-01 12:25:00"), ("b", "p3", "2024-01-01 12:05:00"), ("a", "p8", "2024-01-01 12:31:00")], schema)
    run()
    assert totals() == {"a": 7, "b": 2}


def test_request_outcomes_in_a_stream(spark, tmp_path):
    schema = "request_id string, fingerprint string, t string"
    run = lambda: K.run_to_end(K.request_outcomes(_stream(spark, tmp_path), "10 minutes", 3600), "append", f"{tmp_path}/out", f"{tmp_path}/check")
    seen = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("request_id", "fingerprint", "outcome").collect())
    _arrive(spark, tmp_path, [("r1", "f", "2024-01-01 12:00:02"), ("r1", "f", "2024-01-01 12:00:01"), ("r1", "g", "2024-01-01 12:00:03"), ("r2", None, "2024-01-01 12:00:00")], schema)
    run()
    want = [("r1", "f", "accepted"), ("r1", "g", "conflict"), ("r2", "", "accepted")]
    assert seen() == want
    _arrive(spark, tmp_path, [("r1", "f", "2024-01-01 12:10:00"), ("r1", "g", "2024-01-01 12:10:00"), ("r1", "h", "2024-01-01 12:10:00")], schema)
    run()
    assert seen() == sorted([*want, ("r1", "h", "conflict")])
    _arrive(spark, tmp_path, [("r9", "z", "2024-01-01 18:00:00")], schema)  # passes the first requests by more than an hour
    run()
    _arrive(spark, tmp_path, [("r1", "new", "2024-01-01 18:01:00"), ("r2", "late", "2024-01-01 12:00:00")], schema)
    run()
    assert seen() == sorted([*want, ("r1", "h", "conflict"), ("r9", "z", "accepted"), ("r1", "new", "accepted")])


def test_newest_results_in_a_stream(spark, tmp_path):
    schema = "scope string, seq long, result string, t string"
    run = lambda: K.run_to_end(K.newest_results(_stream(spark, tmp_path)), "update", f"{tmp_path}/out", f"{tmp_path}/check")
    for rows in ([("s", 3, "c"), ("s", 2, "b"), ("t", 1, None)], [("s", 1, "a"), ("t", 2, "y"), (None, 9, "x"), ("t", None, "x")], [("s", 2, "b")]):
        _arrive(spark, tmp_path, [(*r, "2024-01-01 12:00:00") for r in rows], schema)
        run()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("scope", "seq", "result").collect())
    assert got == [("s", 3, "c"), ("t", 1, ""), ("t", 2, "y")]


def test_transcripts_artifacts_and_slug_bundles(spark, tmp_path):
    (tmp_path / "videos.json").write_text(json.dumps([{"title": "A Talk: " + "x" * 80, "transcript": "one"}, {"title": "!!", "transcript": "two"}, {"transcript": None}]))
    got = [tuple(r) for r in S.read_transcripts(spark, str(tmp_path / "videos.json")).collect()]
    assert [r[1] for r in got] == [("a-talk-" + "x" * 80)[:50], "video-2", "video-3"] and [r[2] for r in got] == ["one", "two", None]
    for project, raw in (("p1", '{"n": 1}'), ("p2", "{"), ("p3", '{"n": 3}')):
        (tmp_path / "all" / project).mkdir(parents=True)
        (tmp_path / "all" / project / "02.json").write_text(raw)
    good, broken = S.read_artifacts(spark, str(tmp_path / "all"), "02.json", "n int")
    assert sorted(map(tuple, good.collect())) == [("p1", 1), ("p3", 3)] and [r["project_id"] for r in broken.collect()] == ["p2"]
    assert [r[0] for r in S.missing_artifacts(spark.createDataFrame([("p1",), ("p9",)], "project_id string"), good).collect()] == ["p9"]
    rows = spark.createDataFrame([("c", "p1", "x"), ("c", "p2", "y")], "collection string, project_id string, text string")
    folder = f"file://{tmp_path}/written"
    assert S.write_artifacts(rows, folder).count() == 0
    more = rows.unionByName(spark.createDataFrame([("d", "p3", "z")], rows.schema)).withColumn("text", F.lit("new"))
    assert {r["project_id"] for r in S.write_artifacts(more, folder).collect()} == {"p1", "p2"}
    assert sorted((r["project_id"], r["text"]) for r in spark.read.parquet(folder).collect()) == [("p1", "x"), ("p2", "y"), ("p3", "new")]
    bundle = {"entities": [{"slug": "e", "name": "E", "category": "Person", "projectRoles": [{"project": "p", "role": "r"}]}], "chains": [{"slug": "c", "project": "p", "links": [{"orderIndex": 0, "source": "e", "target": "f"}]}]}
    (tmp_path / "bundle.json").write_text(json.dumps(bundle))
    assert [[tuple(r) for r in part.collect()] for part in S.read_slug_bundle(spark, str(tmp_path / "bundle.json"))] == [[("e", "E", "Person")], [("e", "p", "r")], [("c", 0, "e", "f")]]


def test_named_rows_descriptions_and_stored_vectors(spark):
    table = spark.createDataFrame([("A", "a"), ("B", None), ("C", "c")], "name string, description string")
    grown, refused = M.upsert_named(table, spark.createDataFrame([(" D ",), ("A",), ("D",), (" ",), (None,)], "name string"))
    assert sorted(r["name"] for r in grown.collect()) == ["A", "B", "C", "D"] and refused.count() == 2
    assert {r["name"] for r in M.rename(table, spark.createDataFrame([("A", "X"), ("B", "C")], "old string, new string")).collect()} == {"X", "B", "C"}
    updates = [("A", "X", None), ("B", None, "new"), ("C", "B", "no"), ("nobody", "Y", None), ("Z", " ", "z")]
    done, refused = M.describe(table, spark.createDataFrame(updates, "old string, name string, description string"))
    assert sorted(map(tuple, done.collect()), key=str) == [("B", "new"), ("C", "c"), ("X", "a")] and {r["old"] for r in refused.collect()} == {"C", "nobody", "Z"}
    vectors = spark.createDataFrame([("p", "A", [1.0]), ("p", "B", [2.0]), ("p", "p", [3.0]), ("q", "A", [1.0])], "project_id string, name string, embedding array<double>")
    names = spark.createDataFrame([("A", "e1"), ("B", "e2")], "name string, entity_id string")
    stored, coverage = M.store_embeddings(vectors, names, spark.createDataFrame([("e1", "p"), ("e2", "p"), ("e1", "q"), ("e1", "z")], "entity_id string, project_id string"))
    assert {(r["project_id"], r["kind"], r["entity_id"]) for r in stored.collect()} == {("p", "entity", "e1"), ("p", "entity", "e2"), ("p", "project", None), ("q", "entity", "e1")}
    assert {r["project_id"]: (r["entities"], r["projects"], r["expected"], r["complete"]) for r in coverage.collect()} == {"p": (2, 1, 3, True), "q": (1, 0, 2, False), "z": (0, 0, 2, False)}


def test_semantic_search_and_hybrid_merge(spark):
    """Cosines of the encoder's vectors by brute force; the merge takes text hits first."""
    rng = random.Random(17)
    texts = [(k, " ".join(rng.choices([f"w{j}" for j in range(60)], k=rng.randint(1, 12)))) for k in range(80)] + [(500, None), (501, "")]
    asked = [(k, texts[k * 7][1]) for k in range(6)] + [(3000, "unknownword"), (4000, None)]
    docs, queries = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "query_id long, query string")
    both = spark.createDataFrame([(f"d{k}", t) for k, t in texts] + [(f"q{k}", t) for k, t in asked], "doc_id string, text string")
    unit = {r["doc_id"]: np.array(r["embedding"]) for r in N.hashed_vectors(both, 64).collect()}
    got = R.semantic_search(docs, queries, "id", "text", 5, 0.05)
    want = set()
    for q, _ in asked:
        if f"q{q}" in unit:
            scored = sorted((-round(float(unit[f"q{q}"] @ unit[f"d{k}"]), 6), k) for k, _ in texts if f"d{k}" in unit)
            want |= {(q, k, -s, r + 1) for r, (s, k) in enumerate(scored[:5]) if -s >= 0.05}
    found = {tuple(r) for r in got.select("query_id", "id", "score", "rank").collect()}
    assert {x[:2] for x in found} == {x[:2] for x in want} and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(sorted(found), sorted(want), strict=True))
    first = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    second = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (2, 13, 1)], "query_id long, id long, rank int")
    merged = {tuple(r) for r in R.hybrid_merge(first, second, 2).select("query_id", "id", "source", "rank").collect()}
    assert merged == {(1, 10, "fulltext", 1), (1, 11, "both", 2), (2, 13, "semantic", 1)}

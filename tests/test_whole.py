"""Queries that once asked with a part of a table, against brute force over all of it."""

import random
from collections import deque

import pytest

from kgspark import registry
from kgspark.operators import paths as P
from kgspark.sources.graph import order_graph

SF_DIR = "/root/testdata/sf0.001"


def neighbours(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


def brandes(near):
    total = dict.fromkeys(near, 0.0)
    for s in near:
        far, ways, order, at = {s: 0}, {s: 1}, [], deque([s])
        while at:
            x = at.popleft()
            order.append(x)
            for y in near[x]:
                if y not in far:
                    far[y], ways[y] = far[x] + 1, 0
                    at.append(y)
                if far[y] == far[x] + 1:
                    ways[y] += ways[x]
        depend = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in near[y]:
                if far[x] == far[y] - 1:
                    depend[x] += ways[x] / ways[y] * (1 + depend[y])
            if y != s:
                total[y] += depend[y] / 2
    return total


@pytest.mark.parametrize("held", [P.HELD, 0])
def test_betweenness_held_and_in_rounds(spark, monkeypatch, held):
    """Two components, one of them a long path; a hub; parallel relations and a loop."""
    monkeypatch.setattr(P, "HELD", held)
    rng = random.Random(21)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)] + [("hub", f"n{k}") for k in range(0, 60, 5)] + [(f"c{k}", f"c{k + 1}") for k in range(6)] + [("n1", "n1")]
    want = brandes(neighbours(pairs))
    got = {r["entity_id"]: r["betweenness"] for r in P.betweenness(spark.createDataFrame(pairs + pairs[:9], "src string, dst string")).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_betweenness_asks_from_all_nodes(spark):
    want = brandes(neighbours([tuple(r) for r in order_graph(spark, SF_DIR).relations.select("src", "dst").collect()]))
    got = {r["entity_id"]: r["betweenness"] for r in registry.queries()["betweenness"](spark, SF_DIR).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def least_path(near, a, b):
    far, at = {a: 0}, [a]
    while at:
        at = [y for y in {z for x in at for z in near.get(x, ())} if y not in far and not far.update({y: far[x] + 1 for x in at if y in near[x]})]
    if b not in far or a == b:
        return None
    path = [b]
    while path[0] != a:
        path.insert(0, min(x for x in near[path[0]] if far.get(x, -9) == far[path[0]] - 1))
    return path


@pytest.mark.parametrize("name", ["shortest_paths", "paths_across_projects"])
def test_paths_are_asked_from_every_part(spark, name):
    g = order_graph(spark, SF_DIR)
    near = neighbours([tuple(r) for r in g.relations.select("src", "dst").collect()])
    keys = sorted(int(r["entity_id"][1:]) for r in g.entities.select("entity_id").collect())
    paths = {(f"e{k}", f"e{k + 1}"): path for k in keys if (path := least_path(near, f"e{k}", f"e{k + 1}")) and len(path) <= 9}
    got = registry.queries()[name](spark, SF_DIR).collect()
    assert len(got) == len(paths) > 150
    if name == "shortest_paths":
        assert {(r["a"], r["b"]): r["path"] for r in got} == {pair: ">".join(path) for pair, path in paths.items()}
    else:
        of = {}
        for r in g.mentions.select("entity_id", "project_id").collect():
            of.setdefault(r["entity_id"], set()).add(r["project_id"])
        assert {(r["a"], r["b"]): (r["hops"], r["projects"]) for r in got} == {pair: (len(path) - 1, len(set().union(*(of[n] for n in path)))) for pair, path in paths.items()}


def test_long_paths_in_batches_and_parts(spark, monkeypatch):
    """Paths of five to nine steps, pairs in several batches whose lists meet in several parts; levels are deleted."""
    from kgspark.operators import traversal as T

    monkeypatch.setattr(T, "PAIRS", 5)
    monkeypatch.setattr(T, "MET", 40)
    rng = random.Random(4)
    edges = [(f"c{k}", f"c{k + 1}") for k in range(12)] + [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)] + [("n1", "c3"), ("n2", "c4")]
    near = neighbours(edges)
    pairs = [("c0", f"c{k}") for k in (5, 8, 9)] + [(f"n{k}", f"n{(7 * k + 3) % 40}") for k in range(20)] + [("c9", "n5")]
    got = {(r["a"], r["b"]): r["path"] for r in T.shortest_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "a string, b string"), 8).collect()}
    assert got == {p: path for p in pairs if (path := least_path(near, *p)) and len(path) <= 9}
    assert len(got["c0", "c8"]) == 9 and ("c0", "c9") not in got

"""Suggested links of many small projects."""

import itertools
import random

from kgspark.operators import joins as J
from kgspark.sources.graph import order_graph


def test_small_projects_are_listed_once(spark):
    """Projects of few pairs need one round, also where related pairs are among the k best; a large one still has rounds of its own."""
    rng = random.Random(21)
    people = {f"p{k}": rng.sample(range(60), rng.randint(1, 7)) for k in range(80)} | {"large": list(range(60)), "none": []}
    score = {e: float(rng.randint(0, 9)) for e in range(60)}
    rel = [tuple(rng.sample(range(60), 2)) for _ in range(300)] + [(4, 4)]
    related = {tuple(sorted((f"e{a}", f"e{b}"))) for a, b in rel}
    g = order_graph(spark, "/root/testdata/sf0.001").with_tables(
        mentions=spark.createDataFrame([(f"e{e}", p, "r") for p, who in people.items() for e in who for _ in range(2)], "entity_id string, project_id string, role string"),
        relations=spark.createDataFrame([(f"e{a}", f"e{b}") for a, b in rel], "src string, dst string"), projects=spark.createDataFrame([(p,) for p in people] * 2, "project_id string"),
    )
    scores = spark.createDataFrame([(f"e{e}", s) for e, s in score.items()], "entity_id string, score double")
    want, pairs_of = {}, {}
    for p, who in people.items():
        all_pairs = [(-(score[a] + score[b]), *sorted((f"e{a}", f"e{b}"))) for a, b in itertools.combinations([e for e in who if score[e] > 1], 2)]
        pairs_of[p] = len(all_pairs)
        want[p] = {(p, a, b, -s, k + 1) for k, (s, a, b) in enumerate(sorted(x for x in all_pairs if x[1:] not in related)[:4])}
    for projects in (g.projects.filter("project_id <> 'large'"), g.projects):
        listed = []
        found = J.suggest_links(g, scores, projects, 1.0, 4, listed)
        names = {r["project_id"] for r in projects.collect()}
        assert {(r["project_id"], r["a"], r["b"], r["score"], r["rank"]) for r in found.collect()} == set().union(*(want[p] for p in names))
        assert listed[0] == sum(n for p, n in pairs_of.items() if p != "large") and (len(listed) > 1) == ("large" in names) and sum(listed[1:]) < pairs_of["large"]

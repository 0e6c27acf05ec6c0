"""Bundles of a collection: export, files, the one-document dialect, import, verification, vectors embedded again."""

import json
import os

import pytest

from kgspark.functions.text import hashed_vectors
from kgspark.operators import portable as P
from kgspark.sources import portable as S
from kgspark.sources.graph import Graph

SCHEMAS = {
    "entities": "entity_id string, name string, category string, definition string, aliases array<string>",
    "projects": "project_id string, name string, summary string, domain string, subdomain string, base_tags array<string>, created_at date",
    "project_collections": "project_id string, collection string",
    "project_directories": "project_id string, directory string",
    "mentions": "entity_id string, project_id string, role string",
    "relations": "rel_id string, src string, dst string, rel_type string, causal string, magnitude string, evidence_strength string, year int, project_id string",
    "chains": "chain_id string, project_id string, name string, link_count long",
    "chain_links": "chain_id string, order_index int, src string, dst string",
    "phases": "project_id string, phase_index int, period string",
}


def make(spark, **rows):
    return Graph(**{t: spark.createDataFrame(rows.get(t, []), s) for t, s in SCHEMAS.items()})


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def relation(rel_id, src, dst, project, kind="causes"):
    return (rel_id, src, dst, kind, "", "significant", "established", 1990, project)


@pytest.fixture(scope="module")
def source(spark):
    return make(
        spark,
        entities=[("a", "Ann", "Person", "def a", ["Anna"]), ("b", "Bob", "Person", None, None), ("c", "Cy", "Place", "def c", []), ("a2", "Ann", "Other", "later", ["Annie"]), ("n", None, "Place", "no name", []), ("far", "Far", "Place", "", [])],
        projects=[("p1", "One", "s" * 301, "d", None, ["t"], None), ("p2", "Two", None, "d", "e", None, None), ("p3", "Three", "x", None, None, None, None)],
        project_collections=[("p1", "Col"), ("p2", "COL"), ("p3", "else")],
        project_directories=[("p1", "dir")],
        mentions=[("a", "p1", "hero"), ("b", "p1", None), ("a", "p2", "x"), ("a2", "p2", "w"), ("c", "p2", "y"), ("n", "p1", "z"), ("far", "p3", "q"), ("b", "p3", "q")],
        relations=[relation("r1", "a", "b", "p1"), relation("r2", "a", "c", None), relation("r3", "b", "c", None), relation("r4", "b", "far", "p3"), relation("r5", "a", "c", "p1"), relation("r6", "a", "far", "p1"), relation("r7", "n", "a", "p1")],
        chains=[("k1", "p1", "way", 2), ("k3", "p3", "other", 1)],
        chain_links=[("k1", 0, "a", "b"), ("k1", 1, "b", "far"), ("k3", 0, "b", "far")],
        phases=[("p1", 0, "1990"), ("p3", 0, "1991")],
    )


@pytest.fixture(scope="module")
def bundle(spark, source):
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("a2", [9.0, 9.0]), ("b", None), ("far", [5.0, 5.0])], "entity_id string, embedding array<float>")
    of = spark.createDataFrame([("p1", [0.5, 0.5]), ("p3", [1.0, 1.0])], "project_id string, embedding array<double>")
    similar = spark.createDataFrame([("a", "b", 0.12345), ("b", "a", 0.2), ("a", "far", 0.9), ("a", "a2", 0.9)], "a string, b string, similarity double")
    return P.export_collection(source, "col", vectors, of, similar, spark.createDataFrame([("p2",), ("p3",)], "project_id string"))


def test_export_sections(bundle):
    assert rows(bundle.projects, "project") == [("p1",), ("p2",)]
    assert rows(bundle.entities) == [("Ann", "Person", "def a", ["Anna", "Annie"]), ("Bob", "Person", None, []), ("Cy", "Place", "def c", [])]
    assert rows(bundle.mentions) == [("Ann", "p1", "hero"), ("Ann", "p2", "w"), ("Bob", "p1", None), ("Cy", "p2", "y")]
    # r3 has no project that mentions both ends, r5's own does not but p2 does, r6 ends outside, r7 has an end without name
    assert rows(bundle.relations, "rel_id", "project", "source", "target") == [("r1", "p1", "Ann", "Bob"), ("r2", None, "Ann", "Cy"), ("r5", "p1", "Ann", "Cy")]
    assert rows(bundle.chain_links) == [("k1", 0, "Ann", "Bob"), ("k1", 1, "Bob", "Far")]
    assert rows(bundle.phases) == [("p1", 0, "1990")] and rows(bundle.similar) == [("Ann", "Bob", 0.2)]
    assert rows(bundle.vectors) == [("Ann", "entity", [1.0, 2.0]), ("p1", "project", [0.5, 0.5])]
    assert rows(bundle.missing_sources) == [("p2",)]
    assert rows(P.bundle_bridges(bundle)) == [("Ann", "Person", 2, "silver")]
    assert dict(rows(P.bundle_stats(bundle)))["bridges"] == 1
    assert rows(P.project_lines(bundle), "project", "subdomain", "summary") == [("p1", "", "s" * 300 + "..."), ("p2", "e", "")]


def test_export_of_an_unknown_collection_is_empty(spark, source):
    none = P.export_collection(source, "nowhere")
    assert {n for _, n in rows(P.bundle_stats(none))} == {0}


def test_files_round_trip_and_damage(spark, bundle, tmp_path):
    folder = str(tmp_path / "whole")
    manifest = S.write_export(bundle, folder, "Col")
    assert {r["collection"] for r in manifest.collect()} == {"Col"}
    back, report = S.read_export(spark, folder)
    assert all(r["ok"] for r in report.collect())
    for name in S.SECTIONS:
        assert rows(getattr(back, name)) == rows(getattr(bundle, name)), name
    bare = str(tmp_path / "bare")
    S.write_export(bundle, bare, "Col", include_embeddings=False)
    assert S.read_export(spark, bare)[0].vectors.count() == 0
    part = next(f for f in os.listdir(f"{bare}/mentions") if f.endswith(".json") and os.path.getsize(f"{bare}/mentions/{f}"))
    text = open(f"{bare}/mentions/{part}", encoding="utf-8").read()
    os.remove(f"{bare}/mentions/.{part}.crc")
    open(f"{bare}/mentions/{part}", "w", encoding="utf-8").write(text.replace("Ann", "Amy").replace("Bob", "Rob").replace("Cy", "Si"))
    assert [r["section"] for r in S.read_export(spark, bare)[1].collect() if not r["ok"]] == ["mentions"]
    (tmp_path / "wrong" / "manifest").mkdir(parents=True)
    (tmp_path / "wrong" / "manifest" / "m.json").write_text(json.dumps({"section": "mentions", "format": "other/9"}))
    with pytest.raises(ValueError):
        S.read_export(spark, str(tmp_path / "wrong"))


def test_checksum_counts_repeats_not_order(spark):
    digest = lambda values: S.content_sha256(spark.createDataFrame([(v,) for v in values], "v string")).collect()[0]["sha256"]
    assert digest(["a", "b", None]) == digest([None, "b", "a"])
    assert len({digest(v) for v in (["a"], ["a", "a"], ["a", None], [], ["b"])}) == 5


def test_one_document_dialect(spark, tmp_path):
    graph = {
        "projects": [
            {"name": "One", "uniqueId": "one", "projectId": "id1", "domain": "d", "summary": "s", "tags": ["t"], "html_file": "projects/one/source.html", "temporal_phases": [{"index": 1, "label": "l", "period": "1990"}]},
            {"name": "Two", "projectId": "id2"},
        ],
        "entities": [{"name": "Ann", "category": "Person", "definition": "d", "role": "hero", "aliases": ["A"], "projects": ["One", "Two", "Gone"]}],
        "relationships": [{"source": "Ann", "target": "Bob", "relType": "knows", "year": "1990", "projectId": "id2"}, {"source": "Ann", "target": "Bob", "relType": "knows", "year": "long ago"}],
        "causal_chains": [{"name": "c", "project": "Two", "projectUniqueId": "unknown", "links": [{"source": "Ann", "target": "Bob", "order": 3}, {"source": "Bob", "target": "Cy"}]}],
        "similar_pairs": [{"entity1": "Ann", "entity2": "Bob", "score": 0.5}],
    }
    (tmp_path / "manifest.json").write_text(json.dumps({"format": "f/1"}))
    (tmp_path / "graph.json").write_text(json.dumps(graph, indent=2))
    assert S.read_json_export(spark, str(tmp_path), "f/1").vectors.count() == 0
    (tmp_path / "embeddings.json").write_text(json.dumps({"embeddings": [{"name": "Ann", "type": "entity", "embedding": [1, 2.5]}, {"name": "Two", "type": "project", "embedding": [3.0]}]}, indent=2))
    b = S.read_json_export(spark, str(tmp_path), "f/1")
    assert rows(b.projects, "project", "name") == [("id2", "Two"), ("one", "One")]
    assert rows(b.mentions) == [("Ann", "id2", "hero"), ("Ann", "one", "hero")]
    assert rows(b.relations, "rel_id", "project", "rel_type", "year") == [("r0", "id2", "knows", 1990), ("r1", None, "knows", None)]
    assert rows(b.chains) == [("c0", "id2", "c")] and rows(b.chain_links) == [("c0", 1, "Bob", "Cy"), ("c0", 3, "Ann", "Bob")]
    assert rows(b.phases) == [("one", 1, "1990")] and rows(b.similar) == [("Ann", "Bob", 0.5)] and rows(b.missing_sources) == [("id2",)]
    assert rows(b.vectors) == [("Ann", "entity", [1.0, 2.5]), ("id2", "project", [3.0])]
    with pytest.raises(ValueError):
        S.read_json_export(spark, str(tmp_path), "g/1")


@pytest.fixture(scope="module")
def target(spark):
    """Knows Ann by an alias of Ann's, Bob as an alias, has project Two under another id, and nothing else of the bundle."""
    return make(
        spark,
        entities=[("e1", "Annie", "", " ", ["X"]), ("e2", "Robert", "Human", "mine", ["Bob"]), ("e3", "Zed", "Place", None, None)],
        projects=[("old", "Two", "kept", None, None, None, None)],
        mentions=[("e3", "old", "r")],
        relations=[relation("q", "e3", "e3", "old")],
    )


def test_import(spark, bundle, target):
    have = spark.createDataFrame([("e2", [7.0, 7.0]), ("e3", [0.0, 0.0])], "entity_id string, embedding array<double>")
    done = P.import_bundle(bundle, target, "dir", "new", have, dim=2)
    assert rows(done.skipped) == [("p2",)]
    names = {n: (i, new, stub) for n, i, new, stub in rows(done.names, "name", "entity_id", "is_new", "stub")}
    far, cy = names["Far"][0], names["Cy"][0]
    assert names == {"Ann": ("e1", False, False), "Bob": ("e2", False, False), "Far": (far, True, True), "Cy": (cy, True, False)}
    g = done.graph
    entities = {r["entity_id"]: r for r in g.entities.collect()}
    assert (entities["e1"]["name"], entities["e1"]["category"], entities["e1"]["definition"]) == ("Annie", "Person", "def a")
    assert sorted(entities["e1"]["aliases"]) == ["Ann", "Anna", "X"]
    assert tuple(entities["e2"])[1:] == ("Robert", "Human", "mine", ["Bob"]) and entities["e3"]["aliases"] is None
    assert entities[far]["category"] == "Other" and entities[cy]["definition"] == "def c" and len(entities) == 5
    assert rows(g.mentions) == sorted([("e1", "p1", "hero"), ("e2", "p1", None), (far, "p1", "referenced"), (cy, "p1", "referenced"), ("e3", "old", "r")], key=str)
    # the relation without project comes along, as the imported project uses both its ends
    assert rows(g.relations, "src", "dst", "project_id") == sorted([("e1", "e2", "p1"), ("e1", cy, None), ("e1", cy, "p1"), ("e3", "e3", "old")], key=str)
    assert done.dropped.count() == 0
    assert rows(g.chains, "project_id", "name", "link_count") == [("p1", "way", 2)]
    assert rows(g.chain_links, "order_index", "src", "dst") == [(0, "e1", "e2"), (1, "e2", far)]
    assert rows(g.phases) == [("p1", 0, "1990")] and rows(g.project_collections) == [("p1", "new")] and rows(g.project_directories) == [("p1", "dir")]
    vectors = {r["entity_id"]: r["embedding"] for r in done.entity_vectors.collect()}
    # the graph's own vector stays, the bundle's comes, the others are made; what the import does not touch is left as it is
    assert vectors["e2"] == [7.0, 7.0] and vectors["e1"] == [1.0, 2.0] and vectors["e3"] == [0.0, 0.0]
    assert set(vectors) == {"e1", "e2", "e3", far, cy} and all(any(vectors[e]) for e in (far, cy))
    assert rows(done.project_vectors) == [("p1", [0.5, 0.5])]
    checked = {r["section"]: (r["expected"], r["found"], r["complete"]) for r in P.verify_bundle(bundle, g).collect()}
    # project p2 was skipped: its mentions of Ann and Cy are not under its id
    assert checked == {"projects": (2, 2, True), "entities": (3, 3, True), "mentions": (4, 2, False), "relations": (3, 3, True), "chain_links": (2, 2, True), "phases": (1, 1, True)}


def test_import_twice_changes_nothing(spark, bundle, target):
    once = P.import_bundle(bundle, target, "dir", "new", dim=2).graph
    again = P.import_bundle(bundle, once, "dir", "new", dim=2)
    assert rows(again.skipped) == [("p1",), ("p2",)]
    for table in SCHEMAS:
        assert rows(getattr(again.graph, table)) == rows(getattr(once, table)), table


def test_import_into_nothing_brings_all(spark, bundle):
    done = P.import_bundle(bundle, make(spark), "dir", "new", dim=2)
    assert all(r["complete"] for r in P.verify_bundle(bundle, done.graph).collect())
    assert dict(rows(P.label_counts(done.graph))) == {"Entity": 4, "Project": 2, "Collection": 1, "Directory": 1, "CausalChain": 1, "TemporalEvent": 1}
    assert rows(P.top_bridges(done.graph), "name", "projects") == [("Ann", 2), ("Cy", 2)]
    assert {tuple(r)[1:] for r in P.verify_bundle(bundle, make(spark)).collect()} >= {(2, 0, False), (3, 0, False), (4, 0, False)}


def test_loose_relations_without_known_ends_are_dropped(spark, bundle):
    loose = spark.createDataFrame([("x", None, "Ann", "Nobody", "t", "", "", "", 1), ("y", "p1", None, "Ann", "t", "", "", "", 1)], bundle.relations.schema)
    changed = S.Bundle(**{**{n: getattr(bundle, n) for n in S.SECTIONS}, "relations": loose})
    done = P.import_bundle(changed, make(spark), "dir", "new", dim=2)
    assert rows(done.dropped) == [("x",), ("y",)] and done.graph.relations.count() == 0


def test_repair_embeddings(spark):
    texts = [("a", "red green"), ("b", "red blue"), ("c", "green green"), ("d", "?"), ("e", None), ("f", "red"), (None, "x"), ("f", "red")]
    rows_in = spark.createDataFrame(texts, "id string, text string")
    stored = [("a", [1.0, 2.0, 3.0, 4.0]), ("b", [0.0] * 4), ("c", [1.0]), ("f", [1.0, None, 1.0, 1.0]), ("g", [float("nan")] * 4), ("h", [1.0] * 4), ("a", [0.0] * 4), (None, [1.0] * 4)]
    vectors, without = P.repair_embeddings(rows_in, spark.createDataFrame(stored, "id string, embedding array<double>"), "id", 4)
    got = {r["id"]: (r["refilled"], r["embedding"]) for r in vectors.collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": False, "h": False, "b": True, "c": True, "f": True}
    assert got["a"][1] == [1.0, 2.0, 3.0, 4.0] and rows(without) == [("d",), ("e",), ("g",)]
    plain = spark.createDataFrame([("a", "red green"), ("b", "red blue"), ("c", "green green"), ("d", "?"), ("e", ""), ("f", "red")], "id string, text string")
    whole = {r["id"]: r["embedding"] for r in hashed_vectors(plain, 4, "id").collect()}
    assert all(got[i][1] == pytest.approx(whole[i]) for i in "bcf")


def test_titles_of_parts_and_fallback_where_few(spark):
    from kgspark.functions import text as N

    docs = spark.createDataFrame([(1, "One", "aa\n\nbb"), (2, None, "c"), (3, "Three", None)], "doc_id long, title string, text string")
    parts = N.chunks(docs, 3)
    assert rows(N.chunk_titles(parts, docs)) == [(1, 1, "One - Part 1"), (1, 2, "One - Part 2"), (2, 1, "")]
    texts = spark.createDataFrame([(1, "harbour harbour bridge"), (2, "harbour bridge"), (3, "bridge")], "doc_id long, text string")
    named = spark.createDataFrame([(1, "A"), (1, "B"), (1, "B"), (2, "A"), (2, "A")], "doc_id long, name string")
    got = N.fallback_where_few(texts, named, 2)
    assert rows(got, "doc_id", "name") == [(2, "Bridge"), (2, "Harbour"), (3, "Bridge")]


def test_projects_of_an_extraction(spark):
    from kgspark.operators.exports import identify_projects

    projects = spark.createDataFrame([("p1", "One"), ("p2", "Two"), ("p3", "Twin"), ("p4", "Twin")], "project_id string, name string")
    told = [("a", "p1", "Two"), ("b", None, "Two"), ("c", "gone", "One"), ("d", None, "Twin"), ("e", None, None), ("f", "p4", "Twin")]
    got = identify_projects(spark.createDataFrame(told, "chain string, project_id string, project_name string"), projects)
    assert rows(got, "chain", "project_id") == [("a", "p1"), ("b", "p2"), ("c", "p1"), ("f", "p4")]


def test_recall_summary(spark, source):
    from kgspark.operators.search import recall, recall_summary

    questions = spark.createDataFrame([("q", "who is bob"), ("none", "zzz")], "query_id string, query string")
    said = recall_summary(source, questions, recall(source, questions))
    # Bob is the only seed; Ann, Cy and Far are one step away
    assert rows(said) == [("q", 4, "Found 4 entities across 1 hops from Bob")]


def test_chains_that_cross(spark, source):
    from kgspark.operators.research import chain_crossings, crossed_chains, year_gaps

    assert rows(chain_crossings(source)) == [("b", 2, 2), ("far", 2, 2)]
    assert rows(crossed_chains(source)) == [("k1", "p1", 2, 2), ("k3", "p3", 2, 2)]
    phases = spark.createDataFrame([("p1", 0, "1944-1971"), ("p1", 1, "about 1950"), ("p1", 2, "2008 to 2023"), ("p1", 3, "never"), ("p3", 0, "12345")], SCHEMAS["phases"])
    g = source.with_tables(phases=phases, project_collections=source.project_collections.filter("collection <> 'COL'"))
    assert rows(year_gaps(g)) == [("Col", 1971, 1990), ("Col", 1990, 2008)]

"""Training-data operators against brute force, round trips and planted cases; odd inputs for each."""

import hashlib
import itertools
import random
import re
import string
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgspark.llm import embedding_dedup, fingerprints, html_extraction, licenses, mixing, ngram_join, packing, quality, secrets, tokens
from kgspark.llm.common import n_words
from kgspark.llm.html_blocks import blocks
from kgspark.llm.shingles import _tables, shingle_sets

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and long texts, ties and repeated rows.
ODD = [
    (1, "One two three four five six seven.", "en", "a", 34),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "  \n ", "en", "b", 4),
    (5, "One two three four five six seven.", "en", "a", 34),
    (6, "word " * 20_000, "en", "b", 100_000),
    (7, "Üñî çødé " * 30 + "\n", "de", "b", 270),
    (8, "token = abcdefgh0123456789", "en", None, 26),
]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("id", "n", "size", "target", "taken", "score", "predicted", "key", "component_id", "spans", "h", "length", "_id"):
            df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD, extra=True)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [], extra=True)


# 1 fingerprints


def test_fingerprints_add_and_remove(spark):
    rows = [(1, "b one.\na two."), (2, "a two.\nb one."), (3, "b one."), (4, "a two."), (5, "other text.\na two.")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["paragraphs"] == got[2]["paragraphs"] and got[1]["clauses"] == got[2]["clauses"]
    assert got[1]["paragraphs"] != got[5]["paragraphs"]
    total = [(x + y) % (1 << fingerprints.PARAGRAPH_BITS) for x, y in zip(got[3]["paragraphs"], got[4]["paragraphs"], strict=True)]
    assert total == got[1]["paragraphs"]
    assert [x + y for x, y in zip(got[3]["clauses"], got[4]["clauses"], strict=True)] == got[1]["clauses"]


def test_fingerprint_query(spark, tmp_path, odd):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fingerprints.op1_document_fingerprints(spark, str(tmp_path)).collect()}
    texts = {r[0]: r[1] or "" for r in ODD}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        n = len(texts[i])
        edited = texts[i][: n - n // 4] + texts[ids[(k + 1) % len(ids)]][: n // 4]
        assert got[i]["n_chars"] == n
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[1]["fingerprint"] == got[5]["fingerprint"] != got[6]["fingerprint"]


def test_fingerprints_of_repeated_and_null_ids(spark, tmp_path, empty):
    """Every row has its result; equal to the SQL, which numbers the rows."""
    rows = [(1, "a one. b two."), (1, "c three.\nd four."), (1, "a one. b two."), (None, "e five, f six"), (None, None), (2, ""), (2, "g " * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, fingerprints.op1_document_fingerprints(spark, str(tmp_path)).collect()), key=str)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.execute(fingerprints.SQL).fetchall(), key=str)
    assert sorted(map(str, (r[:2] for r in got))) == sorted(str((i, len(t or ""))) for i, t in rows)
    (tmp_path / "none").mkdir()
    empty.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert fingerprints.op1_document_fingerprints(spark, str(tmp_path / "none")).count() == 0


# 2 html

PAGE = """<html><body><header class="site-header"><a href="/">Home site</a></header><div id="cookie-notice"><p>We use cookies.</p></div>
<div class="post-content"><h1>The   title</h1><p>First &amp; <b>bold</b>part.<p>Second<br>line.</p><div class="advert">Buy now</div><p>Third.</p>
<section class="comments"><p>Nice post!</p><p>I agree.</p></section></div><aside class="sidebar"><p>Related</p></aside><form><label>Name</label></form>
<script>var x = "<p>no</p>";</script><footer>&copy; 2024</footer></body></html>"""


@pytest.fixture(scope="module")
def labeller(spark):
    return html_extraction.fit(spark.read.parquet(f"{SMALL}/pages.parquet"))


def test_blocks():
    assert [b.text for b in blocks(PAGE)][2:6] == ["The title", "First & boldpart.", "Second line.", "Buy now"]
    assert blocks(None) == [] and blocks("") == [] and [b.text for b in blocks("<p>cut <b")] == ["cut"]


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<html><head><title>T</title><meta charset=x><body><p>one<p>two", ["one", "two"]),
        ("<head><title>T</title><p>one", ["one"]),
        ("<p>a <svg width='1'/> b</p><p>c</p><svg><path/></svg><p>d</p>", ["a b", "c", "d"]),
        ("<p>a <math/> b</p><p>c</p>", ["a b", "c"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", ["so x=1 holds"]),
        ("<!--><p>one</p><!-- a --!><p>two</p><!-- cut", ["one", "two"]),
        ("<p title=it's>one</p><p title='a>b' x=\"c>d\">two</p>", ["one", "two"]),
        ("<p x=\"open>one</p><p>two", ["one", "two"]),
        ("a < b <3 c </> d </3 e> f", ["a < b <3 c </> d f"]),
        ("<svg><g><title/><text>no</text></g><svg><text>no</text></svg><text>no</text></svg><p>one</p>", ["one"]),
        ("<div><svg><text>no</text><p>one</p></div><p>two</p>", ["one", "two"]),
        ("<svg><foreignObject><div>no</div></foreignObject></svg><p>one</p>", ["one"]),
        ("<div><video src=x><source src=y></div><p>one</p>", ["one"]),
        ("<ul><li><canvas><li>one</ul><p><audio>no<p>two", ["one", "two"]),
        ("<div>a<video>no</div>b", ["a", "b"]),
        ("<object><object>no</object>no</object><p>one</p><select><option>no</select>two", ["one", "two"]),
        ("<div><template></div>no</template>one</div>", ["one"]),
        ("<script>'<p>no</p>'</script ><p>one</p><textarea>no", ["one"]),
    ],
)
def test_silent_elements_end(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_html_extraction(spark, labeller):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav><a href=x>Home</a></nav>"), (1, "u", PAGE)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")), labeller).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == ["The title\n\nFirst & boldpart.\n\nSecond line.\n\nThird."] * 2
    assert [r["text"] for r in got if r["page_id"] in (2, 3, 4)] == ["", "", ""]
    none = html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string"), labeller)
    assert none.count() == 0


def test_html_extraction_of_table(spark, labeller):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages, labeller).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        want = [" ".join(b.text.split()) for b in blocks(f"<body>{inside}</body>")]
        assert got[r["page_id"]] == "\n\n".join(want)


def test_model_on_unseen_layouts(labeller):
    read = html_extraction.Reader()
    good = total = 0
    for page, wanted in html_extraction.training_pages([("Some plain text here that is long enough to be an article.", 0.0), ("Other words.", 0.9)], 60, seed=99):
        chance = html_extraction.probabilities(labeller, [[read(*b) for b in page]])[0]
        good += int(((chance >= 0.5) == np.array(wanted, bool)).sum())
        total += len(wanted)
    assert good / total > 0.97


def test_reading_takes_time_in_proportion():
    for piece in ("<a ", "<p x='", "<div>a", "</script ", "<a x=\">\"", "<!", "<svg>", "<td>a", "</b", "<li><ul>x"):
        began = time.process_time()
        blocks(piece * (1_000_000 // len(piece)))
        assert time.process_time() - began < 12, piece


def test_unknown_names_and_words(labeller):
    """Without known names, elements, words and context decide; words are of weight."""
    prose = "The council met on Tuesday to talk about the new bridge, and many people came to hear it."
    page = f"""<body><div class="zq1"><ul><li><a href=x>Home</a><li><a href=y>About us</a><li><a href=z>Contact</a></ul></div>
    <div class="kk"><h1>A long title of the article</h1>{f"<p>{prose}</p>" * 6}</div><div class="vv"><p>We use cookies to improve your experience on this site.</p><p>All rights reserved.</p></div></body>"""
    found, read = blocks(page), html_extraction.Reader()
    kept = lambda model: [c >= 0.5 for c in html_extraction.probabilities(model, [[read(b.path, b.text, b.linked) for b in found]])[0]]
    got = kept(labeller)
    assert got[4:10] == [True] * 6 and not any(got[:3]) and not any(got[10:])
    chance = lambda model: html_extraction.probabilities(model, [[read(b.path, b.text, b.linked) for b in found]])[0]
    assert np.abs(chance(labeller) - chance({**labeller, "word": labeller["word"] * 0})).max() > 0.02


def test_long_page(spark, labeller):
    page = "<article>" + "<p>one two three.</p>" * 60_000 + "</article>"
    got = html_extraction.extract(spark.createDataFrame([(1, "u", page), (2, "u", "<p>a</p>")], "page_id long, url string, html string"), labeller).collect()
    assert len(got[0]["text"].split("\n\n")) == 60_000


# 3 n-gram join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("block", [384, 3])
def test_ngram_join(spark, monkeypatch, block):
    """Whole groups, and groups in many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows, passage = [], " ".join(r.choice(words) for _ in range(60))
    for group in range(12):
        base = [r.choice(words) for _ in range(r.choice([4, 6, 9, 30, 120, 400]))]
        for _ in range(8):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                text[r.randrange(len(text))] = r.choice(words)
            if group % 3 == 0:
                text += passage.split()[: r.choice([0, 20, 60])]
            rows.append((len(rows), " ".join(text[: r.choice([len(text), len(text), max(1, len(text) - 5)])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.components(docs).collect()}
    assert got == brute_components(rows)


def test_ngram_join_with_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "frequent_cells", lambda described, total, bits: np.full((1 << bits) // 8, 255, np.uint8))
    r = random.Random(8)
    rows = []
    for _ in range(6):
        base = [f"v{r.randrange(3000)}" for _ in range(r.choice([7, 40, 150, 600]))]
        for _ in range(6):
            text = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 10])):
                text[r.randrange(len(text))] = f"v{r.randrange(3000)}"
            rows.append((len(rows), " ".join(text)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_prefixes_keep_every_link():
    r = np.random.default_rng(4)
    for frequent in (np.zeros((1 << ngram_join.LEAST_BITS) // 8, np.uint8), r.integers(0, 256, (1 << ngram_join.LEAST_BITS) // 8, np.uint8)):
        for _ in range(300):
            n = int(r.integers(4, 300))
            x = r.integers(0, 1 << 63, n, np.uint64)
            keep = int(r.integers(int(0.75 * n), n + 1))
            y = np.concatenate([x[:keep], r.integers(0, 1 << 63, int(r.integers(0, n // 5 + 1)), np.uint64)])
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                bx, ex, fx = ngram_join.signatures(x, frequent)
                by, ey, fy = ngram_join.signatures(y, frequent)
                assert len(np.intersect1d(bx, by))
                for mine, free, theirs, size in ((np.r_[bx, ex], fx, np.r_[by, ey], len(x)), (np.r_[by, ey], fy, np.r_[bx, ex], len(y))):
                    least = -(-80 * size // 100) * ngram_join.EXTRA // 100 + 1
                    assert free or len(np.intersect1d(mine, theirs)) >= least


@pytest.mark.parametrize("block", [384, 40])
def test_ngram_join_family_of_near_copies(spark, monkeypatch, block):
    """One large family whose members are not all near one another, some of them near none."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    r = random.Random(3)
    base = [f"f{k}" for k in range(150)]
    rows = []
    for k in range(260):
        text = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5, 6])):
            text[r.randrange(len(text))] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    assert got == want and len({c for _, c in want.values()}) > 3


def test_ngram_join_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (5, text + " more"), (7, "other words of seven here now"), (7, text), (None, "a b"), (None, "a b"), (9, "a B")]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect() if r["doc_id"]) == [(False, 5, 57, 5), (False, 7, 2, 7), (False, 7, 56, 5), (False, 9, 1, 9)]
    assert sorted((r["n_shingles"], r["component_id"]) for r in got.collect() if r["doc_id"] is None) == [(1, 9), (1, 9), (56, 5)]
    alone = ngram_join.components(spark.createDataFrame([(None, text), (None, text + " x")], "doc_id long, text string")).collect()
    assert [r["component_id"] for r in alone] == [None, None]


def test_shingle_sets_of_odd_texts(monkeypatch):
    r = random.Random(1)
    texts = [None, "", " ", "a", "A b", "a b c d e", "a b c d e f", " x\ny\tz  ", "\x0bq\x0c ü Ü É A", "a\x00b c d e f g"]
    texts += ["".join(r.choice("abAB \t\nü ") for _ in range(r.randrange(80))) for _ in range(800)]
    for stretch in (1 << 20, 16, 7):
        monkeypatch.setattr("kgspark.llm.shingles.STRETCH", stretch)
        _tables.cache_clear()
        got = shingle_sets(pa.array([*texts, "skipped"], pa.string()).slice(0, len(texts)), 5)
        by_set, by_hash = {}, {}
        for text, found in zip(texts, got, strict=True):
            want = shingles(text)
            assert len(found) == len(want)
            assert by_hash.setdefault(found.tobytes(), want) == want and by_set.setdefault(want, found.tobytes()) == found.tobytes()
    monkeypatch.undo()
    _tables.cache_clear()


def test_ngram_join_odd(spark, odd, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(odd).collect()}
    assert got == brute_components([(i, t) for i, t, *_ in ODD])
    assert ngram_join.components(empty).count() == 0


# 4 secrets


def brute_spans(text):
    found = []
    rules = [
        ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    for k, (kind, rx, good) in enumerate(rules):
        for m in re.finditer(rx, text, re.I | re.A if kind == "assign" else re.A):
            if good(m):
                found.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))


SECRET_TEXTS = [
    "é password: hunter22 and API_KEY='abc' Token=abcdef.ghi, token:token : abcdefg",
    "AKIA" + "A1B2" * 4 + " AKIAAKIA12 " + "ab12" * 6 + " deadbeef",
    "secret=\"" + "0f" * 20 + "\" passwd = x",
    "no secrets in here", "", None,
]


def test_secret_spans(spark, odd, empty):
    docs = spark.createDataFrame(list(enumerate(SECRET_TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.scan_rows(docs).select("doc_id", secrets.written(F.filter("spans", lambda s: s["kind"] < 3)).alias("s")).collect()}
    for k, text in enumerate(SECRET_TEXTS):
        assert got[k]["s"] == brute_spans(text or "")
    rows = secrets.scan_rows(odd.unionByName(odd.filter("doc_id = 8"))).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2, 3, 4, 5, 6, 7, 8, 8]
    assert [len(r["spans"]) for r in rows if r["doc_id"] == 8] == [1, 1]
    assert secrets.scan_rows(empty).count() == 0


def test_markov_models_find_random_strings(spark):
    r = random.Random(2)
    parts = ["user", "account", "manager", "factory", "service", "handler", "request", "config", "default", "session", "connection", "builder"]
    rows = [(k, f"call {'_'.join(r.choices(parts, k=4))} and {''.join(p.title() for p in r.choices(parts, k=4))} here") for k in range(120)]
    secret = lambda n: "".join(r.choices(string.ascii_letters + string.digits, k=n))
    rows += [(200 + k, f"token = {secret(40)} there") for k in range(60)]
    rows += [(400 + k, f"value {secret(40)} there") for k in range(10)]
    got = {x["doc_id"]: x["spans"] for x in secrets.scan_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(not got[k] for k in range(120))
    assert sum(bool(got[400 + k]) for k in range(10)) >= 9
    assert all([s["kind"] for s in got[200 + k]] == [0] for k in range(60))


def test_short_keys_in_documents(spark, tmp_path):
    """Keys of 12 to 40 characters without any assignment, in real documents that also hold assigned ones: found; clean documents stay clean; all as in SQL."""
    r = random.Random(5)
    symbols = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"]
    rows = [(x["doc_id"], x["text"] or "") for x in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    keys = {}
    for k, n in enumerate((12, 16, 18, 19, 24, 40) * 10):
        doc, text = rows[k]
        key = "".join(r.choices(symbols[k % 7 % 3], k=n))
        at = text.find(" ") + 1
        rows[k] = (doc, f"{text[:at]} {key} {text[at:]}")
        keys[doc] = (at + 1, at + 1 + n)
    rows += [(100_000 + k, f"the token = {''.join(r.choices(symbols[k % 3], k=32))} of it") for k in range(60)]
    rows += [(200_000 + k, "AN ANNOUNCEMENT OF INTERNATIONALISATION!") for k in range(2)]
    markov = secrets.KINDS.index("markov")
    found = {x["doc_id"]: [(s["start"], s["end"]) for s in x["spans"] if s["kind"] == markov] for x in secrets.scan_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k, v in found.items() if v and k not in keys] == []
    assert all(set(found[k]) <= {v} for k, v in keys.items())
    assert sum(found[k] == [v] for k, v in keys.items()) >= 0.9 * len(keys)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, secrets.op4_secret_scans(spark, str(tmp_path)).collect())) == sorted(db.execute(secrets.SQL).fetchall())


# 5 licences


def test_licenses_inherit(spark, empty):
    rows = [
        ("src/LICENSE", "Released under the MIT License."),
        ("src/a.py", "code"),
        ("src/deep/b.py", "# Licensed under the Apache License, Version 2.0.\nimport sys\nfor line in sys.stdin:\n    print(line.strip())"),
        ("src/deep/er/c.py", None),
        ("lib/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        ("lib/x/d.py", "code"),
        ("top.py", "a licence to speak"),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    own = licenses.own_licenses(files)
    got = {r["path"]: (r["license"], r["inherited_from"]) for r in licenses.inherit(files.join(own, "path", "left").withColumn("is_license_file", F.coalesce("is_license_file", F.lit(False)))).collect()}
    assert got == {
        "src/LICENSE": ("MIT", None), "src/a.py": ("MIT", "src"), "src/deep/b.py": ("Apache-2.0", None), "src/deep/er/c.py": ("MIT", "src"),
        "lib/LICENSE": ("GPL-3.0", None), "lib/x/d.py": ("GPL-3.0", "lib"), "top.py": (None, None),
    }
    assert licenses.own_licenses(empty, "doc_id").count() == 0


def test_licenses_of_whole_texts_and_wrapped_headers(spark):
    mit = next(t for name, t in licenses.TEMPLATES if name == "MIT" and len(t) > 500)
    words = mit.split()
    full = "\n".join(" ".join(words[k : k + 11]) for k in range(0, len(words), 11)).replace("conditions:", "conditions:\n\n")
    header = "# This program is free software; you can redistribute it and/or\n# modify it under the terms of the GNU General Public License as published\n# by the Free Software Foundation; either version 2 of the License.\n\ndef f():\n    return 1\n" + "x = 1\n" * 400
    rows = [("a/LICENSE", full), ("a/b/c.py", "code"), ("d/e.py", header), ("d/f.py", None), ("d/f.py", None), (None, full), ("g.py", "")]
    files = spark.createDataFrame(rows, "path string, text string")
    own = {r["path"]: (r["own_license"], r["is_license_file"]) for r in licenses.own_licenses(files).collect()}
    assert own == {"a/LICENSE": ("MIT", True), "d/e.py": ("GPL-2.0", False), None: ("MIT", True)}
    joined = files.join(licenses.own_licenses(files), "path", "left").withColumn("is_license_file", F.coalesce("is_license_file", F.lit(False)))
    got = [(r["path"], r["license"]) for r in licenses.inherit(joined).collect()]
    assert ("a/b/c.py", "MIT") in got and ("d/e.py", "GPL-2.0") in got and got.count(("d/f.py", None)) == 2 and len(got) == 7


# 6 embeddings


def test_embedding_links_in_many_blocks(spark, monkeypatch):
    """Clustered vectors, lists of many blocks, pairs near the threshold, repeated and null ids."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    r = np.random.default_rng(6)
    rows = []
    for size in (200, 60, 5, 5, 5):
        centre = r.normal(size=32)
        centre /= np.linalg.norm(centre)
        rows += [centre + r.normal(size=32) * 0.055 for _ in range(size)]
    rows += list(r.normal(size=(200, 32)))
    x = np.array(rows, np.float32)
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {a["vec_id"]: a["n_links"] for a in embedding_dedup.near_duplicates(docs).collect()}
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert all(got[k] <= near[k].sum() for k in got)
    assert sum(got.values()) >= 0.95 * near.sum() > 10_000



def test_embedding_links(spark):
    r = np.random.default_rng(1)
    rows = []
    for _ in range(40):
        centre = r.normal(size=64)
        centre /= np.linalg.norm(centre)
        for _ in range(6):
            rows.append((centre + r.normal(size=64) * r.choice([0.01, 0.04])).astype(np.float32).tolist())
    rows += [rows[0]] * 3
    values = [(k, v) for k, v in enumerate(rows)] + [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [None] * 64), (1004, [1.0])]
    got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(spark.createDataFrame(values, "vec_id long, embedding array<float>").withColumn("n", F.lit(1))).collect()}
    x = np.array(rows, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[k]["n_links"] for k in range(len(rows)))
    assert found <= near.sum() and found >= 0.9 * near.sum()
    assert all(got[k]["n_links"] <= near[k].sum() for k in range(len(rows)))
    assert got[len(rows) - 1]["component_id"] == 0 and not got[len(rows) - 1]["kept"]
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in range(1000, 1005))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_recall_near_the_threshold(spark):
    r = np.random.default_rng(3)
    rows, links = [], 0
    for _ in range(300):
        a, b = r.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = r.uniform(0.905, 0.97)
        rows += [a, c * a + np.sqrt(1 - c * c) * b]
        links += 2
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>"))
    assert got.agg(F.sum("n_links")).first()[0] >= 0.9 * links


def test_embedding_links_within_a_hot_group(spark):
    r = np.random.default_rng(4)
    centre = r.normal(size=64)
    rows = np.concatenate([r.normal(size=(6000, 64)), centre / np.linalg.norm(centre) + 0.036 * r.normal(size=(3000, 64))])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")).collect()}
    links = np.array([got[k]["n_links"] for k in range(len(rows))])
    assert (links <= near).all() and links.sum() >= 0.9 * near.sum() > 1_000_000


# 7 packing, 9 token files


def whole_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_matches_whole_texts():
    texts = ["a<|endoftext|>b c", "Don't. isn't!! 'S 'll", "é. x̸=", "İstanbul ΣΑΣ ΣΑΣ.", "x y z\x1c w\x85q", "ﬁ ﬂ½ ²³ Ⅷ", "中文 ひらがな가각 한.", "\x00 a\x00b\r\n\t c", "ß ẞ. ŉ, ǰ!", "", None, "  \n\n "]
    encoder = tokens.encoder(tokens.default_tokenizer())
    assert [x.tolist() for x in encoder.encode_all(texts)] == whole_ids(texts)


def test_tokenizers_that_join_words_are_refused():
    with pytest.raises(ValueError, match="white space"):
        tokens.WordEncoder("/opt/tokenizers/byte_bpe_50k.json")


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, odd, empty, capacity):
    rows = packing.pack_documents(odd, capacity=capacity).collect()
    want = dict(zip([r[0] for r in ODD], whole_ids([r[1] for r in ODD]), strict=True))
    bins = {}
    for r in rows:
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert crc(part) == r["ids_crc32"] and r["start"] == capacity * r["piece"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, want.values()))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack_documents(empty, capacity=capacity).count() == 0


def test_plan_is_tight():
    r = random.Random(1)
    for _ in range(30):
        counts = {r.randint(1, 100): r.randint(1, 400) for _ in range(r.randint(1, 60))}
        runs = packing.plan_bins(counts, 100)
        fill, placed = {}, {}
        for length, lo, hi, first, per, offset in runs:
            assert lo == placed.get(length, 0)
            placed[length] = hi
            for k in range(hi - lo):
                fill.setdefault(first + k // per, []).append((offset + k % per * length, length))
        assert placed == counts
        for places in fill.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 100
        least = max(-(-sum(n * c for n, c in counts.items()) // 100), sum(c for n, c in counts.items() if 2 * n > 100))
        assert len(fill) <= 1.5 * least + 1


def test_token_files(spark, odd, empty, tmp_path):
    docs = odd.unionByName(odd.filter("doc_id = 1"))
    tokens.write_token_files(docs, f"file://{tmp_path}/t", shards=3)
    rows = sorted(tokens.read_token_files(spark, f"file://{tmp_path}/t", with_ids=True).collect(), key=lambda r: r["start"])
    order = sorted([*ODD, ODD[0]], key=lambda r: r[0])
    want = whole_ids([r[1] for r in order])
    assert [r["doc_id"] for r in rows] == [r[0] for r in order]
    assert [r["ids"] for r in rows] == want
    assert [r["start"] for r in rows] == [sum(map(len, want[:k])) for k in range(len(want))]
    assert [r["ids_crc32"] for r in rows] == [crc(x) for x in want]
    tokens.write_token_files(empty, f"file://{tmp_path}/none", shards=2)
    assert tokens.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


# 8 quality


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter(quality.held_out(F.col("doc_id")))
    rows = scored.select("score", "predicted", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    rows = quality.score(odd.drop("score", "predicted"), model, keep=True).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    blank = quality.fit(odd, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, blank).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


# 10 mixing


def brute_targets(sizes, weights, most=3.0):
    left, target = float(sum(sizes)), [0.0] * len(sizes)
    free = [k for k in range(len(sizes))]
    while free:
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = [k for k in free if share[k] > most * sizes[k]]
        if not over:
            for k in free:
                target[k] = share[k]
            break
        for k in over:
            target[k] = most * sizes[k]
            left -= target[k]
            free.remove(k)
    return target


def test_mixing(spark, odd, empty):
    r = random.Random(6)
    rows = [(k, "w " * r.randint(0, 60), "en", r.choice(["a", "b", "c", "d", None]) if k else "tiny", 0) for k in range(400)]
    docs = frame(spark, rows)
    mixed = mixing.mix_sources(docs, n_words(F.col("text")), mixing.quality_weight(F.col("text"))).collect()
    again = mixing.mix_sources(docs.repartition(3), n_words(F.col("text")), mixing.quality_weight(F.col("text"))).collect()
    key = lambda x: (x["doc_id"], x["taken"], x["target"])
    assert sorted(map(key, mixed)) == sorted(map(key, again))
    names = sorted({x[3] for x in rows if x[3] is not None}) + [None]
    source = {x[0]: x[3] for x in rows}
    sizes = [sum(len(x[1].split()) for x in rows if x[3] == s) for s in names]
    targets = brute_targets(sizes, [1 + k % 3 for k in range(len(names))])
    for s, size, target in zip(names, sizes, targets, strict=True):
        own = [x for x in mixed if source[x["doc_id"]] == s]
        assert all(x["source_size"] == size and x["target"] == pytest.approx(target) for x in own)
        assert abs(sum(x["taken"] for x in own) - target) <= 60
        assert all(x["taken"] <= 3 * x["size"] for x in own)
    assert mixing.mix_sources(odd, n_words(F.col("text")), mixing.quality_weight(F.col("text"))).count() == len(ODD)
    assert mixing.mix_sources(empty, n_words(F.col("text")), mixing.quality_weight(F.col("text"))).count() == 0


# pipeline


def test_pipeline_against_its_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(docs, labels)
    bad = {r["doc_id"] for r in quality.score(docs, model).filter("predicted = 0").collect()}
    left = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] not in bad}
    parts = brute_components([(i, r["text"]) for i, r in left.items()])
    left = {i: r for i, r in left.items() if parts[i][1] == i}
    left = {i: r for i, r in left.items() if not brute_spans(r["text"])}
    total = {}
    for r in left.values():
        total[r["source"]] = total.get(r["source"], 0) + len(r["text"].split())
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in packed} <= set(left)
    words = {}
    for r in packed:
        if r["piece"] == 0:
            source = left[r["doc_id"]]["source"]
            words[source] = words.get(source, 0) + len(left[r["doc_id"]]["text"].split())
    names = sorted(total)
    for s, target in zip(names, brute_targets([total[s] for s in names], [1 + k % 3 for k in range(len(names))]), strict=True):
        assert abs(words.get(s, 0) - target) <= max(len(r["text"].split()) for r in left.values() if r["source"] == s)


STAGE_ROWS = [
    (None, "password = hunter2222 in a text of the words of one", None, None, None),
    (None, "one clean text of some words that stays here alone", "en", "a", None),
    (None, "one clean text of some words that stays here alone", "en", "a", None),
    (3, "one clean text of some words that stays here alone", "en", "b", None),
    (3, "another text of the same id as the one above", "en", "b", None),
    (4, "a text that is twice in the table as it is", "en", "b", 7),
    (4, "a text that is twice in the table as it is", "en", "b", 7),
    (5, None, None, None, None),
    (5, None, None, None, None),
    (6, "", "en", "a", 0),
    (7, "long " * 30_000, "en", "a", 0),
    (8, "token = abcdefgh0123456789", "en", "b", 0),
    (8, "the same id as a text with a secret in it", "en", "b", 0),
]


def labelled_folder(tmp_path, spark):
    path = str(tmp_path / "tables")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def as_rows(df):
    return sorted(df.collect(), key=str)


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    folder = labelled_folder(tmp_path, spark)
    docs = frame(spark, STAGE_ROWS, extra=True).withColumn("_row", F.lit(1)).withColumn("copies", F.lit(2))
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        assert {r["size"] for r in got.collect()} <= {"x"}
        assert stage(spark, docs.limit(0), folder).columns == docs.columns and not stage(spark, docs.limit(0), folder).count()
    one = Counter((r["doc_id"], r["text"]) for r in p.keep_one_of_each(spark, docs, folder).collect())
    assert one == Counter([(i, t) for i, t, *_ in [STAGE_ROWS[0], *STAGE_ROWS[3:6], *STAGE_ROWS[7:]]])
    clean = Counter((r["doc_id"], r["text"]) for r in p.drop_secrets(spark, docs, folder).collect())
    assert clean == Counter([(i, t) for i, t, *_ in STAGE_ROWS if "= " not in (t or "")])
    scores = {r["text"]: r["predicted"] for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")), id_col="text").collect()}
    good = Counter((r["doc_id"], r["text"]) for r in p.keep_good(spark, docs, folder).collect())
    assert good == Counter([(i, t) for i, t, *_ in STAGE_ROWS if scores[t]])
    mixed = Counter((r["doc_id"], r["text"]) for r in p.mix(spark, docs, folder).collect())
    want = mixing.mix_sources(docs, n_words(F.col("text")), mixing.quality_weight(F.col("text")), keep=("text",)).collect()
    assert mixed == Counter({(r["doc_id"], r["text"]): 0 for r in want}) + Counter([(r["doc_id"], r["text"]) for r in want for _ in range(r["copies"])])
    packed = p.pack(spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(i for i, *_ in STAGE_ROWS)
    assert p.pack(spark, docs.limit(0), folder).count() == 0

"""Ranked search, URL filter and conversation trie against SQL and brute force; odd inputs and hot groups for each."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import conversation_trie, embedding_dedup, lexical_search, licenses, url_filter
from kgspark.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def as_rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("name, table", [("op11_ranked_lexical_search", "documents"), ("op12_url_filters", "pages"), ("op13_conversation_prefix_trie", "conversations")])
def test_query_equals_sql(spark, name, table):
    con = duckdb.connect()
    for t in {table, "benchmark"}:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    answer = con.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(names) == sorted(got.columns)
    assert as_rows(got) == sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in answer.fetchall()), key=str)


# 11 ranked lexical search


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranked(docs, items, k):
    """Every score of every document, without any bound."""
    counts = [(key, Counter(words(text)), len(words(text))) for key, text in docs]
    n_docs, length = sum(n > 0 for _, _, n in counts), max(1, sum(n for _, _, n in counts))
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for key, c, n in counts:
            m = 25 + 75 * n * n_docs // length
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(words(text)).items() if t in c)
            if s > 0:
                found.append((-s, key is None, key or 0, key, s))
        out += [(item, r, key, s) for r, (*_, key, s) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))) for k in range(800)]
    docs += [(k, docs[7][1]) for k in range(800, 1400)]  # a large group of copies: ties by id
    items = [(k, " ".join(rng.choices(vocabulary, weights, k=12))) for k in range(60)] + [(99, docs[7][1])]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == ranked(docs, items, 10)


def test_search_on_odd_rows(spark):
    docs = [(1, "Alpha beta ALPHA"), (1, "alpha gamma"), (None, "beta, beta"), (4, None), (5, ""), (6, " \n.;"), (7, "Äpfel äpfel ß"), (8, "Alpha beta ALPHA"), (8, "Alpha beta ALPHA"), (9, "x " * 50_000 + "beta")]
    items = [(1, "beta alpha beta"), (1, "beta alpha beta"), (2, None), (3, ""), (None, "gamma"), (5, "Äpfel"), (6, "nowhere"), (7, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for name in ("score", "rank", "n", "terms", "item_id", "term", "df"):
        d = d.withColumn(name, F.lit("?"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("?")).withColumn("doc_id", F.lit("?"))
    for blocks in (2000, 2):
        got = lexical_search.search(d, i, 3, blocks)
        assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == ranked(docs, items, 3)
    assert lexical_search.search(d.limit(0), i).count() == 0
    assert lexical_search.search(d, i.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_accumulators_stop_and_stay_exact():
    """Common terms open no accumulators once the rare ones have decided; scores are those of whole sums."""
    rng = np.random.default_rng(3)
    n = 5000
    terms, docs = [], []
    for t, share in enumerate((0.01, 0.02, 0.5, 0.9)):
        have = np.flatnonzero(rng.random(n) < share)
        terms.append(np.full(len(have), t))
        docs.append(have)
    terms, docs = np.concatenate(terms), np.concatenate(docs)
    adds = rng.integers(800, 1000, len(docs))
    lists = lexical_search.Lists(np.arange(n), np.zeros(n, bool), terms, docs, adds)
    query = [(0, 900), (1, 800), (2, 30), (3, 10)]
    whole = np.zeros(n, np.int64)
    for t, w in query:
        whole[lists.get(t)[0]] += w * lists.get(t)[1]
    opened = []
    real = np.flatnonzero
    found, scores = lexical_search.best_of_chunk(query, lists, 10, 0)
    assert sorted(scores.tolist()) == sorted(whole.tolist())[-len(scores) :] and len(scores) >= 10
    assert (whole[found] == scores).all()
    assert not len(lexical_search.best_of_chunk(query, lists, 10, int(whole.max()) + 1)[0]) and not opened and real is np.flatnonzero


# 12 URL filter


def test_rules_and_parts(spark):
    cases = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://A.Example.NET/EN/1?x": ("a.example.net", "/EN/1", "net/", "block"),
        "https://net/": ("net", "/", "net/", "block"),
        "https://example.com/de/#a?b/c": ("example.com", "/de/", "example.com/de/", "block"),
        "https://m.b.org/fr/x?q=://z/": ("m.b.org", "/fr/x", "org/fr/", "allow"),
    }
    open_ = {"http://a.net": ("a.net", ""), "http://anet/": ("anet", "/"), "http://xexample.com/de/": ("xexample.com", "/de/"), "no mark/de/": ("", ""), "": ("", ""), None: ("", ""), "x://y?z/": ("y", ""), "a://b://c/d": ("b:", "//c/d")}
    rows = [(k, url) for k, url in enumerate([*cases, *open_])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    for name in ("host", "path", "rule", "verdict", "gram", "value", "score", "allow", "html"):
        df = df.withColumn(name, F.lit("?"))
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for k, url in rows:
        host, path, *rest = (cases | open_)[url]
        assert (got[k]["host"], got[k]["path"]) == (host, path)
        assert (got[k]["rule"], got[k]["verdict"]) == tuple(rest) if rest else got[k]["rule"] is None and got[k]["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_repeated_rows_and_ids_stay(spark):
    rows = [(1, "http://a.com/x")] * 3 + [(1, "http://b.com/y"), (None, None), (None, None), (2, None), (3, "http://z.net/" + "a" * 200_000), (4, "\x02\x03")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert Counter(r["page_id"] for r in got) == Counter(k for k, _ in rows)
    assert all(r["verdict"] in ("allow", "block") for r in got)


def brute_scores(urls, rules=url_filter.RULES):
    """url -> (rule verdict or None, score in millionths), by dictionaries and recursion."""

    def parts(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
        return (m[1].lower(), m[2]) if m else ("", "")

    def ruled(url):
        host, path = parts(url)
        fits = [(len(h + p), v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    k = url_filter.ORDER
    fold = {u: int(hashlib.md5(u.encode()).hexdigest()[:13], 16) % url_filter.FOLDS for u in urls}
    counts = {c: defaultdict(Counter) for c in ("allow", "block")}
    cut = lambda u: [("\x02" * k + u + "\x03")[i : i + k + 1] for i in range(len(u) + 1)]
    for u in set(urls):
        if ruled(u) and fold[u] < url_filter.FOLDS - 1:
            for g in cut(u):
                for n in range(k + 1):
                    counts[ruled(u)][g[k - n : k]][g[k]] += 1

    def chance(model, context, c):
        below = 1 / url_filter.CHARACTERS if not context else chance(model, context[1:], c)
        seen = model[context]
        if sum(seen.values()) < url_filter.LEAST_SEEN:
            return below
        return (seen[c] + len(seen) * below) / (sum(seen.values()) + len(seen))

    out = {}
    for u in set(urls):
        values = [round((math.log(chance(counts["allow"], g[:k], g[k])) - math.log(chance(counts["block"], g[:k], g[k]))) * url_filter.UNIT) for g in cut(u)]
        out[u] = (ruled(u), sum(values) // len(values), fold[u])
    return out


def test_scores_equal_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    urls = [r["url"] for r in pages.collect()]
    want = brute_scores(urls)
    calibration = [(s // url_filter.STEP, v) for v, s, fold in want.values() if v and fold == url_filter.FOLDS - 1]
    a, b = sum(v == "allow" for _, v in calibration), sum(v == "block" for _, v in calibration)
    steps = range(min(s for s, _ in calibration), max(s for s, _ in calibration) + 1) if a and b else [0]
    line = max(steps, key=lambda x: (sum(v == "block" and s < x for s, v in calibration) * a - sum(v == "allow" and s < x for s, v in calibration) * b, -abs(x), x)) * url_filter.STEP
    for r in url_filter.judge(pages).join(pages.select("page_id", "url"), "page_id").collect():
        verdict, score, _ = want[r["url"]]
        assert r["verdict"] == (verdict or ("allow" if score >= line else "block"))
        assert r["score"] is None if verdict else abs(r["score"] - (score - line) / url_filter.UNIT) < 1e-9


def test_models_tell_addresses_apart(spark):
    """Without a rule, addresses like the allowed ones are allowed and those like the blocked ones are not."""
    rng = random.Random(2)
    good, bad = ["news", "wiki", "guide", "paper", "science"], ["casino", "pills", "xxx", "bonus", "loans"]
    make = lambda host, words: f"https://{rng.choice(words)}{rng.randint(1, 99)}.{host}/{'-'.join(rng.choices(words, k=3))}/{rng.randint(1, 9999)}"
    rules = (("allow", "good.org", "/"), ("block", "bad.biz", "/"))
    rows = [make("good.org", good) for _ in range(300)] + [make("bad.biz", bad) for _ in range(300)] + [make("open.info", good) for _ in range(200)] + [make("open.info", bad) for _ in range(200)]
    rows += [rows[0]] * 700  # one address holds a third of all rows
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).collect()}
    assert len(got) == len(rows)
    right = [got[k]["verdict"] == ("allow" if k < 800 else "block") for k in range(600, 1000)]
    assert sum(right) >= 0.97 * len(right)
    assert all(got[k]["verdict"] == "allow" for k in range(1000, len(rows)))


# 13 conversation prefix trie


def trie_by_hand(rows):
    """Nodes by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - math.fmod(c, 5), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(full[c]) == len(p)).encode()).hexdigest()
    return sorted(((who[0], len(p), members[p[:-1]][0] if p else None, len(who), kids[p], leaves[p], saved[p], ends(p)) for p, who in members.items()), key=str)


def check_trie(spark, rows, shard_turns):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("depth", "key", "turns", "n_convs", "ends", "path", "parent_key"):
        df = df.withColumn(name, F.lit("?"))
    got = conversation_trie.trie_nodes(df.repartition(3), shard_turns)
    assert sorted(map(tuple, got.collect()), key=str) == trie_by_hand(rows)


@pytest.mark.parametrize("shard_turns", [100_000, 7])
def test_trie_on_odd_rows(spark, shard_turns):
    rows = [(0, 1, "user", "a"), (0, 2, "bot", "b"), (1, 1, "user", "a"), (1, 2, "bot", "ü"), (1, 3, None, None), (2, None, "user", "first"), (2, 0, "user", ""), (2, 0, "user", ""), (2, 0, "bot", "tie"), (7, 1, "", None)]
    rows += [(None, 1, "user", "nobody"), (-3, 0, "user", "a"), (-5, 0, "user", "a"), (-5, 1, "user", "b"), (12, -1, "user", "long " * 20_000), (13, 1, "1:", "x"), (14, 1, "1", ":x")]
    check_trie(spark, rows, shard_turns)


@pytest.mark.parametrize("shard_turns", [100_000, 50])
def test_trie_with_hot_turns_and_copies(spark, shard_turns):
    """A third of the conversations share a first turn, a third are one conversation, one is very deep."""
    rng = random.Random(11)
    rows = []
    for c in range(0, 600):
        kind = c % 3
        turns = ["hello"] + [f"t{rng.randint(0, 3)}" for _ in range(rng.randint(0, 5))] if kind == 0 else ["copy", "of", "one", "talk"] if kind == 1 else [f"u{rng.randint(0, 200)}" for _ in range(rng.randint(1, 6))]
        rows += [(c, k, "user" if k % 2 == 0 else "bot", text) for k, text in enumerate(turns)]
    rows += [(5000 + c, k, "user", "deep" if k < 150 else f"deep {k} {c % 2}") for c in range(4) for k in range(300)]
    check_trie(spark, rows, shard_turns)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.trie_nodes(empty).count() == 0
    assert conversation_trie.trie_nodes(spark.createDataFrame([(None, 1, "a", "b")], empty.schema)).count() == 0


def test_double_array_packs_and_walks():
    rng = random.Random(4)
    sequences = sorted([rng.randint(0, 40) for _ in range(rng.randint(0, 8))] for _ in range(2000))
    trie = conversation_trie.DoubleArray(sequences)
    slots = {}
    for one, path in zip(sequences, trie.walk(sequences), strict=True):
        for d, slot in enumerate(path, 1):
            assert slots.setdefault(slot, tuple(one[:d])) == tuple(one[:d])
    prefixes = {tuple(s[:d]) for s in sequences for d in range(1, len(s) + 1)}
    assert set(slots.values()) == prefixes and len(slots) == len(prefixes)
    assert len(trie.base) < 1.5 * len(prefixes)
    with pytest.raises((KeyError, IndexError)):
        conversation_trie.DoubleArray([[0, 1]]).walk([[1, 0]])


# 6 embeddings: ids that are null or repeated, vectors of several lengths


def test_embedding_links_of_odd_ids_and_lengths(spark):
    """Every row is a vector of its own, whatever its id; links and components equal brute force over rows."""
    rng = np.random.default_rng(21)
    rows = []
    for width, groups in ((8, 60), (3, 12), (2, 1)):
        for _ in range(groups):
            centre = rng.standard_normal(width)
            for _ in range(int(rng.integers(1, 7))):
                rows.append([None if rng.random() < 0.2 else int(rng.integers(0, 150)), (centre + 0.12 * rng.standard_normal(width)).tolist()])
    rows += [[None, rows[0][1]], [5, rows[0][1]], [7, [1.0, 0.0, 0.0, 0.0]], [7, [0.0, 1.0, 0.0, 0.0]], [7, None], [None, None], [9, []], [8, [0.0] * 8], [3, [float("nan")] * 8]]
    valid = [v is not None and len(v) > 0 and np.isfinite(v).all() and any(v) for _, v in rows]
    unit = [np.array(v) / np.linalg.norm(v) if ok else None for (_, v), ok in zip(rows, valid, strict=True)]
    near = [[j for j in range(len(rows)) if j != i and valid[i] and valid[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in range(len(rows))]
    want = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        name = min(ids) if ids else None
        want.append((key, len(near[i]), name, None if key is None else key == name))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cls", F.lit("?")).withColumn("least", F.lit("?"))
    got = embedding_dedup.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# 5 licences: spelling


def test_licenses_however_they_are_spelled(spark):
    """Capitals, blanks and line breaks change no licence; every template has a word that is looked for."""
    assert all(re.search(licenses.STATES, text) for _, text in licenses.TEMPLATES)
    grant = next(text for name, text in licenses.TEMPLATES if name == "MIT")
    spelled = [grant, grant.upper(), grant.lower(), grant.replace("Permission ", "Permission  "), grant.replace(" ", "\n", 1), re.sub(" ", " \n ", grant, count=3)]
    rows = [(k, text, f"d/{k}/x") for k, text in enumerate(spelled)] + [(99, "Nothing of the kind is said here.", "d/99/x")]
    found = {r["key"]: r["own_license"] for r in licenses.own_licenses(spark.createDataFrame(rows, "key long, text string, path string"), "key").collect()}
    assert found == dict.fromkeys(range(len(spelled)), "MIT")

"""Keywords of documents and sections against brute force."""

import math
import random
from collections import Counter

import pytest

from kgspark.functions import text as N


def brute(sections, top, features, summed):
    """Of (doc_id, section_id, text)."""
    out = set()
    for d in {s[0] for s in sections} - {None}:
        mine, counts = [s for s in sections if s[0] == d], {}
        for _, number, text in mine:
            w = [x for x in (text or "").split() if x not in N.STOP_WORDS]
            counts[number] = Counter(w + [" ".join(p) for p in zip(w, w[1:])])
        total, df = sum(counts.values(), Counter()), Counter(t for c in counts.values() for t in c)
        kept = sorted(total, key=lambda t: (-total[t], t))[:features]
        weights = {n: {t: c[t] * (math.log((1 + len(mine)) / (1 + df[t])) + 1) for t in kept if t in c} for n, c in counts.items()}
        units = {n: {t: x / math.sqrt(sum(y * y for y in ws.values())) for t, x in ws.items()} for n, ws in weights.items()}
        if summed:
            units = {None: {t: sum(u.get(t, 0) for u in units.values()) for t in kept}}
        for n, u in units.items():
            best = sorted((-round(x, 6), t) for t, x in u.items())[:top]
            out |= {(d, *(() if summed else (n,)), t, -x, k) for k, (x, t) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("at_once", [20, 500_000])
def test_keywords(spark, monkeypatch, at_once):
    monkeypatch.setattr(N, "WORDS", at_once)
    r = random.Random(11)
    words = "ab abc abd ox oxen the and tin tins zoo zoom of".split()
    rows = [(d, n, " ".join(r.choices(words, k=r.randrange(0, 12)))) for d in range(30) for n in range(r.randrange(1, 5))]
    rows += [(40, 0, None), (41, 0, "the of"), (42, 0, "zoo"), (None, 0, "zoo ox"), (43, 0, " ".join("abcdefghij"[k % 10] * 2 + "klmno"[k // 10] for k in range(50)))]
    df = spark.createDataFrame(rows, "doc_id long, section_id int, text string")
    assert {tuple(x) for x in N.section_keywords(df, 3, 12).collect()} == brute(rows, 3, 12, False)
    assert {tuple(x) for x in N.tfidf_keywords(df, 4, 12).collect()} == brute(rows, 4, 12, True)


def test_only_leading_terms_go_on(spark):
    """Terms of one weight: of each section two go on, not all 400 or so."""
    text = " ".join(a + b for a in "bcdfghklmn" for b in ("ux", "oy", "ez") * 7)
    df = spark.createDataFrame([(d, n, text) for d in range(5) for n in range(3)], "doc_id long, section_id int, text string")
    assert N.leading_terms(df, 2).count() == 5 * 3 * 2
    assert N.leading_terms(df, 2, summed=True).count() == 5 * 2

"""Rules against plain counting, exact sums of binomials, and labels."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from gridspark.llm import rules
from gridspark.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = text.split("\n")
    twice = sum(1 for i, line in enumerate(lines) if line.strip(WHITE) and line in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(inside)


def plain_failed(counts):
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def plain_places(text):
    words, chars, symbols, twice, repeats = plain_counts(text)
    lines = sum(1 for line in text.split("\n") if line.strip(WHITE))
    upper = sum("A" <= c <= "Z" for c in text)
    letters = upper + sum(len(c.encode()) for c in text if "a" <= c <= "z" or ord(c) > 127)
    shares = {"symbols": (symbols, words), "capitals": (upper, letters), "shouts": (text.count("!"), words),
              "repeats": (repeats, words), "lines": (twice, lines), "long_words": (chars, words)}
    return [next((k for k, c in enumerate(rules.LADDERS[r], 1) if Fraction(shares[r][0], max(1, shares[r][1])) > Fraction(c, 1000)), 7)
            for r in rules.RULES]


def plain_at_most(k, n, p):
    return float(sum(math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))


@pytest.mark.parametrize("n", [1, 7, 60, 400])
def test_binomial_tail_and_bound(n):
    for k in sorted({0, 1, n // 20, n // 3, n - 1, n}):
        for p in (0.01, 0.05, 0.5, 0.93):
            assert rules.at_most(k, n, p) == pytest.approx(plain_at_most(k, n, p), rel=1e-9, abs=1e-13)
        bound = rules.upper_bound(k, n, 0.01)
        assert bound == 1 if k == n else plain_at_most(k, n, bound) == pytest.approx(0.01, rel=1e-6)


def test_risk_holds_in_repeated_experiments():
    """A path whose true risk passes RISK is certified beyond it in no more than LEVEL of the draws."""
    rng = np.random.default_rng(3)
    places = np.array([[s] + [7] * 5 for s in range(1, 8)])
    path = [np.array([s, 0, 0, 0, 0, 0]) for s in range(1, 7)]
    risk = np.array([0.01, 0.01, 0.02, 0.02, 0.03, 0.05])
    exceeded = chosen = 0
    for _ in range(2000):
        good = rng.multinomial(800, [*risk, 1 - risk.sum()])
        cutoffs, _ = rules.certified(path, places, good, rules.LEVEL)
        chosen += cutoffs[0] >= 2
        exceeded += risk[:cutoffs[0]].sum() > rules.RISK
    assert exceeded <= 2000 * rules.LEVEL and chosen > 1800


def plain_judge(docs, labels):
    """kept of each row of docs (doc_id, text, lang) by the same rules with loops over single texts."""
    good = defaultdict(int)
    known = {}
    for d, q in labels:
        if d is not None and q is not None:
            known[d] = max(known.get(d, 0), int(q == 1))
    texts = {}
    for d, t, lang in docs:
        if d in known and not plain_failed(plain_counts(t)):
            key = (lang or "", t or "")
            good[key] = max(good[key], known[d])
            texts[key] = plain_places(t or "")
    cutoffs = {}
    strata = {lang or "" for _, _, lang in docs}
    return good, texts, cutoffs, strata


def plain_cutoffs(stratum, good, texts, half):
    """Greedy path on one half, exact test on the other."""
    sides = {h: [(texts[k], g) for k, g in good.items() if k[0] == stratum and half[k[1]] == h] for h in (0, 1)}
    now, chosen = [0] * 6, [0] * 6
    rejected = lambda places, cut: any(p <= c for p, c in zip(places, cut))
    while True:
        options = []
        for r in range(6):
            for s in range(now[r] + 1, 7):
                step = [*now[:r], s, *now[r + 1:]]
                new = [g for places, g in sides[0] if rejected(places, step) and not rejected(places, now)]
                if new.count(0) > new.count(1):
                    options.append((new.count(1) / new.count(0), -new.count(0), r, s, step))
        if not options:
            return chosen
        now = min(options)[4]
        holdout = [places for places, g in sides[1] if g]
        hits = sum(rejected(p, now) for p in holdout)
        if plain_at_most(hits, len(holdout), Fraction(5, 100)) > 0.05 / plain_cutoffs.strata:
            return chosen
        chosen = now


def halves(spark, texts):
    from pyspark.sql import functions as F

    found = {xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63): t for t in texts}
    rows = spark.createDataFrame([(h,) for h in found], "h long").select("h", F.pmod(F.xxhash64("h"), F.lit(2)).alias("half")).collect()
    return {found[r.h]: r.half for r in rows}


def check(spark, docs, labels, got):
    good, texts, _, strata = plain_judge(docs, labels)
    half = halves(spark, {k[1] for k in texts})
    plain_cutoffs.strata = max(1, len(strata))
    cutoffs = {s: plain_cutoffs(s, good, texts, half) for s in strata}
    want = []
    for d, t, lang in docs:
        counts = plain_counts(t)
        failed = plain_failed(counts)
        names = [r for r, p, c in zip(rules.RULES, plain_places(t or ""), cutoffs[lang or ""]) if p <= c]
        want.append((d, *counts, failed, not failed and not names, ",".join(names)))
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    return cutoffs, want


def test_query_equals_plain_version(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()
    got = QUERIES["op13_quality_rules"](spark, folder)
    assert got.columns == ["doc_id", *rules.COUNTS, "base_failed", "kept", "rejected_by"]
    cutoffs, _ = check(spark, [tuple(r) for r in docs], [tuple(r) for r in labels], got)
    assert any(map(any, cutoffs.values()))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(rules, "SLICE", 700)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(6))
    clean = lambda: " ".join(word() for _ in range(60))
    junk = lambda: " ".join(word().upper() + "!!" for _ in range(60))
    docs = [(n, clean(), "xx") for n in range(260)] + [(n, junk(), "xx") for n in range(260, 300)]
    docs += [(n, junk(), None) for n in range(300, 310)]  # too few labels to certify
    docs += [(None, None, None), (None, junk(), "xx"), (7, "", ""), (7, junk(), "xx"), (8, "a b c a b c " * 30, "xx"),
             (9, "\n\n \x0b\nx y\nx y\n" + clean() + "\nx y", "xx"), (9, "### <b> | " * 40, "new"), *[docs[3]] * 5]
    labels = [(n, int(n < 260)) for n in range(310)] + [(None, 1), (5, None), (6, 0), (6, 1), (7, 0), (100_000, 1)]
    table = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, lang string, places int, stratum string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    cutoffs, want = check(spark, docs, labels, rules.judge(table, marks))
    assert any(cutoffs["xx"]) and not any(cutoffs[""])
    assert not any(r[7] for r in want if r[0] in range(260, 300)) and all(r[7] for r in want if r[0] in range(300, 310))
    check(spark, docs, [], rules.judge(table, marks.limit(0)))
    assert rules.judge(table.limit(0), marks).count() == 0


def test_repeats_in_a_long_text():
    words = [b"%d" % (i % 1000) for i in range(200_000)]
    assert rules.repeat_words([words, [], [b"a"] * 4, [b"a", b"b"]]).tolist() == [200_000, 0, 4, 0]

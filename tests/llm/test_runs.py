"""Runs against all periods tried one by one."""

import hashlib
import random
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm import runs
from gridspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words):
    n, out = len(words), []

    def smallest(part):
        return next(q for q in range(1, len(part) + 1) if part[q:] == part[:len(part) - q])

    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and smallest(words[i:j + q]) == q:
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = [w for w in __import__("re").split("[ \t-\r]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-__import__("fractions").Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_random_periodic_sequences():
    rng = random.Random(2)
    for size in (2, 3, 8):
        cases = []
        for _ in range(150):
            words = []
            while len(words) < 160:
                block = [rng.randrange(size) for _ in range(rng.choice((1, 2, 3, 5, 9, 20)))]
                words += (block * rng.choice((1, 2, 3, 4, 9, 30)))[:rng.choice((5, 30, 80))]
            cases.append(words)
        assert runs.runs_of(cases) == [plain_runs(w) for w in cases]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 1), min_size=1, max_size=6), st.integers(1, 12)), max_size=8))
def test_any_blocks(blocks):
    words = [w for block, times in blocks for w in block * times]
    assert runs.runs_of([words, [], words[:5], words]) == [plain_runs(words), [], plain_runs(words[:5]), plain_runs(words)]


def test_small_blocks_of_ordered_sets(monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 2)
    words = ([0] * 40 + [1, 2] * 20 + [0] * 50) * 3
    assert runs.runs_of([words]) == [plain_runs(words)]


@pytest.mark.parametrize("block", [[0], [0, 1, 2], list(range(5000))])
def test_long_texts_stay_near_linear(block):
    words = (block * 200_000)[:200_000]
    start = time.time()
    assert runs.runs_of([words]) == [[(0, 200_000, len(block))]]
    assert time.time() - start < 30


def test_query_equals_plain_version(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_periodic_runs"](spark, FOLDER)
    assert got.columns == ["doc_id", *[f.split()[0] for f in runs.DIGEST]]
    assert sorted(map(tuple, got.collect())) == sorted(plain_row(*r) for r in rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(runs, "SLICE", 40)
    run = " ".join(["a b"] * 30)
    rows = [(None, None), (None, run), (1, ""), (1, run), (1, run), (3, " \t\n"), (4, "x y " * 30), (5, "\x0b" + run)]
    # Ids whose hash makes them periodic.
    rows += [(d, " ".join(str(i) for i in range(n))) for n, d in enumerate([d for d in range(300) if zlib.crc32(str(d).encode()) % 10 == 0], 1)]
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, runs int, start string")
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, runs.planted_runs(docs).collect()), key=key) == sorted((plain_row(*r) for r in rows), key=key)
    listed = {(r.doc_id, len(r.runs)) for r in runs.periodic_runs(docs.where("doc_id = 1")).collect()}
    assert listed == {(1, 0), (1, 1)}
    assert runs.planted_runs(docs.limit(0)).count() == 0

"""Exact top-k against all products."""

import math
import random

import pytest

from gridspark.llm import topk


def brute(rows, every=50, k=5):
    good = []
    for vec_id, x in rows:
        if vec_id is not None and x and all(c is not None and math.isfinite(c) for c in x):
            good.append((vec_id, [math.floor(256 * c) for c in x]))
    out = []
    for n, (q, a) in enumerate(good):
        if q % every == 0:
            scored = sorted((-sum(s * t for s, t in zip(a, b)), v) for m, (v, b) in enumerate(good)
                            if m != n and len(a) == len(b))
            out += [(q, r, v, -s) for r, (s, v) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("tile", [7, 20_000])
@pytest.mark.parametrize("seed", range(3))
def test_equals_all_products(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(topk, "TILE_DATA", tile * 10)
    monkeypatch.setattr(topk, "TILE_QUERIES", tile)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(400):
        c = rng.choice(centres)
        rows.append((i if i % 11 else i // 2, [x + rng.gauss(0, 0.1) for x in c]))
    rows += [(400 + i, centres[0]) for i in range(120)]  # a hot vector, with ties
    rows += [(550, None), (600, []), (650, [None] * 8), (700, [float("nan")] * 8), (None, centres[1]), (750, [0.0] * 8),
             (800, [1.0, 2.0]), (801, [1.0, 2.0]), (850, [3.0]), (900, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute(rows)


def test_large_components_and_empty_tables(spark):
    rows = [(i, [(-1.0) ** i * 2.0 ** 20 + i, float(i)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute(rows)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 50")).count() == 0
    assert topk.top_k(df.where("vec_id % 50 <> 0")).count() == 0

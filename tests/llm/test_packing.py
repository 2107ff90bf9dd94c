"""Packing: plans over histograms, and whole tables against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridspark.llm import packing
from gridspark.llm.tokens import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def histograms():
    rng = random.Random(4)
    yield {}
    yield {1: 1}
    yield {64: 7}
    yield {33: 1000}
    yield {40: 500, 1: 3}
    yield {64: 3, 63: 5, 1: 1000}
    for _ in range(12):
        yield {n: rng.randrange(1, 60) for n in rng.sample(range(1, 65), rng.randrange(1, 40))}


@pytest.mark.parametrize("histogram", list(histograms()), ids=str)
def test_plan_fills_sequences(histogram):
    plan = packing.make_plan(histogram, 64)
    parts, whole = defaultdict(list), 0
    for length, n in histogram.items():
        for rank in range(n):
            placed = packing.place(plan, length, rank)
            assert [p[0] for p in placed] == np.cumsum([0, *[p[1] for p in placed[:-1]]]).tolist()
            assert sum(p[1] for p in placed) == length
            whole += len(placed) == 1
            for _, count, sequence, offset in placed:
                parts[sequence].append((offset, count))
    for spans in parts.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *[c for _, c in spans[:-1]]]).tolist()
        assert sum(c for _, c in spans) <= 64
    tokens = sum(length * n for length, n in histogram.items())
    assert len(parts) == -(-tokens // 64)
    assert sorted(parts) == list(range(len(parts)))


def test_documents(spark):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    texts = [None, "", " \n ", *["same text again"] * 40, *[
        " ".join(rng.choice(["über", "packing", "don't", "x1", "ﬁ", "Größe!!"]) for _ in range(rng.randrange(1, 400)))
        for _ in range(60)], "long words " * 4_000]
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, length int")
    rows = packing.pack(docs, PATH, 256).collect()
    t = Tokenizer.from_file(PATH)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for spans in by_sequence.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *[c for _, c in spans[:-1]]]).tolist()
        assert sum(c for _, c in spans) <= 256
    total = sum(r.length for r in rows)
    assert len(by_sequence) == -(-total // 256)
    full = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in enumerate(texts)}
    assert total == sum(map(len, full.values()))
    for i, ids in full.items():
        if i % 9:
            pieces = sorted(by_doc[i], key=lambda r: r.start)
            assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces[:-1]]]).tolist()
            for p in pieces:
                assert p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    assert packing.pack(docs.limit(0), PATH).count() == 0

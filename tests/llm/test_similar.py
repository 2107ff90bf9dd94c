"""The near-duplicate stage against all pairs of plain shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from gridspark.llm import similar
from gridspark.llm.common import key_filter, may_hold
from gridspark.session import shared_folder


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """Smallest doc_id of each group of rows (doc_id, text) linked at 0.8 or more."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups[find(i)] = min(d, groups.get(find(i), d))
    return sorted(groups.values())


@pytest.mark.parametrize("tile", [8, 2048])
def test_every_similar_pair_is_linked(spark, monkeypatch, tile):
    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar, "FEW", tile // 2)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(60)]
    texts = [None, "", "one two", "One  two", "a b c d e"]
    for n in (30, 120, 400):
        for _ in range(4):
            base = [word() for _ in range(n)] + shared
            texts.append(" ".join(base))
            for edits in (1, 2, 4, 6, 8, 10):
                words = base.copy()
                for at in rng.sample(range(n), min(n, edits * (n + 60) // 120)):
                    words[at] = word()
                texts.append(" ".join(words))
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)


def test_key_filter(spark):
    keys = [0, 1, -1, 7, -(1 << 63), (1 << 63) - 1, *range(1000, 3000)]
    field = key_filter(spark.createDataFrame([(k,) for k in [*keys, None]], "k long")).value
    assert may_hold(field, np.array(keys)).all()
    assert may_hold(field, np.arange(10_000, 30_000)).mean() < 0.01
    assert not may_hold(key_filter(spark.createDataFrame([], "k long")).value, np.array(keys)).any()


def test_intermediate_tables_go(spark):
    import os

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = spark.sparkContext.getCheckpointDir() or shared_folder(spark).rsplit("/", 1)[0]
    before = set(os.listdir(folder.removeprefix("file:")))
    assert similar.representatives(docs).count() > 100
    assert len(set(os.listdir(folder.removeprefix("file:"))) - before) == 1


def test_many_near_copies_and_shared_passages(spark, monkeypatch):
    """Groups whose members are often below 0.8 of one another, and a passage that fills most of many texts."""
    monkeypatch.setattr(similar, "TILE", 16)
    monkeypatch.setattr(similar, "FEW", 4)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(100)]
    texts = []
    for _ in range(60):
        words = base.copy()
        for at in rng.sample(range(100), rng.randrange(4)):
            words[at] = word()
        texts.append(" ".join(words))
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(rng.randrange(4, 30))] + passage) for _ in range(50)]
    texts += [texts[0]] * 20 + [None] * 5 + ["x"] * 5
    rows = [(n * 7 % 1009, t) for n, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, "r", 1) for d, t in rows], "doc_id long, text string, row string, other int")
    got = similar.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)


def test_given_documents(spark):
    """Pairs such as 6 and 145, at 0.833, whose three-word fingerprints differ in 7 bits."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got) == plain_kept(rows)
    assert 6 in got and 145 not in got and 1 in got and 177 not in got


def test_long_texts_of_half_a_passage_stay_apart_without_their_sets(spark, monkeypatch):
    """Pairs of long texts that share half of their words: the sets are made again for similar ones only."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(8):
        passage = [word() for _ in range(1600)]
        texts += [" ".join(passage + [word() for _ in range(1600)]) for _ in range(2)]
    near = [word() for _ in range(3000)]
    texts += [" ".join(near), " ".join(near[:2900])]
    rows = list(enumerate(texts))
    counts = []

    class Counted(similar.Scratch):
        def __call__(self, df):
            out = super().__call__(df)
            if "shingles" in out.columns:
                counts.append(out.count())
            return out

    monkeypatch.setattr(similar, "Scratch", Counted)
    got = similar.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows) == list(range(17))
    assert sum(counts) == 2


def test_differing_bits_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (10, 600, 5000):
        for m in (n, n + 1, 2 * n):
            a, b = (np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n, m))
            b = np.unique(np.concatenate([b, a[n // 2:]]))
            x, y = (similar.wide_bitmap(s) or similar.bitmap(s) for s in (a, b))
            assert 0 < similar.differing(x, y) <= len(np.setxor1d(a, b))
            assert similar.differing(x, x) == 0

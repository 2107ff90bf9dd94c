"""Quality classifier: agreement with labels it never sees, expectation-maximisation, odd tables."""

import numpy as np

from gridspark.llm import quality


def test_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = quality.classify(docs).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in good) >= 0.97 * len(good)
    assert sum(not r.keep for r in bad) >= 0.9 * len(bad)


def test_posteriors_find_the_reliable_heuristics():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    accuracy = [0.95, 0.9, 0.85, 0.55]
    cast = np.stack([np.where(rng.random(len(truth)) < a, truth, ~truth) for a in accuracy], axis=1) * 2
    patterns, index, counts = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    good = quality.posteriors(patterns, counts.astype(float))
    assert np.mean((good[index.ravel()] >= 0.5) == truth) > 0.94


def test_odd_tables(spark):
    prose = "This is a plain sentence, and here is another one. It goes on for a while without anything odd."
    rows = [(None, prose), (1, None), (2, ""), (3, "!!! ### $$$"), (3, "!!! ### $$$"), (4, prose * 2_000), (5, "\x00é")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, keep int")
    got = quality.classify(docs).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert quality.classify(docs.limit(0)).count() == 0
    kept = quality.kept(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)


def test_clean_table_stays_whole(spark):
    rows = [(i, f"Here is sentence number {i}, quite ordinary. Another one follows it, as usual.") for i in range(50)]
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("keep").count() == 50

"""Language identification: held-out accuracy and odd tables."""

import zlib

import pytest

from gridspark.llm import langid


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d in got if got[d].held_out} == set(held)
    right = sum(got[d].lang_pred == truth[d] for d in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_learns_nothing_from_held_out_documents(spark):
    held = [d for d in range(400) if zlib.crc32(str(d).encode()) % 5 == 0]
    free = [d for d in range(400) if d not in held]
    rows = [(d, "der die und nicht", "de") for d in free[:40]] + [(d, "the and of which", "en") for d in free[40:80]]
    rows += [(d, "the and of which", "xx") for d in held]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} <= {"de", "en"}
    assert all(r.lang_pred == "en" for r in got if r.held_out)


@pytest.mark.parametrize("lang", [None, "fr"])
def test_nothing_or_one_language_to_learn(spark, lang):
    rows = [(None, "abc", lang), (1, None, lang), (2, "", lang), (3, "12 .,!", lang), (4, "mot " * 40_000, lang), (4, "mot", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("x", "score")
    got = langid.identify(docs).collect()
    assert len(got) == 6
    for r in got:
        if lang is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    found = [r.lang_pred for r in got if r.doc_id in (1, 2, 3)]
    assert found == ["und"] * 3
    assert langid.identify(docs.limit(0)).count() == 0
    assert langid.kept(docs, 0.5).columns == docs.columns


def test_windows_cover_the_text():
    text = "Ünïcode " * 100
    data = langid.byte_windows(text).tobytes()
    assert data.rstrip(b" ") == text.lower().encode().rstrip(b" ")

"""The pipeline's rows against the same stages in plain Python."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from test_similar import plain_kept

import corpus_pipeline
from gridspark.llm import langid, pii, quality
from gridspark.llm.tokens import tokenizer_path

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect_in_order(spark):
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "language ID", "SimHash near-dedup", "PII", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.select(*corpus_pipeline.COLUMNS).collect()
    scorer, _ = quality.fitted(docs).value
    good = [r for r in rows if scorer.score(quality.features((r.text or "").encode())[None])[0] >= quality.KEEP_FROM]
    assert 0 < len(good) < len(rows)
    predict = langid.fitted(spark.createDataFrame(good, docs.select(*corpus_pipeline.COLUMNS).schema)).value
    names, scores = predict([r.text for r in good])
    known = [r for r, n, s in zip(good, names, scores) if n != "und" and s >= corpus_pipeline.LANGUAGE_FROM]
    kept = set(plain_kept([(r.doc_id, r.text) for r in known]))
    single = [r for r in known if r.doc_id in kept]
    assert len(single) < len(known)
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*t.encode(pii.masked(r.text), add_special_tokens=False).ids, 1], "<u4") for r in single}

    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for doc_id, found in pieces.items():
        found.sort(key=lambda r: r.start)
        assert [p.start for p in found] == np.cumsum([0, *[p.length for p in found[:-1]]]).tolist()
        assert sum(p.length for p in found) == len(ids[doc_id]) == found[0].doc_tokens
        assert all(p.ids_crc32 == zlib.crc32(ids[doc_id][p.start:p.start + p.length].tobytes()) for p in found)
    assert len(sequences) == -(-sum(map(len, ids.values())) // 2048)


def test_stages_on_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "ok words here.", None, "s", 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0), docs.selectExpr("*", "1 as print", "2 as row_hash", "3 as rank")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, "").columns == list(corpus_pipeline.COLUMNS)
            assert stage(spark, table, "").count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, table, "").count() == table.count()


def test_stages_hand_few_texts_at_a_time_to_python(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 1000, 1, 1).selectExpr(
        "id as doc_id", "'a@b.example ' || id as text", "'en' as lang", "'s' as source", "20L as n_chars")

    def rows_of_batches(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    mask = dict(corpus_pipeline.STAGES)["PII"]
    try:
        for limit, most in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("7", 7)):
            spark.conf.set(name, limit)
            masked = mask(spark, docs, "")
            assert max(r.n for r in masked.mapInArrow(rows_of_batches, "n long").collect()) == most
            assert masked.where("text like '<EMAIL> %'").count() == 1000
    finally:
        spark.conf.set(name, before)

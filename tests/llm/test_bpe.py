"""Chunk reuse and join repair against the tokenizers library on whole texts."""

import hashlib
import random
import time

import numpy as np
import pytest

from gridspark.llm import bpe
from gridspark.llm.tokens import tokenizer_path, word_encoder

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def odd_text(rng: random.Random, n: int) -> str:
    pool = ["the", " ", "  ", "\n", " \n ", "\t", "don't", "we'll", "é", "ß", "漢字", "123", "4567", "!!", "...", " ",
            "é", "x" * 40, "<|endoftext|>", "<|endof", "'", "'re", " ", "\x1c", "a", "b", "c", " of", " and"]
    return "".join(rng.choice(pool) for _ in range(n))


TEXTS = [
    "", " ", "a", "<|endoftext|>", "x" * 30_000, " " * 3_000, "ab" * 5_000, "word " * 3_000, "\n \n" * 2_000,
    "漢字" * 2_000, "don't " * 900 + "'", *[odd_text(random.Random(s), 1_500) for s in range(12)],
    *["".join(random.Random(s).choice("etaoin shrdlu\n'") for _ in range(9_000)) for s in range(6)],
    *["".join(random.Random(s).choice(kind) for _ in range(6_000)) for s, kind in enumerate(
        ("etaoinshrdlu", "0123456789", "!?'.,-", " \n\t", "étàöß", "a1"))],
    "'s" + "".join(random.Random(7).choice("abc") for _ in range(4_000)) + "'ll" + "!'" * 2_000 + "s" * 90 + "'" * 70 + "re",
]


@pytest.mark.parametrize("n", range(len(TEXTS)))
def test_joined_chunks_equal_the_library(n, library):
    text, coder = TEXTS[n], bpe.chunks_of(PATH)
    parts = bpe.text_chunks(coder, text)
    joined = []
    for part in parts:
        strings = [c.decode() for c in part]
        joined.append(coder.join(strings, [np.frombuffer(b, coder.encoder.dtype) for b in coder.encode(strings)]))
    want = library.encode(text, add_special_tokens=False).ids
    assert (np.concatenate(joined).tolist() if joined else []) == want
    count, _, decoded = coder.digest(joined)
    assert count == len(want)
    assert decoded == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_small_chunks_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(bpe, "LEAST_CHUNK", 3)
    monkeypatch.setattr(bpe, "CHUNK_BITS", 3)
    coder = bpe.chunks_of(PATH)
    for text in TEXTS:
        joined = []
        for part in bpe.text_chunks(coder, text[:1_500]):
            strings = [c.decode() for c in part]
            joined.append(coder.join(strings, [np.frombuffer(b, coder.encoder.dtype) for b in coder.encode(strings)]))
        want = library.encode(text[:1_500], add_special_tokens=False).ids
        assert (np.concatenate(joined).tolist() if joined else []) == want


def test_word_stretches_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    encoder = word_encoder(path)
    for text, got in zip(TEXTS, encoder.encode(TEXTS)):
        assert np.frombuffer(got, encoder.dtype).tolist() == t.encode(text, add_special_tokens=False).ids


def test_documents(spark, library):
    shared = "".join(random.Random(5).choice("etaoin shrdlu") for _ in range(6_000))
    texts = [*TEXTS, None, shared, "lead " + shared, shared + " tail", shared, "x" + shared + "y"]
    docs = spark.createDataFrame([(i if i % 7 else None, t, "k") for i, t in enumerate(texts)],
                                 "doc_id long, text string, n_tokens string")
    got = sorted(bpe.encode_decode(docs, PATH).collect(), key=repr)
    want = []
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((
            i if i % 7 else None, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("kind", ["etaoinshrdlu", "0123456789", "!?.,-#", "a1"])
def test_a_megabyte_without_blanks(kind, library):
    rng = random.Random(8)
    text, coder = "".join(rng.choice(kind) for _ in range(1_000_000)), bpe.chunks_of(PATH)
    strings = [c.decode() for part in bpe.text_chunks(coder, text) for c in part]
    assert len(strings) > 100
    ids = [np.frombuffer(b, coder.encoder.dtype) for b in coder.encode(strings)]
    start = time.time()
    joined = coder.join(strings, ids)
    took = time.time() - start
    start = time.time()
    assert joined.tolist() == library.encode(text, add_special_tokens=False).ids
    assert took < 5 * (time.time() - start) + 5

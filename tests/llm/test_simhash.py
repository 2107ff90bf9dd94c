"""SimHash fingerprints and components against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from gridspark.llm import simhash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints, radius=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)].append(d)
    return [min(least[find(i)], default=None) for i in range(len(ids))]


@pytest.mark.parametrize("text", ["", " \n", "one", "One two", "a b c", "a b c d A B C d", "É é x y\x0bz\x1cq w", "x " * 70_000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_print(text)


@pytest.mark.parametrize("shard", [8, 50, 5_000])
def test_tree_finds_all_links(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "DIRECT", 64)
    rng = random.Random(shard)
    prints = [rng.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1]
    for _ in range(150):
        p = rng.choice(prints)
        for b in rng.sample(range(64), rng.randrange(1, 5)):
            p ^= 1 << b
        prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "doc_id long, print long")
    got = {r.print: r.component_id for r in simhash.component_of_prints(rows, 3).collect()}
    assert [got[s] for s in signed] == plain_components(list(range(len(prints))), prints)


def test_shard_search_is_complete():
    rng = np.random.default_rng(1)
    homes = rng.integers(0, 1 << 63, 3_000, np.uint64)
    homes[1_000:2_000] = homes[:1_000] ^ np.uint64(0b101)
    visitors = homes[:500] ^ np.uint64(0b10000)
    others = np.concatenate([homes, visitors])
    found = {(i, j) for a, b in simhash.close_pairs(homes, others, 3) for i, j in zip(a.tolist(), b.tolist())}
    want = np.nonzero(np.bitwise_count(homes[:, None] ^ others[None, :]) <= 3)
    assert found == set(zip(want[0].tolist(), want[1].tolist()))


def documents(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [" ".join(word() for _ in range(400)) for _ in range(12)]
    texts = [None, "", *base, *[base[0]] * 30]
    for b in base[:6]:
        words = b.split(" ")
        for n in range(4):
            words = words.copy()
            words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words).upper() if n % 2 else "\n".join(words))
    ids = [None if i in (3, 9) else 1000 - i // 2 for i in range(len(texts))]
    return ids, texts, spark.createDataFrame(
        [(i, t, "en", "s", 3) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, print int")


def test_documents(spark):
    ids, texts, docs = documents(spark)
    prints = [plain_print(t) for t in texts]
    want = list(zip(ids, [f"{p:016x}" for p in prints], plain_components(ids, prints)))
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_representatives(spark):
    ids, texts, docs = documents(spark)
    prints = [plain_print(t) for t in texts]
    groups = len(set(plain_components(range(len(ids)), prints)))
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == groups
    assert len(set(plain_components(range(groups), [plain_print(r.text) for r in rows]))) == groups
    twice = docs.union(docs)
    assert simhash.representatives(twice).count() == groups

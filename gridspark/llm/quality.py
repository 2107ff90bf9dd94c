"""Quality classifier without hand labels.

Simple heuristics vote good, bad or nothing on every document. Expectation-maximisation over the counts of
vote patterns, of which there are at most 3 to the number of heuristics, estimates how often each
heuristic votes right, and so the probability that a document of each pattern is good. A linear scorer
over hashed byte trigrams learns these probabilities from a bounded sample and scores every document, so
that it also sees what no heuristic looks at.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_map, texts
from gridspark.session import materialise

BAD, NONE, GOOD = 0, 1, 2

# Bound of the training sample: documents of each side.
TRAIN_DOCUMENTS = 2000
HASH_BITS = 12
STATISTICS = 7
FEATURES = (1 << HASH_BITS) + STATISTICS
STEPS = 300
KEEP_FROM = 0.5

# Expectation-maximisation starts from, and is held towards, heuristics that are mostly right: the weight
# is a share of all documents, so the result is alike at every size.
PRIOR_SHARE = 0.1
DETECTORS, HEURISTICS = 6, 8
PRIOR_DETECTOR = {BAD: (0.25, 0.7, 0.05), GOOD: (0.02, 0.93, 0.05)}
PRIOR_PROSE = {BAD: (0.05, 0.65, 0.3), GOOD: (0.05, 0.15, 0.8)}
PRIOR_GOOD = 0.8
ROUNDS = 50

# Classes of bytes counted in a text.
LOWER, UPPER, DIGIT, SPACE, STOP, MARK, SHOUT, BAR, SYMBOL = range(9)


def byte_classes() -> np.ndarray:
    table = np.full(256, SYMBOL, np.uint8)
    table[ord("a"):ord("z") + 1] = LOWER
    table[0x80:] = LOWER
    table[ord("A"):ord("Z") + 1] = UPPER
    table[ord("0"):ord("9") + 1] = DIGIT
    for c in b" \t\r\n\x0b\x0c":
        table[c] = SPACE
    table[ord(".")] = STOP
    for c in b",;:?'\"-()":
        table[c] = MARK
    table[ord("!")] = SHOUT
    table[ord("|")] = BAR
    return table


CLASSES = byte_classes()


def statistics(data: bytes) -> tuple[np.ndarray, int]:
    """Shares of symbols, capitals, shouts, bars, repeated neighbours, different words and stops; number of words."""
    counts = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=9)
    words = data.split()
    n = max(1, len(words))
    letters = max(1, int(counts[LOWER] + counts[UPPER]))
    visible = max(1, len(data) - int(counts[SPACE]))
    return np.array([
        (counts[SYMBOL] + counts[SHOUT] + counts[BAR]) / visible, counts[UPPER] / letters, counts[SHOUT] / n,
        counts[BAR] / n, sum(map(operator.eq, words, words[1:])) / n, len(set(words)) / n, counts[STOP] / n,
    ]), len(words)


def votes(data: bytes) -> tuple[int, ...]:
    """One vote of each heuristic: detectors of one kind of rubbish each, which vote bad or not at all, then two
    that look for prose, which vote good or not at all. A text without words gets no votes."""
    s, n = statistics(data)
    if not n:
        return (NONE,) * HEURISTICS
    symbols, capitals, shouts, bars, repeats, different, stops = s
    return tuple(BAD if bad else NONE for bad in (
        symbols - bars * n / max(1, len(data)) > 0.08,
        n >= 5 and capitals > 0.4,
        shouts > 0.2,
        n >= 10 and bars > 0.1,
        n >= 10 and repeats > 0.15,
        n >= 100 and different < 0.1,
    )) + tuple(GOOD if good else NONE for good in (
        symbols < 0.03 and (n < 10 or capitals < 0.15),
        repeats < 0.05 and bars < 0.02 and (n < 10 or 0.01 < stops < 0.5),
    ))


def posteriors(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability that a document of each vote pattern (rows of votes) is good."""
    n, k = patterns.shape
    hot = np.stack([patterns == v for v in (BAD, NONE, GOOD)], axis=2).astype(float)  # (n, k, 3)
    total = counts.sum()
    weight = PRIOR_SHARE * total
    kinds = [PRIOR_DETECTOR if i < DETECTORS else PRIOR_PROSE for i in range(k)]
    prior = np.array([[kind[side] for kind in kinds] for side in (BAD, GOOD)])  # (2, k, 3)
    chance = prior
    share = PRIOR_GOOD
    good = np.full(n, PRIOR_GOOD)
    for _ in range(ROUNDS):
        logs = np.einsum("nkv,ckv->cn", hot, np.log(chance)) + np.log([[1 - share], [share]])
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        mass = np.stack([(1 - good) * counts, good * counts])  # (2, n)
        seen = np.einsum("cn,nkv->ckv", mass, hot) + weight * prior
        chance = seen / seen.sum(axis=2, keepdims=True)
        share = (mass[1].sum() + weight * PRIOR_GOOD) / (total + weight)
    return good


def features(data: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, and the statistics."""
    out = np.zeros(FEATURES, np.float32)
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(raw) > 2:
        mixed = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA6B) + raw[2:] * np.uint32(0xC2B2AE35)
        hashed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - HASH_BITS)
        out[:1 << HASH_BITS] = np.sqrt(np.bincount(hashed, minlength=1 << HASH_BITS) / len(hashed))
    out[1 << HASH_BITS:] = np.sqrt(statistics(data)[0])
    return out


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights + self.bias, -500, 500)))


def fit(rows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> Scorer:
    """Weighted logistic regression towards soft targets, by Adam over the whole sample."""
    w, b = np.zeros(rows.shape[1], np.float32), 0.0
    if not len(rows) or (target >= 0.5).all():
        return Scorer(w, 20.0)  # nothing bad was seen: everything is kept
    weight = weight / weight.sum()
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        error = (Scorer(w, b).score(rows) - target) * weight
        grad = np.append(rows.T @ error.astype(np.float32) + 1e-5 * w, error.sum())
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        move = 0.05 * first / (1 - 0.9 ** step) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
        w -= move[:-1].astype(np.float32)
        b -= float(move[-1])
    return Scorer(w, b)


def as_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def fitted(docs: DataFrame):
    """Broadcast (scorer, probability by vote pattern) learnt from docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = docs.withColumn("hash", F.xxhash64("doc_id", "text"))

    def cast_votes(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = ["".join("bng"[v] for v in votes(as_bytes(t))) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(found)], names=["hash", "votes"])

    cast = materialise(arrow_map(marked.select("hash", "text"), cast_votes, "hash long, votes string"))
    counted = cast.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").toPandas()
    good = {}
    if len(counted):
        patterns = np.array([["bng".index(c) for c in v] for v in counted["votes"]])
        good = dict(zip(counted["votes"], posteriors(patterns, counted["n"].to_numpy(float)).tolist()))
    sides = {side: [v for v, p in good.items() if (p >= 0.5) == side] for side in (False, True)}
    total = {side: int(counted.loc[counted["votes"].isin(v), "n"].sum()) for side, v in sides.items()}
    chosen: dict[int, str] = {}
    for names in sides.values():
        if names:
            picked = cast.where(F.col("votes").isin(names)).orderBy("hash").limit(TRAIN_DOCUMENTS).toPandas()
            chosen.update(zip(picked["hash"].tolist(), picked["votes"]))

    def sample_features(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(as_bytes(t)).astype(np.float16).tobytes() for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(rows, pa.binary())], names=["hash", "row"])

    if chosen:
        wanted = spark.createDataFrame([(h,) for h in sorted(chosen)], "hash long")
        sample = arrow_map(marked.select("hash", "text").join(F.broadcast(wanted), "hash"), sample_features,
                           "hash long, row binary").dropDuplicates(["hash"]).orderBy("hash").toPandas()
        rows = np.array([np.frombuffer(r, np.float16) for r in sample["row"]], np.float32)
        target = np.array([good[chosen[h]] for h in sample["hash"]])
        side = target >= 0.5
        weight = np.where(side, total[True] / max(1, side.sum()), total[False] / max(1, (~side).sum()))
        scorer = fit(rows, target, weight)
    else:
        scorer = Scorer(np.zeros(FEATURES, np.float32), 20.0)
    return spark.sparkContext.broadcast((scorer, good))


def classify(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, votes (one letter for each heuristic: b, n or g), posterior (the
    weak-label probability of being good), score (the trained scorer's) and keep.

    A null text counts as empty; texts without words get no votes and score like any other. Null and repeated doc_ids
    stay as they are, other columns of docs are ignored, an empty table gives an empty one. The scorer learns from
    at most TRAIN_DOCUMENTS documents of each side, those with the smallest hashes; the vote counts cover all.
    """
    docs = docs.select("doc_id", "text")
    shared = fitted(docs)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, known = shared.value
        found, scores = [], []
        all_texts = [as_bytes(t) for t in texts(batch)]
        for at in range(0, len(all_texts), 256):
            part = all_texts[at:at + 256]
            found += ["".join("bng"[v] for v in votes(t)) for t in part]
            scores += model.score(np.stack([features(t) for t in part])).tolist()
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found), pa.array([known.get(v, PRIOR_GOOD) for v in found]),
             pa.array(scores, pa.float64()), pa.array([s >= KEEP_FROM for s in scores])],
            names=["doc_id", "votes", "posterior", "score", "keep"])

    return arrow_map(docs, judge, "doc_id long, votes string, posterior double, score double, keep boolean")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that the classifier keeps, all columns as they are."""
    model = fitted(docs)

    def filter_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer, _ = model.value
        keep = []
        all_texts = [as_bytes(t) for t in texts(batch)]
        for at in range(0, len(all_texts), 256):
            scores = scorer.score(np.stack([features(t) for t in all_texts[at:at + 256]]))
            keep += (scores >= KEEP_FROM).tolist()
        return batch.filter(pa.array(keep))

    return arrow_map(docs, filter_rows, docs.schema)

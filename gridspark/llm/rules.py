"""Quality rules whose cutoffs are certified on labelled documents.

Each rule compares one measure of a text with a cutoff out of a fixed ladder, lenient to strict. In every stratum (a
language) half of the labelled texts, chosen by their hash, draws up a path of tightening cutoffs: each step is the one
that rejects the fewest good texts for the bad ones it adds, as long as it rejects more bad than good. The other half, the
holdout, walks that path and stops before the first step at which the exact binomial bound no longer shows that at most
RISK of the good texts are rejected. Testing in a fixed order and stopping needs no correction along the path; the level is
divided among the strata (Bonferroni), so with confidence 1 - LEVEL no stratum exceeds the risk. A stratum with too few
labels certifies nothing and keeps its documents.

Measures are taken in one pass without a shuffle. What the cutoffs need is counts of ladder places, at most (STEPS + 1) ^ rules
a stratum however many documents there are, summed by Spark; copies of a text count once, as copies are no independent evidence.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_map, texts
from gridspark.session import materialise

# Largest share of good documents that the rules may reject in a stratum, and the chance of exceeding it anywhere.
RISK = 0.05
LEVEL = 0.05

# Ladders in thousandths: symbols, capitals in words, exclamation marks and characters for each word; repeated words of all
# words, repeated lines of all lines.
LADDERS = {
    "symbols": (2000, 1000, 500, 300, 200, 100),
    "capitals": (900, 700, 500, 400, 300, 200),
    "shouts": (900, 700, 500, 300, 200, 100),
    "repeats": (450, 400, 300, 200, 100, 50),
    "lines": (800, 600, 400, 300, 200, 100),
    "long_words": (20_000, 15_000, 12_000, 10_000, 9_000, 8_000),
}
RULES = tuple(LADDERS)
STEPS = 6
CUTOFFS = np.array([LADDERS[r] for r in RULES])

FEWEST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes([*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)])
# Words measured at a time; one longer text goes alone.
SLICE = 500_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def number_of(data: bytes, wanted: bytes) -> int:
    return len(data) - len(data.translate(None, wanted))


def repeat_words(sequences: list[list[bytes]]) -> np.ndarray:
    """Words of each sequence that lie in a window of three words found twice or more in it."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    total = int(sizes.sum())
    if total < 3:
        return np.zeros(len(sizes), np.int64)
    # Numbers go on from text to text, so windows of different texts never look alike.
    fresh, ids = count(), []
    for words in sequences:
        number = defaultdict(fresh.__next__)
        ids += map(number.__getitem__, words)
    w = np.array(ids, np.int64)
    different = int(w.max()) + 1
    key = w[:-2] * different + w[1:-1]
    if different > 1 << 20:
        key = np.unique(key, return_inverse=True)[1]
    key = key * different + w[2:]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(total + 2, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(total, np.int64)
    covered[twice[:total] | np.roll(twice, 1)[:total] | np.roll(twice, 2)[:total]] = 1
    sums = np.concatenate([[0], np.cumsum(covered)])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def measures(part: list[str], datas: list[bytes], sequences: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS of each text, and the place of each rule's measure on its ladder: the first step that rejects it, or STEPS + 1."""
    rows = []
    for text, data, words in zip(part, datas, sequences):
        lines = [line for line in data.split(b"\n") if line.strip()]
        upper = number_of(data, UPPER)
        rows.append((len(words), len(text) - number_of(data, b" \t\n\x0b\x0c\r"), number_of(data, SYMBOLS),
                     len(lines) - len(set(lines)), 0, len(lines), upper, upper + number_of(data, LOWER), data.count(b"!")))
    counts = np.array(rows, np.int64)
    counts[:, 4] = repeat_words(sequences)
    words, chars, symbols, twice, repeats, lines, upper, letters, shouts = counts.T
    over = np.stack([symbols, upper, shouts, repeats, twice, chars], axis=1)
    under = np.maximum(1, np.stack([words, letters, words, words, lines, words], axis=1))
    rejects = 1000 * over[:, :, None] > CUTOFFS[None] * under[:, :, None]
    return counts[:, :5], STEPS + 1 - rejects.sum(axis=2)


def slices(all_texts: list[str]) -> Iterator[tuple[list[str], list[bytes], list[list[bytes]]]]:
    part: tuple[list[str], list[bytes], list[list[bytes]]] = ([], [], [])
    size = 0
    for text in all_texts:
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        if part[0] and size + len(words) > SLICE:
            yield part
            part, size = ([], [], []), 0
        for column, value in zip(part, (text, data, words)):
            column.append(value)
        size += len(words)
    if part[0]:
        yield part


def measured(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, stratum (lang, empty for null), text_hash, COUNTS, base_failed and
    places (one for each rule)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        counts, places, hashes = [], [], []
        for part in slices(texts(batch)):
            found = measures(*part)
            counts.append(found[0])
            places.append(found[1])
            hashes += [xxhash.xxh3_64_intdigest(data) - (1 << 63) for data in part[1]]
        all_counts = np.concatenate(counts)
        failed = (all_counts[:, 0] < FEWEST_WORDS) | (100 * all_counts[:, 4] > MOST_REPEATED * all_counts[:, 0])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("stratum"), pa.array(hashes, pa.int64()),
             *[pa.array(c) for c in all_counts.T], pa.array(failed),
             pa.array(np.concatenate(places).tolist(), pa.list_(pa.int32()))],
            names=["doc_id", "stratum", "text_hash", *COUNTS, "base_failed", "places"])

    numbers = ", ".join(f"{c} long" for c in COUNTS)
    return arrow_map(
        docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("stratum")), run,
        f"doc_id long, stratum string, text_hash long, {numbers}, base_failed boolean, places array<int>")


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by Lentz's evaluation of its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    tiny = 1e-300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    value = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            value *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * value


def at_most(k: int, n: int, p: float) -> float:
    """Chance of at most k hits in n independent trials of chance p."""
    return 1.0 if k >= n else beta_share(1 - p, n - k, k + 1)


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact upper confidence bound (Clopper and Pearson) of a chance, k hits seen in n trials."""
    low, high = 0.0, 1.0
    if k >= n:
        return 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if at_most(k, n, middle) > level else (low, middle)
    return high


def tightening(places: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[np.ndarray]:
    """Path of cutoff steps for all rules (0: off), given how many good and bad texts have each row of places."""
    now = np.zeros(places.shape[1], np.int64)
    path = []
    while True:
        passing = (places > now).all(axis=1)
        best = None
        for rule in range(len(now)):
            for step in range(int(now[rule]) + 1, STEPS + 1):
                hit = passing & (places[:, rule] <= step)
                lost, won = int(good[hit].sum()), int(bad[hit].sum())
                if won > lost:
                    candidate = (lost / won, -won, rule, step)
                    best = min(best or candidate, candidate)
        if best is None:
            return path
        now = now.copy()
        now[best[2]] = best[3]
        path.append(now)


def certified(path: list[np.ndarray], places: np.ndarray, good: np.ndarray, level: float) -> tuple[np.ndarray, int]:
    """Last cutoffs of the path before the exact test first fails to show a risk of at most RISK, and the good texts that they reject."""
    chosen, lost = np.zeros(places.shape[1], np.int64), 0
    total = int(good.sum())
    for cutoffs in path:
        hits = int(good[(places <= cutoffs).any(axis=1)].sum())
        if at_most(hits, total, RISK) > level:
            break
        chosen, lost = cutoffs, hits
    return chosen, lost


def thresholds(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per stratum of rows (as of measured()) that has labels: cutoffs (the ladder step of each rule, 0: off), n_holdout (good
    texts), n_rejected (of them) and risk_bound (upper confidence bound of the share of good texts rejected).

    labels (doc_id, quality): 1 is good. Null labels say nothing; of labels that disagree on a document or on copies of a text, good
    counts. Texts that fail the base rules take no part.
    """
    strata = max(1, rows.select("stratum").distinct().count())
    level = LEVEL / strata
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"))
    once = rows.where("not base_failed").join(known, "doc_id").groupBy("stratum", "text_hash").agg(
        F.max("good").alias("good"), F.min("places").alias("places"))
    counted = once.groupBy("stratum", F.pmod(F.xxhash64("text_hash"), F.lit(2)).alias("holdout"), "places").agg(
        F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))

    def choose(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        half = {}
        for holdout in (0, 1):
            part = found[found["holdout"] == holdout]
            places = np.array(part["places"].tolist(), np.int64).reshape(-1, len(RULES))
            half[holdout] = places, part["good"].to_numpy(np.int64), part["bad"].to_numpy(np.int64)
        places, good, _ = half[1]
        cutoffs, lost = certified(tightening(*half[0]), places, good, level)
        total = int(good.sum())
        return pd.DataFrame({"stratum": [key[0]], "cutoffs": [cutoffs.tolist()], "n_holdout": [total], "n_rejected": [lost],
                             "risk_bound": [upper_bound(lost, total, level)]})

    return counted.groupBy("stratum").applyInPandas(
        choose, "stratum string, cutoffs array<int>, n_holdout long, n_rejected long, risk_bound double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, COUNTS, base_failed, kept, and rejected_by, the names of the certified rules
    that reject it, comma-joined.

    Words are separated by ASCII white space; a null or empty text has none and fails the base rules. Null and repeated doc_ids stay
    rows of their own, null languages are a stratum, other columns are ignored, an empty table gives an empty one. Without labels
    only the base rules reject.
    """
    rows = materialise(measured(docs))
    chosen = materialise(thresholds(rows, labels)).select("stratum", "cutoffs")
    off = F.array(*[F.lit(0)] * len(RULES))
    hits = F.zip_with("places", F.coalesce("cutoffs", off), lambda place, cutoff: place <= cutoff)
    names = F.filter(F.zip_with(hits, F.array(*[F.lit(r) for r in RULES]), lambda hit, name: F.when(hit, name)),
                     lambda name: name.isNotNull())
    return rows.join(chosen, "stratum", "left").select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~F.exists(hits, lambda hit: hit)).alias("kept"),
        F.array_join(names, ",").alias("rejected_by"))

"""Language identification by a small byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of fixed length that cover it whole. Bytes are embedded, filters
of several widths slide over a window, each keeps its largest answer, and a softmax turns these into
language probabilities. A document's probabilities are the means over its windows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_map

UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")

WINDOW = 128  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
EMBEDDING = 8
BLOCK = 96  # windows computed at a time

# Bound of the training sample: documents of each language (on average, drawn by hash), and windows of each document.
TRAIN_DOCUMENTS = 1500
TRAIN_WINDOWS = 4
HASH_RANGE = 1 << 40
EPOCHS = 4
BATCH = 64
STEP = 4e-3


@dataclass
class Network:
    """languages may be empty: then nothing was learnt and every text is undetermined."""

    languages: list[str]
    embedding: np.ndarray  # (256, EMBEDDING)
    filters: np.ndarray  # (widest * EMBEDDING, filters), narrower ones zero in their last rows
    filter_bias: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def hidden(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pooled answers, their places, and the unrolled input of (n, WINDOW) bytes."""
        widest = WIDTHS[-1]
        embedded = self.embedding[windows].reshape(len(windows), -1)
        step = embedded.strides[1]
        places = WINDOW - widest + 1
        unrolled = np.lib.stride_tricks.as_strided(
            embedded, (len(windows), places, widest * EMBEDDING),
            (embedded.strides[0], step * EMBEDDING, step))
        unrolled = np.ascontiguousarray(unrolled).reshape(-1, widest * EMBEDDING)
        answers = (unrolled @ self.filters).reshape(len(windows), places, -1)
        return answers, unrolled, embedded

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), BLOCK):
            answers, _, _ = self.hidden(windows[at:at + BLOCK])
            pooled = np.maximum(answers.max(axis=1) + self.filter_bias, 0)
            out[at:at + BLOCK] = softmax(pooled @ self.weights + self.bias)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def filter_mask() -> np.ndarray:
    mask = np.zeros((WIDTHS[-1] * EMBEDDING, FILTERS * len(WIDTHS)), np.float32)
    for n, width in enumerate(WIDTHS):
        mask[:width * EMBEDDING, n * FILTERS:(n + 1) * FILTERS] = 1
    return mask


def byte_windows(text: str) -> np.ndarray:
    """(n, WINDOW) bytes that cover the whole text in lower case, the last one padded with blanks."""
    data = text.lower().encode("utf-8", "replace")
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW)


def train(samples: list[tuple[str, str]], seed: int = 11) -> Network:
    """A network from (text, language) samples, each of about one window."""
    languages = sorted({lang for _, lang in samples})
    rng = np.random.default_rng(seed)
    widest, filters = WIDTHS[-1], FILTERS * len(WIDTHS)
    mask = filter_mask()
    p = {
        "embedding": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        "filters": (rng.normal(0, 0.3, (widest * EMBEDDING, filters)) * mask).astype(np.float32),
        "filter_bias": np.zeros(filters, np.float32),
        "weights": rng.normal(0, 0.1, (filters, max(1, len(languages)))).astype(np.float32),
        "bias": np.zeros(max(1, len(languages)), np.float32),
    }
    network = Network(languages, **p)
    if len(languages) < 2:
        return network
    windows = np.concatenate([byte_windows(text)[:1] for text, _ in samples])
    number = {lang: n for n, lang in enumerate(languages)}
    target = np.array([number[lang] for _, lang in samples])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    steps = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            steps += 1
            for name, grad in gradients(network, windows[pick], target[pick], mask).items():
                # Adam with its usual decay rates.
                first, second = moments[name]
                first += 0.1 * (grad - first)
                second += 0.001 * (grad * grad - second)
                scale = STEP * np.sqrt(1 - 0.999 ** steps) / (1 - 0.9 ** steps)
                getattr(network, name)[...] -= (scale * first / (np.sqrt(second) + 1e-8)).astype(np.float32)
    return network


def gradients(network: Network, windows: np.ndarray, target: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    n, widest = len(windows), WIDTHS[-1]
    answers, unrolled, _ = network.hidden(windows)
    best = answers.argmax(axis=1)  # (n, filters)
    raw = np.take_along_axis(answers, best[:, None], axis=1)[:, 0] + network.filter_bias
    pooled = np.maximum(raw, 0)
    error = softmax(pooled @ network.weights + network.bias)
    error[np.arange(n), target] -= 1
    error /= n
    back = (error @ network.weights.T) * (raw > 0)  # (n, filters)
    places = WINDOW - widest + 1
    chosen = unrolled.reshape(n, places, -1)[np.arange(n)[:, None], best]  # (n, filters, inputs)
    inputs = back[:, :, None] * network.filters.T[None]  # to the embedded bytes behind each answer
    embedding = np.zeros_like(network.embedding)
    for offset in range(widest):
        which = windows[np.arange(n)[:, None], best + offset]
        np.add.at(embedding, which, inputs[:, :, offset * EMBEDDING:(offset + 1) * EMBEDDING])
    return {
        "weights": pooled.T @ error, "bias": error.sum(axis=0),
        "filters": np.einsum("nf,nfi->if", back, chosen) * mask, "filter_bias": back.sum(axis=0),
        "embedding": embedding,
    }


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """Pieces of about TRAIN_DOCUMENTS documents of each language, chosen by a hash among those that are not held out;
    TRAIN_WINDOWS stretches spread over each. A language's share follows from its count, so none is gathered."""
    free = docs.where("lang is not null and text is not null").where(~held_out())
    counts = free.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(HASH_RANGE)) / HASH_RANGE
    # A row per language: fewer than the network, which holds a column of weights for each, has numbers.
    chosen = free.join(F.broadcast(counts), "lang").where(draw < TRAIN_DOCUMENTS / F.col("n"))
    starts = [F.lit(1) + F.floor(F.length("text") * i / TRAIN_WINDOWS).cast("int") for i in range(TRAIN_WINDOWS)]
    pieces = chosen.select("lang", F.explode(F.array_distinct(F.array(
        *[F.col("text").substr(s, F.lit(WINDOW)) for s in starts]))).alias("piece"))
    rows = pieces.toPandas()
    found = [(t, lang) for t, lang in zip(rows["piece"], rows["lang"]) if LETTER.search(t)]
    return sorted(found)


def held_out():
    """A fifth of the documents, by the checksum of the doc_id; a document without one is never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


class Predictor:
    """(language, score) of each text."""

    def __init__(self, network: Network):
        self.network = network

    def __call__(self, found: list[str | None]) -> tuple[list[str], list[float]]:
        net = self.network
        names, scores = [UNDETERMINED] * len(found), [0.0] * len(found)
        known: list[int] = []
        windows: list[np.ndarray] = []
        pending = 0

        def settle() -> None:
            nonlocal pending
            if known:
                starts = np.cumsum([0, *[len(w) for w in windows[:-1]]])
                sums = np.add.reduceat(net.probabilities(np.concatenate(windows)), starts, axis=0)
                mean = sums / np.array([[len(w)] for w in windows])
                for row, b, s in zip(known, mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist()):
                    names[row], scores[row] = net.languages[b], min(1.0, s)
            known.clear()
            windows.clear()
            pending = 0

        for row, text in enumerate(found):
            if net.languages and text and LETTER.search(text):
                known.append(row)
                windows.append(byte_windows(text))
                pending += len(windows[-1])
                if pending > 16_384:
                    settle()
        settle()
        return names, scores


def fitted(docs: DataFrame):
    """Broadcast predictor learnt from docs (doc_id, text, lang)."""
    network = train(training_sample(docs.select("doc_id", "text", "lang")))
    return docs.sparkSession.sparkContext.broadcast(Predictor(network))


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from text and lang of documents that are not held out; predicts from the text alone. A text that is null
    or has no letter is `und` with score 0, and so is every text when there is nothing to learn from. With one
    language only, that one is predicted. Null and repeated doc_ids stay as they are, other columns of docs are
    ignored, an empty table gives an empty one.
    """
    model = fitted(docs)

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = model.value(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()),
             pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return arrow_map(docs.select("doc_id", "text", held_out().alias("held_out")), predict,
                     "doc_id long, held_out boolean, lang_pred string, score double")


def kept(docs: DataFrame, least: float) -> DataFrame:
    """The rows of docs (doc_id, text, lang, ...) whose language is found with a score of `least` or more; a null lang
    becomes the language found, other columns stay as they are."""
    model = fitted(docs)

    def filter_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = model.value(batch.column("text").to_pylist())
        place = batch.schema.get_field_index("lang")
        lang = [old if old is not None else new for old, new in zip(batch.column(place).to_pylist(), names)]
        filled = batch.set_column(place, batch.schema.field(place), pa.array(lang, pa.string()))
        return filled.filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, scores)]))

    return arrow_map(docs, filter_rows, docs.schema)

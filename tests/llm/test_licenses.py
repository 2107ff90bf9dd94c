"""Licence scan against word counting and a full edit-distance table."""

import random
import re
import time

import numpy as np
import pytest

from gridspark.llm import licenses


def least_edits(notice: str, words: str) -> int:
    """Smallest edit distance between the notice and any part of words: one row of the table per character."""
    row = np.zeros(len(words) + 1, int)
    for i, c in enumerate(notice, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, d in enumerate(words, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
        row = new
    return int(row.min())


def damaged(rng: random.Random, text: str, edits: int) -> str:
    for _ in range(edits):
        at = rng.randrange(1, len(text) - 1)
        text = rng.choice([text[:at] + text[at + 1:], text[:at] + rng.choice("xqz") + text[at:],
                           text[:at] + rng.choice("xqz") + text[at + 1:]])
    return text


@pytest.mark.parametrize("seed", range(25))
def test_every_place_within_the_edits_is_found(seed):
    rng = random.Random(seed)
    filler = lambda: " ".join(rng.choice(["the", "rights", "public", "license", "all", "reserved", "and", "of"])
                              for _ in range(rng.randrange(0, 8)))
    notice, _ = rng.choice(licenses.NOTICES)
    text = f"{filler()} {damaged(rng, notice, rng.randrange(0, licenses.edits_allowed(notice) + 3))} {filler()}"
    words = licenses.normal_words(text)
    found = {m["notice"] for m in licenses.fuzzy_matches(words)}
    assert found == {n for n, _ in licenses.NOTICES if least_edits(n, words) <= licenses.edits_allowed(n)}
    for m in licenses.fuzzy_matches(words):
        assert least_edits(m["notice"], m["matched"]) <= m["edits"] <= licenses.edits_allowed(m["notice"])
        assert words.split(" ")[m["first_word"]].startswith(m["matched"].strip().split(" ")[0][:1]) or m["edits"]


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return (len(words), len(places), min((w for w, _ in places), default=None),
            max((w for w, _ in places), default=None), ",".join(sorted({x for _, x in places})))


TEXTS = [
    None, "", "...", "CC BY", "cc by cc-by CC  BY", "All rights\nreserved. All Rights Reserved!", "ÀLL rights reserved",
    "GNU General Public License, version 3 " * 50, "xcc by", "cc byx", "ccby", "all all rights reserved reserved", "É cc by é",
    "word " * 20_000 + "all rights reserved",
]


def test_rows(spark):
    docs = spark.createDataFrame([(i // 2 if i else None, t, 7) for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, score int")
    got = licenses.license_scan(docs).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    want = [(i // 2 if i else None, *brute_base(t)) for i, t in enumerate(TEXTS)]
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted(
        want, key=key)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_spans_stand_in_the_text():
    rng = random.Random(9)
    for _ in range(60):
        notice, _ = rng.choice(licenses.NOTICES)
        shown = "".join(c.upper() if rng.random() < 0.3 else rng.choice((" ", "\n", " - ", "\u2014 ")) if c == " " else c for c in notice)
        text = f"é {'word, ' * rng.randrange(4)}[{damaged(rng, shown, rng.randrange(2))}] and more."
        for m in licenses.scan_text(text)["matches"]:
            assert licenses.normal_words(text[m["start"]:m["end"]]) == m["matched"].strip()


def test_query_reports_spans(spark):
    from gridspark.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = [r for r in QUERIES["op1_license_scan"](spark, folder).collect() if r.spans]
    assert found
    for r in found:
        for label, start, end, edits in (s.split(":") for s in r.spans.split(",")):
            words = licenses.normal_words(documents[r.doc_id][int(start):int(end)])
            assert min(least_edits(n, words) for n, x in licenses.NOTICES if x == label) <= int(edits) and label in r.labels.split(",")


def test_one_megabyte_of_hits():
    text = "cc by " * 200_000
    start = time.time()
    assert licenses.scan_text(text)["n_base"] == 200_000
    assert time.time() - start < 10


@pytest.mark.parametrize("part", ["general public license ", "genral public licence ", "permission is hereby "])
def test_many_notices_take_time_in_proportion(part):
    took = []
    for size in (50_000, 200_000):
        start = time.time()
        licenses.scan_text(part * (size // len(part)))
        took.append(time.time() - start)
    assert took[1] < 10 * took[0] + 0.5

"""Licence notices in texts: exact phrases, and short notices with a bounded number of edits.

A notice of length m that may differ by k edits is cut into k + 1 pieces. By the pigeonhole principle
any place within k edits holds one piece unchanged and at most k characters from its expected place,
so one pass for the pieces of all notices gives every window in which a match can lie. Only
windows are given to the bounded-error matcher, which confirms the edits and reports the span.

Both searches work on the text's words: A-Z in lower case, every other ASCII character that is no
letter or digit a separator, words joined by one blank.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridspark.llm.common import arrow_map, texts

# Exact phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Short notices found with edits, and their labels.
NOTICES = (
    ("all rights reserved", "reserved"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
    ("general public license", "gpl"),
    ("licensed under the apache license", "apache"),
    ("licensed under the mit license", "mit"),
    ("mozilla public license", "mpl"),
    ("permission is hereby granted free of charge", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
)
CHARACTERS_PER_EDIT = 8

WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, matches array<struct<label:string,notice:string,start:long,end:long,first_word:long,edits:int,"
    "matched:string>>"
)
# The words of normal_words() where they stand in the text itself.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def normal_words(text: str) -> str:
    """The text's words joined by one blank."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()).decode("utf-8", "replace")


def edits_allowed(notice: str) -> int:
    return len(notice) // CHARACTERS_PER_EDIT


def pieces(notice: str) -> list[tuple[int, str]]:
    """Offset and text of k + 1 pieces whose lengths differ by one at most."""
    k, m = edits_allowed(notice), len(notice)
    cuts = [m * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.cache
def seed_automaton():
    import ahocorasick

    seeds: dict[str, list[tuple[int, int]]] = {}
    for n, (notice, _) in enumerate(NOTICES):
        for offset, piece in pieces(notice):
            seeds.setdefault(piece, []).append((n, offset))
    automaton = ahocorasick.Automaton()
    for piece, places in seeds.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return automaton


@functools.cache
def matcher(notice: str):
    return regex.compile(f"(?e)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits_allowed(notice)}}}")


def windows(words: str) -> dict[int, list[list[int]]]:
    """Per notice the merged character windows in which a match can lie."""
    found: dict[int, list[list[int]]] = {}
    for end, (length, places) in seed_automaton().iter(words):
        for n, offset in places:
            notice = NOTICES[n][0]
            k, start = edits_allowed(notice), end + 1 - length - offset
            found.setdefault(n, []).append([max(0, start - k), min(len(words), start + len(notice) + k)])
    for n, spans in found.items():
        spans.sort()
        merged = spans[:1]
        for span in spans[1:]:
            if span[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], span[1])
            else:
                merged.append(span)
        found[n] = merged
    return found


class BlankCount:
    """Blanks before growing places of a text: what was counted is not counted again."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.blanks = text, 0, 0

    def before(self, place: int) -> int:
        self.blanks += self.text.count(" ", self.at, place)
        self.at = place
        return self.blanks


def fuzzy_matches(words: str) -> list[dict]:
    """Leftmost non-overlapping matches of every notice within its edits; start and end are places in words."""
    out = []
    for n, spans in sorted(windows(words).items()):
        notice, label = NOTICES[n]
        counted = BlankCount(words)
        for start, end in spans:
            for m in matcher(notice).finditer(words, start, end):
                matched = m.group()
                first = m.start() + len(matched) - len(matched.lstrip())
                out.append({
                    "label": label, "notice": notice, "edits": sum(m.fuzzy_counts), "matched": matched,
                    "start": first, "end": first + len(matched.strip()), "first_word": counted.before(first),
                })
    return out


def in_text(text: str, words: str, matches: list[dict]) -> list[dict]:
    """The matches with start and end as code points of the text itself."""
    if not matches:
        return matches
    own = [m.start() for m in WORD.finditer(text)]
    here = [0, *accumulate(len(w) + 1 for w in words.split(" "))]

    def place(at: int) -> int:
        word = bisect_right(here, at) - 1
        return own[word] + at - here[word]

    # The end is one past the last character, which lies in a word.
    return [{**m, "start": place(m["start"]), "end": place(m["end"] - 1) + 1} for m in matches]


def phrase_places(words: str) -> list[tuple[int, str]]:
    """(word index, label) of every place at which an exact phrase's words stand."""
    padded, out = f" {words} ", []
    for phrase, label in PHRASES:
        counted = BlankCount(padded)
        at = padded.find(f" {phrase} ")
        while at >= 0:
            out.append((counted.before(at), label))
            at = padded.find(f" {phrase} ", at + 1)
    return out


def scan_text(text: str) -> dict:
    words = normal_words(text)
    base = phrase_places(words)
    matches = in_text(text, words, fuzzy_matches(words))
    scores = [1.0] * bool(base) + [1 - m["edits"] / len(m["notice"]) for m in matches]
    return {
        "n_words": words.count(" ") + 1 if words else 0,
        "n_base": len(base),
        "first_word": min((w for w, _ in base), default=None),
        "last_word": max((w for w, _ in base), default=None),
        "base_labels": ",".join(sorted({label for _, label in base})),
        "labels": ",".join(sorted({label for _, label in base} | {m["label"] for m in matches})),
        "score": max(scores, default=0.0),
        "matches": matches,
    }


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text), with its notices.

    matches lists the bounded-error matches (label, notice, start and end in code points of the text, end exclusive,
    first word, edits, matched words); score is
    the closeness of the best match, 1 for an exact phrase, 0 without any. A null text counts as empty: no
    words, empty labels, null first and last word. Null and repeated doc_ids stay as they are, other
    columns of docs are ignored, an empty table gives an empty one. Rows are independent: nothing is shuffled.
    """
    types = pa.schema([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("matches", pa.list_(pa.struct([
            ("label", pa.string()), ("notice", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
            ("first_word", pa.int64()), ("edits", pa.int32()),
            ("matched", pa.string())]))),
    ])

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.RecordBatch.from_pylist([scan_text(t) for t in texts(batch)], schema=types)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *found.columns], names=["doc_id", *types.names])

    return arrow_map(docs.select("doc_id", "text"), scan, SCHEMA)

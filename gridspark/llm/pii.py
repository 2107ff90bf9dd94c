"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds and their rules, matches leftmost and non-overlapping within a kind, failing ones dropped:
email, ip (parts up to 255), card (14 to 19 digits, Luhn), phone (10 to 15 digits after a plus), and
iban (country code, two check digits, 15 to 34 characters, remainder 1 modulo 97), and secret (the value assigned to a token,
key or password, of 16 or more characters, letters and digits mixed).
A span's score is that of its kind, higher near words that speak for it and lower near words that speak for something
else, such as a version number. All spans are reported with their scores; masking takes those from MASK_FROM on.
Spans are code points, end exclusive.

The patterns are written so that none looks at a stretch of text more than a constant number of
times: e-mails start from their @, runs of digits are entered at their first digit only.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from gridspark.llm.common import arrow_map, texts

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE_KINDS = KINDS[:4]

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:token|secret|password|passwd|pwd|api[_-]?key|secret[_-]?key|access[_-]?key|private[_-]?key)"
    r"[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?([A-Za-z0-9+/_.~-]{16,512}+={0,2})", re.I)

# Score of a kind without context, and whole words that raise or lower it when they stand near a span.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "secret": 0.8}
CONTEXT = {
    "email": ("mail", "email", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "adresse", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil", "appel"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "secret": ("key", "login", "private", "confidential", "bearer", "authorization"),
}
AGAINST = {
    "email": ("example", "placeholder"),
    "ip": ("version", "release", "section", "chapter", "firmware", "kapitel", "capítulo", "chapitre"),
    "card": ("isbn", "tracking", "serial", "barcode"),
    "phone": ("isbn", "version", "formula"),
    "iban": ("example", "placeholder"),
    "secret": ("example", "placeholder", "checksum"),
}
CONTEXT_CHARS = 40
CONTEXT_GAIN, CONTEXT_LOSS = 0.2, 0.3
# Score from which a span is masked: an address that only looks like one beside "version" stays, one of a server goes.
MASK_FROM = 0.4
CONTEXT_WORD = re.compile(r"[^\W\d_]+")

SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_iban long,"
    " n_secret long, scores string, found array<struct<kind:string,start:long,end:long,score:double>>"
)


def emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            out.append((start, last))
        # A later match may not reach back over this @: it is no local character.
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        value = int(d) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small_parts(address: str) -> bool:
    return all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in address.split("."))


def is_card(match: str) -> bool:
    digits = only_digits(match)
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_iban(match: str) -> bool:
    plain = match.replace(" ", "")
    return 15 <= len(plain) <= 34 and mod97(plain)


def proposals(text: str) -> dict[str, list[tuple[int, int]]]:
    """Confirmed spans by kind."""
    out = {"email": emails(text)}
    out["ip"] = [m.span() for m in IP.finditer(text) if small_parts(m[0])]
    out["card"] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 14 and is_card(m[0])]
    out["phone"] = (
        [m.span() for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15] if "+" in text else []
    )
    out["iban"] = [m.span() for m in IBAN.finditer(text) if is_iban(m[0])]
    out["secret"] = [m.span(1) for m in SECRET.finditer(text) if is_mixed(m[1])] if "=" in text or ":" in text else []
    return out


def is_mixed(value: str) -> bool:
    return any(map(str.isdigit, value)) and any(map(str.isalpha, value))


def score(text: str, kind: str, start: int, end: int) -> float:
    """Score of a span, from 0 to 1, in thousandths. A word cut off by the ends of the context is no context."""
    low, high = max(0, start - CONTEXT_CHARS), min(len(text), end + CONTEXT_CHARS)
    around = {w.lower() for a, b in ((low, start), (end, high)) for w in CONTEXT_WORD.findall(text, a, b)
              if len(w) <= CONTEXT_CHARS}
    gain = CONTEXT_GAIN * (not around.isdisjoint(CONTEXT[kind])) - CONTEXT_LOSS * (not around.isdisjoint(AGAINST[kind]))
    return round(max(0.0, min(1.0, PRIOR[kind] + gain)), 3)


def find_in_text(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, ordered."""
    return sorted((s, KINDS.index(kind), e) for kind, spans in proposals(text).items() for s, e in spans)


def join_spans(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans if KINDS[k] in kinds)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): counts by kind, digest of the base spans, all spans.

    found lists every span with its score, scores the scores alone, in the order of spans. A null text counts as empty: zero counts, empty spans and the
    digest of the empty string. Null and repeated doc_ids stay as they are, other columns of docs are
    ignored, an empty table gives an empty one. Rows are independent: nothing is shuffled.
    """
    found_type = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, joined, scores, found = [], [], [], []
        for text in texts(batch):
            spans = find_in_text(text)
            for n, kind in enumerate(KINDS):
                counts[kind].append(sum(k == n for _, k, _ in spans))
            digests.append(hashlib.sha256(join_spans(spans, BASE_KINDS).encode()).hexdigest())
            joined.append(join_spans(spans, KINDS))
            found.append([
                {"kind": KINDS[k], "start": s, "end": e, "score": score(text, KINDS[k], s, e)} for s, k, e in spans
            ])
            scores.append(",".join(f"{f['score']:g}" for f in found[-1]))
        arrays = [
            batch.column("doc_id"), *[pa.array(counts[k], pa.int64()) for k in BASE_KINDS], pa.array(digests),
            pa.array(joined), pa.array(counts["iban"], pa.int64()), pa.array(counts["secret"], pa.int64()),
            pa.array(scores, pa.string()), pa.array(found, found_type),
        ]
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_iban", "n_secret", "scores", "found"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return arrow_map(docs.select("doc_id", "text"), find, SCHEMA)


def masked(text: str) -> str:
    """The text with every span that scores MASK_FROM or more replaced by its kind in angle brackets; overlapping spans merge
    under the first."""
    out, last, open_end = [], 0, -1
    for start, kind, end in find_in_text(text):
        if score(text, KINDS[kind], start, end) < MASK_FROM:
            continue
        if start < open_end:
            open_end = max(open_end, end)
            last = open_end
            continue
        out += [text[last:start], f"<{KINDS[kind].upper()}>"]
        last = open_end = end
    return "".join(out) + text[last:]


def mask_texts(docs: DataFrame) -> DataFrame:
    """docs (text, n_chars, ...) with masked texts; n_chars follows, null texts and their n_chars become or stay null."""

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [None if t is None else masked(t) for t in batch.column("text").to_pylist()]
        sizes = pa.array([None if t is None else len(t) for t in found], pa.int64())
        columns = {"text": pa.array(found, pa.string()), "n_chars": sizes}
        names = batch.schema.names
        return pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in names], names=names)

    return arrow_map(docs, mask, docs.schema)

"""Personal data against the plain patterns."""

import hashlib
import random
import re

import pytest

from gridspark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    spans = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    spans += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(spans)


def with_luhn(body: str) -> str:
    return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))


@pytest.mark.parametrize("seed", range(60))
def test_base_spans_equal_the_patterns(seed):
    rng = random.Random(seed)
    pool = ["a@b.c", "@", "x.y+z@", "foo@bar", ".com", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "0001.0.0.255", "+1 (555) 010-9999",
            "+49", " ", "-", ".", "é", "\n", with_luhn("411111111111111"), "4111-1111-1111-1111", "4111 1111 1111 1112",
            "12345678901234567890123", "word", "a@b.c@d.e", "%", "(", "٣"]
    text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 60)))
    assert [s for s in pii.find_in_text(text) if s[1] < 4] == plain(text)


def test_iban_and_score():
    text = "bank account DE89 3704 0044 0532 0130 00 and DE88370400440532013000"
    found = [s for s in pii.find_in_text(text) if s[1] == 4]
    assert [text[s:e] for s, _, e in found] == ["DE89 3704 0044 0532 0130 00"]
    assert pii.score(text, "iban", found[0][0], found[0][2]) == 1.0
    assert pii.score("x 1.2.3.4 y", "ip", 2, 9) == 0.5


def test_context_is_made_of_whole_words():
    def scored(text):
        start = text.index("10.0.0.1")
        return pii.score(text, "ip", start, start + 8)

    assert scored("ship at 10.0.0.1") == scored("10.0.0.1") == scored("ip " + "x" * 60 + " 10.0.0.1") == 0.5
    assert scored("the server, 10.0.0.1") == scored("10.0.0.1 is the HOST") == 0.7
    assert scored("version 10.0.0.1") == 0.2 and scored("10.0.0.1 versions") == 0.5
    assert scored("server version 10.0.0.1") == 0.4
    assert pii.masked("version 10.0.0.1 of server 10.0.0.2" + " x" * 40 + " 10.0.0.3") == (
        "version <IP> of server <IP>" + " x" * 40 + " <IP>")
    assert pii.masked("version 10.0.0.1" + " x" * 40) == "version 10.0.0.1" + " x" * 40


def test_assigned_secrets():
    value = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    for text in (f'a token = "{value}" b', f"API_KEY:{value}", f"x&password={value}", f"### token = '{value}'###"):
        (start, kind, end), = [s for s in pii.find_in_text(text) if s[1] == 5]
        assert text[start:end] == value
        assert value not in pii.masked(text) and "<SECRET>" in pii.masked(text)
    for text in (f"betoken = {value}", f"token {value}", "token = 1234567890123456", "secret: internationalisation", "key = " + value):
        assert not [s for s in pii.find_in_text(text) if s[1] == 5]


def test_secrets_of_given_documents_are_found(spark):
    from gridspark.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    planted = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").collect()
               if re.search('token = "[0-9a-f]{40}"', r.text or "")}
    got = {r.doc_id: r for r in QUERIES["op4_pii"](spark, folder).collect()}
    assert planted and planted == {d for d, r in got.items() if r.n_secret}
    assert all(len(r.scores.split(",")) == len(r.spans.split(",")) for r in got.values())


def test_masking_leaves_no_span():
    text = "mail a.b@c.de or +49 30 1234567, card 4111 1111 1111 1111 at 10.0.0.1, clean tail."
    masked = pii.masked(text)
    assert masked.startswith("mail <EMAIL> or <PHONE>, card <CARD> at <IP>, clean tail.")
    assert not pii.find_in_text(masked)
    assert pii.masked("nothing here") == "nothing here"


def test_long_runs_stay_fast():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000, "1 " * 150_000, "token = " * 40_000, "token=" + "a1" * 200_000):
        pii.find_in_text(text)


def test_rows(spark):
    texts = [None, "", "a@b.cd", "a@b.cd", "x" * 50_000 + " 1.2.3.4"]
    docs = spark.createDataFrame([(None if i == 1 else 5, t, "c") for i, t in enumerate(texts)],
                                 "doc_id long, text string, spans string")
    got = pii.find_pii(docs).collect()
    want = []
    for i, t in enumerate(texts):
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain(t or ""))
        want.append((None if i == 1 else 5, hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert sorted(((r.doc_id, r.base_sha256, r.spans) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r.n_email for r in got) == 2 and sum(r.n_ip for r in got) == 1
    assert pii.find_pii(docs.limit(0)).count() == 0

"""Repair against all edits of short conversations, and plain damage."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

from gridspark.llm import conversations as conv
from gridspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, messages) by trying all edits: every right sequence of roles up to two messages a row."""
    marks = faults(rows)
    best = None
    alphabet = [""] + [s + "ua" * n for n in range(1, len(rows) + 2) for s in ("", "s")]
    for roles in alphabet:
        # All ways to spell the roles from the rows in order: (rows used, roles made, cost, audit, messages).
        open_ = [(0, 0, 0, "", ())]
        while open_:
            i, k, cost, audit, made = open_.pop()
            if best and cost > best[0]:
                continue
            if i == len(rows) and k == len(roles):
                best = min(best or (cost, audit, made), (cost, audit, made))
                continue
            if i < len(rows):
                role, text = rows[i]
                open_.append((i + 1, k, cost + 4, audit + "D", made))
                if k < len(roles) and marks[i] not in ("blank", "duplicate"):
                    more = cost + 3 * (marks[i] == "truncated")
                    if role[:1] == roles[k]:
                        open_.append((i + 1, k + 1, more, audit + "K", (*made, (role, text))))
                    if roles[k] in "ua":
                        open_.append((i + 1, k + 1, more + 3, audit + "R", (*made, ({"u": "user", "a": "assistant"}[roles[k]], text))))
            if k < len(roles) and roles[k] in "ua":
                open_.append((i, k + 1, cost + 3, audit + "I", (*made, ({"u": "user", "a": "assistant"}[roles[k]], ""))))
    return best


def plain_damage(rows):
    """{conv_id: rows after damage}, rows being (conv_id, turn, role, text)."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        out[c] += [(t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (
            0 if kind == 0 else 2 if kind == 3 else 1)
    for found in out.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def plain_rows(rows):
    out = []
    for c, found in plain_damage(rows).items():
        turns = [t for t, _, _ in found if t is not None]
        messages = [(r, x) for _, r, x in found]
        marks = faults(messages)
        cost, audit, made = plain_repair(messages)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(messages, messages[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        text = "\n".join(f"{r}:{x}" for r, x in made)
        out.append((c, gaps, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


def repair(rows):
    marks, v = faults(rows), conv.Viterbi()
    made = [e for (role, text), m in zip(rows, marks) for e in v.feed(role, text, m in ("blank", "duplicate"), m == "truncated")]
    made += v.end()
    return v.cost, "".join(e for e, _, _ in made), tuple((r, x) for e, r, x in made if e != "D")


def test_all_short_conversations():
    rng = random.Random(4)
    for _ in range(700):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "", "u", "user"]), rng.choice(["a.", "b.", "c!", "d", "", "e?", "f."]))
                for _ in range(rng.randrange(7))]
        assert repair(rows) == plain_repair(rows), rows


def test_edits_come_out_as_soon_as_they_are_final():
    v, undecided, made = conv.Viterbi(), 0, 0
    for n in range(20_000):
        made += sum(1 for _ in v.feed(("user", "assistant")[n % 2], f"{n}.", False, False))
        undecided = max(undecided, n + 1 - made)
    assert undecided < 10
    assert "".join(e for e, _, _ in v.end())[-1:] == "K"


def test_two_repairs_undecided_to_the_end():
    """User messages only: every second is reroled, and which ones depends on the last. Ties stay cheap."""
    start = time.time()
    for n in (20_000, 20_001):
        cost, audit, _ = repair([("user", f"{i}.") for i in range(n)])
        assert (cost, len(audit)) == (3 * ((n + 1) // 2), n + n % 2)
        assert audit == ("KR" * (n // 2) if n % 2 == 0 else min(audit, "KR" * (n // 2) + "KI"))
    assert time.time() - start < 20
    for n in range(1, 8):
        rows = [("user", f"{i}.") for i in range(n)]
        assert repair(rows) == plain_repair(rows)


def test_query_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversation_repair"](spark, FOLDER)
    assert got.columns == ["conv_id", *conv.COUNTS, "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_rows(rows))


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.choice([None, 0, 1, 1, 2, 5]), rng.choice([None, "user", "assistant", "system", ""]),
             rng.choice([None, "", "a.", "a.", "b", "?!", " \t\x0b"])) for _ in range(36)]
    rows += [(8, -(1 << 63), "user", "x."), (9, 7, "user", "long " * 50_000 + ".")]
    gone = next(c for c in range(100, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "x."))
    schema = "conv_id long, turn long, role string, text string, copies string, seen int, digest int"
    table = spark.createDataFrame([(*r, "x", 7, 1) for r in rows], schema)
    key = lambda r: (r[0] is not None, r)
    got = sorted(map(tuple, conv.repair_damaged(table).collect()), key=key)
    assert got == sorted(plain_rows(rows), key=key)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert conv.repair_damaged(table.limit(0)).count() == conv.edits(table.limit(0)).count() == 0
    undamaged = defaultdict(list)
    filled = [(c, t, *(" " if v is None else v for v in rest)) for c, t, *rest in rows]
    for c, _, role, text in sorted(filled, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        undamaged[c].append((role, text))
    made = defaultdict(list)
    for r in sorted(conv.edits(table).collect(), key=lambda r: r.place):
        made[r.conv_id].append(r)
    for c, found in undamaged.items():
        cost, audit, messages = plain_repair(found)
        assert "".join(r.edit for r in made[c]) == audit
        assert tuple((r.role, r.text) for r in made[c] if r.edit != "D") == messages


def test_extreme_turns(spark):
    ends = [(c, t, "user", "x.") for c in range(30) for t in (-(1 << 63), (1 << 63) - 1)]
    got = conv.repaired(spark.createDataFrame([(*r, 1) for r in ends], "conv_id long, turn long, role string, text string, copies int"))
    assert {r.gaps for r in got.collect()} == {(1 << 63) - 1}

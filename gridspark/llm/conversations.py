"""Repair of damaged conversations by the cheapest edits, decided while their rows stream by.

A conversation is right when its roles read (s?(ua)+)? by their initials. Edits keep, rerole, delete or insert
messages; the cheapest ones are found by Viterbi's algorithm over four states (nothing yet, after the system's, the user's, the
assistant's message). Each state's survivor is a leaf of a tree of back pointers, whose nodes count what still refers
to them. Once all survivors descend from one node, the edits up to it are final: they are emitted and their rows released,
so a conversation of any length takes the memory of its undecided end only.

Equal costs are settled by the whole undecided sequences of edits, the least in ASCII order. Sequences of two survivors
over the same rows are never prefixes of one another, so their order is final once they part: each survivor carries its place in
that order, and ties compare places, then the edits of the last row, instead of reading the sequences again.

Spark damages the rows, finds their faults and brings each conversation's rows together in order, with one shuffle; tasks stream them.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import record_batch

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3
LEGAL = {"su", "ua", "au"}
# States; the last two letters are those of the role in them. A message of role r may follow the states of BEFORE[r].
START, SYSTEM, USER, ASSISTANT = range(4)
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
BEFORE = {"s": (START,), "u": (START, SYSTEM, ASSISTANT), "a": (USER,)}
NAME = {USER: "user", ASSISTANT: "assistant"}
# From any state all continuations of another can be followed for 10 more: insert user and assistant (6) and delete a
# system message (4). A survivor that costs more than that above the cheapest never wins or ties.
HOPELESS = 10
# Rows of an output batch.
BATCH = 2048


def next_role(state: int) -> int:
    """The role, as a state, that reroling and inserting give after a state."""
    return ASSISTANT if state == USER else USER


@functools.cache
def steps(initial: str, required: bool, truncated: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, edits) over one row with the insertions before it; required is whether it must be deleted."""
    out = []
    for start in range(4):
        state, cost, edits = start, 0, ""
        for _ in range(3):
            out.append((start, state, cost + COST[DELETE], edits + DELETE))
            if not required:
                more = cost + TRUNCATED * truncated
                if initial in BEFORE and state in BEFORE[initial]:
                    out.append((start, STATE[initial], more + COST[KEEP], edits + KEEP))
                out.append((start, next_role(state), more + COST[REROLE], edits + REROLE))
            state, cost, edits = next_role(state), cost + COST[INSERT], edits + INSERT
    return tuple(out)


@functools.cache
def endings() -> tuple[tuple[int, int, str], ...]:
    """(from, cost, edits) of the insertions that end a conversation rightly."""
    return ((START, 0, ""), (ASSISTANT, 0, ""), (USER, COST[INSERT], INSERT), (SYSTEM, 2 * COST[INSERT], 2 * INSERT))


@dataclass(eq=False)
class Node:
    """Edits over one row, with insertions before it, on top of the parent's."""

    parent: Node | None
    edits: str = ""
    row: tuple[str, str] | None = None
    children: set[Node] = field(default_factory=set)
    held: bool = True


@dataclass
class Survivor:
    cost: int
    place: int
    node: Node


class Viterbi:
    """Edits of one conversation; feed() and end() yield those that are final."""

    def __init__(self) -> None:
        self.root = Node(None)
        self.survivors = {START: Survivor(0, 0, self.root)}
        self.state = START
        self.cost = 0

    def release(self, node: Node) -> None:
        node.held = False
        while not node.held and not node.children and node.parent is not None:
            parent = node.parent
            parent.children.discard(node)
            node.parent = None
            node = parent

    def final(self) -> Iterator[tuple[str, str, str]]:
        """Edits up to the node from which all survivors descend."""
        while not self.root.held and len(self.root.children) == 1:
            (self.root,) = self.root.children
            self.root.parent = None
            yield from self.emitted(self.root.edits, self.root.row)

    def emitted(self, edits: str, row: tuple[str, str] | None) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) with the message as it becomes; a deleted one as it was."""
        for edit in edits:
            role, text = row if edit != INSERT else ("", "")
            if edit in (REROLE, INSERT):
                self.state = next_role(self.state)
                role = NAME[self.state]
            elif edit == KEEP:
                self.state = STATE[role[:1]]
            yield edit, role, text

    def feed(self, role: str, text: str, required: bool, truncated: bool) -> Iterator[tuple[str, str, str]]:
        best: dict[int, tuple[int, int, str, int]] = {}
        for start, to, cost, edits in steps(role[:1], required, truncated):
            old = self.survivors.get(start)
            if old:
                candidate = (old.cost + cost, old.place, edits, start)
                if to not in best or candidate < best[to]:
                    best[to] = candidate
        most = min(best.values())[0] + HOPELESS
        alive = sorted(((c[1], c[2], to) for to, c in best.items() if c[0] <= most))
        fresh: dict[int, Survivor] = {}
        for place, (_, edits, to) in enumerate(alive):
            cost, _, _, start = best[to]
            parent = self.survivors[start].node
            node = Node(parent, edits, (role, text))
            parent.children.add(node)
            fresh[to] = Survivor(cost, place, node)
        for old in self.survivors.values():
            self.release(old.node)
        self.survivors = fresh
        yield from self.final()

    def end(self) -> Iterator[tuple[str, str, str]]:
        open_ = [(s, c, e) for s, c, e in endings() if s in self.survivors]
        self.cost, _, edits, start = min(
            (self.survivors[s].cost + c, self.survivors[s].place, e, s) for s, c, e in open_)
        node, path = self.survivors[start].node, []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            yield from self.emitted(node.edits, node.row)
        yield from self.emitted(edits, None)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with every row damaged by a hash of its place: role and text (null: one
    blank), copies (how often the row stays: 0, 1 or 2)."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    text = F.coalesce("text", F.lit(" "))
    kind = F.col("kind")
    return conversations.select("conv_id", "turn", "role", "text", (F.crc32(place) % 20).alias("kind")).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with their faults, each conversation in one partition by turn (nulls first),
    then role and text, so that equal rows stand together.

    seen counts the equal rows (role and text) before a row; blank and truncated are by its text alone.
    """
    white = r"' \t\n\u000B\f\r'"
    ended = F.expr(f"trim(TRAILING {white} FROM text)")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    equal = Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())
    earlier = equal.rowsBetween(Window.unboundedPreceding, -1)
    return (rows.repartition("conv_id").withColumn("digest", digest)
            .withColumn("seen", F.coalesce(F.sum("copies").over(earlier), F.lit(0)).cast("long"))
            .select("conv_id", "turn", "role", "text", "copies", "seen", (ended == "").alias("blank"),
                    (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
            .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "seen"))


class Conversation:
    """Counts of the rows of one conversation, and its repair."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.role = None
        self.viterbi = Viterbi()

    def feed(self, turn, role, text, copies, seen, blank, truncated) -> Iterator[tuple[str, str, str]]:
        if copies and turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        for copy in range(copies):
            duplicate = not blank and seen + copy > 0
            cut = truncated and not blank and not duplicate
            self.blank, self.duplicate, self.truncated = (
                n + fault for n, fault in zip((self.blank, self.duplicate, self.truncated), (blank, duplicate, cut)))
            self.illegal += self.role is not None and self.role + role[:1] not in LEGAL
            self.role = role[:1]
            yield from self.viterbi.feed(role, text, blank or duplicate, cut)

    def gaps(self) -> int:
        return 0 if self.first is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, Iterator[tuple[str, str, str]]]]:
    """(conversation, some final edits) as the ordered rows stream by; a conversation's last pair comes from its end."""
    now: Conversation | None = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (
            "conv_id", "turn", "role", "text", "copies", "seen", "blank", "truncated")]
        for conv_id, *row in zip(*columns):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now, now.viterbi.end()
                now = Conversation(conv_id)
            yield now, now.feed(*row)
    if now is not None:
        yield now, now.viterbi.end()


def edits(rows: DataFrame) -> DataFrame:
    """The repair as rows (conv_id, place, edit, role, text), place from 0 in each conversation: K and R with the message as
    it becomes, I with the inserted one, D with the deleted one.

    rows (conv_id, turn, role, text) are taken by turn, nulls first, and rows of the same turn by role and text; null roles and texts
    count as one blank, other columns are ignored. A null conv_id is a conversation like others. Deleted are blank and repeated messages
    (same role and text as before), and others where that is cheapest. Empty tables give empty ones.
    """
    ready = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")],
                        F.lit(1).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        of, place = None, 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            return record_batch(**dict(zip(("conv_id", "place", "edit", "role", "text"), zip(zip(*out), kinds))))

        for conversation, found in streamed(batches):
            if conversation is not of:
                of, place = conversation, 0
            for edit in found:
                out.append((conversation.conv_id, place, *edit))
                place += 1
            if len(out) >= BATCH:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return in_order(ready).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, copies): conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit (the edits' letters) and repaired_sha256, the hash of the repaired messages as role:text lines.

    Rows are taken as in edits(); rows of 0 copies only say that the conversation exists. Without other rows its numbers are
    zero, its audit empty and its hash that of the empty string. Gaps beyond the largest long are given as that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        of, letters, text, any_ = None, [], None, False

        def close() -> None:
            out.append((of.conv_id, of.gaps(), of.blank, of.duplicate, of.truncated, of.illegal, of.viterbi.cost,
                        "".join(letters), text.hexdigest()))

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(),) * 7 + (pa.string(),) * 2
            return record_batch(**dict(zip(("conv_id", *COUNTS, "audit", "repaired_sha256"), zip(zip(*out), kinds))))

        for conversation, found in streamed(batches):
            if conversation is not of:
                if of is not None:
                    close()
                    if len(out) >= BATCH:
                        yield batch()
                        out.clear()
                of, letters, text, any_ = conversation, [], hashlib.sha256(), False
            for edit, role, message in found:
                letters.append(edit)
                if edit != DELETE:
                    text.update(f"{chr(10) * any_}{role}:{message}".encode("utf-8", "surrogatepass"))
                    any_ = True
        if of is not None:
            close()
            yield batch()

    names = ", ".join(f"{c} long" for c in COUNTS)
    return in_order(rows).mapInArrow(run, f"conv_id long, {names}, audit string, repaired_sha256 string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """repaired() of the damaged rows of conversations (conv_id, turn, role, text)."""
    return repaired(damaged(conversations))

"""Repair of conversation structure: the cheapest edits that make a conversation a dialogue.

A dialogue is nothing, or an optional system turn and then pairs of user and assistant turns.  Rows are kept, given another role
or deleted, and empty turns are inserted, at the least cost; of equally cheap edits the ones whose initials, in order,
come first as text.

Rows are repartitioned by conversation and sorted by turn; one pass carries the state of a dynamic programme across
Arrow batches, so a conversation of any length takes bounded memory.  Before a row and after the last one the edited
dialogue is in one of four STATES; for each the pass keeps the least cost, its rank among the states in the order of
their edits, and a running hash of its repaired text.  Edits that end at a row, in different states, are never
prefixes of one another, so the order of two never changes by what follows, and the ranks decide ties.  What a
row does to costs and ranks depends on few things only: such steps are made once and numbered.  A row's step number, two
bytes, is all that is kept of it; it holds the way back from each state.  The numbers of a giant conversation
go to a scratch file of the task attempt, beyond SPILL of them, and are read back from its end.

Which rows repeat an earlier one is not found in that pass, whose memory would grow with a conversation, but by an
aggregation: of each (conversation, role, text) one row, with its first turn, keeps its text; all rows follow without.
So a text that a conversation repeats is merged before any shuffle, and only its first row travels whole.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)  # what the edited dialogue ends with
ENDS = (NOTHING, ASSISTANT)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an inserted or rerolled turn becomes
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ORDERLY = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"
MOST_INSERTS = 2  # a third would only add another pair, which costs more than it can save
SPILL = 1 << 20  # step numbers in memory
FAULTS = ("blank", "duplicate", "truncated")

Way = tuple[int, str]  # the state before, and the initials of the edits since


def moves(initial: str, spoilt: bool, cut: bool) -> list[tuple[int, str, int, int]]:
    """(state before, edits, state after, cost) of a row; a ``spoilt`` one must be deleted, a ``cut`` one costs more if it stays."""
    out = []
    for start in STATES:
        state, inserted = start, ""
        for n in range(MOST_INSERTS + 1):
            out.append((start, inserted + "D", state, n * INSERT + DELETE))
            if not spoilt:
                own = INITIALS.get(initial)
                if own == NEXT[state] or (own == SYSTEM and state == NOTHING):
                    out.append((start, inserted + "K", own, n * INSERT + KEEP + cut * TRUNCATED))
                out.append((start, inserted + "R", NEXT[state], n * INSERT + REROLE + cut * TRUNCATED))
            state, inserted = NEXT[state], inserted + "I"
    return out


class Steps:
    """The numbered steps: each holds the way back from every state, None where it can't be reached."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.after: list[tuple[tuple, tuple, int]] = []  # costs above the least one, ranks, and what the least one grew by
        self.ways: list[tuple[Way | None, ...]] = []

    def take(self, costs: tuple, ranks: tuple, kind: tuple[str, bool, bool]) -> int:
        key = costs, ranks, kind
        if key not in self.number:
            best: list[tuple | None] = [None] * len(STATES)
            for start, edits, state, cost in moves(*kind):
                if costs[start] is not None:
                    tried = costs[start] + cost, ranks[start], edits, start
                    if best[state] is None or tried < best[state]:
                        best[state] = tried
            order = sorted((b[1:3], state) for state, b in enumerate(best) if b)
            place = {state: n for n, (_, state) in enumerate(order)}
            least = min(b[0] for b in best if b)
            self.number[key] = len(self.ways)
            self.after.append((tuple(b and b[0] - least for b in best), tuple(place.get(s) for s in STATES), least))
            self.ways.append(tuple(b and (b[3], b[2]) for b in best))
        return self.number[key]


class Trail:
    """Step numbers in order, read back from the end; beyond ``most`` they go to a scratch file of this task attempt."""

    def __init__(self, most: int = SPILL):
        self.own, self.most, self.spilled = array("H"), most, None

    def add(self, number: int) -> None:
        self.own.append(number)
        if len(self.own) >= self.most:
            if self.spilled is None:
                self.spilled = tempfile.TemporaryFile()
            self.own.tofile(self.spilled)
            self.own = array("H")

    def back(self) -> Iterator[int]:
        yield from reversed(self.own)
        if self.spilled:
            end, size = self.spilled.tell(), self.most * self.own.itemsize
            for at in range(end - size, -1, -size):
                self.spilled.seek(at)
                block = array("H")
                block.frombytes(self.spilled.read(size))
                yield from reversed(block)
            self.spilled.close()


class Conversation:
    """One conversation, as its rows come."""

    def __init__(self, steps: Steps, spill: int):
        self.steps, self.trail = steps, Trail(spill)
        self.costs, self.ranks, self.least = (0, None, None, None), (0, None, None, None), 0
        self.hashes = [hashlib.sha256(), None, None, None]
        self.counts = dict.fromkeys((*FAULTS, "illegal"), 0)
        self.first = self.last = self.before = None
        self.turns = 0

    def row(self, turn: int | None, role: str, text: bytes | None, fault: str | None) -> None:
        if turn is not None:
            self.turns += self.last is None or turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None:
            self.counts["illegal"] += self.before + initial not in ORDERLY
        self.before = initial
        n = self.steps.take(self.costs, self.ranks, (initial if initial in INITIALS else "", fault in ("blank", "duplicate"), fault == "truncated"))
        self.trail.add(n)
        self.hashes = [way and self.grown(*way, role, text) for way in self.steps.ways[n]]
        self.costs, self.ranks, more = self.steps.after[n]
        self.least += more

    def grown(self, state: int, edits: str, role: str, text: bytes | None):
        """The hash of the state before, with the turns that the edits add."""
        if edits == "D":
            return self.hashes[state]
        own = self.hashes[state].copy()
        for edit in edits:
            if edit != "D":
                own.update(b"" if state == NOTHING else b"\n")
                state = INITIALS[role[:1]] if edit == "K" else NEXT[state]
                own.update((role if edit == "K" else NAMES[state]).encode() + b":")
                if edit != "I":
                    own.update(text)
        return own

    def result(self) -> dict:
        best = None
        for state in STATES:
            if self.costs[state] is not None:
                end, inserted = state, ""
                while end not in ENDS:
                    end, inserted = NEXT[end], inserted + "I"
                tried = self.costs[state] + len(inserted) * INSERT, self.ranks[state], inserted, state
                best = tried if best is None or tried < best else best
        cost, _, inserted, state = best
        final = self.hashes[state].copy()
        end = state
        for _ in inserted:
            end = NEXT[end]
            final.update(f"\n{NAMES[end]}:".encode())
        parts = [inserted]
        for n in self.trail.back():
            state, edits = self.steps.ways[n][state]
            parts.append(edits)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, **self.counts, "cost": self.least + cost, "audit": "".join(reversed(parts)), "repaired_sha256": final.hexdigest()}


def either(c: str) -> Column:
    """A null is one space."""
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows damaged by crc32(``conv_id:turn``) % 20.  A dropped row stays as a
    mark of its conversation, with ``gone`` set."""
    kind = F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn"))) % 20
    rows = conversations.select("conv_id", "turn", either("role").alias("role"), either("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


FIRST, ROW, GONE = 0, 1, 2  # kinds of the records that the pass reads
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def records(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, kind, a, b, fault) in the pass's order: every row without its text, the first of each
    (role, text) after a FIRST record that holds it.  a and b tell the texts of a conversation's turn apart."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    marks = [F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b")]
    there = rows.where("NOT gone")
    # hash aggregation: strings are keys only
    first = there.groupBy("conv_id", "role", "text").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unknown"))
    first = first.select("conv_id", F.when(~F.col("unknown"), F.col("least")).alias("turn"), "role", F.col("text").cast("binary").alias("text"), F.lit(FIRST).alias("kind"), *marks, F.lit(None).cast("string").alias("fault"))
    every = there.select("conv_id", "turn", "role", F.lit(None).cast("binary").alias("text"), F.lit(ROW).alias("kind"), *marks, fault.alias("fault"))
    gone = rows.where("gone").select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("text"), F.lit(GONE).alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(None).cast("string").alias("fault"))
    return first.unionByName(every).unionByName(gone).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "a", "b", "kind")


def repair(rows: DataFrame, spill: int = SPILL) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of
    (conv_id, turn, role, text, gone).

    A row's first fault counts: blank (only ASCII white space), duplicate (role and text seen earlier in the conversation),
    truncated (its last other character is none of ``.!?``).  Rows of one turn come in the order of their roles, then of their
    texts' hashes; rows without a turn come first, and those without conv_id are one conversation.  Role and text are
    not null; a role counts by its first letter, and other letters can't be kept.  Where all rows are gone, counts
    are zero and audit and repaired text empty.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, own, at, held, out = Steps(), None, None, None, []

        def send() -> pa.RecordBatch:
            names = ["conv_id", *out[0][1]]
            columns = [pa.array([c for c, _ in out], kind), *(pa.array([r[n] for _, r in out]) for n in names[1:])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, turn, role, text, what, a, b, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "kind", "a", "b", "fault"))):
                if own is None or conv != at:
                    if own is not None:
                        out.append((at, own.result()))
                    own, at, held = Conversation(steps, spill), conv, None
                if what == FIRST:
                    held = (turn, a, b, role), text
                elif what == ROW:
                    known = held is not None and held[0] == (turn, a, b, role)
                    own.row(turn, role, held[1] if known else None, fault if known or fault == "blank" else "duplicate")
                    held = None
                if len(out) >= 1000:
                    yield send()
                    out = []
        if own is not None:
            out.append((at, own.result()))
        if out:
            yield send()

    ordered = records(rows)
    return ordered.mapInArrow(run, f"conv_id {dict(ordered.dtypes)['conv_id']}, {RESULT}")


def damaged_and_repaired(conversations: DataFrame, **options) -> DataFrame:
    """``repair`` of the rows that ``damage`` leaves of ``conversations``; nulls of role and text are one space, extra
    columns are ignored."""
    return repair(damage(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")), **options)

"""Repair of conversations: the cheapest edits after which roles follow ``(s?(ua)+)?``.

Rows of a conversation are taken by turn. Each is kept (0), given another role (3) or deleted (4); rows
without text and repeats of an earlier row must be deleted; turns without text may be put in anywhere
(3); a row that ends without ``.``, ``!`` or ``?`` costs 3 unless it is deleted. What the roles so far
allow next is one of four states (nothing yet, system, user, assistant), so the edits' initials fix the
repaired turns. A forward pass carries the least (cost, initials) of every state; at most two inserted
turns close a row's layer, as longer runs of them lead back to a state that was cheaper before.

Rows are shuffled once, by conversation, and sorted inside the task, which spills. They then stream
through the pass: a state keeps its cost, its rank among the others, a hash of its repaired turns so
far, and one byte a row to spell its edits at the end; texts are never held. Two states' initials up to
a row never begin one another (both end in that row's edit), so ranks decide between them. A hash over
all turns of a conversation can only be made in their order, so one conversation is one task's stream.

Edge cases: null roles and texts are read as one space (so such a text is blank), null turns come
first; rows of equal turn go by role and text; equal rows are duplicates after the first; null
conversation ids are one conversation; a conversation without rows has zeros and empty edits; an empty
table gives no rows. Only conv_id, turn, role and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrace.llm.common import fresh

#: White space, ends of a sentence, pairs of initials that may follow one another.
BLANKS = "\t\n\x0b\x0c\r "
ENDS = ".!?"
FOLLOWING = frozenset(("su", "ua", "au"))
#: States: nothing yet, after a system turn, after a user, after an assistant; the role that may come next.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
#: Costs of other roles, deleted rows, inserted turns and rows that end early.
REROLE, DELETE, INSERT, EARLY = 3, 4, 3, 3

REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"


def _chains() -> list[tuple[int, int, int]]:
    """(from, to, inserted turns) of every way to close a layer: up to two, and none that leads back."""
    found = [(s, s, 0) for s in range(4)]
    for start in range(4):
        state = start
        for n in (1, 2):
            state = NEXT[state][1]
            if state != start:
                found.append((start, state, n))
    return found


def _moves(initial: str, must_go: bool, early: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, initials of the edits) of a row, the best of each pair of states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start, state, n in _chains():
        ways = [(state, DELETE, "D")]
        if not must_go:
            extra, nxt = EARLY if early else 0, NEXT[state]
            ways.append((nxt[1], REROLE + extra, "R"))
            if initial == nxt[0][0]:
                ways.append((nxt[1], extra, "K"))
            if initial == "s" and state == NOTHING:
                ways.append((SYSTEM, extra, "K"))
        for to, cost, letter in ways:
            way = (cost + INSERT * n, "I" * n + letter)
            best[start, to] = min(way, best.get((start, to), way))
    return [(start, to, cost, edits) for (start, to), (cost, edits) in sorted(best.items())]


MOVES = {(i, m, e): _moves(i, m, e) for i in "sua-" for m in (False, True) for e in (False, True)}
#: How the last layer is closed: inserted turns from each state to one where a conversation may end.
CLOSING = ("", "II", "I", "")
EDITS = sorted({edits for moves in MOVES.values() for *_, edits in moves})
CODE = {edits: k for k, edits in enumerate(EDITS)}


@dataclass
class Pass:
    """The forward pass over one conversation: per state cost, rank and hash; per row and state where it came from."""

    states: dict[int, tuple[int, int, object]] = field(default_factory=lambda: {NOTHING: (0, 0, sha256())})
    trail: bytearray = field(default_factory=bytearray)

    def add(self, role: str, text: str, must_go: bool, early: bool) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
        best: dict[int, tuple[int, int, str, int]] = {}
        for start, to, cost, edits in MOVES[initial, must_go, early]:
            if start in self.states:
                way = (self.states[start][0] + cost, self.states[start][1], edits, start)
                if to not in best or way < best[to]:
                    best[to] = way
        ranks = {to: k for k, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
        before, self.states, origin = self.states, {}, bytearray(4)
        for to, (cost, _, edits, start) in best.items():
            self.states[to] = (cost, ranks[to], _written(before[start][2], start, edits, role, text))
            origin[to] = start << 6 | CODE[edits]
        self.trail += origin

    def end(self) -> tuple[int, str, str]:
        """Cost, edits and hash of the cheapest repair."""
        cost, _, closing, state = min((cost + INSERT * len(CLOSING[s]), rank, CLOSING[s], s) for s, (cost, rank, _) in self.states.items())
        digest = _written(self.states[state][2], state, closing, "", "").hexdigest()
        edits = [closing]
        for at in range(len(self.trail) - 4, -1, -4):
            own = self.trail[at + state]
            edits.append(EDITS[own & 63])
            state = own >> 6
        return cost, "".join(reversed(edits)), digest


def _written(digest, state: int, edits: str, role: str, text: str):
    """The hash after the turns that the edits write from a state on; the hash given stays as it is."""
    if edits == "D" or not edits:
        return digest
    digest = digest.copy()
    for letter in edits:
        if letter == "D":
            continue
        own, to = (role, SYSTEM if state == NOTHING and role[:1] == "s" else NEXT[state][1]) if letter == "K" else NEXT[state]
        digest.update(f"{'' if state == NOTHING else chr(10)}{own}:{'' if letter == 'I' else text}".encode())
        state = to
    return digest


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that a checksum of ``conv_id:turn`` deals out; rows taken away
    stay as marks (dropped), so that no conversation is lost."""
    blank = F.lit(" ")
    conv_id, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    fault = F.crc32(F.concat(F.coalesce(conv_id.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text, ENDS, "")).otherwise(text)
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = turns.select(
        conv_id.alias("conv_id"), turn.alias("turn"), F.when(fault == 4, "user").otherwise(role).alias("role"), text.alias("text"), (fault == 0).alias("dropped"), copies
    )
    return rows.select("conv_id", "turn", "role", "text", "dropped")


def _ordered(turns: DataFrame, dropped: Column) -> DataFrame:
    """(conv_id, turn, role, text, dropped, blank, again, early) by conversation and turn in one shuffle."""
    nth, digest = fresh("nth", "digest")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    bare = F.rtrim(text, F.lit(BLANKS))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), dropped.alias("dropped"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("early"), F.md5(F.when(~dropped, text)).alias(digest),
    )
    same = Window.partitionBy("conv_id", "role", digest, "dropped").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.repartition("conv_id").withColumn(nth, F.row_number().over(same))  # the shuffle serves the window too
    rows = rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", nth)
    return rows.select("conv_id", "turn", "role", "text", "dropped", "blank", (F.col(nth) > 1).alias("again"), "early")


def repair_report(turns: DataFrame, dropped: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    ``dropped`` says which rows only stand for their conversation."""
    rows = _ordered(turns, F.lit(False) if dropped is None else dropped)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in REPORT.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        done: list[tuple] = []
        own: _Conversation | None = None
        for batch in batches:
            for part in range(0, batch.num_rows, 256):  # texts become Python strings a few at a time
                for row in zip(*(c.to_pylist() for c in batch.slice(part, 256).columns)):
                    if own is None or own.conv_id != row[0]:
                        if own is not None:
                            done.append(own.report())
                        own = _Conversation(row[0])
                    if not row[4]:
                        own.add(*row[1:4], *row[5:])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
                done = []
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(own.report(), kinds)], names)

    return rows.mapInArrow(report, REPORT)


class _Conversation:
    """Counts of one conversation's faults, and its forward pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.steps = conv_id, Pass()
        self.first = self.last = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, again: bool, early: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += early and not blank and not again
        self.illegal += self.before is not None and self.before + role[:1] not in FOLLOWING
        self.before = role[:1]
        self.steps.add(role, text, blank or again, early and not blank)

    def report(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.steps.end())


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role and text of the turns of every repaired conversation."""
    audits = repair_report(turns).select("conv_id", "audit")
    audit = fresh("audit")[0]
    rows = turns.join(audits.select(F.col("conv_id").alias("own"), F.col("audit").alias(audit)), F.col("conv_id").eqNullSafe(F.col("own"))).drop("own")
    first = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")))
    # Edits of a row are those since the former row's; inserted turns at the end go with the last row.
    own = F.split(F.regexp_replace(audit, "([DKR])(?=I*[DKR])", "$1,"), ",")
    rows = rows.withColumn(audit, F.element_at(own, F.row_number().over(first)))
    place, state = fresh("place", "state")
    letters = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.posexplode(F.split(audit, "")).alias(place, "edit"))
    letters = letters.where("edit in ('K', 'R', 'I')")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", place)
    letters = letters.withColumn(state, F.row_number().over(order) - 1)
    led = F.first(F.when((F.col(state) == 0) & (F.col("edit") == "K") & F.col("role").startswith("s"), 1), True).over(Window.partitionBy("conv_id"))
    letters = letters.withColumn("led", F.coalesce(led, F.lit(0)))
    role = F.when(F.col("edit") == "K", F.col("role")).when((F.col(state) - F.col("led")) % 2 == 0, "user").otherwise("assistant")
    return letters.select("conv_id", F.col(state).cast("long").alias("place"), "edit", role.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))

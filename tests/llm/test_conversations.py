"""Repair of conversations against all sequences of edits, and the repaired turns against their hash."""

import re
import zlib
from hashlib import sha256
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seatrace.llm import conversations, queries
from tests.compare import assert_same
from tests.llm.samples import SF, rows

BLANK = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
        seen.add((role, text))
        out.append((fault, BLANK.search(text) is not None and last not in (".", "!", "?")))
    return out


def cheapest(turns):
    """The least (cost, edits, text) over all edits with up to two turns inserted at a place."""
    runs = [r for n in range(3) for r in product(("user", "assistant"), repeat=n)]
    options = []
    for (role, text), (fault, early) in zip(turns, faults(turns)):
        own = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            own += [("K", 3 * early, (role, text)), *(("R", 3 + 3 * early, (to, text)) for to in ("user", "assistant"))]
        options.append(own)
    best = None
    for edits in product(*options):
        for puts in product(runs, repeat=len(turns) + 1):
            audit, cost, lines = "", 0, []
            for k, run in enumerate(puts):
                audit, cost = audit + "I" * len(run), cost + 3 * len(run)
                lines += [(r, "") for r in run]
                if k < len(edits):
                    audit, cost = audit + edits[k][0], cost + edits[k][1]
                    lines += [edits[k][2]] if edits[k][2] else []
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    return best


def passed(turns):
    steps, seen = conversations.Pass(), set()
    for (role, text), (fault, early) in zip(turns, faults(turns)):
        steps.add(role, text, fault in ("blank", "duplicate"), early)
        seen.add((role, text))
    cost, audit, digest = steps.end()
    return cost, audit, digest


TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "u", " ", ""]), st.sampled_from(["Well.", "no end", "Yes!", "", " \n", "Two. words ", "a?"]))


@settings(max_examples=120, deadline=None)
@given(st.lists(TURN, max_size=2))
def test_pass_is_the_cheapest_of_all_edits(turns):
    cost, audit, text = cheapest(turns)
    assert passed(turns) == (cost, audit, sha256(text.encode()).hexdigest())


@settings(max_examples=6, deadline=None)
@given(st.lists(TURN, min_size=3, max_size=3))
def test_pass_of_three_turns(turns):
    cost, audit, text = cheapest(turns)
    assert passed(turns) == (cost, audit, sha256(text.encode()).hexdigest())


def naive(turns):
    """A pass with whole strings instead of ranks and trails."""
    states = {0: (0, "", "")}
    step = lambda s, letter, cost, line, to: (to, (s[0] + cost, s[1] + letter, s[2] + ("\n" if s[2] else "") + line))
    nxt = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    def closed(states):
        for _ in range(3):
            new = dict(states)
            for k, s in states.items():
                to, way = step(s, "I", 3, nxt[k][0] + ":", nxt[k][1])
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
            states = new
        return states

    for (role, text), (fault, early) in zip(turns, faults(turns)):
        new = {}
        for k, s in closed(states).items():
            ways = [(k, (s[0] + 4, s[1] + "D", s[2]))]
            if fault not in ("blank", "duplicate"):
                ways.append(step(s, "R", 3 + 3 * early, f"{nxt[k][0]}:{text}", nxt[k][1]))
                if role[:1] == nxt[k][0][0]:
                    ways.append(step(s, "K", 3 * early, f"{role}:{text}", nxt[k][1]))
                if role[:1] == "s" and k == 0:
                    ways.append(step(s, "K", 3 * early, f"{role}:{text}", 1))
            for to, way in ways:
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        states = new
    best = min(v for k, v in closed(states).items() if k in (0, 3))
    return best[0], best[1], sha256(best[2].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(TURN, max_size=40))
def test_ranks_and_trails_equal_whole_strings(turns):
    assert passed(turns) == naive(turns)


def test_query(spark):
    assert_same(queries.op12_viterbi_repair(spark, SF), SF, queries.ORACLE_SQL["op12_viterbi_repair"])


ROWS = [
    (1, 0, "user", "Hello."), (1, 0, "user", "Hello."), (1, 1, "assistant", "no end"), (1, None, "system", "Rules!"), (1, 9, None, None),
    (None, 1, "assistant", "First?"), (None, None, "user", None), (2, None, None, None), (3, 5, "tool", "x"), (4, -3, "user", "a" * 200_000 + "."), (4, 4, "assistant", "b."), (5, 7, "", ""),
]


def odd(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("dropped", "nth", "audit", "state", "led", "place", "cost"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def ordered():
    found = {}
    for conv_id, turn, role, text in sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
        found.setdefault(conv_id, []).append((turn, role or " ", text or (" " if text is None else "")))
    return found


def test_report_of_odd_rows(spark):
    got = {r["conv_id"]: r for r in rows(conversations.repair_report(odd(spark).select("conv_id", "turn", "role", "text", F.lit("x").alias("audit"))))}
    assert set(got) == set(ordered())
    for conv_id, turns in ordered().items():
        own, r = [t[1:] for t in turns], got[conv_id]
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == naive(own)
        kinds = [f for f, _ in faults(own)]
        assert [r[k] for k in ("blank", "duplicate", "truncated")] == [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        known = {t[0] for t in turns} - {None}
        assert r["gaps"] == (max(known) - min(known) + 1 - len(known) if known else 0)
        assert r["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))


def test_repaired_turns_hash_as_reported(spark):
    df = odd(spark).select("conv_id", "turn", "role", "text", F.lit("x").alias("audit"))
    want = {r["conv_id"]: r["repaired_sha256"] for r in rows(conversations.repair_report(df))}
    texts = {}
    for r in sorted(rows(conversations.repaired_turns(df)), key=lambda r: (r["conv_id"] or 0, r["place"])):
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv_id, digest in want.items():
        assert sha256("\n".join(texts.get(conv_id, [])).encode()).hexdigest() == digest


def test_damage(spark):
    data = [(c, t, "assistant", "One. Two! x") for c in (None, *range(12)) for t in (None, *range(8))]
    found = sorted(((r["conv_id"], r["turn"], r["role"], r["text"], r["dropped"]) for r in rows(conversations.damage(spark.createDataFrame(data, SCHEMA)))), key=repr)
    want = []
    for c, t, role, text in data:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text, k == 0)
        want += [row] * (2 if k == 3 else 1)
    assert found == sorted(want, key=repr)


def test_conversations_all_of_whose_rows_went_and_none_at_all(spark):
    at = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turns = conversations.damage(spark.createDataFrame([(at, 0, "user", "Gone.")], SCHEMA))
    assert [tuple(r.values()) for r in rows(conversations.repair_report(turns, F.col("dropped")))] == [(at, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]
    assert rows(conversations.repair_report(spark.createDataFrame([], SCHEMA))) == []


def test_a_long_conversation(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    (r,) = rows(conversations.repair_report(df))
    want = "\n".join(f"{'user' if k % 2 == 0 else 'assistant'}:{k}." for k in range(n))
    assert (r["cost"], r["audit"], r["repaired_sha256"]) == (0, "K" * n, sha256(want.encode()).hexdigest())

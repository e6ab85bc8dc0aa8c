"""Personal data: labelers that vote on candidate spans, weighed by expectation-maximisation.

Candidates are the base spans (strict patterns) and loose ones: e-mail addresses spelt out with at
and dot, IPv6 addresses, digit groups inside a run too long for a card, card numbers with dots, and
phone numbers without a country code. Six labelers vote yes, no or nothing on every candidate:
strict pattern, check rule of the kind, gazetteer (known endings, issuers, codes), cue words before
the span, its surroundings, and plainness of its digits. The votes of the whole table are counted by
pattern (kind and votes: a few thousand patterns at most); on those counts EM estimates each labeler's
reliability per kind. The posteriors train a logistic span classifier that sees more than the votes: the
span's length and separators, its place in the line, the characters on both sides and the word before
(``shape_of``). A loose candidate becomes a span if the classifier gives it ``threshold``; base spans always
stay. The classifier is fitted to all candidates of the table by Newton steps: tasks send sums of a fixed
size, never candidates.

Two steps touch the data: one pass over the texts finds candidates (written without texts to a
scratch table), and a pass over that table applies the classifier.

Edge cases: a null or empty text has no spans; overlapping loose candidates are taken leftmost first
and never over a base span; repeated rows are judged alike; an empty table gives no rows; only doc_id
and text are read, so other columns cannot clash (``redact`` keeps all columns).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatrace.llm.common import scratch, text_slices

KINDS = ("email", "ip", "card", "phone")
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Digits before a start are excluded: a run of digits matches from its first digit or not at all.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63}){1,4}")
IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
GROUPS = re.compile(r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[ .-][0-9]{4}){3}|[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5})(?![0-9])")
LOCAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
#: Gazetteers and cue words.
ENDINGS = frozenset("com org net edu gov info io co uk de fr es it nl eu us ca au ch at be se no dk fi pl pt ru jp cn in br".split())
CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "64", "65", "81", "82", "86", "90", "91", "351", "352", "353", "354", "358", "420", "421")
ISSUERS = ("34", "35", "36", "37", "38", "4", "50", "51", "52", "53", "54", "55", "56", "57", "58", "6", "22", "23", "24", "25", "26", "27")
CUES = {
    "email": re.compile(r"(?i)mail|contact|write|reach|correo|schreib|écri|kontakt"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server|adresse|direcci|login"),
    "card": re.compile(r"(?i)card|visa|master|credit|pay|karte|carte|tarjeta|account|iban"),
    "phone": re.compile(r"(?i)phone|call|tel|fax|mobile|whatsapp|anruf|appel|llam|móvil|handy"),
}
AGAINST = re.compile(r"(?i)version|isbn|order|invoice|token|hash|sha|secret|key|serial|build")
LABELERS = ("pattern", "check", "gazetteer", "cue", "around", "plain")

#: Letters of each place of a shape: length, place in the line, character before and after, word before, separators.
SHAPES = ("abcd", "smew", "nldsp", "nldsp", "nciwk", "nsdox")
WIDTH = len(KINDS) + 2 * len(LABELERS) + sum(map(len, SHAPES))

SPAN = "struct<kind:int,start:int,stop:int,votes:string,shape:string>"
FOUND = f"n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<{SPAN}>, loose array<{SPAN}>"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _small_parts(ip: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in ip.split("."))


def _digits(text: str) -> str:
    return "".join(filter("0123456789".__contains__, text))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the strict patterns, by start and then kind."""
    spans: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LEFT:
            start -= 1
        found = EMAIL_RIGHT.match(text, at) if start < at else None
        if found:
            spans.append((0, start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    first = DIGIT.search(text)
    if first:
        lo = first.start()
        spans += [(1, *m.span()) for m in IP.finditer(text, lo) if _small_parts(m[0])]
        spans += [(2, *m.span()) for m in CARD.finditer(text, lo) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            spans += [(3, *m.span()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[1], s[0]))


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Further candidates outside the base spans, leftmost first, without overlaps."""
    found: list[Span] = []
    if "dot" in text and "at" in text and re.search(r"[(\[{ ]dot[)\]} ]", text):
        found += [(0, *m.span()) for m in SPELT.finditer(text)]
    if text.count(":") >= 7:
        found += [(1, *m.span()) for m in IPV6.finditer(text)]
    first = DIGIT.search(text)
    if first:
        found += [(2, *m.span()) for m in GROUPS.finditer(text, first.start())]
        found += [(3, *m.span()) for m in LOCAL.finditer(text, max(0, first.start() - 1))]
    taken, at, end, out = sorted((a, b) for _, a, b in base), 0, 0, []
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2], s[0])):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= end and not (at < len(taken) and taken[at][0] < b):
            out.append((kind, a, b))
            end = b
    return out


def votes(text: str, span: Span, strict: bool) -> str:
    """The labelers' votes as a string of +, - and 0, after the kind."""
    kind, a, b = span
    own, digits = text[a:b], _digits(text[a:b])
    before, after = text[max(0, a - 40) : a], text[b : b + 1]
    yes = lambda good, bad=True: "+" if good else "-" if bad else "0"
    last = re.split(r"[.\s\])}]+", own)[-1].lower()
    if kind == 0:
        check, gazetteer, plain = yes(last.isalpha() and len(last) >= 2), yes(last in ENDINGS, False), "0"
    elif kind == 1:
        v6 = ":" in own
        check = yes(v6 or _small_parts(own))
        gazetteer = "0" if v6 else yes(0 < int(own.split(".")[0][-3:]) < 240)
        plain = yes(len(set(own)) > 3)
    elif kind == 2:
        check, gazetteer, plain = yes(luhn(digits)), yes(digits.startswith(ISSUERS)), yes(len(set(digits)) > 3)
    else:
        check = yes(10 <= len(digits) <= 15)
        gazetteer = yes(digits.startswith(CODES)) if own[0] == "+" else yes(digits[0] in "23456789" and digits[3] in "23456789")
        plain = yes(len(set(digits)) > 3)
    cue = "+" if CUES[KINDS[kind]].search(before) else "-" if AGAINST.search(before[-16:]) else "0"
    around = yes(not (before[-1:].isalnum() or before[-1:] in "_/" and before or after.isalnum() or after == "_"))
    return f"{KINDS[kind]}{yes(strict, False)}{check}{gazetteer}{cue}{around}{plain}"


def _char(c: str) -> str:
    return "n" if not c else "l" if c.isalpha() else "d" if c.isdigit() else "s" if c.isspace() else "p"


def shape_of(text: str, span: Span) -> str:
    """What the classifier sees of a span besides the votes, a letter of each of SHAPES."""
    _, a, b = span
    own, before, after = text[a:b], text[max(0, a - 80) : a], text[b : b + 80]
    length = "abcd"[(len(own) > 10) + (len(own) > 16) + (len(own) > 24)]
    first, last = not before.rpartition("\n")[2].strip(), not after.partition("\n")[0].strip()
    line = "w" if first and last else "s" if first else "e" if last else "m"
    words = before.split()
    word = "n" if not words else "k" if words[-1][-1] in ":=#" else "i" if any(map(str.isdigit, words[-1])) else "c" if words[-1][0].isupper() else "w"
    kinds = {x for x in own if x in " -."}
    inside = "n" if not kinds else "x" if len(kinds) > 1 else {" ": "s", "-": "d", ".": "o"}[kinds.pop()]
    return length + line + _char(before[-1:]) + _char(after[:1]) + word + inside


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, base counts and hash, and all candidates with their votes; without the text."""
    fields = [docs.schema[k] for k in keep] + T.StructType.fromDDL(FOUND).fields
    names = [f.name for f in fields]
    arrow = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("votes", pa.string()), ("shape", pa.string())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = lambda text, s, strict: {"kind": s[0], "start": s[1], "stop": s[2], "votes": votes(text, s, strict), "shape": shape_of(text, s)}
        for batch in text_slices(batches, len(keep)):
            counts, hashes, bases, looses = np.zeros((batch.num_rows, 4), np.int64), [], [], []
            for row, text in enumerate(batch.column(len(keep)).to_pylist()):
                base = base_spans(text)
                for kind, _, _ in base:
                    counts[row, kind] += 1
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                bases.append([entry(text, s, True) for s in base])
                looses.append([entry(text, s, False) for s in loose_spans(text, base)])
            columns = [*batch.columns[: len(keep)], *(pa.array(counts[:, k]) for k in range(4)), pa.array(hashes, pa.string()), pa.array(bases, arrow), pa.array(looses, arrow)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(search, T.StructType(fields))


def fit_labelers(patterns: list[tuple[str, int]], rounds: int = 50, trust: float = 20.0) -> dict[str, float]:
    """Posterior of each vote pattern, by EM over (pattern, count) per kind.

    Each labeler has a table P(vote | class), started and held near being better than chance by
    ``trust`` pseudo-votes, and each kind its own share of true spans.
    """
    out: dict[str, float] = {}
    lean = {1: np.array([0.6, 0.1, 0.3]), 0: np.array([0.1, 0.6, 0.3])}  # P(+), P(-), P(0)
    for kind in KINDS:
        own = [(p, n) for p, n in sorted(patterns) if p.startswith(kind)]
        if not own:
            continue
        v = np.array([["+-0".index(c) for c in p[len(kind) :]] for p, _ in own])
        n = np.array([n for _, n in own], float)
        tables = {c: np.tile(lean[c], (len(LABELERS), 1)) for c in (0, 1)}
        share = 0.5
        for _ in range(rounds):
            odds = [np.log(w) + sum(np.log(tables[c][k, v[:, k]]) for k in range(len(LABELERS))) for c, w in ((0, 1 - share), (1, share))]
            true = 1 / (1 + np.exp(np.clip(odds[0] - odds[1], -50, 50)))
            share = float(((true * n).sum() + 1) / (n.sum() + 2))
            for c, w in ((0, (1 - true) * n), (1, true * n)):
                for k in range(len(LABELERS)):
                    seen = np.bincount(v[:, k], w, 3) + trust * lean[c]
                    tables[c][k] = seen / seen.sum()
        out |= {p: float(t) for (p, _), t in zip(own, true)}
    return out


def features(candidates: list[tuple[str, str]]) -> np.ndarray:
    """Rows of 0 and 1 for (votes, shape): the kind, the votes for and against, and the letters of the shape."""
    x = np.zeros((len(candidates), WIDTH))
    for row, (own, shape) in zip(x, candidates, strict=True):
        row[next(k for k, kind in enumerate(KINDS) if own.startswith(kind))] = 1
        for k, vote in enumerate(own[-len(LABELERS) :]):
            if vote != "0":
                row[len(KINDS) + 2 * k + (vote == "-")] = 1
        at = len(KINDS) + 2 * len(LABELERS)
        for letters, letter in zip(SHAPES, shape, strict=True):
            row[at + letters.index(letter)] = 1
            at += len(letters)
    return x


def chances(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))


def newton_sums(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the log-likelihood over weighted rows, side by side."""
    p = chances(x, w)
    return np.column_stack([x.T @ (n * (y - p)), (x * (n * p * (1 - p))[:, None]).T @ x])


def fit_classifier(sums: Callable[[np.ndarray], np.ndarray], mass: float, steps: int = 12, l2: float = 1e-3) -> np.ndarray:
    """Weights by Newton steps; sums gives newton_sums over all rows, mass is the rows' total weight."""
    w = np.zeros(WIDTH)
    for _ in range(steps):
        both = sums(w)
        step = np.linalg.solve(both[:, 1:] + (l2 * mass + 1e-6) * np.eye(WIDTH), both[:, 0] - l2 * mass * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def span_classifier(found: DataFrame) -> np.ndarray | None:
    """Weights learnt from all candidates of the table; None if it has none.

    Candidates weigh so that a pattern of votes has the logarithm of its count in all: a common one doesn't
    drown the others.
    """
    every = found.select(F.explode(F.concat("base", "loose")).alias("c")).select("c.votes", "c.shape")
    kinds = scratch(every.groupBy("votes", "shape").count(), "kinds")
    patterns = sorted((r["votes"], r["n"]) for r in kinds.groupBy("votes").agg(F.sum("count").alias("n")).collect())  # at most 4 kinds x 3 ** 6 votes
    if not patterns:
        return None
    posterior = fit_labelers(patterns)
    weight = {p: float(np.log1p(n) / n) for p, n in patterns}

    def sums(w: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((WIDTH, WIDTH + 1))
            for batch in batches:
                own, shapes, counts = (c.to_pylist() for c in batch.columns)
                y, n = (np.array([of[v] for v in own]) for of in (posterior, weight))
                total += newton_sums(features(list(zip(own, shapes, strict=True))), y, n * counts, w)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

        parts = kinds.mapInArrow(part, "sums array<double>").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
        return np.array([r["v"] for r in parts.orderBy("k").collect()]).reshape(WIDTH, WIDTH + 1)  # of fixed size

    return fit_classifier(sums, float(sum(np.log1p(n) for _, n in patterns)))


def taken(candidates: list[tuple[str, str]], w: np.ndarray | None, threshold: float) -> list[bool]:
    """Which loose candidates (votes, shape) become spans."""
    return (chances(features(candidates), w) >= threshold).tolist() if candidates and w is not None else [False] * len(candidates)


def find_pii(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, counts and hash of the base spans, and all spans as kind:start:end, comma-joined."""
    found = scratch(find_candidates(docs), "candidates")
    w = span_classifier(found)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, looses = (c.to_pylist() for c in batch.columns[-2:])
            good = iter(taken([(s["votes"], s["shape"]) for row in looses for s in row], w, threshold))
            rows = [base + [s for s in loose if next(good)] for base, loose in zip(bases, looses, strict=True)]
            spans = [joined(sorted(((s["kind"], s["start"], s["stop"]) for s in row), key=lambda s: (s[1], s[0], s[2]))) for row in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(spans, pa.string())], [*batch.schema.names[:-2], "spans"])

    out = T.StructType([*found.schema.fields[:-2], T.StructField("spans", T.StringType())])
    return found.mapInArrow(every, out).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def redact(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; all columns stay.

    The classifier is learnt in a first pass over the texts; the second finds the spans again and
    replaces them, so texts are never joined to spans.
    """
    w = span_classifier(scratch(find_candidates(docs), "candidates"))
    at = docs.columns.index("text")

    def replace(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        loose = loose_spans(text, base)
        good = taken([(votes(text, s, False), shape_of(text, s)) for s in loose], w, threshold)
        spans = base + [s for s, keep in zip(loose, good, strict=True) if keep]
        out, end = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= end:
                out += [text[end:a], f"[{KINDS[kind].upper()}]"]
            end = max(end, b)
        return "".join(out) + text[end:] if out else text

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, at):
            texts = pa.array([replace(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], batch.schema.names)

    return docs.mapInArrow(batches_of, docs.schema)

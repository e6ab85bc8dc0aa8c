"""Probabilistic suffix tree for scoring texts: word contexts of varying length, kept by a divergence test.

Tokens are the lower-cased words of a text and one end. The root gives every token
(c + 1) / (N + V + 1). A context of one to ``depth`` words seen ``least`` times becomes a state if its
next-token counts differ from what the longest state that is a suffix of it predicts (twice the
log-likelihood ratio above the number of next tokens plus ``strictness`` times its standard
deviation). A state's distribution is discounted absolutely and the mass taken off goes to its suffix:

    P(w | s) = max(c(s w) - d, 0) / c(s) + (1 - sum of the former) P(w | longest suffix state of s)

where next tokens seen once are left to the suffix. Scores take the longest state that is a suffix of
the words before each token.

All that lies below a context is learnt and used in one place. A token's states are suffixes of each other, so
tokens go, with the words before them, to the range of hashes of their last word: there the contexts ending in
that word are counted and judged, shortest first, and the tokens' shares of the score are summed by text. Words
in fewer than two training places can be in no state and in no listed next token, so they end a context.

Contexts seen HEAVY times or more ("heavy") would make a range too large. All their suffixes are heavy too, so these
few states are learnt before, level by level in shuffled groups and joins, and a token goes to the range of its first
context that is not heavy, with what the heavy ones give it. Tasks hold the frequent words (at most 1 / head_share), the
heavy contexts, up to ``held`` of the most frequent entries of the heavy tree, and a filter of BITS bits that spares keys
which are in no table. Blocks of texts ask for the other entries and for the counts of other words, each key once: keys
and entries meet in ranges of keys, and the answers go back to their block. Contexts are told by 64-bit hashes of
their words. Counts cover all training documents.

What lies on disk at once is kept low: a step's shuffles go before the next one's are written, and beyond PASS_TOKENS
lookups are done by halves of their keys, blocks ask in PASSES parts, and ranges learn in LEARN_PASSES parts, one after another.

Edge cases: a null or empty text is the end alone; without training documents N and V are 0 and every
token has probability 1; repeated rows are scored alike; an empty table gives no rows. Only doc_id and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatrace.llm.common import discard, free_shuffles, scratch

#: Name of the end in the table of counts; no word holds a space.
END = " "
TAIL = -1
#: Bits of a filter of hashes, as a power of two.
BITS = 26
#: Tokens of a block, whose rows count and ask together; training tokens and entries for each range of hashes.
BLOCK_TOKENS, RANGE_TOKENS, RANGE_ENTRIES = 1 << 19, 1 << 20, 1 << 18
#: Blocks' tokens that make a context heavy.
HEAVY = 2
#: Parts of the blocks that ask, and of the ranges that learn, one after another, beyond so many training tokens.
PASSES, LEARN_PASSES, PASS_TOKENS = 4, 3, 1 << 22
#: Sets the key of a state apart from that of a next token with the same words.
STATE = 0x5851F42D4C957F2D


def word_hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little", signed=True)


def _texts(docs: DataFrame, training: Column) -> DataFrame:
    held = F.coalesce(~training, F.lit(False))
    return docs.select(F.col("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c) over all training texts, summed inside each task before the shuffle."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())], ["token", "c"])
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                own.update(text.lower().split())
            own[b" "] += batch.num_rows
            if len(own) > 500_000:
                yield emit()
                own.clear()
        if own:
            yield emit()

    partial = texts.where("not held_out").select("text").mapInArrow(counts, "token string, c long")
    return partial.groupBy("token").agg(F.sum("c").alias("c"))


def with_hash(counts: DataFrame) -> DataFrame:
    """counts with the hash of each token (gram) as the first words of a context have it."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array([word_hash(t) for t in batch.column(0).cast(pa.binary()).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_longer(np.zeros(len(words), np.int64), words))], ["token", "c", "gram"])

    return counts.mapInArrow(hashed, "token string, c long, gram long")


def encode(texts: DataFrame, head: dict[bytes, int], logs: np.ndarray) -> DataFrame:
    """Rows with packed ids of the frequent words (TAIL for others), the packed hashes of the others in their order, the sum of root
    log-probabilities of the frequent ones, a block of about BLOCK_TOKENS tokens and a number in it."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, number = TaskContext.get().partitionId() << 32, 0, 0
        hashes: dict[bytes, int] = {}
        for batch in batches:
            ids, rares, bases, n_tokens, blocks, numbers = [], [], [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words = text.lower().split()
                words.append(b" ")
                own = np.fromiter(map(head.get, words, repeat(TAIL)), np.int32, len(words))
                others = [words[k] for k in np.flatnonzero(own == TAIL).tolist()]
                if len(hashes) > 200_000:
                    hashes.clear()
                hashes.update((w, word_hash(w)) for w in others if w not in hashes)
                ids.append(own.tobytes())
                rares.append(np.array([hashes[w] for w in others], np.int64).tobytes())
                bases.append(float(logs[own[own >= 0]].sum()))
                n_tokens.append(len(own))
                if size and size + len(own) > BLOCK_TOKENS:
                    block, size, number = block + 1, 0, 0
                blocks.append(block)
                numbers.append(number)
                size, number = size + len(own), number + 1
            arrays = [
                batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(bases, pa.float64()), pa.array(ids, pa.binary()),
                pa.array(rares, pa.binary()), pa.array(blocks, pa.int64()), pa.array(numbers, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "head_base", "ids", "rare", "block", "number"])

    types = "doc_id long, held_out boolean, n_tokens long, head_base double, ids binary, rare binary, block long, number long"
    return texts.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(encoded, types)


def _ends(column: pa.BinaryArray, kind: type) -> np.ndarray:
    """Where the numbers of each row begin, and where the last row's end, in a column of packed numbers."""
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // np.dtype(kind).itemsize


def _values(column: pa.BinaryArray, kind: type) -> np.ndarray:
    ends = _ends(column, kind)
    return np.frombuffer(column.buffers()[2], kind)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, kind)


def _split(values: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Packed numbers of rows with so many of them."""
    offsets = np.append(0, np.cumsum(sizes) * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _slices(batch: pa.RecordBatch, ids: int, tokens: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``tokens`` ids in column ``ids``, so that arrays over ids stay small."""
    ends = _ends(batch.column(ids), np.int32)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + tokens, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def _longer(gram: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, each made one word longer."""
    x = gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _grams(ids: pa.BinaryArray, rare: pa.BinaryArray, hashes: np.ndarray, most: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the runs of 1 to ``most`` words that end at each token, each token's place in its
    document, and its document. A run of k words is one only from place k - 1 on."""
    flat, ends = _values(ids, np.int32), _ends(ids, np.int32)
    sizes = np.diff(ends)
    words = hashes[flat]
    words[flat == TAIL] = _values(rare, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - (ends[:-1] - ends[0])[doc]
    grams = [_longer(np.zeros(len(words), np.int64), words)]
    while len(grams) < most:
        grams.append(_longer(np.append(np.zeros(min(1, len(words)), np.int64), grams[-1][:-1]), words))
    return grams, place, doc


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Bits at the leading and at the last BITS bits of each key (column gram): of fixed size, and never
    without a key's bits."""
    places = F.array(F.expr(f"shiftrightunsigned(gram, {64 - BITS})"), F.expr(f"gram & {(1 << BITS) - 1}L"))
    words = keys.select(F.explode(places).alias("place")).select(F.shiftright("place", 6).alias("at"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bits"))
    found = words.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def _maybe(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    key = key.view(np.uint64)
    hit = lambda at: (bits[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
    return hit(key >> np.uint64(64 - BITS)) & hit(key & np.uint64((1 << BITS) - 1)) > 0


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Runs of rows of one block (the first column), cut into slices."""
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        first = np.append(0, np.flatnonzero(np.diff(blocks)) + 1) if len(blocks) else np.zeros(0, np.int64)
        for start, size in zip(first.tolist(), np.diff(np.append(first, len(blocks))).tolist()):
            yield int(blocks[start]), _slices(batch.slice(start, size), 1)


def _by_range(keys: np.ndarray, ranges: int) -> tuple[list[int], np.ndarray]:
    """The ranges of ascending keys, by their leading bits, and where all but the first begin."""
    number = (keys >> np.int64(64 - ranges)) if ranges else np.zeros(len(keys), np.int64)
    kinds, first = np.unique(number, return_index=True)
    return kinds.tolist(), first[1:]


def _packed(names: list[str], kinds: list[int], longs: list[int] | None, *parts: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of a range, perhaps a block, and packed arrays."""
    first = [pa.array(kinds, pa.int64())] + ([pa.array(longs, pa.int64())] if longs is not None else [])
    return pa.RecordBatch.from_arrays([*first, *(pa.array([x.tobytes() for x in p[: len(kinds)]], pa.binary()) for p in parts)], names)  # an empty array splits into one part


def count_nexts(encoded: DataFrame, level: int, shared: Broadcast, ranges: int) -> DataFrame:
    """(gram, context, suffix, last, c): runs of level + 1 words that come twice or more, for contexts that
    pass the filter.

    Blocks send each run once, packed, to ranges of hashes. shared has the hashes of the frequent words and the filter."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*own)]
            gram, at, n = np.unique(columns[0], return_index=True, return_counts=True)
            kinds, first = _by_range(gram, ranges)
            return _packed(["range", *names], kinds, None, *(np.split(x, first) for x in (gram, *(c[at] for c in columns[1:]), n)))

        own, block = [], None
        for at, parts in _runs(batches):
            if own and at != block:
                yield emit()
                own = []
            block = at
            hashes, bits = shared.value
            for part in parts:
                grams, place, doc = _grams(part.column(1), part.column(2), hashes, level + 1)
                here = np.flatnonzero(place >= level)
                here = here[_maybe(grams[level - 1][here - 1], bits)]
                own.append((grams[level][here], grams[level - 1][here - 1], grams[level - 1][here], np.append(doc[1:] != doc[:-1], True)[here]))
        if own:
            yield emit()

    def again(rows: pa.Table) -> pa.Table:
        columns = [np.frombuffer(b"".join(rows[c].to_pylist()), bool if c == "last" else np.int64) for c in names]
        gram, at, own = np.unique(columns[0], return_index=True, return_inverse=True)
        sums = np.zeros(len(gram), np.int64)
        np.add.at(sums, own, columns[4])
        kept = np.flatnonzero(sums >= 2)
        return pa.table([pa.array(x) for x in (gram[kept], *(c[at[kept]] for c in columns[1:4]), sums[kept])], names)

    names = ["gram", "context", "suffix", "last", "c"]
    training = encoded.where("not held_out").select("block", "ids", "rare")
    asked = training.mapInArrow(counts, "range long, gram binary, context binary, suffix binary, last binary, c binary")
    counted = scratch(asked.groupBy("range").applyInArrow(again, "gram long, context long, suffix long, last boolean, c long"), f"nexts{level}")
    free_shuffles(encoded.sparkSession)
    return counted


def parts_of(df: DataFrame, column: str, parts: int) -> list[DataFrame]:
    """df in so many parts by a hash of the column; all of it in one, if parts is 1."""
    if parts == 1:
        return [df]
    return [df.where(F.pmod(F.hash(column), F.lit(parts)) == k) for k in range(parts)]


def looked_up(rows: DataFrame, by: str, table: DataFrame, how: str, name: str, parts: int, made: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """What is made of rows joined with table, as scratch tables: one for each part of the keys, so that only a
    part of both sides is in a shuffle at once."""
    out = []
    for own, known in zip(parts_of(rows, by, parts), parts_of(table, by, parts)):
        out.append(scratch(made(own.join(known, by, how)), name))
        free_shuffles(rows.sparkSession)
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def learn_tree(encoded: DataFrame, counts: DataFrame, hashes: np.ndarray, scale: float, ranges: int, depth: int, least: float, next_share: float, discount: float, strictness: float, parts: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(gram, value, c) of all entries of the contexts that come ``least`` times, and the contexts: the mass that a state
    leaves to its suffix, under gram ^ STATE, and the share of a state's next token over the root's. scale is N + V + 1;
    joins are done in so many parts."""
    words = counts.select("gram", "c", ((F.col("c") + 1) / F.lit(scale)).alias("p"))
    # What the states up to this level give a token after a run's other words, and what the root gives it.
    chances = words.select("gram", "p", F.col("p").alias("root"))
    last_level: list[DataFrame] = []
    contexts = counts.where((F.col("c") >= least) & (F.col("token") != END)).select("gram", "c")
    entries, heavy = [], []
    for level in range(1, depth + 1):
        heavy.append(contexts.select("gram").toArrow()["gram"].to_numpy())
        shared = encoded.sparkSession.sparkContext.broadcast((hashes, bit_filter(contexts)))
        none = contexts.select("gram", *(F.col("gram").alias(x) for x in ("context", "suffix")), F.lit(False).alias("last"), "c").limit(0)
        counted = count_nexts(encoded, level, shared, ranges) if len(heavy[-1]) else none
        shared.destroy()
        before = chances.select(F.col("gram").alias("suffix"), F.col("p").alias("before"), "root")
        placed = looked_up(counted, "suffix", before, "inner", f"placed{level}", parts, lambda x: x.select("gram", "context", "last", "c", "before", "root"))
        discard(*([counted] if len(heavy[-1]) else []))
        known = together(placed)
        c, total, share = F.col("c"), F.col("total"), (F.col("c") - discount) / F.col("total")
        listed = c >= total * next_share
        totals = contexts.select(F.col("gram").alias("context"), F.col("c").alias("total"))

        def judged(rows: DataFrame) -> DataFrame:
            sums = rows.where(listed).groupBy("context", "total").agg(
                F.count("*").alias("kinds"), F.sum("c").alias("sum"), F.sum("before").alias("mass"), F.sum(c * F.log(c / total / F.col("before"))).alias("gain"), (1 - F.sum(share)).alias("rest")
            )
            other = total - F.col("sum")
            gain = F.col("gain") + F.when(other > 0, other * F.log(other / total / F.greatest(1 - F.col("mass"), F.lit(1e-9)))).otherwise(0)
            return sums.where(2 * gain > F.col("kinds") + strictness * F.sqrt(2 * F.col("kinds"))).select("context", "rest", "total")

        states = looked_up(known, "context", totals, "inner", f"states{level}", parts, judged)
        discard(*last_level)
        own = F.when(F.col("rest").isNotNull() & listed, share)
        p = F.coalesce("rest", F.lit(1.0)) * F.col("before") + F.coalesce(own, F.lit(0.0))
        last_level = looked_up(known, "context", together(states), "left", f"chances{level}", parts, lambda x: x.select("gram", "last", "c", p.alias("p"), "root", (own / F.col("root")).alias("value")))
        discard(*placed)
        chances = together(last_level)
        masses = together(states).select(F.col("context").bitwiseXOR(F.lit(STATE)).alias("gram"), F.col("rest").alias("value"), F.col("total").alias("c"))
        entries.append(scratch(masses.union(chances.where("value is not null").select("gram", "value", "c")), f"tree{level}"))
        discard(*states)
        contexts = chances.where((F.col("c") >= least) & ~F.col("last")).select("gram", "c")
    discard(*last_level)
    return together(entries), np.sort(np.concatenate(heavy))


def split_tree(tree: DataFrame, held: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Sorted keys and values of at most ``held`` of the most frequent entries, and a table of the others."""
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in tree.groupBy(step).count().collect()), reverse=True)
    kept, cut = 0, 1 << 30
    for at, n in sizes:
        if kept + n > held:
            break
        kept, cut = kept + n, at
    top = tree.where(step >= cut).select("gram", "value").toArrow()
    keys, values = (top[x].to_numpy() for x in ("gram", "value"))
    order = np.argsort(keys)
    return keys[order], values[order], tree.where(step < cut).select("gram", "value")


def _held(key: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of the keys, NaN for those not held; keys are sought in their order, which is several times as fast."""
    found = np.full(len(key), np.nan)
    if len(keys):
        order = np.argsort(key)
        sought = key[order]
        at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
        found[order] = np.where(keys[at] == sought, values[at], np.nan)
    return found


def _within(key: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key if len(keys) else np.zeros(len(key), bool)


def _before(x: np.ndarray, k: int) -> np.ndarray:
    """x at the place k before each, zeros for the first k."""
    return np.append(np.zeros(min(k, len(x)), x.dtype), x[: max(0, len(x) - k)])


def _reach(ids: np.ndarray, place: np.ndarray, seen: np.ndarray, grams: list[np.ndarray], depth: int, often: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place how many words before it are seen (up to depth), and how many of them make heavy contexts."""
    length, deep = np.zeros(len(ids), np.uint8), np.zeros(len(ids), np.uint8)
    live, frequent, word = np.ones(len(ids), bool), np.ones(len(ids), bool), often[ids]
    for k in range(1, depth + 1):
        live &= (place >= k) & _before(seen, k)
        frequent &= live & _before(word, k)
        if k > 1:
            at = np.flatnonzero(frequent)
            frequent[at] = _within(grams[k - 1][at - 1], heavy)
        length += live
        deep += frequent
    return length, deep


def _sought(grams: list[np.ndarray], deep: np.ndarray, depth: int, keys: np.ndarray, values: np.ndarray, bits: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each level the places after heavy contexts, and for the state before a place and its next token: the values
    held (NaN for others) and the keys that may be in the table of the others (0 elsewhere)."""
    slots: list[tuple[np.ndarray, ...]] = []
    for level in range(1, depth + 1):
        at = np.flatnonzero(deep >= level)
        for key in (grams[level - 1][at - 1] ^ np.int64(STATE), grams[level][at]):
            value = _held(key, keys, values)
            slots.append((at, value, np.where(np.isnan(value) & _maybe(key, bits), key, 0)))
    return slots


def _tail_keys(rare: np.ndarray) -> np.ndarray:
    """The hashes of single words, as the table of counts has them."""
    return _longer(np.zeros(len(rare), np.int64), rare)


def _heavy_slots(ids: pa.BinaryArray, rare: pa.BinaryArray, depth: int, hashes: np.ndarray, often: np.ndarray, heavy: np.ndarray, keys: np.ndarray, values: np.ndarray, bits: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    if not often.any():
        return []
    grams, place, _ = _grams(ids, rare, hashes, depth + 1)
    flat = _values(ids, np.int32)
    # Heavy contexts are made of frequent words alone, so the counts of others don't matter here.
    _, deep = _reach(flat, place, flat != TAIL, grams, depth, often, heavy)
    return _sought(grams, deep, depth, keys, values, bits)


def missing_keys(encoded: DataFrame, depth: int, shared: Broadcast, ranges: int) -> DataFrame:
    """(range, block, keys): the words and keys that a block's places need and no task holds, each once a block."""

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            asked = np.unique(np.concatenate(own))
            kinds, first = _by_range(asked, ranges)
            return _packed(["range", "block", "keys"], kinds, [block] * len(kinds), np.split(asked, first))

        own, block = [], None
        for at, parts in _runs(batches):
            if own and at != block:
                yield emit()
                own = []
            block = at
            for part in parts:
                slots = _heavy_slots(part.column(1), part.column(2), depth, *shared.value)
                asked = [key[key != 0] for *_, key in slots] + [_tail_keys(_values(part.column(2), np.int64))]
                own += [np.unique(key) for key in asked if len(key)]
        if own:
            yield emit()

    return encoded.select("block", "ids", "rare").mapInArrow(missing, "range long, block long, keys binary")


def answers(asked: DataFrame, others: DataFrame, ranges: int) -> DataFrame:
    """(block, range, values) of others for the keys that a block asked for in a range, in ascending order of the
    keys, NaN where there is none: both sides meet in ranges of keys, packed."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            key, value = (np.concatenate(x) for x in zip(*own))
            order = np.argsort(key)
            kinds, first = _by_range(key[order], ranges)
            return _packed(["range", "keys", "values"], kinds, None, np.split(key[order], first), np.split(value[order], first))

        own, size = [], 0
        for batch in batches:
            if batch.num_rows:
                own.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                size += batch.num_rows
            if size > 1 << 20:
                yield emit()
                own, size = [], 0
        if own:
            yield emit()

    def answered(rows: pa.Table, known: pa.Table) -> pa.Table:
        keys, values = (np.frombuffer(b"".join(known[c].to_pylist()), k) for c, k in (("keys", np.int64), ("values", np.float64)))
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        own: dict[int, np.ndarray] = {}
        for block, asked in zip(rows["block"].to_pylist(), rows["keys"]):
            asked = np.frombuffer(asked.as_buffer(), np.int64)
            own[block] = np.union1d(own[block], asked) if block in own else asked
        parts = [_held(asked, keys, values).tobytes() for asked in own.values()]
        number = pa.array(rows["range"].to_pylist()[:1] * len(own), pa.int64())
        return pa.table([pa.array(list(own), pa.int64()), number, pa.array(parts, pa.binary())], ["block", "range", "values"])

    table = others.mapInArrow(packed, "range long, keys binary, values binary")
    return asked.groupBy("range").cogroup(table.groupBy("range")).applyInArrow(answered, "block long, range long, values binary")


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte: the upper bytes of small ones are zeros in a row, which shuffles compress."""
    return x.astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes()


def _from_planes(x: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def placed_tokens(scored: DataFrame, depth: int, shared: Broadcast, ranges: int, passes: int, part: int) -> DataFrame:
    """(range, block, codes, number, deep, rare, times, ratio): the tokens that have a seen context which isn't heavy,
    with the words before them, in the range of the first such context; only ranges of this part.

    codes are the ids of the token and the words before it, then one for none and one for words with their hashes in
    rare; number is twice that of the text, and one more if it is held out."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, often, heavy = shared.value[:3]
        none, other = len(hashes) - 1, len(hashes)

        def emit() -> pa.RecordBatch:
            key, codes, number, deep, rare, times, ratio = (np.concatenate(x, axis=-1) for x in zip(*own))
            order = np.argsort(key)
            kinds, first = _by_range(key[order], ranges)
            columns: list[list[bytes]] = [[] for _ in range(6)]
            for at in np.split(order, first)[: len(kinds)]:
                c = codes[:, at]
                mine = (_planes(c), _planes(number[at]), deep[at].tobytes(), rare[:, at][c == other].tobytes(), times[at][c[0] == other].astype(np.int64).tobytes(), ratio[at][deep[at] > 0].tobytes())
                for column, x in zip(columns, mine):
                    column.append(x)
            names = ["range", "block", "codes", "number", "deep", "rare", "times", "ratio"]
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array([block] * len(kinds), pa.int64()), *(pa.array(x, pa.binary()) for x in columns)], names)

        own, block = [], None
        for at, parts in _runs(batches):
            if own and at != block:
                yield emit()
                own = []
            block = at
            for x in parts:
                ids, tail = _values(x.column(1), np.int32), _values(x.column(2), np.int64)
                grams, place, doc = _grams(x.column(1), x.column(2), hashes, depth)
                rare, count = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                is_tail = ids == TAIL
                rare[is_tail], count[is_tail] = tail, _values(x.column(3), np.int64)
                seen = ~is_tail | (count >= 2)
                length, deep = _reach(ids, place, seen, grams, depth, often, heavy)
                key = np.zeros(len(ids), np.int64)
                for k in range(depth):
                    here = np.flatnonzero((deep == k) & (length > k))
                    key[here] = grams[k][here - 1]
                number = (key >> np.int64(64 - ranges)) if ranges else np.zeros(len(key), np.int64)
                here = np.flatnonzero((length > deep) & (number % passes == part))
                code = np.where(is_tail, np.where(seen, other, none), ids)
                codes = np.stack([code[here], *(np.where(length[here] >= k, code[here - k], none) for k in range(1, depth + 1))])
                rares = np.stack([rare[here - k] for k in range(depth + 1)])
                ratio = np.zeros(len(ids))
                ratio[deep > 0] = _values(x.column(6), np.float64)
                held = x.column(5).to_numpy(zero_copy_only=False)
                texts = (x.column(4).to_numpy() * 2 + held)[doc[here]]
                own.append((key[here], codes, texts, deep[here], rares, count[here], ratio[here]))
        if own:
            yield emit()

    types = "range long, block long, codes binary, number binary, deep binary, rare binary, times binary, ratio binary"
    return scored.select("block", "ids", "rare", "times", "number", "held_out", "ratio").mapInArrow(placed, types)


def _judged(words: np.ndarray, none: np.ndarray, train: np.ndarray, deep: np.ndarray, length: np.ndarray, root: np.ndarray, ratio: np.ndarray, least: float, next_share: float, discount: float, strictness: float) -> np.ndarray:
    """The ratios of tokens (words[0]) after the words before them (words[1:], the last one first) by the states below
    their heavy contexts. All places of a context must be among them; train tells the ones that count."""
    context, alive, again = np.zeros(words.shape[1], np.int64), np.ones(words.shape[1], bool), ~none
    for level in range(1, len(words)):
        context = _longer(context, words[level])
        alive &= length >= level
        at = np.flatnonzero(alive & (deep < level))
        _, own = np.unique(context[at], return_inverse=True)
        totals = np.bincount(own, train[at])
        enough = totals[own] >= least
        alive[at[~enough]] = False
        at, own = at[enough], own[enough]
        # A next token that comes twice after a context came twice after its suffix.
        near = np.flatnonzero(again[at])
        if not len(near):
            continue
        _, entry = np.unique(_longer(context[at[near]], words[0][at[near]]), return_inverse=True)
        c = np.bincount(entry, train[at[near]])
        some = np.zeros(len(c), np.int64)
        some[entry] = near
        again[at[near]] = c[entry] >= 2
        of, total, before = own[some], totals[own[some]], ratio[at[some]] * root[at[some]]
        share = (c - discount) / total
        listed = (c >= 2) & (c >= total * next_share)
        sums = lambda x: np.bincount(of[listed], x[listed], len(totals))
        kinds, other = sums(np.ones(len(c))), totals - sums(c)
        left = np.maximum(1 - sums(before), 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sums(np.where(listed, c * np.log(c / total / before), 0)) + np.where(other > 0, other * np.log(other / totals / left), 0)
        state = (kinds > 0) & (2 * gain > kinds + strictness * np.sqrt(2 * kinds))
        ratio[at] *= np.where(state, 1 - sums(share), 1)[own]
        ratio[at[near]] += np.where(listed & state[of], share, 0)[entry] / root[at[near]]
    return ratio


def score_texts(
    docs: DataFrame,
    training: Column,
    depth: int = 3,
    head_share: float = 1e-6,
    least: int = 2,
    context_share: float = 0.0,
    next_share: float = 0.0,
    discount: float = 0.75,
    strictness: float = 4.0,
    held: int = 2_000_000,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; training is a condition on rows.

    context_share and next_share raise the counts that contexts and next tokens need, as shares of N and
    of the context's count."""
    spark = docs.sparkSession
    texts = _texts(docs, training)
    counts = scratch(with_hash(count_tokens(texts)), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    free_shuffles(spark)
    is_frequent = F.col("c") >= max(1.0, head_share * n)
    frequent = counts.where(is_frequent).select("token", "c").toPandas().sort_values(["c", "token"], ascending=[False, True])
    singles = frequent["c"].to_numpy(np.int64)
    head = {t.encode(): k for k, t in enumerate(frequent["token"])}
    hashes = np.array([*map(word_hash, head), 0], np.int64)
    scale = float(n + v + 1)
    root = (singles + 1) / scale if n else np.ones(1)
    encoded = scratch(encode(texts, head, np.log10(root)), "encoded", compression="zstd")
    many = n >= PASS_TOKENS
    passes, ranges = (LEARN_PASSES if many else 1), (n // RANGE_TOKENS).bit_length()
    enough = max(2.0, least, context_share * n)
    often = np.append((singles >= max(HEAVY * BLOCK_TOKENS, enough)) & (frequent["token"] != END).to_numpy(bool), False)
    tails = counts.where(~is_frequent).select("gram", F.col("c").cast("double").alias("value"))
    if often.any():
        tree, heavy = learn_tree(encoded, counts, hashes, scale, ranges, depth, max(HEAVY * BLOCK_TOKENS, enough), next_share, discount, strictness, 2 if many else 1)
        keys, values, others = split_tree(tree, held)
        bits, known = bit_filter(others), others.union(tails)
    else:
        heavy, keys, values, bits, known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(1 << (BITS - 6), np.uint64), tails
    key_ranges = max(0, (known.count() // RANGE_ENTRIES).bit_length())
    shared = spark.sparkContext.broadcast((hashes, often, heavy, keys, values, bits))

    def score(rows: pa.Table, answered: pa.Table) -> pa.Table:
        """What the root and the heavy contexts give: sums for whole texts, and ratios for tokens after heavy contexts."""
        order = np.argsort(answered["range"].to_numpy())
        mass = np.frombuffer(b"".join(answered["values"].take(pa.array(order)).to_pylist()), np.float64)
        batches = [part for whole in rows.combine_chunks().to_batches() for part in _slices(whole, 5)]
        slots = [_heavy_slots(b.column(5), b.column(6), depth, *shared.value) for b in batches]
        asked = [key[key != 0] for x in slots for *_, key in x] + [_tail_keys(_values(b.column(6), np.int64)) for b in batches]
        own = np.unique(np.concatenate(asked or [np.zeros(0, np.int64)]))
        if len(own) != len(mass):
            raise ValueError("a block's answers aren't those to its questions")
        parts: list[list[pa.Array]] = [[] for _ in range(5)]
        for b, found in zip(batches, slots):
            ids, rare = _values(b.column(5), np.int32), _values(b.column(6), np.int64)
            is_tail = ids == TAIL
            times = np.zeros(len(rare), np.int64)
            if len(rare):
                times = np.nan_to_num(mass[np.searchsorted(own, _tail_keys(rare))]).astype(np.int64)
            sizes = np.diff(_ends(b.column(5), np.int32))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            base = b.column(4).to_numpy() + np.bincount(doc[is_tail], np.log10((times + 1) / scale), len(sizes))
            n_known = np.bincount(doc[~is_tail], minlength=len(sizes)) + np.bincount(doc[is_tail][times > 0], minlength=len(sizes))
            settled, after, values = np.zeros(len(sizes)), np.zeros(len(ids), bool), np.ones(len(ids))
            if found:
                for at, value, key in found:
                    hit = np.flatnonzero(key)
                    value[hit] = mass[np.searchsorted(own, key[hit])]
                for (at, state, _), (_, share, _) in zip(found[::2], found[1::2]):
                    values[at] = values[at] * np.where(np.isnan(state), 1, state) + np.where(np.isnan(share), 0, share)
                after[found[0][0]] = True
                grams, place, _ = _grams(b.column(5), b.column(6), hashes, depth)
                seen = ~is_tail
                seen[is_tail] = times >= 2
                length, deep = _reach(ids, place, seen, grams, depth, often, heavy)
                settled = np.bincount(doc, np.where(length > deep, 0, np.log10(values)), len(sizes))
            packed = (_split(x, np.bincount(doc[own], minlength=len(sizes))) for x, own in ((times, is_tail), (values[after], after)))
            for column, x in zip(parts, (pa.array(base), pa.array(n_known.astype(np.int64)), pa.array(settled), *packed)):
                column.append(x)
        types = (pa.float64(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
        names = ["block", "doc_id", "held_out", "n_tokens", "number", "ids", "rare"]
        return pa.table([*(rows[c] for c in names), *(pa.chunked_array(x, t) for x, t in zip(parts, types))], [*names, "base", "known", "settled", "times", "ratio"])

    scored = []
    columns = ["block", "doc_id", "held_out", "n_tokens", "head_base", "ids", "rare", "number"]
    types = "block long, doc_id long, held_out boolean, n_tokens long, number long, ids binary, rare binary, base double, known long, settled double, times binary, ratio binary"
    for part in parts_of(encoded, "block", PASSES if many else 1):
        found = scratch(answers(missing_keys(part, depth, shared, key_ranges), known, key_ranges), "answers")
        free_shuffles(spark)
        scored.append(scratch(part.select(*columns).groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, types), "scored", compression="zstd"))
        discard(found)
    discard(encoded, counts, *([tree] if often.any() else []))
    shared.destroy()
    shared = spark.sparkContext.broadcast((hashes, often, heavy, np.append(root[: len(singles)], [1 / scale, 1.0])))

    def learn(rows: pa.Table) -> pa.Table:
        hashes, *_, roots = shared.value
        none, other, table = len(hashes) - 1, len(hashes), np.append(hashes, 0)
        number, deep, words, first, chance, none_at, lengths, ratio = ([] for _ in range(8))
        for codes, texts, levels, rare, times, given in zip(*(rows[c] for c in ("codes", "number", "deep", "rare", "times", "ratio"))):
            codes = _from_planes(codes).reshape(depth + 1, -1)
            own = table[codes]
            own[codes == other] = np.frombuffer(rare.as_buffer(), np.int64)
            p = roots[codes[0]]
            p[codes[0] == other] = (np.frombuffer(times.as_buffer(), np.int64) + 1) / scale
            levels, ratios = np.frombuffer(levels.as_buffer(), np.uint8), np.ones(codes.shape[1])
            ratios[levels > 0] = np.frombuffer(given.as_buffer(), np.float64)
            for column, x in zip((number, deep, words, chance, none_at, lengths, ratio), (_from_planes(texts), levels, own, p, codes[0] == none, (codes[1:] != none).sum(0, np.uint8), ratios)):
                column.append(x)
        sizes = [*map(len, number)]
        words, deep, chance, none_at, lengths, ratio = (np.concatenate(x, axis=-1) for x in (words, deep, chance, none_at, lengths, ratio))
        train = (np.concatenate(number) & 1 == 0).astype(np.float64)
        logs = np.log10(_judged(words, none_at, train, deep, lengths, chance, ratio, enough, next_share, discount, strictness))
        numbers, sums = [], []
        for texts, own in zip(number, np.split(logs, np.cumsum(sizes)[:-1])):
            texts = (texts >> 1).astype(np.int64)
            met = np.flatnonzero(np.bincount(texts))
            numbers.append(met.astype("<u4").tobytes())
            sums.append(np.bincount(texts, own)[met].tobytes())
        return pa.table([rows["block"], pa.array(numbers, pa.binary()), pa.array(sums, pa.binary())], ["block", "numbers", "sums"])

    whole, learned = together(scored), []
    for part in range(passes):
        placed = placed_tokens(whole, depth, shared, ranges, passes, part)
        learned.append(scratch(placed.groupBy("range").applyInArrow(learn, "block long, numbers binary, sums binary"), "learned"))
        free_shuffles(spark)
    shared.destroy()

    def summed(rows: pa.Table, parts: pa.Table) -> pa.Table:
        number = rows["number"].to_numpy()
        ratio = np.zeros(number.max(initial=-1) + 1)
        for at, own in zip(parts["numbers"], parts["sums"]):
            ratio[np.frombuffer(at.as_buffer(), "<u4")] += np.frombuffer(own.as_buffer(), np.float64)
        base = rows["base"].to_numpy()
        columns = [*(rows[c] for c in ("doc_id", "held_out", "n_tokens", "known")), pa.array(np.full(len(number), n, np.int64)), rows["base"], pa.array(base + rows["settled"].to_numpy() + ratio[number])]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    sides = whole.select("block", "doc_id", "held_out", "n_tokens", "known", "base", "settled", "number"), together(learned)
    types = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return sides[0].groupBy("block").cogroup(sides[1].groupBy("block")).applyInArrow(summed, types)

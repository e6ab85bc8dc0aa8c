"""Alignment of two tokenizers' tokens over the same texts, and how often their ids end together.

A is a byte-level vocabulary read on a space and the text, B a sentencepiece model, which puts that
space itself. Bytes where tokens of both end cut the tokens into groups; each such pair of an A and a B
token is a link.

1. Tasks align their texts in slices and write one row a document with its links as packed ids. Rows of
   about ``BLOCK`` links share a block.
2. A block's distinct pairs with their times go, by id of B, to stripes of ``STRIPE`` ids. A stripe adds
   them to a dense matrix (``np.add.at``) of STRIPE rows and a column for each id of A; blocks of a stripe
   are dealt over salts first, whose nonzero cells are added once more. Row maxima are the best counts.
3. The pairs of the blocks meet their stripe's counts, by stripe and salt, and the answers go back to
   their block, where documents sum theirs. Pairs are distinct per block, so frequent ids cost no more
   than others, and nothing is broadcast.

Edge cases: a text that is null or empty, or whose tokens don't spell a space and the text (as where it
holds U+2581, which B writes for a space), has no tokens and zeros; repeated rows and null ids count
each; an empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatrace.llm.common import scratch, text_slices
from seatrace.llm.tokenization import PieceEncoder, SentencePieces

#: Links of a block, ids of B in a stripe, rows of blocks of a stripe that go to one salt.
BLOCK, STRIPE, SALT_ROWS = 4 << 20, 64, 64
#: Bytes of text aligned at a time.
SLICE = 1 << 20
#: Fixed value: how byte-level vocabularies of this kind cut a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of letters, digits, marks and white space that every library takes for the same.
PLAIN = re.compile("[\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*")

ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
COUNTED = "stripe int, links binary, times binary, best binary"


class Aligner:
    """Tokens of both vocabularies over slices of texts, of one worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = PieceEncoder(a_path), SentencePieces(b_path)
        if self.a.kind != "pieces" or self.a.typecode != "H":
            raise ValueError(f"{a_path} is no byte-level vocabulary of up to 65,536 ids")
        letters = {letter: k for k, letter in enumerate(self.a.letters)}
        vocabulary = self.a.library.get_vocab(with_added_tokens=False)
        spelt = {k: bytes(letters[c] for c in t) for t, k in vocabulary.items() if all(c in letters for c in t)}
        self.a_bytes = [spelt.get(k, b"") for k in range(self.a.library.get_vocab_size())]
        self.a_size, self.b_size = len(self.a_bytes), len(self.b.bytes)
        self.a_length, self.b_length = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b.bytes))
        marks = [f"{k}{end}".encode() for n, ends in ((self.a_size, ",|"), (self.b_size, ",;")) for k in range(n) for end in ends]
        self.marks = np.array(marks, object)
        self.ranked = self._ranked(vocabulary)

    def _ranked(self, vocabulary: dict[str, int]) -> tiktoken.Encoding | None:
        """The vocabulary by ranks, if its ids are ranks: letters first, then the merges in their order."""
        merges = json.loads(self.a.library.to_str())["model"]["merges"]
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        first = len(self.a.letters)
        if any(vocabulary[t] != first + k for k, t in enumerate(joined)) or any(vocabulary.get(c, first) >= first for c in self.a.letters):
            return None
        ranks = {self.a_bytes[k]: k for k in range(first + len(joined))}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B of each text; none where they don't spell it."""
        none = np.zeros(0, np.uint16)
        found = []
        for text, b in zip(texts, self.b.library.encode(texts, num_threads=1)):
            spaced = " " + text
            own = spaced.encode()
            if not text or own != b"".join(map(self.b.bytes.__getitem__, b)):
                found.append((none, none))
                continue
            plain = self.ranked and PLAIN.fullmatch(text)
            a = self.ranked.encode_to_numpy(spaced).astype(np.uint16) if plain else np.frombuffer(self.a.encode(spaced), np.uint16)
            same = int(self.a_length[a].sum()) == len(own) and own == b"".join(map(self.a_bytes.__getitem__, a.tolist()))
            found.append((a, np.array(b, np.uint16)) if same else (none, none))
        return found

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """Of each text: tokens of A and of B, groups, their hash, and the links b * a_size + a in ascending order."""
        found = self.tokens(texts)
        a, b = (np.concatenate(x) for x in zip(*found))
        a_ends, b_ends = self.a_length[a].cumsum(), self.b_length[b].cumsum()
        at = np.minimum(np.searchsorted(b_ends, a_ends), max(0, len(b) - 1))
        a_last = b_ends[at] == a_ends if len(b) else np.zeros(len(a), bool)
        a_at, b_at = np.flatnonzero(a_last), at[a_last]
        b_last = np.zeros(len(b), bool)
        b_last[b_at] = True
        # All tokens in the order of their groups, A's before B's.
        spelt = np.empty(len(a) + len(b), np.int64)
        before = np.append(0, b_at + 1)  # tokens of B before each group
        spelt[np.arange(len(a)) + before[np.cumsum(a_last) - a_last]] = a.astype(np.int64) * 2 + a_last
        up_to = np.append(a_at + 1, len(a))  # tokens of A up to each group
        spelt[np.arange(len(b)) + up_to[np.cumsum(b_last) - b_last]] = b.astype(np.int64) * 2 + b_last + 2 * self.a_size
        links = (b[b_at].astype(np.int64) * self.a_size + a[a_at]).astype(np.uint32 if self.a_size * self.b_size < 1 << 32 else np.uint64)
        sizes = np.array([[len(x), len(y)] for x, y in found])
        ends = np.vstack([[0, 0], sizes.cumsum(0)])
        cuts = np.searchsorted(a_at, ends[:, 0])
        result = []
        for k, (n_a, n_b) in enumerate(sizes.tolist()):
            text = b"".join(self.marks[spelt[ends[k].sum() : ends[k + 1].sum()]])[:-1]
            own = np.sort(links[cuts[k] : cuts[k + 1]])
            result.append((n_a, n_b, len(own), sha256(text).hexdigest() if n_a else "", own))
        return result


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process and pair of vocabularies."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def align_texts(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """One row a document, with its block and its links (sorted b * a_size + a, packed)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("part"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, held = aligner(a_path, b_path), 0, 0
        for batch in text_slices(batches, 1, SLICE):
            rows = own.align(batch.column(1).to_pylist())
            blocks = []
            for row in rows:
                if held and held + row[2] > block:
                    number, held = number + 1, 0
                held += row[2]
                blocks.append(number)
            blocks = batch.column(2).to_numpy().astype(np.int64) << 32 | np.array(blocks, np.int64)
            n_a, n_b, n_groups, digest, links = zip(*rows)
            counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)]
            arrays = [pa.array(blocks), batch.column(0), *counts, pa.array(digest, pa.string()), pa.array([x.tobytes() for x in links], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in ALIGNED.split(", ")])

    return texts.mapInArrow(aligned, ALIGNED)


def _packed(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def block_pairs(aligned: DataFrame, a_size: int, kind: type) -> DataFrame:
    """(stripe, block, links, times): the distinct pairs of each block, in ascending order, by stripe."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            links, times = np.unique(np.concatenate(own), return_counts=True)
            stripe = (links // (a_size * STRIPE)).astype(np.int32)
            kinds, first = np.unique(stripe, return_index=True)
            parts = [x.tobytes() for x in np.split(links, first[1:])], [x.tobytes() for x in np.split(times.astype(np.int64), first[1:])]
            blocks = pa.array(np.full(len(kinds), at, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(kinds), blocks, *(pa.array(x, pa.binary()) for x in parts)], ["stripe", "block", "links", "times"])

        own, at = [], None
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for cut in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1):
                if not len(cut):
                    continue
                if own and blocks[cut[0]] != at:
                    yield emit()
                    own = []
                at = blocks[cut[0]]
                links = _packed(batch.column(1).slice(int(cut[0]), len(cut)), kind)
                if len(links):
                    own.append(links)
        if own:
            yield emit()

    return aligned.select("block", "links").mapInArrow(pairs, "stripe int, block long, links binary, times binary")


def _stripe_matrix(batches: Iterator[pa.RecordBatch], at: int, a_size: int, kind: type) -> tuple[int, np.ndarray] | None:
    """The stripe and its dense counts, from batches whose columns at ``at`` and after it hold links and times."""
    matrix, stripe = None, 0
    for batch in batches:
        if matrix is None and batch.num_rows:
            stripe, matrix = batch.column(0)[0].as_py(), np.zeros(STRIPE * a_size, np.int64)
        for links, times in zip(batch.column(at), batch.column(at + 1)):
            cells = np.frombuffer(links.as_buffer(), kind).astype(np.int64) - stripe * STRIPE * a_size
            np.add.at(matrix, cells, np.frombuffer(times.as_buffer(), np.int64))
    return None if matrix is None else (stripe, matrix.reshape(STRIPE, a_size))


def pair_counts(pairs: DataFrame, salts: int, a_size: int, kind: type) -> DataFrame:
    """(stripe, links, times, best): every linked pair in ascending order with its count in all documents,
    and whether no other pair of its id of B has a higher one."""

    def row(stripe: int, matrix: np.ndarray) -> pa.RecordBatch:
        cells = np.flatnonzero(matrix)
        counts = matrix.ravel()[cells]
        best = counts == matrix.max(1)[cells // a_size]
        packed = [x.tobytes() for x in ((cells + stripe * STRIPE * a_size).astype(kind), counts, best)]
        return pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], [x.split()[0] for x in COUNTED.split(", ")])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := _stripe_matrix(batches, 2, a_size, kind):
            yield row(*found)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := _stripe_matrix(batches, 1, a_size, kind):
            yield row(*found)

    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes and much work: not to be merged by size
    if salts == 1:
        return pairs.repartition(tasks, "stripe").groupBy("stripe").applyInArrow(part, COUNTED)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts))).repartition(tasks, "stripe", "salt")
    return salted.groupBy("stripe", "salt").applyInArrow(part, COUNTED).repartition(tasks, "stripe").groupBy("stripe").applyInArrow(whole, COUNTED)


def block_answers(pairs: DataFrame, counts: DataFrame, salts: int, kind: type) -> DataFrame:
    """(block, links, times, best) of the pairs of each block, from their stripe's counts."""

    def answered(asked: pa.Table, known: pa.Table) -> pa.Table:
        links, times, best = (_packed(known[c], k) for c, k in (("links", kind), ("times", np.int64), ("best", bool)))
        at = [np.searchsorted(links, np.frombuffer(x.as_buffer(), kind)) for x in asked["links"]]
        parts = [pa.array([x[k].tobytes() for k in at], pa.binary()) for x in (times, best)]
        return pa.table([asked["block"], asked["links"], *parts], ["block", "links", "times", "best"])

    asked = pairs.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).select("stripe", "salt", "block", "links")
    known = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    by = "stripe", "salt"
    return asked.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(answered, "block long, links binary, times binary, best binary")


def count_alignments(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    _, aligned, pairs, counts, salts, kind = _counted(docs, a_path, b_path, block)
    answers = block_answers(pairs, counts, salts, kind)
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def summed(rows: pa.Table, found: pa.Table) -> pa.Table:
        links, times, best = (_packed(found[c], k) for c, k in (("links", kind), ("times", np.int64), ("best", bool)))
        order = np.argsort(links, kind="stable")
        links, times, best = links[order], times[order], best[order]
        own = [np.searchsorted(links, np.frombuffer(x.as_buffer(), kind)) for x in rows["links"]]
        n_best, sums = ([int(x[k].sum()) for k in own] for x in (best, times))
        return pa.table([rows["doc_id"], rows["n_a"], rows["n_b"], rows["n_groups"], rows["n_groups"], pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), rows["groups_sha256"]], [x.split()[0] for x in kinds.split(", ")])

    return aligned.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(summed, kinds)


def best_links(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """(a, b, count, best) of every pair of ids that tokens of the documents link."""
    a_size, _, _, counts, _, kind = _counted(docs, a_path, b_path, block)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links, times, best = (_packed(batch.column(k), x) for k, x in ((1, kind), (2, np.int64), (3, bool)))
            ids = [pa.array((x).astype(np.int32)) for x in (links % a_size, links // a_size)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(times), pa.array(best)], ["a", "b", "count", "best"])

    return counts.mapInArrow(rows, "a int, b int, count long, best boolean")


def _counted(docs: DataFrame, a_path: str, b_path: str, block: int) -> tuple[int, DataFrame, DataFrame, DataFrame, int, type]:
    own = Aligner(a_path, b_path)
    kind = np.uint32 if own.a_size * own.b_size < 1 << 32 else np.uint64
    aligned = scratch(align_texts(docs, a_path, b_path, block), "aligned", compression="zstd")
    pairs = scratch(block_pairs(aligned, own.a_size, kind), "pairs", compression="zstd")
    salts = 1 + int(pairs.count() // (-(-own.b_size // STRIPE) * SALT_ROWS))
    return own.a_size, aligned, pairs, pair_counts(pairs, salts, own.a_size, kind), salts, kind

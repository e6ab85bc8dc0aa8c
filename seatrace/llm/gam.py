"""Quality classifier: a generalised additive model with pairwise interactions over text statistics.

The statistics of a text (``FEATURES``) are computed in one pass and written to a scratch table.
The model is fitted on the driver from at most ``sample_rows`` labelled rows (default 20,000, chosen
by a hash of doc_id; below that number all labelled rows are used). Fitting is cyclic boosting: in
every round each feature in turn gets a tree of at most four leaves on its own bins, added to that
feature's lookup table with a small learning rate; afterwards the pairs of features whose four-way
cuts explain most of the remaining gradient are boosted the same way. A score is the logistic of
the sum of table entries, taken for whole batches at once.

Edge cases: a null or empty text has the statistics of no words and is scored; without labelled rows
all scores are 0.5, with labels of one class they are near that class; null labels and labels other
than 0 and 1 are left out; repeated rows are scored alike. Added columns replace input columns of the
same name. Labels, language, source and ids are never inputs of a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatrace.llm.common import scratch, text_slices

FEATURES = (
    "words", "word_length", "upper", "digit", "mark", "symbol", "pipe", "shout", "stop", "line_end", "non_ascii",
    "space", "entropy", "distinct", "top_word", "stutter", "line_repeat", "capital_words",
)
UPPER, LOWER, DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
SYMBOLS = np.frombuffer(b"#$%&*+/<=>@\\^_`{}~", np.uint8)


def statistics(text: bytes) -> tuple[float, ...]:
    """FEATURES of a UTF-8 text."""
    words = text.split()
    if not words:
        return (0.0,) * len(FEATURES)
    n, size = len(words), len(text)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = bytes_[bytes_ > 0] / size
    upper, letters = int(bytes_[UPPER].sum()), int(bytes_[LOWER].sum())
    counts = Counter(words)
    lines = text.split(b"\n")
    return (
        math.log1p(n), (size - int(bytes_[32])) / n, upper / max(1, upper + letters), int(bytes_[DIGIT].sum()) / size,
        int(bytes_[MARKS].sum()) / size, int(bytes_[SYMBOLS].sum()) / n, int(bytes_[124]) / n, int(bytes_[33]) / n,
        int(bytes_[46]) / n, int(bytes_[10]) / n, int(bytes_[128:].sum()) / size, int(bytes_[32]) / size,
        float(-(share * np.log2(share)).sum()), len(counts) / n, max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / len(lines), upper / n,
    )


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs and FEATURES of its text."""
    fields = [docs.schema[k] for k in keep] + [T.StructField(f, T.DoubleType()) for f in FEATURES]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, len(keep)):
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            rows = np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))
            columns = [*batch.columns[:-1], *(pa.array(rows[:, k]) for k in range(len(FEATURES)))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *FEATURES])

    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(batches_of, T.StructType(fields))


@dataclass
class Gam:
    """Cuts and lookup tables; ``pairs`` are (feature, feature, cuts, cuts, table)."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, k], side="right")]
        for a, b, cuts_a, cuts_b, table in self.pairs:
            total += table[np.searchsorted(cuts_a, x[:, a], side="right"), np.searchsorted(cuts_b, x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


def _best_cut(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Gain and place of the best two-way cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h, l2) + _gain(g.sum() - left_g, h.sum() - left_h, l2) - _gain(g.sum(), h.sum(), l2)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """Leaf values for each bin from a tree of depth two."""
    _, middle = _best_cut(g, h, l2)
    edges = {0, middle, len(g)}
    for a, b in ((0, middle), (middle, len(g))):
        gain, cut = _best_cut(g[a:b], h[a:b], l2)
        if gain > 0:
            edges.add(a + cut)
    value, edges = np.zeros(len(g)), sorted(edges)
    for a, b in zip(edges, edges[1:]):
        value[a:b] = -g[a:b].sum() / (h[a:b].sum() + l2)
    return value


def _four_way(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best cut of a grid in four, one cut along each side."""
    sums = lambda m: np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = sums(g), sums(h)
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None]
    quarter = lambda c: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])
    if 1 in g.shape:
        return 0.0, np.zeros(g.shape)
    gain = sum(_gain(a, b, l2) for a, b in zip(quarter(cg), quarter(ch)))
    at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    at_best = lambda c: [np.broadcast_to(m, gain.shape)[at] for m in quarter(c)]
    values = [-a / (b + l2) for a, b in zip(at_best(cg), at_best(ch))]
    cell, r, c = np.empty(g.shape), at[0] + 1, at[1] + 1
    cell[:r, :c], cell[:r, c:], cell[r:, :c], cell[r:, c:] = values
    return float(gain[at]), cell


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, n_pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 60, l2: float = 2.0) -> Gam:
    if not len(y):
        return Gam(0.0, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    p = (y.sum() + 1) / (len(y) + 2)
    cuts = [_quantile_cuts(x[:, k], bins) for k in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)]
    model = Gam(math.log(p / (1 - p)), cuts, [np.zeros(len(c) + 1) for c in cuts])
    total = np.full(len(y), model.base)
    gradient = lambda: 1 / (1 + np.exp(-total)) - y
    for _ in range(rounds):
        for k, own in enumerate(binned):
            g = gradient()
            h = (g + y) * (1 - g - y)
            size = len(model.tables[k])
            step = rate * _tree(np.bincount(own, g, size), np.bincount(own, h, size), l2)
            model.tables[k] += step
            total += step[own]
    coarse = [_quantile_cuts(x[:, k], pair_bins) for k in range(x.shape[1])]
    cells = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(coarse)]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(cells[a] * shape[1] + cells[b], values, shape[0] * shape[1]).reshape(shape)

    g = gradient()
    h = (g + y) * (1 - g - y)
    gains = [(_four_way(grid(a, b, g), grid(a, b, h), l2)[0], a, b) for a in range(x.shape[1]) for b in range(a)]
    best = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:n_pairs] if gain > 0]
    tables = {(a, b): np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in best}
    for _ in range(pair_rounds):
        for a, b in best:
            g = gradient()
            step = rate * _four_way(grid(a, b, g), grid(a, b, (g + y) * (1 - g - y)), l2)[1]
            tables[a, b] += step
            total += step[cells[a], cells[b]]
    model.pairs = [(a, b, coarse[a], coarse[b], table) for (a, b), table in tables.items()]
    return model


def labelled_sample(stats: DataFrame, labels: DataFrame, may_train: Column, sample_rows: int) -> pd.DataFrame:
    """FEATURES and quality of at most about sample_rows labelled documents."""
    known = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & may_train)
    n = known.count()
    part = 1 << 20
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) < int(part * min(1.0, sample_rows / max(1, n))))
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = stats.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # the sample is bounded
    return rows.select("doc_id", *FEATURES, "quality").toPandas().sort_values("doc_id")


def quality_scores(docs: DataFrame, labels: DataFrame, may_train: Column | None = None, sample_rows: int = 20_000, **fit) -> DataFrame:
    """doc_id and score (1: label 1 is likely) of every row of docs; labels are (doc_id, quality).

    may_train is a condition on doc_id of the labels that may be learnt from.
    """
    stats = scratch(text_statistics(docs, ["doc_id"]), "statistics")
    model = fit_labelled(stats, labels, may_train, sample_rows, **fit)
    return score_statistics(stats, model, ["doc_id"])


def fit_labelled(stats: DataFrame, labels: DataFrame, may_train: Column | None = None, sample_rows: int = 20_000, **fit) -> Gam:
    sample = labelled_sample(stats, labels, F.lit(True) if may_train is None else may_train, sample_rows)
    return fit_gam(sample[list(FEATURES)].to_numpy(float), sample["quality"].to_numpy(float), **fit)


def score_statistics(stats: DataFrame, model: Gam, keep: list[str]) -> DataFrame:
    fields = [stats.schema[k] for k in keep] + [T.StructField("score", T.DoubleType())]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(len(keep) + k).to_numpy(zero_copy_only=False) for k in range(len(FEATURES))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(model.score(x))], [*keep, "score"])

    return stats.select(*keep, *FEATURES).mapInArrow(score, T.StructType(fields))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = 20_000) -> DataFrame:
    """docs without those whose score is below threshold, the text being read once more to score it."""
    stats = scratch(text_statistics(docs, ["doc_id"]), "statistics")
    model = fit_labelled(stats, labels, None, sample_rows)
    schema = T.StructType([*docs.schema.fields])
    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, names.index("text")):
            texts = batch.column(names.index("text")).fill_null("").cast(pa.binary()).to_pylist()
            if texts:
                good = model.score(np.array([statistics(t) for t in texts])) >= threshold
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(kept, schema)

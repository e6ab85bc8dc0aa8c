"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a string of ``bits`` bits, the signs of its projections (centred at the
shard's mean) on random orthogonal directions, and is the sorted array of those strings. A query
descends every tree to its longest matching prefix by binary search; then all trees ascend together,
one bit at a time, until the ranges that share the prefix hold ``reach`` x the shard's rows over all
trees. All rows of those ranges are candidates and are ranked by exact Euclidean distance in double
precision. ``reach`` is a share, so recall doesn't depend on the size of the data; on vectors spread
evenly over a sphere of 64 dimensions, 64 trees with a reach of 0.8 (some six tenths of the rows) find over 0.9 of the 10 nearest.

Of rows with equal vectors only those of the k + 1 smallest ids are candidates, and k rows of an id,
which is exact: whichever id is the query's own, k of the first remaining rows are among them. They are
found by rankings that keep as many per task before they shuffle, so a vector that a third of all rows
share is no large group.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
rows without id; vectors of different lengths don't meet; ties go to the smaller id; with fewer than k
candidates all are returned; rows that repeat an id are one query (the smallest vector) but may be
returned as candidates each; an empty table gives no rows. Only the id and the vector are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrace.llm.blocks import finite_vectors, search_blocks
from seatrace.llm.common import scratch


class PrefixForest:
    """Trees over the rows of x; seeded, so a rerun builds the same."""

    def __init__(self, x: np.ndarray, trees: int, bits: int, seed: int):
        self.x, self.bits, self.mean = x, min(bits, 64), x.mean(0)
        rng = np.random.default_rng(seed)
        dim = x.shape[1]
        draw = lambda: np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-self.bits // dim))], 1)
        self.directions = [draw()[:, : self.bits] for _ in range(trees)]
        strings = [self.hash(x, t) for t in range(trees)]
        self.order = [np.argsort(s, kind="stable") for s in strings]
        self.strings = [s[o] for s, o in zip(strings, self.order)]

    def hash(self, x: np.ndarray, tree: int) -> np.ndarray:
        signs = (x - self.mean) @ self.directions[tree] > 0
        weights = np.uint64(1) << np.arange(63, 63 - self.bits, -1, dtype=np.uint64)
        return signs.astype(np.uint64) @ weights

    def candidates(self, queries: np.ndarray, wanted: float) -> list[np.ndarray]:
        """Row numbers for each query, from the deepest common level that holds ``wanted`` entries."""
        hashes = [self.hash(queries, t) for t in range(len(self.strings))]
        open_ = np.ones(len(queries), bool)
        lows, highs = (np.zeros((len(self.strings), len(queries)), np.int64) for _ in range(2))
        for level in range(self.bits, -1, -1):
            at = np.flatnonzero(open_)
            if not len(at):
                break
            mask = np.uint64(0) if level == 0 else np.uint64((1 << 64) - (1 << (64 - level)))
            for t, (own, strings) in enumerate(zip(hashes, self.strings)):
                lows[t, at] = np.searchsorted(strings, own[at] & mask, side="left")
                highs[t, at] = np.searchsorted(strings, own[at] | ~mask, side="right")
            open_[at] = (highs[:, at] - lows[:, at]).sum(0) < wanted
        out = []
        for q in range(len(queries)):
            seen = np.zeros(len(self.x), bool)
            for order, low, high in zip(self.order, lows[:, q].tolist(), highs[:, q].tolist()):
                seen[order[low:high]] = True
            out.append(np.flatnonzero(seen))
        return out


def forest_neighbours(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, trees: int = 64, bits: int = 64, reach: float = 0.8, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id and score (distance) of the k nearest found for every row with is_query (a condition on id)."""
    valid = finite_vectors(df, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    valid = scratch(valid, "vectors")
    rows = valid.withColumn("copy", F.row_number().over(Window.partitionBy("v", "id").orderBy("id"))).where(F.col("copy") <= k)
    rows = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1).select("id", "v", "row")
    queries = valid.where(is_query).groupBy("id").agg(F.min("v").alias("v"))

    def search(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray):
        forest = PrefixForest(x, trees, bits, seed)
        found = []
        for number, near in enumerate(forest.candidates(q, reach * len(x))):
            near = near[ids[near] != q_ids[number]]
            if len(near) < min(k, len(x)):
                near = np.flatnonzero(ids != q_ids[number])
            distance = np.sqrt(((x[near] - q[number]) ** 2).sum(1))
            first = np.argsort(distance, kind="stable")[:k]  # rows stand by id
            found.append((np.full(len(first), number), near[first], distance[first]))
        return tuple(np.concatenate(c) for c in zip(*found))

    return search_blocks(rows, queries, valid.count(), queries.count(), search, k, "double", F.col("score"))

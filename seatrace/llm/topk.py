"""Exact top-k inner products by columnar branch-and-bound.

Components are turned into integers floor(scale * x). A shard keeps its vectors by dimension (vertical
layout), dimensions in falling order of mass. A query adds up products one block of dimensions at a
time; after each block, what the remaining dimensions can still add is at most the product of the
remaining norms of query and vector, so a vector whose upper bound is below the k-th best lower bound
is dropped and the surviving columns are compacted. Sums are integers held in doubles as long as no
sum of products can reach 2 ** 53, else Python integers; bounds are widened by more than their rounding
error, so no vector of the true top k is lost.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows
without id; zero vectors do; vectors of different lengths don't meet; ties go to the smaller id; with
fewer than k candidates all are returned; rows that repeat an id are one query (the smallest vector)
but may be returned as candidates each; a score beyond 64 bits is an error; an empty table gives no
rows. Only the id and the vector are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatrace.llm.blocks import finite_vectors, search_blocks
from seatrace.llm.common import scratch


class VerticalBlocks:
    """Integer vectors by dimension, with the norm of what remains after each block."""

    def __init__(self, x: np.ndarray, width: int):
        self.order = np.argsort(-(x * x).sum(0), kind="stable")
        self.columns = np.ascontiguousarray(x[:, self.order].T)
        self.starts = list(range(0, len(self.order), width)) or [0]
        self.width = width
        squares = self.columns**2
        self.rest = [np.sqrt(squares[s + width :].sum(0)) for s in self.starts]

    def best(self, query: np.ndarray, skip: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and sums of the k best, best first, ties in row order; rows in ``skip`` are left out."""
        query = query[self.order]
        alive = np.flatnonzero(~skip)
        total = np.zeros(len(alive))
        for start, rest in zip(self.starts, self.rest):
            block = slice(start, start + self.width)
            columns = self.columns[block]
            total = total + query[block] @ (columns if len(alive) == columns.shape[1] else columns[:, alive])
            remaining = np.sqrt((query[start + self.width :] ** 2).sum())
            if len(alive) > k:
                reach = remaining * rest[alive] * (1 + 1e-9) + 1e-6
                least = np.partition(total - reach, len(alive) - k)[len(alive) - k]
                stay = total + reach >= least
                alive, total = alive[stay], total[stay]
        first = np.argsort(-total, kind="stable")[:k]
        return alive[first], total[first]


def top_inner_products(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, width: int = 8) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest integer inner products for every row with is_query (a condition on id)."""
    valid = scratch(finite_vectors(df, id_col, vector_col), "vectors")
    queries = valid.where(is_query).groupBy("id").agg(F.min("v").alias("v"))

    def search(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray):
        x, q = np.floor(scale * x), np.floor(scale * q)
        if x.size and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] >= 2**53:
            return _plain(ids, x, q_ids, q, k)
        blocks = VerticalBlocks(x, width)
        found = []
        for number, query in enumerate(q):
            rows, sums = blocks.best(query, ids == q_ids[number], k)
            found.append((np.full(len(rows), number), rows, sums.astype(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*found))

    return search_blocks(valid, queries, valid.count(), queries.count(), search, k, "long", F.col("score").desc())


def _plain(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int):
    """Sums of Python integers, for components so large that doubles would round."""
    x, q = ([[int(c) for c in row] for row in m.tolist()] for m in (x, q))
    found = []
    for number, query in enumerate(q):
        sums = {row: sum(map(int.__mul__, query, v)) for row, v in enumerate(x) if ids[row] != q_ids[number]}
        found += [(number, row, sums[row]) for row in sorted(sums, key=lambda r: (-sums[r], r))[:k]]
    columns = list(zip(*found)) or [(), (), ()]
    return np.array(columns[0], np.int64), np.array(columns[1], np.int64), np.array(columns[2], np.int64)

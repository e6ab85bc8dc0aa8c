"""A query set against all vectors in blocks, for the two searches.

Vectors are dealt to shards by a hash of their row number, so that rows of one id are spread, and queries
to blocks of bounded size; every pair
of a shard and a block of queries is one group, searched with numpy, that returns the best k of each
query. The groups' results are then ranked per query. Vectors meet only vectors of their own length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard: SPREAD at least while there are fewer than FEW shards, MOST at most.
SPREAD, FEW, MOST = 1024, 24, 32_768
QUERY_BLOCK = 2048

#: (ids of the shard, its vectors, query ids, query vectors) to (query number, row number, score) arrays.
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def finite_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, row) of rows with an id whose vector is not null and has only finite components, as doubles.

    row is their number, which holds once the result is written.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.monotonically_increasing_id().alias("row"))


def search_blocks(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, search: Search, k: int, score_type: str, best: Column) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best among rows (id, v, row) by ``best``, then id."""
    shards = max(-(-n_rows // MOST), min(FEW, -(-n_rows // SPREAD)), 1)
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    deal = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("dim", F.size("v")).withColumn("shard", deal("row", shards)).withColumn("block", every(blocks))
    right = queries.withColumn("dim", F.size("v")).withColumn("block", deal("id", blocks)).withColumn("shard", every(shards))
    arrow = pa.int64() if score_type == "long" else pa.float64()
    names = ["query_id", "vec_id", "score"]

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        if not vectors.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], arrow)], names)
        ids, q_ids = (t["id"].to_numpy() for t in (vectors, asked))
        order = np.argsort(ids, kind="stable")  # so that ties fall to smaller ids
        q, row, score = search(ids[order], _matrix(vectors)[order], q_ids, _matrix(asked))
        return pa.table([pa.array(q_ids[q]), pa.array(ids[order][row]), pa.array(score, arrow)], names)

    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(best, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(table: pa.Table) -> np.ndarray:
    column = table["v"].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

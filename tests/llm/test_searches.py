import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seatrace.llm import queries
from seatrace.llm.ann_forest import forest_neighbours
from seatrace.llm.topk import top_inner_products
from tests.compare import SMALL, assert_same
from tests.llm.samples import SF, rows

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
NAN, INF = float("nan"), float("inf")


def table(spark, data):
    return spark.createDataFrame(data, VECTORS).withColumn("id", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("rank", F.lit(2))


def odd(spark):
    good = [(k, [float(np.float32(np.sin(k * j + j))) for j in range(1, 9)]) for k in range(1, 60)]
    return table(spark, good + [(100, [0.5] * 8), (101, [0.5] * 8), (102, [0.5] * 8), (103, [0.5] * 8), (200, None), (300, [NAN] + [1.0] * 7), (400, [None] + [1.0] * 7), (500, [INF] * 8), (600, [0.0] * 8), (700, [1.0, 2.0]), (None, [1.0] * 8)])


def brute(data, is_query, k, score, order):
    out = []
    for q, v in data:
        if is_query(q):
            found = sorted(((score(v, w), c) for c, w in data if c != q and len(w) == len(v)), key=order)[:k]
            out += [(q, n, c, s) for n, (s, c) in enumerate(found, 1)]
    return sorted(out)


def valid(spark_rows):
    return [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark_rows if r["vec_id"] is not None and r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"])]


def distance(v, w):
    return float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()))


def test_forest_on_odd_rows_is_exact_on_few(spark):
    df = odd(spark)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(forest_neighbours(df, F.col("id") % 100 == 0, reach=1.0, trees=4)))
    data = [(k, v) for k, v in valid(df.collect()) if any(v)]
    want = brute(data, lambda q: q % 100 == 0, 10, distance, lambda x: x)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_forest_with_many_rows_of_equal_vectors_and_of_one_id(spark):
    near = [float(x) for x in range(1, 9)]
    data = [(100, near)] * 12 + [(101, near)] + [(7, near)] * 30 + [(k, [float(k)] * 8) for k in range(1, 5)]
    df = table(spark, data)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(forest_neighbours(df, F.col("id") % 100 == 0, reach=1.0, trees=4)))
    assert got == [(100, k + 1, 7, 0.0) for k in range(10)]
    few = table(spark, [(100, near)] * 12 + [(101, near), (1, [1.0] * 8)])
    got = rows(forest_neighbours(few, F.col("id") % 100 == 0, reach=1.0, trees=4))
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 101), (2, 1)]


def test_forest_recall_on_the_driver_table(spark):
    got = rows(queries.op1_prefix_forest(spark, SF))
    data = valid(spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    want = brute([(k, v) for k, v in data if any(v)], lambda q: q % 100 == 0, 10, distance, lambda x: x)
    found = {(g["query_id"], g["vec_id"]) for g in got}
    assert len(got) == len(want)
    assert len(found & {(w[0], w[2]) for w in want}) >= 0.9 * len(want)
    exact = dict(data)
    assert all(abs(g["score"] - distance(exact[g["query_id"]], exact[g["vec_id"]])) < 1e-12 for g in got)


def test_forest_recall_on_vectors_without_structure(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    df = table(spark, [(k, v.tolist()) for k, v in enumerate(x)])
    got = {(g["query_id"], g["vec_id"]) for g in rows(forest_neighbours(df, F.col("id") % 300 == 0))}
    x = x.astype(float)
    want = set()
    for q in range(0, 3000, 300):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = INF
        want |= {(q, int(c)) for c in np.argsort(d, kind="stable")[:10]}
    assert len(got & want) >= 0.9 * len(want)


def test_searches_of_nothing(spark):
    nothing = spark.createDataFrame([], VECTORS)
    assert rows(forest_neighbours(nothing, F.lit(True))) == []
    assert rows(top_inner_products(nothing, F.lit(True))) == []


def test_branch_and_bound_on_odd_rows(spark):
    df = odd(spark)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(top_inner_products(df, F.col("id") % 50 == 0)))
    data = [(k, [int(np.floor(256 * x)) for x in v]) for k, v in valid(df.collect())]
    want = brute(data, lambda q: q % 50 == 0, 5, lambda v, w: sum(map(int.__mul__, v, w)), lambda x: (-x[0], x[1]))
    assert got == want


def test_branch_and_bound_with_large_components(spark):
    df = table(spark, [(k, [3e12 + k * 1e9, float(k), 1.0]) for k in range(0, 120, 10)])
    try:
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(top_inner_products(df, F.col("id") % 50 == 0, scale=1)))
    except Exception as error:  # beyond 64 bits it is an error, as the operator says
        assert "OverflowError" in str(error) or "too large" in str(error) or "int too big" in str(error) or "too big" in str(error)
    else:
        raise AssertionError(got)


def test_branch_and_bound_equals_sql(spark):
    assert_same(queries.op6_branch_and_bound(spark, SMALL), SMALL, queries.ORACLE_SQL["op6_branch_and_bound"])

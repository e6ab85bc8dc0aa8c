"""Places of the local projection have the same last bits as in SQL, so depths from them round to the same millimetres."""

import duckdb
from pyspark.sql import functions as F

from seatrace.functions import geodesy
from seatrace.plans import queries

POINTS = 20_000


def test_places_are_those_of_the_sql_to_the_last_bit(spark):
    k = F.col("id")
    points = spark.range(POINTS).select(k.alias("t0"), (k * 7919 % 400_009 / 13.0 - 9000).alias("x"), (k * 104_729 % 60_013 / 17.0 - 1700).alias("y"))
    got = {r["t0"]: (r["q"]["lon"], r["q"]["lat"]) for r in points.select("t0", geodesy.local_inverse(F.col("x"), F.col("y"), *queries.CENTRE).alias("q")).collect()}
    lon, lat = queries.CENTRE
    source = f"SELECT t0, {lon} AS lon, atan((1 - {geodesy.FLATTENING!r}) * tan(radians({lat}))) AS u, atan2(x, y) AS az, sqrt(x * x + y * y) AS dist FROM points"
    with duckdb.connect() as con:
        con.execute("CREATE TABLE points (t0 BIGINT, x DOUBLE, y DOUBLE)")
        con.execute(f"INSERT INTO points SELECT i, CAST(i * 7919 % 400009 AS DOUBLE) / 13 - 9000, CAST(i * 104729 % 60013 AS DOUBLE) / 17 - 1700 FROM range({POINTS}) r(i)")
        want = {t: (a, b) for t, a, b in con.execute(f"WITH {queries._direct_sql(source)} SELECT t0, lon_at, lat_at FROM placed").fetchall()}
    assert got == want and len(got) == POINTS


def test_places_without_a_coordinate(spark):
    rows = spark.createDataFrame([(None, 1.0), (1.0, None), (float("inf"), 0.0), (0.0, 0.0)], "x double, y double")
    got = [r["q"] for r in rows.coalesce(1).select(geodesy.local_inverse(F.col("x"), F.col("y"), *queries.CENTRE).alias("q")).collect()]
    missing = lambda v: v is None or v != v
    assert all(missing(q["lon"]) and missing(q["lat"]) for q in got[:3]) and abs(got[3]["lat"] - queries.CENTRE[1]) < 1e-12

"""Stand-in tracks, lines, rasters and catches made from the generic test tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Message type that stands for each event type.
MESSAGE_TYPES = {"view": 1, "signup": 18, "click": 27, "purchase": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def micros_of(when: datetime) -> int:
    return round(when.replace(tzinfo=UTC).timestamp() * 1_000_000)


def sway(event_id: str = "event_id") -> Column:
    return (50 * (F.col(event_id) % 7 - 3)).cast("double")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mmsi, ts, us, event_id, x, y, depth): x never falls, y swings; whole hundredths of metres."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("mmsi"), "ts", micros("ts").alias("us"), "value")
    w = Window.partitionBy("mmsi").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).over(w).cast("double") / 100
    depth = (100 + F.col("event_id") % 40 * 20).cast("double")
    return events.select("mmsi", "ts", "us", "event_id", x.alias("x"), sway().alias("y"), depth.alias("depth"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mmsi, ts to the hour, message_type, lon, lat, event_id): several reports for some hours."""
    kind = F.lit(None).cast("int")
    for name, number in MESSAGE_TYPES.items():
        kind = F.when(F.col("event_type") == name, number).otherwise(kind)
    events = table(spark, sf_dir, "events")
    lon, lat = F.floor(F.col("value") * 100 + 0.5).cast("long"), F.col("event_id") % 89
    return events.select(F.col("user_id").alias("mmsi"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), kind.alias("message_type"), lon.alias("lon"), lat.alias("lat"), "event_id")


def cable(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    y = 20 * ((k * 7) % 5 - 2)
    return table(spark, sf_dir, "nation").select(F.lit("cable_a").alias("cable_id"), k.alias("seq"), (200 * k).cast("double").alias("x"), y.cast("double").alias("y"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, elevation) in thousandths of the embeddings' components."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "e"))
    return cells.select("row", "col", F.floor(F.col("e").cast("double") * 1000).cast("int").alias("elevation"))


#: Where the stand-in sea lies in the plane of the tracks: north-west corner, and width and height of a cell.
SEA_CORNER, SEA_PIXEL = (-2000.0, 800.0), (500.0, 8.0)


def sea(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, elevation): the stand-in raster as a sea bed, 100 to 899 below the surface everywhere."""
    bed = (-100 - F.abs("elevation") % 800).cast("int")
    return raster(spark, sf_dir).select("row", "col", bed.alias("elevation"))


def antenna_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mmsi, event_id, us, x, y, vx, vy): every place of a track but its last, with ten seconds to the next."""
    points = track(spark, sf_dir)
    w = Window.partitionBy("mmsi").orderBy("us", "event_id")
    ahead = points.withColumns({f"v{p}": (F.lead(p).over(w) - F.col(p)) / 10 for p in "xy"})
    return ahead.where("vx is not null").select("mmsi", "event_id", "us", "x", "y", "vx", "vy")


def catches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as catch reports: every fifth has no gear specification."""
    items = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_partkey")
    return items.select(
        F.when(F.col("l_orderkey") % 2 == 0, "25").otherwise("21").alias("area"),
        F.format_string("%02d", F.col("l_linenumber")).alias("location"),
        F.year("l_shipdate").alias("year"),
        F.col("l_shipdate").alias("start"),
        F.col("l_linestatus").alias("gear_group"),
        F.col("l_returnflag").alias("gear"),
        F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit("S"), (F.col("l_partkey") % 3).cast("string"))).alias("specification"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, lon, lat) over the sea: 6 to 18 degrees east, 76 to 79 north."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", (6 + (k % 600) / 50).alias("lon"), (76 + (k % 300) / 100).alias("lat"))


def speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mmsi, us, longitude, latitude, lon, lat, speed, course): some without a speed."""
    k = F.col("event_id")
    lon, lat, speed = 9 + k % 7 / 10, 78 + k % 5 / 10, F.when(k % 11 != 0, k % 5 / 4)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("mmsi"), micros("ts").alias("us"), lon.alias("longitude"), lat.alias("latitude"), lon.alias("lon"), lat.alias("lat"),
        speed.alias("speed"), F.col("value").alias("course"),
    )


#: The same stand-ins as SQL, to be put before a query.
TRACK_SQL = """track AS (SELECT user_id AS mmsi, ts, epoch_us(ts) AS us, event_id,
  CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 100 AS x,
  CAST(50 * (event_id % 7 - 3) AS DOUBLE) AS y, CAST(100 + event_id % 40 * 20 AS DOUBLE) AS depth FROM events)"""
REPORTS_SQL = """reports AS (SELECT user_id AS mmsi, date_trunc('hour', ts) AS hour,
  CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 18 WHEN 'click' THEN 27 WHEN 'purchase' THEN 3 END AS message_type,
  CAST(floor(value * 100 + 0.5) AS BIGINT) AS lon, event_id % 89 AS lat, event_id FROM events)"""
CABLE_SQL = """cable AS (SELECT 'cable_a' AS cable_id, n_nationkey AS seq, CAST(200 * n_nationkey AS DOUBLE) AS x, CAST(20 * ((n_nationkey * 7) % 5 - 2) AS DOUBLE) AS y FROM nation),
segments AS (SELECT * FROM (SELECT cable_id, seq AS seg, x AS cx0, y AS cy0, lead(x) OVER w AS cx1, lead(y) OVER w AS cy1 FROM cable WINDOW w AS (PARTITION BY cable_id ORDER BY seq)) WHERE cx1 IS NOT NULL)"""
RASTER_SQL = """cells AS (SELECT CAST(vec_id AS INTEGER) AS row, CAST(i - 1 AS INTEGER) AS col, CAST(floor(CAST(embedding[i] AS DOUBLE) * 1000) AS INTEGER) AS elevation
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i))"""
SEA_SQL = RASTER_SQL.replace("cells AS", "land AS") + """, cells AS (SELECT row, col, -100 - abs(elevation) % 800 AS elevation FROM land)"""
#: Tow points with the depth of the sea under them, under the name of the tracks they come from.
TOWED_SQL = TRACK_SQL.replace("track AS", "antenna AS") + f""", {SEA_SQL},
aft AS (SELECT mmsi, event_id, us, x - vx / v * 25 AS x, y - vy / v * 25 AS y FROM (SELECT *, sqrt(vx * vx + vy * vy) AS v FROM (
  SELECT *, (lead(x) OVER w - x) / 10 AS vx, (lead(y) OVER w - y) / 10 AS vy FROM antenna WINDOW w AS (PARTITION BY mmsi ORDER BY us, event_id))) WHERE v >= 0.01),
pixels AS (SELECT *, CAST(floor(px - 0.5) AS INTEGER) AS c, CAST(floor(py - 0.5) AS INTEGER) AS r FROM (
  SELECT *, (x - {SEA_CORNER[0]}) / {SEA_PIXEL[0]} AS px, ({SEA_CORNER[1]} - y) / {SEA_PIXEL[1]} AS py FROM aft)),
stencil AS (SELECT p.*, a.elevation AS e0, b.elevation AS e1, d.elevation AS e2, e.elevation AS e3, px - (c + 0.5) AS dx, py - (r + 0.5) AS dy FROM pixels p
  LEFT JOIN cells a ON a.row = r AND a.col = c LEFT JOIN cells b ON b.row = r AND b.col = c + 1 LEFT JOIN cells d ON d.row = r + 1 AND d.col = c LEFT JOIN cells e ON e.row = r + 1 AND e.col = c + 1),
track AS (SELECT mmsi, event_id, us, x, y, CASE WHEN e < 0 THEN -e END AS depth FROM (SELECT *, e0 * (1 - dx) * (1 - dy) + e1 * dx * (1 - dy) + e2 * (1 - dx) * dy + e3 * dx * dy AS e FROM stencil))"""
STEPS_SQL = """steps AS (SELECT * FROM (SELECT mmsi, us AS t0, x AS x0, y AS y0, lead(us) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1
  FROM track WINDOW w AS (PARTITION BY mmsi ORDER BY us, event_id)) WHERE t1 IS NOT NULL)"""

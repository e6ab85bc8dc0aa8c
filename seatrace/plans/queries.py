"""The registered queries over the test tables, each with the SQL that gives the same rows.

Lengths leave a query as whole millimetres (floor(1000 x + 0.5)), angles as whole millionths, so both
engines agree on the last digit; counts are 64-bit.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seatrace.functions import geodesy, masks, records
from seatrace.functions.spline import smooth_tracks, smooth_whole_tracks
from seatrace.operators import crossings, gear, paths, positions, provenance, raster, runs, summaries, tiles, validation
from seatrace.plans import bridge
from seatrace.plans.bridge import CABLE_SQL, RASTER_SQL, REPORTS_SQL, STEPS_SQL, TOWED_SQL, TRACK_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def whole(value: Column, scale: int) -> Column:
    return F.floor(value * scale + 0.5).cast("long")


def mm(value: Column) -> Column:
    return whole(value, 1000)


def mm_sql(value: str, name: str, scale: int = 1000) -> str:
    return f"CAST(floor(({value}) * {scale} + 0.5) AS BIGINT) AS {name}"


RATIOS, SPREADS = [2.0, 2.5, 3.0, 3.5, 4.0], [120.0, 320.0, 520.0]
MAX_WARP, DEPTH_OFFSET = 3000.0, -20.0
GRID_SQL = f"""grid AS (SELECT printf('G%04d', r.k * {len(SPREADS)} + s.k) AS scenario_id, r.v AS ratio, s.v AS spread FROM
  (VALUES {", ".join(f"({k}, CAST({v} AS DOUBLE))" for k, v in enumerate(RATIOS))}) r(k, v), (VALUES {", ".join(f"({k}, CAST({v} AS DOUBLE))" for k, v in enumerate(SPREADS))}) s(k, v))"""
STATUS_SQL = f"""status AS (SELECT scenario_id, ratio, spread, reason IS NULL AS accepted, reason AS rejection_reason FROM (SELECT *,
  CASE WHEN missing THEN '{gear.NO_DEPTH}' WHEN ratio * deep > {MAX_WARP} THEN '{gear.CEILING}' WHEN short <= 0 THEN '{gear.REACH}' END AS reason
  FROM (SELECT scenario_id, ratio, spread, max(depth + {DEPTH_OFFSET}) AS deep, bool_or(depth IS NULL) AS missing,
    min(ratio * (depth + {DEPTH_OFFSET}) * (ratio * (depth + {DEPTH_OFFSET})) - (depth + {DEPTH_OFFSET}) * (depth + {DEPTH_OFFSET}) - spread / 2 * (spread / 2)) AS short FROM grid, track GROUP BY ALL)))"""


def _grid(spark: SparkSession) -> DataFrame:
    return gear.scenario_grid(spark, RATIOS, SPREADS)


def _towed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The antenna's tracks, 25 m aft, with the depth of the sea there."""
    return gear.towed_track(bridge.antenna_steps(spark, sf_dir), bridge.sea(spark, sf_dir), 25.0, bridge.SEA_CORNER, bridge.SEA_PIXEL)


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gear.scenario_status(_towed(spark, sf_dir), _grid(spark), MAX_WARP, depth_offset=DEPTH_OFFSET)


def _steps(track: DataFrame) -> DataFrame:
    return paths.consecutive(track, "mmsi", ["us", "event_id"], ["us", "x", "y"]).withColumnsRenamed({"us0": "t0", "us1": "t1"})


def _crossings(spark: SparkSession, sf_dir: str, **window) -> DataFrame:
    segments = paths.polyline_segments(bridge.cable(spark, sf_dir))
    return crossings.crossings(_steps(bridge.track(spark, sf_dir)), segments, ["mmsi"], 400.0, **window)


HITS_SQL = """hits AS (SELECT *, t0 + u * (t1 - t0) AS t, x0 + u * (x1 - x0) AS cx, y0 + u * (y1 - y0) AS cy FROM (
  SELECT *, ((cx0 - x0) * (cy1 - cy0) - (cy0 - y0) * (cx1 - cx0)) / den AS u, ((cx0 - x0) * (y1 - y0) - (cy0 - y0) * (x1 - x0)) / den AS v FROM (
  SELECT *, (x1 - x0) * (cy1 - cy0) - (y1 - y0) * (cx1 - cx0) AS den FROM steps, segments
  WHERE least(x0, x1) <= greatest(cx0, cx1) AND greatest(x0, x1) >= least(cx0, cx1)) WHERE den <> 0) WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1),
crossed AS (SELECT * FROM (SELECT *, t - lag(t) OVER (PARTITION BY mmsi, cable_id ORDER BY t, seg) AS gap FROM hits) WHERE gap IS NULL OR gap >= 1)"""


@query(f"WITH {TRACK_SQL}, {STEPS_SQL}, {CABLE_SQL}, {HITS_SQL} SELECT mmsi, cable_id, CAST(count(*) AS BIGINT) AS crossings, CAST(floor(min(t)) AS BIGINT) AS first_us, CAST(floor(max(t)) AS BIGINT) AS last_us FROM crossed GROUP BY mmsi, cable_id")
def crossing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which vessels cross the cable, how often, and when first and last."""
    found = _crossings(spark, sf_dir).groupBy("mmsi", "cable_id")
    return found.agg(F.count("*").alias("crossings"), F.floor(F.min("t")).alias("first_us"), F.floor(F.max("t")).alias("last_us"))


@query(f"WITH {TRACK_SQL}, {STEPS_SQL}, {CABLE_SQL}, {HITS_SQL} SELECT mmsi, cable_id, seg, CAST(floor(t) AS BIGINT) AS t_us, {mm_sql('cx', 'cx_mm')}, {mm_sql('cy', 'cy_mm')} FROM crossed")
def cable_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crossings(spark, sf_dir).select("mmsi", "cable_id", "seg", F.floor("t").alias("t_us"), mm(F.col("cx")).alias("cx_mm"), mm(F.col("cy")).alias("cy_mm"))


@query(f"WITH {TRACK_SQL}, {STEPS_SQL}, {CABLE_SQL}, {HITS_SQL}, f AS (SELECT *, t >= epoch_us(TIMESTAMP '2024-01-10') AND t < epoch_us(TIMESTAMP '2024-01-20') AS inside FROM crossed) SELECT CAST(count(*) AS BIGINT) AS crossings, CAST(count(*) FILTER (inside) AS BIGINT) AS inside, CAST(count(DISTINCT mmsi) AS BIGINT) AS vessels, CAST(count(DISTINCT CASE WHEN inside THEN mmsi END) AS BIGINT) AS vessels_inside, CAST(floor(avg(CASE WHEN inside THEN cx END) + 0.5) AS BIGINT) AS centre_x, CAST(floor(avg(CASE WHEN inside THEN cy END) + 0.5) AS BIGINT) AS centre_y FROM f")
def crossing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and centroid of the crossings within a half-open interval."""
    bounds = [F.lit(d).cast("timestamp") for d in ("2024-01-10", "2024-01-20")]
    inside = (F.col("t") >= F.unix_micros(bounds[0])) & (F.col("t") < F.unix_micros(bounds[1]))
    found = _crossings(spark, sf_dir).withColumn("inside", inside)
    centre = lambda c: F.floor(F.avg(F.when(F.col("inside"), F.col(c))) + 0.5).cast("long")
    return found.agg(
        F.count("*").alias("crossings"), F.count_if("inside").alias("inside"), F.countDistinct("mmsi").alias("vessels"),
        F.countDistinct(F.when(F.col("inside"), F.col("mmsi"))).alias("vessels_inside"), centre("cx").alias("centre_x"), centre("cy").alias("centre_y"),
    )


CLIP = ("2024-01-10 00:00:00", "2024-01-10 12:00:00")
CLIP_SQL = """clipped AS (SELECT mmsi, a AS t0, b AS t1, x0 + (a - t0) / (t1 - t0) * (x1 - x0) AS x0, x0 + (b - t0) / (t1 - t0) * (x1 - x0) AS x1,
  y0 + (a - t0) / (t1 - t0) * (y1 - y0) AS y0, y0 + (b - t0) / (t1 - t0) * (y1 - y0) AS y1 FROM (SELECT *,
  CAST(greatest(t0, epoch_us(TIMESTAMP '{}')) AS DOUBLE) AS a, CAST(least(t1, epoch_us(TIMESTAMP '{}')) AS DOUBLE) AS b FROM steps) WHERE a < b)""".format(*CLIP)


@query(f"WITH {TRACK_SQL}, {STEPS_SQL}, {CABLE_SQL}, {CLIP_SQL}, {HITS_SQL.replace('FROM steps, segments', 'FROM clipped, segments')} SELECT mmsi, seg, CAST(floor((t - epoch_us(TIMESTAMP '{CLIP[0]}')) / 1000) AS BIGINT) AS t_ms FROM crossed WHERE t < epoch_us(TIMESTAMP '{CLIP[1]}')")
def clipped_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings within half a day, steps being cut to it first."""
    a, b = (int(datetime.fromisoformat(f"{d}+00:00").timestamp() * 1e6) for d in CLIP)
    return _crossings(spark, sf_dir, start=float(a), end=float(b)).select("mmsi", "seg", F.floor((F.col("t") - a) / 1000).alias("t_ms"))


@query(f"WITH {REPORTS_SQL} SELECT mmsi, hour, message_type, lon, lat, event_id FROM reports QUALIFY row_number() OVER (PARTITION BY mmsi, hour ORDER BY CASE WHEN message_type IN (1, 2, 3) THEN 0 WHEN message_type IN (18, 19) THEN 1 WHEN message_type = 27 THEN 2 ELSE 3 END, coalesce(message_type, 999), lon, lat, event_id) = 1")
def report_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = positions.best_reports(bridge.reports(spark, sf_dir), ["mmsi", "hour"], ["lon", "lat", "event_id"])
    return best.select("mmsi", "hour", "message_type", "lon", "lat", "event_id")


@query("WITH p AS (SELECT user_id AS mmsi, date_trunc('hour', ts) AS ts, CAST(floor(value / 25) AS BIGINT) AS x, event_id % 7 AS y FROM events) SELECT mmsi, x, y FROM (SELECT DISTINCT ON (mmsi, ts, x, y) * FROM p WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12')")
def distinct_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("mmsi"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.floor(F.col("value") / 25).alias("x"), (F.col("event_id") % 7).alias("y"))
    return positions.distinct_positions(rows, "2024-01-05", "2024-01-12")


ISLANDS_SQL = """p AS (SELECT user_id AS mmsi, epoch_us(ts) AS us, event_id, CAST(floor(value / 100) AS BIGINT) AS x, CAST(0 AS BIGINT) AS y FROM events),
c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(x) OVER w IS DISTINCT FROM x OR lag(y) OVER w IS DISTINCT FROM y THEN 1 ELSE 0 END AS changed FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY us, event_id)),
g AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY mmsi ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS island FROM c),
islands AS (SELECT mmsi, island, CAST(floor((min(us) + max(us)) / 2) AS BIGINT) AS us, any_value(x) AS x, any_value(y) AS y, CAST(count(*) AS BIGINT) AS size FROM g GROUP BY mmsi, island)"""


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("mmsi"), bridge.micros("ts").alias("us"), "event_id", F.floor(F.col("value") / 100).alias("x"), F.lit(0).cast("long").alias("y"))
    return positions.position_islands(rows, "x", "y")


@query(f"WITH {ISLANDS_SQL} SELECT * FROM islands")
def position_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _islands(spark, sf_dir)


JUMP_LIMIT = 0.05
OUTLIERS_SQL = f"""j AS (SELECT user_id AS mmsi, event_id, epoch_us(ts) / 1e6 AS t, value * 10 AS x, CAST(50 * (event_id % 7 - 3) AS DOUBLE) AS y FROM events),
d AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) / abs(t - lag(t) OVER w) AS v0,
  sqrt((x - lead(x) OVER w) * (x - lead(x) OVER w) + (y - lead(y) OVER w) * (y - lead(y) OVER w)) / abs(t - lead(t) OVER w) AS v1,
  count(*) OVER (PARTITION BY mmsi) AS n FROM j WINDOW w AS (PARTITION BY mmsi ORDER BY t, event_id)),
kept AS (SELECT mmsi, event_id FROM d WHERE NOT coalesce(v0 > {JUMP_LIMIT} AND v1 > {JUMP_LIMIT} AND n >= 4, false))"""


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("mmsi"), "event_id", (bridge.micros("ts") / 1e6).alias("t"), (F.col("value") * 10).alias("x"), bridge.sway().alias("y"))
    return positions.drop_speed_outliers(rows, JUMP_LIMIT, ["t", "event_id"])


@query(f"WITH {OUTLIERS_SQL} SELECT mmsi, event_id FROM kept")
def speed_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("mmsi", "event_id")


QUALITY_SQL = f"""{ISLANDS_SQL}, jumps AS (SELECT *, abs(x - lag(x) OVER v) / (abs(us - lag(us) OVER v) / 1e6) AS v0, abs(x - lead(x) OVER v) / (abs(us - lead(us) OVER v) / 1e6) AS v1,
  count(*) OVER (PARTITION BY mmsi) AS n FROM islands WINDOW v AS (PARTITION BY mmsi ORDER BY us, island)),
good AS (SELECT * FROM jumps WHERE NOT coalesce(v0 > 0.0002 AND v1 > 0.0002 AND n >= 4, false))"""


@query(
    f"WITH {QUALITY_SQL} SELECT CAST((SELECT count(*) FROM events) AS BIGINT) AS source_positions, CAST((SELECT count(*) FROM islands) AS BIGINT) AS position_groups, "
    "CAST((SELECT count(*) FROM good) AS BIGINT) AS kept_positions, CAST((SELECT count(*) FROM islands) - (SELECT count(*) FROM good) AS BIGINT) AS rejected_positions"
)
def track_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, groups of repeats, and groups that isolated jumps reject."""
    islands = _islands(spark, sf_dir).withColumn("t", F.col("us") / 1e6)
    kept = positions.drop_speed_outliers(islands, 0.0002, ["us", "island"])
    return positions.track_quality(table(spark, sf_dir, "events"), islands, kept)


@query("""WITH c AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN '25' ELSE '21' END AS area, printf('%02d', l_linenumber) AS location, year(l_shipdate) AS year, month(l_shipdate) AS month,
  l_linestatus AS gear_group, l_returnflag AS gear, CASE WHEN l_partkey % 5 <> 0 THEN 'S' || (l_partkey % 3) END AS specification FROM lineitem)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (gear = 'A') AS BIGINT) AS gear_rows, CAST(count(*) FILTER (gear IS DISTINCT FROM 'A') AS BIGINT) AS other_gear,
  CAST(count(*) FILTER (specification = 'S1') AS BIGINT) AS usual_specification, CAST(count(*) FILTER (specification IS DISTINCT FROM 'S1') AS BIGINT) AS other_specification
FROM c WHERE ((area = '25' AND location IN ('04', '05')) OR (area = '21' AND location IN ('01', '02'))) AND year BETWEEN 1995 AND 1998 AND month BETWEEN 1 AND 4 AND gear_group = 'F'""")
def trawl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = {"25": ("04", "05"), "21": ("01", "02")}
    return summaries.trawl_counts(bridge.catches(spark, sf_dir), areas, (1995, 1998), (1, 4), "F", "A", "S1")


SCREEN_REACH = 60.0
SCREEN_SQL = """screen AS (SELECT mmsi, cable_id, min(sqrt((x - (cx0 + p * dx)) * (x - (cx0 + p * dx)) + (y - (cy0 + p * dy)) * (y - (cy0 + p * dy)))) AS distance FROM (
  SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0.0, least(1.0, ((x - cx0) * dx + (y - cy0) * dy) / (dx * dx + dy * dy))) ELSE 0.0 END AS p FROM (
  SELECT *, cx1 - cx0 AS dx, cy1 - cy0 AS dy FROM track, segments WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11')) GROUP BY mmsi, cable_id)"""


def _screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = bridge.track(spark, sf_dir).where(positions.half_open("ts", "2024-01-10", "2024-01-11")).select("mmsi", "x", "y")
    return paths.screen_vessels(points, paths.polyline_segments(bridge.cable(spark, sf_dir)), SCREEN_REACH)


@query(f"WITH {TRACK_SQL}, {CABLE_SQL}, {SCREEN_SQL} SELECT mmsi, cable_id, {mm_sql('distance', 'distance_mm')}, distance <= {SCREEN_REACH} AS within FROM screen")
def candidate_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screen(spark, sf_dir).select("mmsi", "cable_id", mm(F.col("distance")).alias("distance_mm"), "within")


@query(f"WITH {TRACK_SQL}, {CABLE_SQL}, {SCREEN_SQL} SELECT CAST(count(DISTINCT mmsi) AS BIGINT) AS observed, CAST(count(DISTINCT CASE WHEN distance <= {SCREEN_REACH} THEN mmsi END) AS BIGINT) AS retained FROM screen")
def screen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screen(spark, sf_dir).agg(F.countDistinct("mmsi").alias("observed"), F.countDistinct(F.when(F.col("within"), F.col("mmsi"))).alias("retained"))


CHAIN_SQL = """chain AS (SELECT *, CAST(sum(step_mm) OVER (PARTITION BY mmsi ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chainage_mm FROM (
  SELECT *, coalesce(CAST(floor(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) * 1000 + 0.5) AS BIGINT), 0) AS step_mm
  FROM track WINDOW w AS (PARTITION BY mmsi ORDER BY us, event_id)))"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.chainage(bridge.track(spark, sf_dir), ["us", "event_id"])


@query(f"WITH {TRACK_SQL}, {CHAIN_SQL} SELECT mmsi, event_id, step_mm, chainage_mm FROM chain")
def tow_chainage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir).select("mmsi", "event_id", "step_mm", "chainage_mm")


@query(f"WITH {TRACK_SQL}, {STEPS_SQL} SELECT mmsi, t0, {mm_sql('CASE WHEN v >= 0.01 THEN x0 - vx / v * 25 END', 'tow_x_mm')}, {mm_sql('CASE WHEN v >= 0.01 THEN y0 - vy / v * 25 END', 'tow_y_mm')} FROM (SELECT *, sqrt(vx * vx + vy * vy) AS v FROM (SELECT *, (x1 - x0) / 10 AS vx, (y1 - y0) / 10 AS vy FROM steps))")
def tow_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(bridge.track(spark, sf_dir)).select("mmsi", "t0", F.col("x0").alias("x"), F.col("y0").alias("y"), ((F.col("x1") - F.col("x0")) / 10).alias("vx"), ((F.col("y1") - F.col("y0")) / 10).alias("vy"))
    return paths.tow_points(steps, 25).select("mmsi", "t0", mm(F.col("tow_x")).alias("tow_x_mm"), mm(F.col("tow_y")).alias("tow_y_mm"))


PATH_SQL = """path AS (SELECT * FROM (SELECT mmsi, chainage_mm / 1000 AS s0, lead(chainage_mm) OVER w / 1000 AS s1, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1
  FROM chain WINDOW w AS (PARTITION BY mmsi ORDER BY us, event_id)) WHERE s1 > s0)"""


def _path(chain: DataFrame) -> DataFrame:
    ends = paths.consecutive(chain.withColumn("s", F.col("chainage_mm") / 1000), "mmsi", ["us", "event_id"], ["s", "x", "y"])
    return ends.where("s1 > s0")


@query(f"WITH {TRACK_SQL}, {CHAIN_SQL}, {PATH_SQL} SELECT c.mmsi, event_id, {mm_sql('x0 + (pos - s0) / (s1 - s0) * (x1 - x0)', 'ix_mm')}, {mm_sql('y0 + (pos - s0) / (s1 - s0) * (y1 - y0)', 'iy_mm')} FROM (SELECT mmsi, event_id, chainage_mm / 1000 - 700 AS pos FROM chain) c JOIN path p ON c.mmsi = p.mmsi AND s0 <= pos AND pos < s1")
def path_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each vessel was 700 m earlier along its own path."""
    chain = _chain(spark, sf_dir)
    probes = chain.select("mmsi", "event_id", (F.col("chainage_mm") / 1000 - 700).alias("at"))
    found = paths.interpolate(probes, _path(chain), "at", 500.0)
    return found.select("mmsi", "event_id", mm(F.col("ix")).alias("ix_mm"), mm(F.col("iy")).alias("iy_mm"))


@query(f"WITH {GRID_SQL} SELECT * FROM grid")
def scenario_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark)


@query(f"WITH {TOWED_SQL}, {GRID_SQL}, {STATUS_SQL} SELECT * FROM status")
def scenario_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


@query(f"WITH {TOWED_SQL}, {GRID_SQL}, {STATUS_SQL} SELECT CAST(count(*) FILTER (accepted) AS BIGINT) AS accepted, CAST(count(*) FILTER (NOT accepted) AS BIGINT) AS rejected FROM status")
def scenario_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


@query(f"""WITH {TOWED_SQL}, {GRID_SQL}, {STATUS_SQL}, e AS (SELECT (min(ratio) + max(ratio)) / 2 AS mr, (min(spread) + max(spread)) / 2 AS ms, CASE WHEN max(ratio) > min(ratio) THEN max(ratio) - min(ratio) ELSE 1.0 END AS sr, CASE WHEN max(spread) > min(spread) THEN max(spread) - min(spread) ELSE 1.0 END AS ss FROM status)
SELECT scenario_id, ratio, spread FROM status, e WHERE accepted ORDER BY abs(ratio - mr) / sr + abs(spread - ms) / ss, ratio, spread LIMIT 1""")
def reference_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gear.reference_case(_status(spark, sf_dir))


@query(f"WITH {TOWED_SQL}, {GRID_SQL}, {STATUS_SQL} SELECT r.ratio, s.spread FROM (SELECT DISTINCT ratio FROM status WHERE accepted) r, (SELECT DISTINCT spread FROM status WHERE accepted) s WHERE NOT EXISTS (SELECT 1 FROM status t WHERE t.accepted AND t.ratio = r.ratio AND t.spread = s.spread)")
def missing_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gear.missing_cells(_status(spark, sf_dir).where("accepted"))


GEAR_SQL = f"""tows AS (SELECT mmsi, event_id, us, chainage_mm / 1000 AS s, x, y, depth, depth + {DEPTH_OFFSET} AS d FROM chain),
swept AS (SELECT *, sqrt(l2) AS lag FROM (SELECT t.*, g.scenario_id, g.ratio, g.spread, g.ratio * d * (g.ratio * d) - d * d - g.spread / 2 * (g.spread / 2) AS l2 FROM tows t, status g WHERE g.accepted) WHERE l2 > 0),
found AS (SELECT w.*, x0 + (s - lag - s0) / (s1 - s0) * (x1 - x0) AS ix, y0 + (s - lag - s0) / (s1 - s0) * (y1 - y0) AS iy FROM swept w JOIN path p ON w.mmsi = p.mmsi AND s0 <= s - lag AND s - lag < s1),
turned AS (SELECT *, (x - ix) / chord AS ux, (y - iy) / chord AS uy FROM (SELECT *, sqrt((x - ix) * (x - ix) + (y - iy) * (y - iy)) AS chord FROM found) WHERE chord >= 1),
centred AS (SELECT *, x - lag * ux AS cx, y - lag * uy AS cy FROM turned),
placed AS (SELECT scenario_id, mmsi, event_id, us, component, cx + across * -uy AS px, cy + across * ux AS py FROM (SELECT *, 'port_door' AS component, spread / 2 AS across FROM centred UNION ALL SELECT *, 'starboard_door', -(spread / 2) FROM centred UNION ALL SELECT *, 'centre_clump', 0.0 FROM centred))"""


def _gear_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tow points with chainage and depth, the path they make, and the accepted scenarios."""
    towed = _towed(spark, sf_dir)
    chain = paths.chainage(towed, ["us", "event_id"])
    tow = chain.select("mmsi", "event_id", "us", (F.col("chainage_mm") / 1000).alias("s"), "x", "y", "depth")
    status = gear.scenario_status(towed, _grid(spark), MAX_WARP, depth_offset=DEPTH_OFFSET)
    return tow, _path(chain), status.where("accepted").select("scenario_id", "ratio", "spread")


def _gear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gear.gear_positions(*_gear_inputs(spark, sf_dir), 500.0, depth_offset=DEPTH_OFFSET, longest=MAX_WARP)


@query(f"WITH {TOWED_SQL}, {CHAIN_SQL}, {PATH_SQL}, {GRID_SQL}, {STATUS_SQL}, {GEAR_SQL} SELECT scenario_id, mmsi, event_id, component, {mm_sql('px', 'x_mm')}, {mm_sql('py', 'y_mm')} FROM placed")
def gear_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gear(spark, sf_dir).select("scenario_id", "mmsi", "event_id", "component", mm(F.col("x")).alias("x_mm"), mm(F.col("y")).alias("y_mm"))


@query(f"""WITH {TOWED_SQL}, {CHAIN_SQL}, {PATH_SQL}, {GRID_SQL}, {STATUS_SQL}, {GEAR_SQL}, m AS (SELECT scenario_id, component, min(event_id) AS t FROM placed WHERE px < 1000 GROUP BY 1, 2),
n AS (SELECT scenario_id, string_agg(component, '+' ORDER BY component) AS names FROM m GROUP BY 1)
SELECT ratio, string_agg(CAST(CAST(spread AS INTEGER) AS VARCHAR) || ':' || CAST(accepted AS VARCHAR) || ':' || coalesce(names, ''), ';' ORDER BY spread) AS cells FROM status LEFT JOIN n USING (scenario_id) GROUP BY ratio""")
def result_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which components came west of x = 1000, by ratio and spread."""
    seen = _gear(spark, sf_dir).where("x < 1000").groupBy("scenario_id", "component").agg(F.min("event_id").alias("t"))
    return gear.result_matrix(_status(spark, sf_dir), seen)


#: Where the stand-in raster lies: centre of the projection, north-west corner, degrees of a cell.
CENTRE, CORNER, PIXEL = (9.55, 78.34), (9.5, 78.36), (0.02, 0.001)


def _direct_sql(source: str) -> str:
    """CTEs from r0, which is source with lon, lat (radians of the reduced one as u), az and dist, to placed with lon_at and lat_at."""
    f, e2 = geodesy.FLATTENING, (geodesy.A**2 - geodesy.B**2) / geodesy.B**2
    ctes = [
        f"r0 AS ({source})",
        "r1 AS (SELECT *, cos(u) * sin(az) AS sa, 1 - cos(u) * sin(az) * (cos(u) * sin(az)) AS ca2, atan2(sin(u), cos(u) * cos(az)) AS s1 FROM r0)",
        f"r2 AS (SELECT *, w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) AS b, dist / ({geodesy.B!r} * (1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))))) AS first "
        f"FROM (SELECT *, ca2 * {e2!r} AS w FROM r1))",
        "d0 AS (SELECT *, first AS sigma FROM r2)",
    ]
    for n in range(geodesy.VINCENTY_STEPS):
        ctes.append(
            f"d{n + 1} AS (SELECT * EXCLUDE (sigma, ss, cs, cm), first + b * ss * (cm + b / 4 * (cs * (-1 + 2 * cm * cm) - b / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm))) AS sigma "
            f"FROM (SELECT *, sin(sigma) AS ss, cos(sigma) AS cs, cos(2 * s1 + sigma) AS cm FROM d{n}))"
        )
    last = f"(SELECT *, sin(sigma) AS ss, cos(sigma) AS cs, cos(2 * s1 + sigma) AS cm, {f / 16!r} * ca2 * (4 + {f!r} * (4 - 3 * ca2)) AS c FROM d{geodesy.VINCENTY_STEPS})"
    flat = "(sin(u) * ss - cos(u) * cs * cos(az))"
    lat = f"degrees(atan2(sin(u) * cs + cos(u) * ss * cos(az), (1 - {f!r}) * sqrt(sa * sa + {flat} * {flat})))"
    gain = f"(1 - c) * {f!r} * sa * (sigma + c * ss * (cm + c * cs * (-1 + 2 * cm * cm)))"
    lon = f"lon + degrees(atan2(ss * sin(az), cos(u) * cs - sin(u) * ss * cos(az)) - {gain})"
    return ", ".join(ctes) + f", placed AS (SELECT *, {lon} AS lon_at, {lat} AS lat_at FROM {last})"


TOW_DEPTHS_SQL = f"""WITH {TRACK_SQL}, {STEPS_SQL}, {RASTER_SQL},
aft AS (SELECT mmsi, t0, x0 - vx / v * 25 AS tx, y0 - vy / v * 25 AS ty FROM (SELECT *, CASE WHEN sqrt(vx * vx + vy * vy) >= 0.01 THEN sqrt(vx * vx + vy * vy) END AS v FROM (SELECT *, (x1 - x0) / 10 AS vx, (y1 - y0) / 10 AS vy FROM steps))),
{_direct_sql(f"SELECT mmsi, t0, {CENTRE[0]} AS lon, atan((1 - {geodesy.FLATTENING!r}) * tan(radians({CENTRE[1]}))) AS u, atan2(tx, ty) AS az, sqrt(tx * tx + ty * ty) AS dist FROM aft")},
pixels AS (SELECT mmsi, t0, px, py, CAST(floor(px - 0.5) AS INTEGER) AS c, CAST(floor(py - 0.5) AS INTEGER) AS r FROM (SELECT *, (lon_at - {CORNER[0]}) / {PIXEL[0]} AS px, ({CORNER[1]} - lat_at) / {PIXEL[1]} AS py FROM placed)),
near AS (SELECT p.*, a.elevation AS e0, b.elevation AS e1, d.elevation AS e2, e.elevation AS e3, px - (c + 0.5) AS dx, py - (r + 0.5) AS dy FROM pixels p
  LEFT JOIN cells a ON a.row = r AND a.col = c LEFT JOIN cells b ON b.row = r AND b.col = c + 1 LEFT JOIN cells d ON d.row = r + 1 AND d.col = c LEFT JOIN cells e ON e.row = r + 1 AND e.col = c + 1),
depths AS (SELECT mmsi, t0, e0 * (1 - dx) * (1 - dy) + e1 * dx * (1 - dy) + e2 * (1 - dx) * dy + e3 * dx * dy AS e FROM near)
SELECT mmsi, t0, {mm_sql('CASE WHEN e < 0 THEN -e END', 'depth_mm')} FROM depths"""


@query(TOW_DEPTHS_SQL)
def tow_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of the raster under each tow point, 25 m aft of the antenna."""
    steps = _steps(bridge.track(spark, sf_dir)).select("mmsi", "t0", F.col("x0").alias("x"), F.col("y0").alias("y"), ((F.col("x1") - F.col("x0")) / 10).alias("vx"), ((F.col("y1") - F.col("y0")) / 10).alias("vy"))
    return gear.depths_under(paths.tow_points(steps, 25), bridge.raster(spark, sf_dir), CENTRE, CORNER, PIXEL).select("mmsi", "t0", mm(F.col("depth")).alias("depth_mm"))


FAILURES_SQL = f"""failures AS (SELECT scenario_id, CASE WHEN ix IS NULL THEN '{gear.OFF_PATH}' ELSE '{gear.SHORT_CHORD}' END AS reason FROM (
  SELECT w.scenario_id, w.x, w.y, x0 + (s - lag - s0) / (s1 - s0) * (x1 - x0) AS ix, y0 + (s - lag - s0) / (s1 - s0) * (y1 - y0) AS iy
  FROM swept w LEFT JOIN path p ON w.mmsi = p.mmsi AND s0 <= s - lag AND s - lag < s1) WHERE ix IS NULL OR sqrt((x - ix) * (x - ix) + (y - iy) * (y - iy)) < 1)"""


@query(
    f"WITH {TOWED_SQL}, {CHAIN_SQL}, {PATH_SQL}, {GRID_SQL}, {STATUS_SQL}, {GEAR_SQL}, {FAILURES_SQL} "
    "SELECT scenario_id, reason, CAST(count(*) AS BIGINT) AS points FROM failures GROUP BY 1, 2"
)
def gear_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points without gear positions, by scenario and reason."""
    return gear.gear_failures(*_gear_inputs(spark, sf_dir), 500.0, DEPTH_OFFSET, MAX_WARP).groupBy("scenario_id", "reason").agg(F.count("*").alias("points"))


@query(
    f"WITH {TOWED_SQL}, {CHAIN_SQL}, {PATH_SQL}, {GRID_SQL}, {STATUS_SQL}, {GEAR_SQL}, "
    "d AS (SELECT a.scenario_id, sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) AS got, spread AS wanted, ratio * t.d AS warp, "
    "sqrt((a.px - t.x) * (a.px - t.x) + (a.py - t.y) * (a.py - t.y) + t.d * t.d) AS port, sqrt((b.px - t.x) * (b.px - t.x) + (b.py - t.y) * (b.py - t.y) + t.d * t.d) AS starboard "
    "FROM placed a JOIN placed b ON a.scenario_id = b.scenario_id AND a.event_id = b.event_id AND a.component = 'port_door' AND b.component = 'starboard_door' "
    "JOIN status s ON s.scenario_id = a.scenario_id JOIN tows t ON t.event_id = a.event_id) "
    "SELECT scenario_id, CAST(count(*) AS BIGINT) AS points, CAST(count(*) FILTER (abs(got - wanted) > 1e-6 + 1e-5 * abs(wanted)) AS BIGINT) AS open_doors, "
    "CAST(count(*) FILTER (abs(port - warp) > 1e-6 + 1e-5 * abs(warp) OR abs(starboard - warp) > 1e-6 + 1e-5 * abs(warp)) AS BIGINT) AS open_warps FROM d GROUP BY 1"
)
def gear_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points of a scenario have doors that aren't the spread apart, or that don't close the warp's triangle."""
    tow, path, grid = _gear_inputs(spark, sf_dir)
    return gear.gear_closure(gear.gear_positions(tow, path, grid, 500.0, depth_offset=DEPTH_OFFSET, longest=MAX_WARP), tow, grid, DEPTH_OFFSET)


GEAR_HITS_SQL = """gsteps AS (SELECT * FROM (SELECT scenario_id, mmsi, component, us AS t0, px AS x0, py AS y0, lead(us) OVER w AS t1, lead(px) OVER w AS x1, lead(py) OVER w AS y1
  FROM placed WINDOW w AS (PARTITION BY scenario_id, mmsi, component ORDER BY us, event_id)) WHERE t1 IS NOT NULL), """ + HITS_SQL.replace("FROM steps, segments", "FROM gsteps, segments").replace(
    "PARTITION BY mmsi, cable_id", "PARTITION BY scenario_id, mmsi, component, cable_id"
)


def _gear_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = paths.polyline_segments(bridge.cable(spark, sf_dir))
    steps = gear.gear_steps(*_gear_inputs(spark, sf_dir), 500.0, depth_offset=DEPTH_OFFSET, longest=MAX_WARP)
    return crossings.crossings(steps, segments, ["scenario_id", "mmsi", "component"], 400.0, columns=["t"])


@query(
    f"WITH {TOWED_SQL}, {CHAIN_SQL}, {PATH_SQL}, {GRID_SQL}, {STATUS_SQL}, {GEAR_SQL}, {CABLE_SQL}, {GEAR_HITS_SQL} "
    "SELECT scenario_id, mmsi, component, cable_id, CAST(count(*) AS BIGINT) AS crossings, CAST(floor(min(t) / 1000) AS BIGINT) AS first_ms, CAST(floor(max(t) / 1000) AS BIGINT) AS last_ms "
    "FROM crossed GROUP BY ALL"
)
def gear_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the parts of the towed gear, not the vessel, cross the cable: the main result."""
    found = _gear_crossings(spark, sf_dir).groupBy("scenario_id", "mmsi", "component", "cable_id")
    return found.agg(F.count("*").alias("crossings"), F.floor(F.min("t") / 1000).alias("first_ms"), F.floor(F.max("t") / 1000).alias("last_ms"))


FAILURE = ("2024-01-10", "2024-01-20")
SMOOTHED = ("2024-01-10", "2024-01-13")


@query(
    f"WITH {TOWED_SQL}, {CHAIN_SQL}, {PATH_SQL}, {GRID_SQL}, {STATUS_SQL}, {GEAR_SQL}, {CABLE_SQL}, {GEAR_HITS_SQL} "
    f"SELECT component, CAST(count(*) AS BIGINT) AS crossings, CAST(count(*) FILTER (t >= epoch_us(TIMESTAMP '{FAILURE[0]}') AND t < epoch_us(TIMESTAMP '{FAILURE[1]}')) AS BIGINT) AS inside, "
    "CAST(count(DISTINCT scenario_id) AS BIGINT) AS scenarios, CAST(count(DISTINCT mmsi) AS BIGINT) AS vessels FROM crossed GROUP BY 1"
)
def crossing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of each part of the gear over all scenarios, and those within the failure's interval."""
    return crossings.crossing_metrics(_gear_crossings(spark, sf_dir), *FAILURE)


CONFIG = {"geometry_grid": {"door_spreads_m": SPREADS, "warp_depth_ratios": RATIOS}, "gear": {"depth_offset_m": DEPTH_OFFSET, "max_warp_length_m": MAX_WARP}, "failure_interval": list(FAILURE)}
CONFIG_SHA256 = runs.config_sha256(CONFIG)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's row: hashes of the configuration, of stand-ins for its inputs, and of a fixed text for the code."""
    text = lambda name, key, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value]), ","), 256).alias(name)
    regions = table(spark, sf_dir, "region").agg(text("ais_content_sha256", "r_regionkey", "r_name"))
    nations = table(spark, sf_dir, "nation").agg(text("cable_sha256", "n_nationkey", "n_name"))
    fixed = {name: F.sha2(F.lit(name), 256) for name in ("ais_source_manifest_sha256", "bathymetry_sha256", "implementation_sha256")}
    return runs.with_run_id(regions.join(nations).withColumns(fixed | {"config_sha256": F.lit(CONFIG_SHA256)}))


def _metrics_sql() -> str:
    groups = {
        "ais.track": QUALITY_METRICS_SQL,
        "ais.screen": f"SELECT CAST(count(DISTINCT mmsi) AS BIGINT) AS observed, CAST(count(DISTINCT CASE WHEN distance <= {SCREEN_REACH} THEN mmsi END) AS BIGINT) AS retained FROM screen",
        "model.scenarios": "SELECT CAST(count(*) FILTER (accepted) AS BIGINT) AS accepted, CAST(count(*) FILTER (NOT accepted) AS BIGINT) AS rejected FROM status",
        "model.reference": "SELECT scenario_id, ratio, spread FROM status, (SELECT (min(ratio) + max(ratio)) / 2 AS mr, (min(spread) + max(spread)) / 2 AS ms, max(ratio) - min(ratio) AS sr, max(spread) - min(spread) AS ss FROM status) WHERE accepted ORDER BY abs(ratio - mr) / sr + abs(spread - ms) / ss, ratio, spread LIMIT 1",
    }
    columns = {"ais.track": ("source_positions", "position_groups", "kept_positions", "rejected_positions"), "ais.screen": ("observed", "retained"), "model.scenarios": ("accepted", "rejected"), "model.reference": ("scenario_id", "ratio", "spread")}
    rows = [f"SELECT '{g}.{c}' AS name, CAST(to_json({c}) AS VARCHAR) AS value FROM ({sql})" for g, sql in groups.items() for c in columns[g]]
    counts = ("crossings", "inside", "scenarios", "vessels")
    rows += [f"SELECT 'model.crossings.' || component || '.{c}', CAST({c} AS VARCHAR) FROM parts" for c in counts]
    nul = "'\\x00'::BLOB"
    fixed = [f"sha256('{name}')::BLOB" for name in ("ais_source_manifest_sha256", "bathymetry_sha256", "implementation_sha256")]
    parts = [f"'{CONFIG_SHA256}'::BLOB", "a::BLOB", fixed[0], "c::BLOB", fixed[1], fixed[2]]
    screen = SCREEN_SQL.replace("FROM track, segments", "FROM antenna, segments")
    islands = ISLANDS_SQL + ", " + QUALITY_SQL.removeprefix(ISLANDS_SQL + ", ")
    return (
        f"WITH {TOWED_SQL}, {CHAIN_SQL}, {PATH_SQL}, {GRID_SQL}, {STATUS_SQL}, {GEAR_SQL}, {CABLE_SQL}, {GEAR_HITS_SQL}, {screen}, {islands}, "
        f"parts AS (SELECT component, count(*) AS crossings, count(*) FILTER (t >= epoch_us(TIMESTAMP '{FAILURE[0]}') AND t < epoch_us(TIMESTAMP '{FAILURE[1]}')) AS inside, count(DISTINCT scenario_id) AS scenarios, count(DISTINCT mmsi) AS vessels FROM crossed GROUP BY 1), "
        f"run AS (SELECT 'run_' || substr(sha256({f' || {nul} || '.join(parts)}), 1, 16) AS run_id FROM (SELECT sha256(string_agg(r_name, ',' ORDER BY r_regionkey)) AS a FROM region), (SELECT sha256(string_agg(n_name, ',' ORDER BY n_nationkey)) AS c FROM nation)), "
        f"metrics AS ({' UNION ALL '.join(rows)}) SELECT run_id, '{CONFIG_SHA256}' AS config_sha256, name, value FROM metrics, run"
    )


QUALITY_METRICS_SQL = "SELECT CAST((SELECT count(*) FROM events) AS BIGINT) AS source_positions, CAST((SELECT count(*) FROM islands) AS BIGINT) AS position_groups, CAST((SELECT count(*) FROM good) AS BIGINT) AS kept_positions, CAST((SELECT count(*) FROM islands) - (SELECT count(*) FROM good) AS BIGINT) AS rejected_positions"


@query(_metrics_sql().replace("g AS (SELECT *, CAST(sum(changed)", "numbered AS (SELECT *, CAST(sum(changed)").replace("AS x, any_value(y) AS y, CAST(count(*) AS BIGINT) AS size FROM g GROUP BY", "AS x, any_value(y) AS y, CAST(count(*) AS BIGINT) AS size FROM numbered GROUP BY"))
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric table of a run: its tracks, screen, scenarios, reference case and crossings, under its id."""
    groups = [
        runs.metric_rows(track_quality(spark, sf_dir), "ais.track"),
        runs.metric_rows(screen_counts(spark, sf_dir), "ais.screen"),
        runs.metric_rows(scenario_counts(spark, sf_dir), "model.scenarios"),
        runs.metric_rows(reference_case(spark, sf_dir), "model.reference"),
        runs.metric_rows(crossing_metrics(spark, sf_dir), "model.crossings", by="component"),
    ]
    return runs.metric_table(groups, _run(spark, sf_dir)).drop("generated_at")


DEPTH_SQL = """points AS (SELECT event_id, event_id % 6500 / 100 + 0.25 AS px, event_id % 501 + 0.75 AS py FROM events),
placed AS (SELECT *, CAST(floor(px - 0.5) AS INTEGER) AS c, CAST(floor(py - 0.5) AS INTEGER) AS r FROM points),
near AS (SELECT p.*, a.elevation AS e0, b.elevation AS e1, d.elevation AS e2, e.elevation AS e3, px - (c + 0.5) AS dx, py - (r + 0.5) AS dy FROM placed p
  LEFT JOIN cells a ON a.row = r AND a.col = c LEFT JOIN cells b ON b.row = r AND b.col = c + 1 LEFT JOIN cells d ON d.row = r + 1 AND d.col = c LEFT JOIN cells e ON e.row = r + 1 AND e.col = c + 1),
depths AS (SELECT event_id, e0 * (1 - dx) * (1 - dy) + e1 * dx * (1 - dy) + e2 * (1 - dx) * dy + e3 * dx * dy AS e FROM near)"""


@query(f"WITH {RASTER_SQL}, {DEPTH_SQL} SELECT event_id, {mm_sql('CASE WHEN e < 0 THEN -e END', 'depth_mm')} FROM depths")
def depth_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    points = table(spark, sf_dir, "events").select("event_id", (k % 6500 / 100 + 0.25).alias("px"), (k % 501 + 0.75).alias("py"))
    return raster.bilinear_depth(points, bridge.raster(spark, sf_dir)).select("event_id", mm(F.col("depth")).alias("depth_mm"))


HORN_SQL = """horn AS (SELECT m.row, m.col, sum(w.east * n.elevation) / (8 * 250.0) AS gx, sum(w.south * n.elevation) / (8 * 400.0) AS gy FROM cells m,
  (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)) w(r, c, east, south), cells n
  WHERE n.row = m.row + w.r AND n.col = m.col + w.c GROUP BY m.row, m.col HAVING count(*) = 8),
slopes AS (SELECT row, col, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM horn)"""


@query(f"WITH {RASTER_SQL}, {HORN_SQL} SELECT row, col, {mm_sql('slope', 'slope_u', 1_000_000)} FROM slopes")
def horn_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.horn_slopes(bridge.raster(spark, sf_dir), 250.0, 400.0).select("row", "col", whole(F.col("slope"), 1_000_000).alias("slope_u"))


@query(f"""WITH {RASTER_SQL}, {HORN_SQL}, near AS (SELECT c.row AS centre_row, c.col AS centre_col, s.slope FROM cells c, unnest(range(-3, 4)) AS a(i), unnest(range(-5, 6)) AS b(j), slopes s
  WHERE i * 400.0 * (i * 400.0) + j * 250.0 * (j * 250.0) <= 1000000 AND s.row = c.row + i AND s.col = c.col + j)
SELECT centre_row, centre_col, {mm_sql('median(slope)', 'median_u', 1_000_000)}, {mm_sql('min(slope)', 'least_u', 1_000_000)}, {mm_sql('max(slope)', 'greatest_u', 1_000_000)}, CAST(count(*) AS BIGINT) AS cells FROM near GROUP BY centre_row, centre_col""")
def slope_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes within a kilometre of every cell."""
    found = tiles.slopes_around(bridge.raster(spark, sf_dir), 1000.0, 250.0, 400.0, raster.NODATA)
    return found.select("centre_row", "centre_col", *(whole(F.col(c), 1_000_000).alias(f"{c}_u") for c in ("median", "least", "greatest")), "cells")


@query(f"WITH {RASTER_SQL} SELECT col, {mm_sql('CAST(sum(row * elevation) AS DOUBLE) / sum(elevation)', 'centre_mm')} FROM cells WHERE elevation > 0 AND col % 4 = 0 GROUP BY col")
def column_centreline(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = raster.column_centres(bridge.raster(spark, sf_dir), F.col("elevation"), 4)
    return centres.select("col", mm(F.col("centre")).alias("centre_mm"))


DENSITY_SQL = f"WITH {TRACK_SQL}, g AS (SELECT CAST(round_even(x / 100, 0) AS BIGINT) AS gx, CAST(round_even(y / 100, 0) AS BIGINT) AS gy, CAST(count(*) AS BIGINT) AS n FROM track GROUP BY 1, 2) "


@query(DENSITY_SQL + "SELECT gx, gy, n FROM g")
def density_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.density_cells(bridge.track(spark, sf_dir), 100.0)


@query(DENSITY_SQL + "SELECT gx, gy, n, CASE WHEN row_number() OVER (ORDER BY gx, gy) = 1 THEN 'west' ELSE 'east' END AS label FROM (SELECT * FROM g ORDER BY n DESC, gx, gy LIMIT 2)")
def density_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.top_two_cells(summaries.density_cells(bridge.track(spark, sf_dir), 100.0))


@query("""WITH r AS (SELECT CASE WHEN event_type = 'purchase' THEN 'TRAWLERS' ELSE event_type END AS gear, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS hours, CASE WHEN user_id % 10 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS vessel FROM events)
SELECT CAST(sum(CASE WHEN gear = 'TRAWLERS' THEN hours END) AS DOUBLE) AS trawler_hours, CAST(sum(hours) AS DOUBLE) AS all_hours, CAST(count(DISTINCT CASE WHEN gear = 'TRAWLERS' THEN nullif(vessel, '') END) AS BIGINT) AS trawlers, CAST(count(DISTINCT nullif(vessel, '')) AS BIGINT) AS vessels FROM r""")
def effort_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "props")
    gear_name = F.when(F.col("event_type") == "purchase", "TRAWLERS").otherwise(F.col("event_type"))
    vessel = F.when(F.col("user_id") % 10 == 0, "").otherwise(F.col("user_id").cast("string"))
    return summaries.effort_summary(events.select(gear_name.alias("gear"), F.get_json_object("props", "$.k").cast("double").alias("hours"), vessel.alias("vessel_id")))


@query("""SELECT event_type AS gear, CAST(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS DOUBLE) AS hours, CAST(count(*) AS BIGINT) AS records FROM events GROUP BY 1""")
def nested_effort_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records found at any depth of a report; here events lie bare, in two or in five levels, with more below them."""
    bare = F.format_string('{"geartype": "%s", "hours": %s, "below": [{"hours": 99}]}', "event_type", F.get_json_object("props", "$.k"))
    two = F.concat(F.lit('{"entries": [{"public-global-fishing-effort:v1": ['), bare, F.lit("]}]}"))
    five = F.concat(F.lit('[[{"hours": true, "a": {"hours": "9", "b": ['), bare, F.lit("]}}]]"))
    kind = F.col("event_id") % 3
    wrapped = F.when(kind == 0, bare).when(kind == 1, two).otherwise(five)
    found = records.hour_records(table(spark, sf_dir, "events").select(wrapped.alias("json")), "json")
    return found.groupBy("gear").agg(F.sum("hours").alias("hours"), F.count("*").alias("records"))


@query("SELECT o_orderkey, o_custkey AS run_id, c_mktsegment FROM orders JOIN (SELECT DISTINCT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 9000) ON o_custkey = c_custkey")
def current_run_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("run_id"))
    named = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("run_id"), "c_mktsegment")
    return summaries.current_runs(runs, named).select("o_orderkey", "run_id", "c_mktsegment")


@query("SELECT 'orders.' || o_orderpriority AS name, CAST(count(*) AS VARCHAR) AS value FROM orders GROUP BY 1 UNION ALL SELECT 'customers.' || c_mktsegment, CAST(count(*) AS VARCHAR) FROM customer GROUP BY 1")
def metric_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = lambda name, column: table(spark, sf_dir, name).groupBy(column).count().select(F.concat(F.lit(f"{name if name == 'orders' else 'customers'}."), F.col(column)).alias("name"), F.col("count").cast("string").alias("value"))
    return summaries.merge_metrics(metric("orders", "o_orderpriority"), metric("customer", "c_mktsegment"))


@query("SELECT user_id, date_trunc('hour', ts) AS hour, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return summaries.duplicates(hourly, ["user_id", "hour"])


@query("""WITH b AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1), d AS (SELECT user_id, a, b, unnest(generate_series(date_trunc('day', a), date_trunc('day', b - INTERVAL 1 MICROSECOND), INTERVAL 1 DAY)) AS day FROM b)
SELECT user_id, CAST(day AS DATE) AS day, greatest(a, day) AS window_start, least(b, day + INTERVAL 1 DAY) AS window_end FROM d""")
def partition_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request windows of a track: one for each day it touches, cut to its ends."""
    spans = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = spans.withColumn("day", F.explode(summaries.day_windows(F.col("a"), F.col("b"))))
    midnight = F.col("day").cast("timestamp_ntz")
    return days.select("user_id", "day", F.greatest("a", midnight).alias("window_start"), F.least(F.col("b"), midnight + F.expr("INTERVAL 1 DAY")).alias("window_end"))


@query("SELECT n_regionkey, sha256(s) AS sha256, 'run_' || substr(sha256(s), 1, 16) AS run_id FROM (SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS s FROM nation GROUP BY 1)")
def manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.manifest_hash(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name")


@query("SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS customers, CAST(floor(sum(floor(c_acctbal))) AS BIGINT) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def owner_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped counts over the dimension tables (nation and region are fixed at 25 and 5 rows)."""
    joined = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.sum(F.floor("c_acctbal")).cast("long").alias("balance"))


PLACES_SQL = "places AS (SELECT c_custkey, 6 + c_custkey % 600 / 50 AS lon, 76 + c_custkey % 300 / 100 AS lat FROM customer)"


def _utm_sql() -> str:
    e = 2 * geodesy.N**0.5 / (1 + geodesy.N)
    east = " + ".join(["eta", *(f"{a!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(geodesy.ALPHA, 1))])
    north = " + ".join(["xi", *(f"{a!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(geodesy.ALPHA, 1))])
    scale = geodesy.UTM_SCALE * geodesy.RECTIFYING
    return f"""WITH {PLACES_SQL}, s AS (SELECT c_custkey, radians(lon - 15) AS lam, sin(radians(lat)) AS sp FROM places), t AS (SELECT *, sinh(atanh(sp) - {e!r} * atanh({e!r} * sp)) AS t FROM s),
    p AS (SELECT c_custkey, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
    SELECT c_custkey, {mm_sql(f'{geodesy.UTM_EAST} + {scale!r} * ({east})', 'east_cm', 100)}, {mm_sql(f'{scale!r} * ({north})', 'north_cm', 100)} FROM p"""


@query(_utm_sql())
def utm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bridge.places(spark, sf_dir).withColumn("p", geodesy.utm_forward(F.col("lon"), F.col("lat")))
    return p.select("c_custkey", whole(F.col("p.east"), 100).alias("east_cm"), whole(F.col("p.north"), 100).alias("north_cm"))


def _sphere_sql(lam: str) -> str:
    return f"""SELECT *, CASE WHEN ca2 > 0 THEN cs - 2 * sin(u1) * sin(u2) / ca2 ELSE 0 END AS cm FROM (SELECT *, 1 - sa * sa AS ca2, atan2(ss, cs) AS sigma FROM (
    SELECT *, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa FROM (SELECT k, u1, u2, l, lam, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs,
    sqrt(cos(u2) * sin(lam) * (cos(u2) * sin(lam)) + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) * (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam))) AS ss FROM {lam})))"""


def _inverse_sql(columns: str) -> str:
    """columns, which may use the distance and the sine and cosine of the bearing, from (9.55, 78.34) to each place."""
    f, e2 = geodesy.FLATTENING, (geodesy.A**2 - geodesy.B**2) / geodesy.B**2
    ctes = [
        f"WITH {PLACES_SQL}, i0 AS (SELECT c_custkey AS k, atan((1 - {f!r}) * tan(radians(78.34))) AS u1, atan((1 - {f!r}) * tan(radians(lat))) AS u2, "
        "radians(lon - 9.55) AS l, radians(lon - 9.55) AS lam FROM places)"
    ]
    for n in range(geodesy.VINCENTY_STEPS):
        ctes.append(
            f"i{n + 1} AS (SELECT k, u1, u2, l, l + (1 - c) * {f!r} * sa * (sigma + c * ss * (cm + c * cs * (-1 + 2 * cm * cm))) AS lam "
            f"FROM (SELECT *, {f / 16!r} * ca2 * (4 + {f!r} * (4 - 3 * ca2)) AS c FROM ({_sphere_sql(f'i{n}')})))"
        )
    last = _sphere_sql(f"i{geodesy.VINCENTY_STEPS}")
    metres = (
        f"{geodesy.B!r} * (1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))) * "
        "(sigma - b * ss * (cm + b / 4 * (cs * (-1 + 2 * cm * cm) - b / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm))))"
    )
    turn = "atan2(cos(u2) * sin(lam), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam))"
    return ", ".join(ctes) + f""" SELECT k AS c_custkey, {columns} FROM (SELECT *, {metres} AS metres, {turn} AS turn
    FROM (SELECT *, w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) AS b FROM (SELECT *, ca2 * {e2!r} AS w FROM ({last}))))"""


def _ring_sql() -> str:
    """The vertices of the rings of 2 km around the places, by the direct problem."""
    source = f"SELECT c_custkey, n, lon, atan((1 - {geodesy.FLATTENING!r}) * tan(radians(lat))) AS u, radians(CAST(n * 5 % 360 AS DOUBLE)) AS az, 2000 AS dist FROM places, unnest(range(0, 73)) AS t(n)"
    columns = f"{mm_sql('lon_at', 'lon_u', 1_000_000)}, {mm_sql('lat_at', 'lat_u', 1_000_000)}, CAST(200000 AS BIGINT) AS metres_cm"
    return f"WITH {PLACES_SQL}, {_direct_sql(source)} SELECT c_custkey, CAST(n * 5 AS INTEGER) AS bearing, {columns} FROM placed"


@query(_inverse_sql(mm_sql('metres', 'metres_cm', 100)))
def geodesic_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = geodesy.geodesic_distance(9.55, 78.34, F.col("lon"), F.col("lat"))
    return bridge.places(spark, sf_dir).select("c_custkey", whole(far, 100).alias("metres_cm"))


@query(_ring_sql())
def geodesic_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of 2 km: the vertices, each also measured back to its centre."""
    ring = geodesy.geodesic_circles(bridge.places(spark, sf_dir), 2000.0)
    back = geodesy.geodesic_distance(F.col("lon"), F.col("lat"), F.col("v.lon"), F.col("v.lat"))
    vertex = [whole(F.col(f"v.{c}"), 1_000_000).alias(f"{c}_u") for c in ("lon", "lat")]
    return ring.select("c_custkey", (F.col("n") * 5).alias("bearing"), *vertex, whole(back, 100).alias("metres_cm"))


@query(_inverse_sql(f"{mm_sql('metres * sin(turn)', 'x_cm', 100)}, {mm_sql('metres * cos(turn)', 'y_cm', 100)}"))
def local_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the azimuthal equidistant projection around one of them."""
    p = bridge.places(spark, sf_dir).withColumn("p", geodesy.local_forward(F.col("lon"), F.col("lat"), 9.55, 78.34))
    return p.select("c_custkey", whole(F.col("p.x"), 100).alias("x_cm"), whole(F.col("p.y"), 100).alias("y_cm"))


SLOW_SQL = """slow AS (SELECT 9 + event_id % 7 / 10 AS lon, 78 + event_id % 5 / 10 AS lat FROM events WHERE CASE WHEN event_id % 11 <> 0 THEN event_id % 5 / 4 END <= 0.5)"""


def _clusters_sql() -> str:
    e = 2 * geodesy.N**0.5 / (1 + geodesy.N)
    scale = geodesy.UTM_SCALE * geodesy.RECTIFYING
    east = " + ".join(["eta", *(f"{a!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(geodesy.ALPHA, 1))])
    north = " + ".join(["xi", *(f"{a!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(geodesy.ALPHA, 1))])
    xi = " - ".join(["xi", *(f"{b!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, b in enumerate(geodesy.BETA, 1))])
    eta = " - ".join(["eta", *(f"{b!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, b in enumerate(geodesy.BETA, 1))])
    lat = " + ".join(["chi", *(f"{d!r} * sin({2 * k} * chi)" for k, d in enumerate(geodesy.DELTA, 1))])
    return f"""WITH {SLOW_SQL}, s AS (SELECT radians(lon - 15) AS lam, sin(radians(lat)) AS sp FROM slow), t AS (SELECT *, sinh(atanh(sp) - {e!r} * atanh({e!r} * sp)) AS t FROM s),
    p AS (SELECT atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t),
    g AS (SELECT CAST(round_even(({geodesy.UTM_EAST} + {scale!r} * ({east})) / 1000, 0) AS BIGINT) AS gx, CAST(round_even({scale!r} * ({north}) / 1000, 0) AS BIGINT) AS gy, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1, 2),
    top AS (SELECT *, row_number() OVER (ORDER BY gx, gy) AS k FROM (SELECT * FROM g ORDER BY n DESC, gx, gy LIMIT 2)),
    q AS (SELECT k, n, gy * 1000 / {scale!r} AS xi, (gx * 1000 - {geodesy.UTM_EAST}) / {scale!r} AS eta FROM top), r AS (SELECT k, n, {xi} AS xi, {eta} AS eta FROM q),
    c AS (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM r)
    SELECT CASE WHEN k = 1 THEN 'west' ELSE 'east' END AS label, {mm_sql('degrees(atan2(sinh(eta), cos(xi))) + 15', 'lon_u', 1_000_000)}, {mm_sql(f'degrees({lat})', 'lat_u', 1_000_000)}, n FROM c"""


@query(_clusters_sql())
def dwell_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two cells of a kilometre where slow vessels stay most."""
    found = validation.dwell_clusters(bridge.speeds(spark, sf_dir), 0.5, 1000.0)
    return found.select("label", whole(F.col("lon"), 1_000_000).alias("lon_u"), whole(F.col("lat"), 1_000_000).alias("lat_u"), "n")


@query()
def spatial_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate against a surveyed line, the slow clusters and a core."""
    line = bridge.cable(spark, sf_dir).select(F.col("cable_id").alias("line_id"), "seq", (9 + F.col("x") / 10_000).alias("lon"), (78 + F.col("y") / 10_000).alias("lat"))
    return validation.spatial_validation(line, validation.dwell_clusters(bridge.speeds(spark, sf_dir), 0.5, 1000.0), 9.2, 78.1, (9.94, 78.19))


@query(f"WITH {TRACK_SQL}, {STEPS_SQL}, {CABLE_SQL}, {HITS_SQL} SELECT mmsi, {mm_sql('(min(t) - epoch_us(TIMESTAMP ' + repr(FAILURE[0]) + ')) / 3.6e9', 'delay_u', 1_000)}, CAST(count(DISTINCT CAST(floor(t) AS BIGINT)) AS BIGINT) AS times FROM crossed GROUP BY mmsi")
def crossing_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours from the failure's start to each vessel's first crossing, and its number of distinct times."""
    hits = _crossings(spark, sf_dir)
    times = validation.crossing_times(hits, ["mmsi"]).groupBy("mmsi").agg(F.count("*").alias("times"))
    first = hits.groupBy("mmsi").agg(F.min("t").alias("t"))
    return first.join(times, "mmsi").select("mmsi", mm(validation.delay_hours(F.col("t"), f"{FAILURE[0]} 00:00:00")).alias("delay_u"), "times")


@query("SELECT event_type AS dataset_id, CAST(count(*) AS BIGINT) AS positions, CAST(count(DISTINCT user_id) AS BIGINT) AS vessels, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset_id"), F.col("user_id").alias("mmsi"), "ts")
    return provenance.ingest_summary(rows)


@query("""WITH w AS (SELECT DISTINCT user_id AS mmsi, date_trunc('day', ts) AS a FROM events),
p AS (SELECT mmsi, a, '{"end":"' || strftime(a + INTERVAL 1 DAY, '%Y%m%d%H%M') || '","minSpeed":0.5,"mmsiIds":[' || mmsi || '],"start":"' || strftime(a, '%Y%m%d%H%M') || '"}' AS payload FROM w)
SELECT mmsi, CAST(a AS DATE) AS day, payload, substr(sha256('{"endpoint":"ais/positions/for-mmsis-time","payload":' || payload || '}'), 1, 16) AS request_id FROM p""")
def position_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request of each vessel and day, with its canonical payload and id."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    windows = table(spark, sf_dir, "events").select(F.col("user_id").alias("mmsi"), day.alias("a")).distinct().withColumn("b", F.col("a") + F.expr("INTERVAL 1 DAY"))
    return provenance.position_requests(windows, 0.5).select("mmsi", F.col("a").cast("date").alias("day"), "payload", "request_id")


@query("""WITH v AS (SELECT min(200 * n_nationkey) - 50 AS x0, max(200 * n_nationkey) + 50 AS x1, min(20 * ((n_nationkey * 7) % 5 - 2)) - 50 AS y0, max(20 * ((n_nationkey * 7) % 5 - 2)) + 50 AS y1 FROM nation)
SELECT CAST(x0 + i * 300 AS DOUBLE) AS minx, CAST(y0 + j * 300 AS DOUBLE) AS miny, CAST(least(x0 + i * 300 + 300, x1) AS DOUBLE) AS maxx, CAST(least(y0 + j * 300 + 300, y1) AS DOUBLE) AS maxy
FROM v, unnest(range(0, 100)) AS a(i), unnest(range(0, 100)) AS b(j) WHERE x0 + i * 300 < x1 AND y0 + j * 300 < y1""")
def tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 300 m that cover the cable and 50 m around it."""
    return validation.tile_plan(validation.bounds_around(bridge.cable(spark, sf_dir), 50.0), 300.0)


@query()
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each vessel's positions in order."""
    return provenance.content_hashes(bridge.speeds(spark, sf_dir), b"positions-v1\0")


@query(f"""WITH {RASTER_SQL}, l AS (SELECT row, sha256(string_agg(CAST(elevation AS VARCHAR), ',' ORDER BY col)) AS h, min(elevation) AS a, max(elevation) AS b FROM cells GROUP BY row)
SELECT count(*) = (SELECT count(*) FROM embeddings) AS complete, min(a) AS least, max(b) AS greatest, sha256(string_agg(h, ',' ORDER BY row)) AS sha256 FROM l""")
def raster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the raster is whole, its range and a hash."""
    return provenance.raster_report(bridge.raster(spark, sf_dir), table(spark, sf_dir, "embeddings").count(), 64)


@query(f"WITH {PLACES_SQL} SELECT c_custkey, {mm_sql('lon', 'lon_u', 1_000_000)}, {mm_sql('lat', 'lat_u', 1_000_000)} FROM places")
def projection_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places through the local projection and UTM and back."""
    p = bridge.places(spark, sf_dir).withColumn("p", geodesy.local_forward(F.col("lon"), F.col("lat"), 9.55, 78.34))
    p = p.withColumn("q", geodesy.local_inverse(F.col("p.x"), F.col("p.y"), 9.55, 78.34))
    p = p.withColumn("r", geodesy.utm_forward(F.col("q.lon"), F.col("q.lat"))).withColumn("s", geodesy.utm_inverse(F.col("r.east"), F.col("r.north")))
    return p.select("c_custkey", whole(F.col("s.lon"), 1_000_000).alias("lon_u"), whole(F.col("s.lat"), 1_000_000).alias("lat_u"))


@query()
def smooth_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothing splines of all tracks, each evaluated on ten-minute steps of its whole time."""
    points = bridge.track(spark, sf_dir).withColumn("t", F.col("us") / 1e6)
    start = F.min("t").over(Window.partitionBy("mmsi"))
    timed = points.select("mmsi", (F.col("t") - start).alias("t"), "x", "y")
    return smooth_whole_tracks(timed, 600.0, 40.0)


@query()
def smooth_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One smoothing spline of each vessel's positions within a closed window, on its steps of ten minutes."""
    start, end = (datetime.fromisoformat(d) for d in SMOOTHED)
    points = bridge.track(spark, sf_dir).where(positions.closed("ts", *SMOOTHED)).withColumn("t", (F.col("us") - bridge.micros_of(start)) / 1e6)
    return smooth_tracks(points.select("mmsi", "t", "x", "y"), 0.0, (end - start).total_seconds(), 600.0, 40.0)


@query(f"WITH {CABLE_SQL} SELECT cable_id, {mm_sql('sum(sqrt((cx1 - cx0) * (cx1 - cx0) + (cy1 - cy0) * (cy1 - cy0)))', 'length_mm')} FROM segments GROUP BY 1")
def line_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.line_length(bridge.cable(spark, sf_dir)).select("cable_id", mm(F.col("length_m")).alias("length_mm"))


@query()
def mask_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 64 raster rows: centreline of the largest connected part of the cells above a level."""
    cells = bridge.raster(spark, sf_dir).select(F.floor(F.col("row") / 64).cast("long").alias("tile"), (F.col("row") % 64).alias("row"), "col", (F.col("elevation") > 150).cast("int").alias("alpha"))
    return masks.tile_centrelines(cells)


#: Level above which a cell of the raster belongs to the mask, and how often the mask is grown.
MASK_LEVEL, GROWN = 260, 1
PARTS_SQL = f"""grown AS (SELECT DISTINCT c.row + o.i AS row, c.col + o.j AS col FROM cells c, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(i, j) WHERE c.elevation > {MASK_LEVEL}),
walk AS (SELECT row, col, row AS r, col AS c FROM grown UNION SELECT w.row, w.col, g.row, g.col FROM walk w, grown g WHERE g.row BETWEEN w.r - 1 AND w.r + 1 AND g.col BETWEEN w.c - 1 AND w.c + 1),
named AS (SELECT row, col, min(struct_pack(r := r, c := c)) AS first FROM walk GROUP BY row, col)"""


@query(f"WITH RECURSIVE {RASTER_SQL}, {PARTS_SQL} SELECT first.r AS first_row, first.c AS first_col, CAST(count(*) AS BIGINT) AS cells FROM cells JOIN named USING (row, col) WHERE elevation > {MASK_LEVEL} GROUP BY first")
def mask_part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the raster's high cells, connected once grown, in tiles of 16 cells that they run across."""
    cells = bridge.raster(spark, sf_dir).where(F.col("elevation") > MASK_LEVEL).select("row", "col", F.lit(1).alias("alpha"))
    return tiles.part_sizes(tiles.mask_parts(cells, GROWN, tile=16))


@query()
def stitched_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cable cut into five pieces, shuffled and joined again by nearest ends."""
    v = bridge.cable(spark, sf_dir)
    piece = F.floor(F.col("seq") / 5).cast("long")
    doubled = v.select("cable_id", piece.alias("piece"), F.struct("seq", "x", "y").alias("p")).union(v.where("seq % 5 = 0 and seq > 0").select("cable_id", piece - 1, F.struct("seq", "x", "y")))
    ordered = doubled.groupBy("cable_id", "piece").agg(F.array_sort(F.collect_list("p")).alias("points"))
    return masks.stitch_lines(ordered.select("cable_id", "piece", F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points")), 10.0)

"""Cells along lines, meetings of steps and lines, repeated hits, nearest lines and the gear's offsets, by brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from seatrace.operators import crossings, gear, paths, summaries
from seatrace.operators.cells import touched_cells
from seatrace.plans import bridge, queries
from tests.compare import SMALL

STEP = "mmsi long, t0 double, t1 double, x0 double, y0 double, x1 double, y1 double"
SEGMENT = "cable_id string, seg int, cx0 double, cy0 double, cx1 double, cy1 double"


def test_cells_along_a_line(spark):
    rng = np.random.default_rng(3)
    lines = [(k, *map(float, v)) for k, v in enumerate(rng.uniform(-50, 50, (60, 4)))]
    lines += [(100, 0.0, 0.0, 40.0, 40.0), (101, 5.0, -30.0, 5.0, 30.0), (102, -30.0, 10.0, 30.0, 10.0), (103, 3.0, 3.0, 3.0, 3.0), (104, 1.0, 0.0, 1.0 + 1e-12, 70.0), (105, None, 1.0, 2.0, 3.0)]
    got = {}
    for r in touched_cells(spark.createDataFrame(lines, "id long, a double, b double, c double, d double"), ("a", "b", "c", "d"), 10.0).collect():
        got.setdefault(r["id"], []).append((r["_gx"], r["_gy"]))
    assert set(got) == {r[0] for r in lines if r[1] is not None} and all(len(v) == len(set(v)) for v in got.values())
    for key, a, b, c, d in lines:
        if a is None:
            continue
        along = np.linspace(0, 1, 4001)
        cells = {(math.floor(x / 10), math.floor(y / 10)) for x, y in zip(a + along * (c - a), b + along * (d - b))}
        assert cells <= set(got[key]) and len(got[key]) <= 3 * (2 + (abs(c - a) + abs(d - b)) / 10)


def test_a_long_step_has_as_many_cells_as_it_crosses(spark):
    step = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 0.0, 100_000.0, 99_000.0)], STEP)
    assert 498 <= touched_cells(step, ("x0", "y0", "x1", "y1"), 400.0).count() <= 1000


def test_random_crossings_in_any_cell_size(spark):
    rng = np.random.default_rng(4)
    steps = [(k % 7, float(k), float(k + 1), *map(float, rng.uniform(0, 100, 4).round(int(rng.integers(0, 4))))) for k in range(120)]
    segments = [(f"c{k % 3}", k, *map(float, rng.uniform(0, 100, 4).round(1))) for k in range(40)]
    want = set()
    for s in steps:
        for g in segments:
            dx, dy, ex, ey = s[5] - s[3], s[6] - s[4], g[4] - g[2], g[5] - g[3]
            den = dx * ey - dy * ex
            if den:
                u, v = ((g[2] - s[3]) * ey - (g[3] - s[4]) * ex) / den, ((g[2] - s[3]) * dy - (g[3] - s[4]) * dx) / den
                if 0 <= u <= 1 and 0 <= v <= 1:
                    want.add((s[1], g[1]))
    for cell in (3.0, 17.0, 400.0):
        found = crossings.crossing_hits(spark.createDataFrame(steps, STEP), spark.createDataFrame(segments, SEGMENT), cell).collect()
        assert len(found) == len(want) and {(r["t0"], r["seg"]) for r in found} == want


LINE = [("a", 0, 0.0, 0.0, 10.0, 0.0), ("a", 1, 10.0, 0.0, 20.0, 0.0), ("a", 2, 20.0, 0.0, 20.0, 10.0), ("a", 3, 20.0, 10.0, 30.0, 10.0)]


@pytest.mark.parametrize(
    ("step", "parts", "points"),
    [
        ((5, -5, 5, 5), [(5, 0)], [(5, 0)]),  # across
        ((5, 0, 5, 5), [(5, 0)], [(5, 0)]),  # a T from the line
        ((5, 5, 5, 0), [(5, 0)], [(5, 0)]),  # a T onto it
        ((-5, 0, 0, 0), [(0, 0)], [(0, 0)]),  # end to end on one line
        ((-5, 0, -1, 0), [], []),  # on one line, apart
        ((2, 0, 8, 0), [], []),  # along a segment
        ((-5, 0, 15, 0), [], []),  # along two, over their joint
        ((5, 0, 25, 0), [], []),  # along two and past the corner, where the next segment begins
        ((12, 5, 35, 5), [(20, 5)], [(20, 5)]),
        ((20, -5, 20, 5), [], []),  # over the corner, then along
        ((15, 0.0, 15, 0.0), [], []),  # no step
        ((5, 1, 25, 1), [(20, 1)], [(20, 1)]),
    ],
)
def test_rules_for_meetings(spark, step, parts, points):
    steps = spark.createDataFrame([(1, 0.0, 1.0, *map(float, step))], STEP)
    lines = spark.createDataFrame(LINE, SEGMENT)
    for rule, want in ((True, parts), (False, points)):
        got = crossings.crossing_hits(steps, lines, 7.0, parts=rule).select("cx", "cy").distinct().collect()
        assert sorted(tuple(r) for r in got) == sorted(want), rule


def test_a_line_met_twice_and_once_along(spark):
    """A step that runs along a line and crosses it elsewhere has that crossing by one rule only."""
    line = [("a", 0, 0.0, 0.0, 10.0, 0.0), ("a", 1, 10.0, 0.0, 10.0, 9.0), ("a", 2, 10.0, 9.0, 15.0, -9.0)]
    steps = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 0.0, 30.0, 0.0)], STEP)
    got = [crossings.crossing_hits(steps, spark.createDataFrame(line, SEGMENT), 4.0, parts=rule).select("cx", "cy").collect() for rule in (True, False)]
    assert [tuple(r) for r in got[0]] == [(12.5, 0.0)] and got[1] == []


def test_repeated_hits_are_judged_by_the_last_kept_one(spark):
    rng = np.random.default_rng(6)
    rows = [(1, "a", k, 0.6 * k) for k in range(50)] + [(2, "a", k, 100.0) for k in range(4)] + [(None, "b", 0, 1.0), (None, "b", 1, 1.5), (None, "c", 2, 1.5)]
    rows += [(3, "a", k, float(t)) for k, t in enumerate(np.cumsum(rng.uniform(0, 1.2, 3000)))]
    want = set()
    last = {}
    for m, c, k, t in sorted(rows, key=lambda r: (str(r[0]), r[1], r[3], r[2])):
        if (m, c) not in last or t - last[m, c] >= 1.0:
            want.add((m, c, k))
            last[m, c] = t
    df = spark.createDataFrame(rows, "mmsi long, cable_id string, seg int, t double").withColumn("note", F.lit("kept"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = crossings.without_repeats(df, ["mmsi", "cable_id"]).collect()
            assert {tuple(r)[:3] for r in got} == want and len(got) == len(want) and {r["note"] for r in got} == {"kept"}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [r["seg"] for r in crossings.without_repeats(df.where("mmsi = 1"), ["mmsi", "cable_id"]).orderBy("seg").collect()] == list(range(0, 50, 2))


def test_steps_that_meet_on_a_line_of_constant_name_cross_it_once(spark):
    """Two steps of a track end and begin on the line; whatever step a hit is of, its track is in one task."""
    steps = spark.createDataFrame([(m, k, float(k), float(k + 1), 3.0 * k, 5.0 * k, 3.0 * k + 3, 5.0 * k + 5) for m in range(60) for k in range(4)], "mmsi long, part int, t0 double, t1 double, x0 double, y0 double, x1 double, y1 double")
    timed = steps.withColumns({t: F.col(t) * 1_000_000 for t in ("t0", "t1")})
    lines = spark.createDataFrame([(0, 0.0, 10.0, 6.0, 10.0), (1, 6.0, 10.0, 30.0, 10.0)], SEGMENT.removeprefix("cable_id string, ")).withColumn("cable_id", F.lit("a"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for columns in (None, ["t"]):
            df = crossings.crossings(timed, lines, ["mmsi"], 400.0, columns=columns)
            got = [(r["mmsi"], r["seg"], r["t"]) for r in df.collect()]
            assert sorted(got) == [(m, 0, 2_000_000.0) for m in range(60)]
            plan = df._jdf.queryExecution().executedPlan().initialPlan().toString()
            assert plan.count("REPARTITION_BY_COL") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def plain_distance(p, g):
    dx, dy = g[2] - g[0], g[3] - g[1]
    d2 = dx * dx + dy * dy
    f = max(0.0, min(1.0, ((p[0] - g[0]) * dx + (p[1] - g[1]) * dy) / d2)) if d2 else 0.0
    return math.hypot(p[0] - g[0] - f * dx, p[1] - g[1] - f * dy)


def test_nearest_lines(spark):
    rng = np.random.default_rng(8)
    points = [(k % 9, *map(float, rng.normal(0, 30_000 if k % 9 < 3 else 800, 2))) for k in range(400)] + [(20, 1e7, -1e7), (21, None, 0.0), (21, 5.0, 5.0), (22, float("nan"), 0.0)]
    segments = []
    for c in range(5):
        v = np.cumsum(rng.normal(0, 300 if c else 9000, (30, 2)), axis=0) + rng.normal(0, 20_000, 2)
        segments += [(f"c{c}", k, *map(float, (*a, *b))) for k, (a, b) in enumerate(zip(v, v[1:]))]
    segments.append(("dot", 0, 7.0, 7.0, 7.0, 7.0))
    want = {}
    for m, x, y in points:
        if x is not None and not math.isnan(x):
            for c, _, *g in segments:
                want[m, c] = min(want.get((m, c), math.inf), plain_distance((x, y), g))
    df, lines = spark.createDataFrame(points, "mmsi long, x double, y double"), spark.createDataFrame(segments, SEGMENT)
    for how in ({}, {"cell": 50.0, "fan": 8, "levels": 4}, {"cell": 90_000.0, "levels": 0}):
        got = {(r["mmsi"], r["cable_id"]): r["distance"] for r in paths.nearest_lines(df, lines, **how).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
    plan = paths.nearest_lines(df, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and plan.count("Join Inner, (") >= 5
    assert paths.nearest_lines(df.where("false"), lines).count() == paths.nearest_lines(df, lines.where("false")).count() == 0


def test_screen_of_geographic_positions(spark):
    centre = (9.55, 78.34)
    rows = [(1, "2022-01-07 03:10:00", 9.55, 78.35), (1, "2022-01-07 03:10:00", 9.55, 78.35), (1, "2022-01-07 03:11:00", 9.55, 78.34), (2, "2022-01-07 03:10:30", 10.0, 78.34), (3, "2022-01-07 03:10:30", 200.0, 0.0)]
    df = spark.createDataFrame(rows, "mmsi long, t string, lon double, lat double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    line = spark.createDataFrame([("a", 0, 9.4, 78.34), ("a", 1, 9.7, 78.34)], "cable_id string, seq int, lon double, lat double")
    got = {r["mmsi"]: (r["distance"], r["within"]) for r in paths.screen_positions(df, line, centre, "2022-01-07 03:10:00", "2022-01-07 03:11:00", 3000.0).collect()}
    assert got.keys() == {1, 2} and abs(got[1][0] - 1112) < 2 and got[1][1] and 6000 < got[2][0] < 7500 and not got[2][1]


@pytest.mark.parametrize(("offset", "depths"), [(-50.0, [100.0, 140.0]), (30.0, [100.0, 140.0]), (0.0, [100.0, 400.0]), (-120.0, [100.0, 140.0]), (500.0, [100.0, 990.0])])
def test_offsets_of_both_signs(spark, offset, depths):
    grid = gear.scenario_grid(spark, [1.5, 2.0, 3.0], [10.0, 300.0])
    got = {(r["ratio"], r["spread"]): r["rejection_reason"] for r in gear.scenario_status(spark.createDataFrame([(d,) for d in depths], "depth double"), grid, 3000.0, depth_offset=offset).collect()}
    for (ratio, spread), reason in got.items():
        deep = [d + offset for d in depths]
        want = gear.CEILING if any(ratio * d > 3000 for d in deep) else gear.REACH if any((ratio * d) ** 2 - d * d - (spread / 2) ** 2 <= 0 for d in deep) else None
        assert reason == want, (ratio, spread)


def test_a_negative_reach_is_no_point_before_the_path(spark):
    tow = spark.createDataFrame([(1, k, k * 1_000_000, 50.0 * k, 50.0 * k, 0.0, 100.0) for k in range(20)], "mmsi long, event_id long, us long, s double, x double, y double, depth double")
    path = paths.consecutive(tow, "mmsi", ["us"], ["s", "x", "y"])
    grid = gear.scenario_grid(spark, [2.0], [300.0])
    (status,) = gear.scenario_status(tow, grid, 3000.0, depth_offset=-50.0).collect()
    assert status["rejection_reason"] == gear.REACH
    assert gear.swept_points(tow, path, grid, 500.0, -50.0).count() == 0 and gear.gear_failures(tow, path, grid, 500.0, -50.0).count() == 0
    whole = gear.gear_positions(tow, path, gear.scenario_grid(spark, [3.0], [100.0]), 500.0, depth_offset=-10.0)
    assert whole.count() and gear.scenario_status(tow.withColumn("depth", F.lit(float("nan"))), grid, 3000.0).first()["rejection_reason"] == gear.NO_DEPTH


def test_closure_is_observed_in_the_pass_that_writes(spark):
    tow, path, grid = queries._gear_inputs(spark, SMALL)
    seen = Observation("closure")
    positions = gear.gear_positions(tow, path, grid, 500.0, depth_offset=queries.DEPTH_OFFSET, observation=seen)
    assert positions.count() == 3 * seen.get["points"] and seen.get["open_doors"] == seen.get["open_warps"] == 0
    bad = positions.withColumn("x", F.when(F.col("component") == "port_door", F.col("x") + 0.5).otherwise(F.col("x")))
    for df, wrong in ((positions, False), (bad, True)):
        for r in gear.gear_closure(df, tow, grid, queries.DEPTH_OFFSET).collect():
            assert (r["open_warps"] > 0) == wrong
    shallow = tow.withColumn("depth", F.col("depth") * 1.01)
    assert all(r["open_warps"] == r["points"] for r in gear.gear_closure(positions, shallow, grid, queries.DEPTH_OFFSET).collect())


def test_towed_track_over_a_geographic_raster(spark):
    steps = bridge.antenna_steps(spark, SMALL)
    flat = gear.towed_track(steps, bridge.sea(spark, SMALL), 25.0, bridge.SEA_CORNER, bridge.SEA_PIXEL)
    round_ = gear.towed_track(steps, bridge.sea(spark, SMALL), 25.0, queries.CORNER, queries.PIXEL, queries.CENTRE)
    assert flat.count() == round_.count() and flat.where("depth is null").count() == 0 and round_.where("depth > 100").count() > 100


def test_errors_of_paths_and_crossings(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 3.0, 5.0)], "mmsi long, us long, x double, y double")
    assert [r["chainage_mm"] for r in paths.moving_chainage(points, ["us"]).orderBy("us").collect()] == [0, 5000, 6000]
    for still in ([(1, 3, 3.0, 5.0)], [(1, 3, None, 5.0)]):
        with pytest.raises(Exception, match="no move of vessel 1"):
            paths.moving_chainage(points.union(spark.createDataFrame(still, points.schema)), ["us"]).collect()
    assert summaries.at_least(points, 3, "positions").count() == 3
    for few in (points.limit(2), points.where("false")):
        with pytest.raises(Exception, match="fewer than 3 positions"):
            summaries.at_least(few, 3, "positions").collect()
    hits = spark.createDataFrame([("G1", "a", 1.0), ("G1", "b", 1.0), ("G1", "a", 2.0)], "scenario_id string, component string, t double")
    keys = ["scenario_id", "component"]
    assert crossings.checked_crossings(hits, keys, 1.0, 2.5).count() == 3
    for bad, message in ((hits.union(hits.limit(1)), "comes twice"), (hits.withColumn("t", F.col("t") + 0.5), "outside"), (hits.withColumn("t", F.lit(None).cast("double")), "outside")):
        with pytest.raises(Exception, match=message):
            crossings.checked_crossings(bad, keys, 1.0, 2.5).collect()

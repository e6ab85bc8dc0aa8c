"""The pass that places gear behind whole tracks."""

import pytest
from pyspark.sql import functions as F

from seatrace.operators import crossings, gear, paths
from seatrace.plans import bridge, queries
from tests.compare import SMALL


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["gear_positions", "gear_failures", "result_matrix"])
def test_the_grid_is_no_product_of_tasks(spark, name):
    assert "CartesianProduct" not in plan(queries.QUERIES[name](spark, SMALL))


def test_steps_come_from_the_pass_that_places_the_gear(spark):
    tow, path, grid = queries._gear_inputs(spark, SMALL)
    placed = dict(depth_offset=queries.DEPTH_OFFSET, longest=queries.MAX_WARP)
    want = gear.component_steps(gear.gear_positions(tow, path, grid, 500.0, **placed))
    steps = gear.gear_steps(tow, path, grid, 500.0, **placed)
    assert "Window [lead(x" not in plan(steps).split("MapInArrow")[0]
    expected = rows(want.select(*steps.columns))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert rows(steps) == expected and len(expected) > 10_000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_no_more_path_than_the_longest_lag(spark):
    """Vessels, rows without a place, and points off the path, in small batches; a longer lag is an error."""
    points = [(m, k, k * 1_000_000, 50.0 * k, 50.0 * k, 0.0, 100.0) for m in (None, 1, 2) for k in range(40)] + [(3, 0, 0, None, None, None, 100.0)]
    tow = spark.createDataFrame(points, "mmsi long, event_id long, us long, s double, x double, y double, depth double")
    path = paths.consecutive(tow, "mmsi", ["us"], ["s", "x", "y"])
    grid = gear.scenario_grid(spark, [2.0, 4.0], [100.0])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
        got = {(r["mmsi"], r["event_id"], r["ratio"]): (r["_lag"], r["ix"], r["iy"]) for r in gear.swept_points(tow, path, grid, 0.0, longest=400.0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 2 * len(points)
    for (m, k, _), (lag, ix, iy) in got.items():
        there = m in (1, 2) and 50 * k >= lag
        assert (ix is not None) == there and (not there or (abs(ix - (50 * k - lag)) < 1e-9 and iy == 0))
    with pytest.raises(Exception, match="a lag beyond the longest"):
        gear.swept_points(tow, path, grid, 0.0, longest=100.0).collect()


def test_meetings_are_solved_once_a_row(spark):
    """Conditions on a meeting aren't unfolded into what it comes from, and hits go by track in one shuffle."""
    steps = queries._steps(bridge.track(spark, SMALL))
    found = crossings.crossings(steps, paths.polyline_segments(bridge.cable(spark, SMALL)), ["mmsi"], 400.0, columns=["t"])
    text = plan(found)
    assert max(map(len, (line for line in text.splitlines() if "Filter" in line))) < 3000
    assert found.columns == ["t", "mmsi", "cable_id", "seg"] and "hashpartitioning(mmsi" in text
    whole = crossings.crossings(steps, paths.polyline_segments(bridge.cable(spark, SMALL)), ["mmsi"], 400.0)
    assert rows(whole.select("mmsi", "cable_id", "seg", F.col("t"))) == rows(found.select("mmsi", "cable_id", "seg", "t"))

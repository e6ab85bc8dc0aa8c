"""Queries over whole tables, which have no SQL, by brute force."""

import math
from collections import defaultdict
from datetime import datetime
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from seatrace.functions import geodesy, spline
from seatrace.operators import positions
from seatrace.plans import bridge, queries
from tests.compare import SMALL


def close(got, want):
    return abs(got - want) <= 1  # whole millimetres or millionths


def brute_gear(points):
    """(status by (ratio, spread), places) of points (mmsi, us, event_id, x, y, depth), all depths moved by the offset."""
    points = [p | {"depth": p["depth"] + queries.DEPTH_OFFSET} for p in points]
    lag2 = lambda r, w, d: (r * d) ** 2 - d * d - (w / 2) ** 2
    status = {}
    for r in queries.RATIOS:
        for w in queries.SPREADS:
            deep = any(r * p["depth"] > queries.MAX_WARP for p in points)
            status[r, w] = not deep and all(lag2(r, w, p["depth"]) > 0 for p in points)
    tracks = defaultdict(list)
    for p in sorted(points, key=lambda p: (p["us"], p["event_id"])):
        tracks[p["mmsi"]].append(p)
    places = {}
    for mmsi, own in tracks.items():
        s = [0.0]
        for a, b in zip(own, own[1:]):
            s.append(s[-1] + math.floor(math.hypot(b["x"] - a["x"], b["y"] - a["y"]) * 1000 + 0.5))
        s = [x / 1000 for x in s]
        for k, p in enumerate(own):
            for (r, w), accepted in status.items():
                if not accepted:
                    continue
                lag = math.sqrt(lag2(r, w, p["depth"]))
                for i in range(len(own) - 1):
                    if s[i] <= s[k] - lag < s[i + 1]:
                        f = (s[k] - lag - s[i]) / (s[i + 1] - s[i])
                        dx, dy = (p[c] - (own[i][c] + f * (own[i + 1][c] - own[i][c])) for c in "xy")
                        if (chord := math.hypot(dx, dy)) >= 1:
                            ux, uy = dx / chord, dy / chord
                            for name, across in (("port_door", w / 2), ("starboard_door", -w / 2), ("centre_clump", 0.0)):
                                places[r, w, mmsi, p["event_id"], name] = p["x"] - lag * ux - across * uy, p["y"] - lag * uy + across * ux
    return status, places


def test_gear_of_all_points(spark):
    status, places = brute_gear([r.asDict() for r in queries._towed(spark, SMALL).collect()])
    found = {(r["ratio"], r["spread"]): r["accepted"] for r in queries.scenario_status(spark, SMALL).collect()}
    assert found == status and any(status.values())
    assert not all(status.values())
    name = {r["scenario_id"]: (r["ratio"], r["spread"]) for r in queries.scenario_grid(spark, SMALL).collect()}
    got = {(*name[r["scenario_id"]], r["mmsi"], r["event_id"], r["component"]): (r["x_mm"], r["y_mm"]) for r in queries.gear_positions(spark, SMALL).collect()}
    assert got.keys() == places.keys() and len({k[2] for k in got}) == 15
    assert all(close(got[k][c], 1000 * places[k][c]) for k in got for c in (0, 1))
    counts = queries.scenario_counts(spark, SMALL).first()
    assert (counts["accepted"], counts["rejected"]) == (sum(status.values()), len(status) - sum(status.values()))
    middle = min((abs(r - 3) / 2 + abs(w - 320) / 400, r, w) for (r, w), v in status.items() if v)
    best = queries.reference_case(spark, SMALL).first()
    assert (best["ratio"], best["spread"]) == middle[1:]
    full = {(r, w) for r in {r for (r, _), v in status.items() if v} for w in {w for (_, w), v in status.items() if v}}
    assert {tuple(r) for r in queries.missing_scenarios(spark, SMALL).collect()} == {k for k in full if not status[k]}
    cells = {r["ratio"]: r["cells"] for r in queries.result_matrix(spark, SMALL).collect()}
    for r in queries.RATIOS:
        seen = {w: sorted({k[4] for k, p in places.items() if k[:2] == (r, w) and p[0] < 1000}) for w in queries.SPREADS}
        assert cells[r] == ";".join(f"{int(w)}:{str(status[r, w]).lower()}:{'+'.join(seen[w])}" for w in queries.SPREADS)


def test_depths_under_the_tow_points(spark):
    cells = {(r["row"], r["col"]): r["elevation"] for r in bridge.raster(spark, SMALL).collect()}
    tracks = defaultdict(list)
    for r in bridge.track(spark, SMALL).orderBy("us", "event_id").collect():
        tracks[r["mmsi"]].append(r)
    want = defaultdict(list)
    for mmsi, own in tracks.items():
        for a, b in zip(own, own[1:]):
            v = math.hypot(b["x"] - a["x"], b["y"] - a["y"]) / 10
            depth = None
            if v >= 0.01:
                x, y = (a[c] - (b[c] - a[c]) / 10 / v * 25 for c in "xy")
                lon, lat = (float(c[0]) for c in geodesy.direct(*(np.array([k]) for k in (*queries.CENTRE, math.degrees(math.atan2(x, y)), math.hypot(x, y)))))
                px, py = (lon - queries.CORNER[0]) / queries.PIXEL[0] - 0.5, (queries.CORNER[1] - lat) / queries.PIXEL[1] - 0.5
                r, c = math.floor(py), math.floor(px)
                four = [cells.get((r + i, c + j)) for i in (0, 1) for j in (0, 1)]
                if None not in four:
                    e = sum(v * w for v, w in zip(four, ((1 - px + c) * (1 - py + r), (px - c) * (1 - py + r), (1 - px + c) * (py - r), (px - c) * (py - r))))
                    depth = -e if e < 0 else None
            want[mmsi, a["us"]].append(depth)
    got = defaultdict(list)
    for r in queries.tow_depths(spark, SMALL).collect():
        got[r["mmsi"], r["t0"]].append(r["depth_mm"])
    assert got.keys() == want.keys() and sum(v != [None] for v in got.values()) > 100
    for k, depths in want.items():
        assert sorted(map(repr, (d is None for d in depths))) == sorted(map(repr, (d is None for d in got[k])))
        assert all(close(g, 1000 * w) for g, w in zip(sorted(d for d in got[k] if d is not None), sorted(d for d in depths if d is not None)))


def test_slopes_around_every_cell(spark):
    cells = {(r["row"], r["col"]): r["elevation"] for r in bridge.raster(spark, SMALL).collect()}
    slopes = {}
    for r, c in cells:
        ring = {(i, j): cells.get((r + i, c + j)) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j}
        if None not in ring.values():
            gx = sum((2 if i == 0 else 1) * j * e for (i, j), e in ring.items()) / (8 * 250)
            gy = sum((2 if j == 0 else 1) * i * e for (i, j), e in ring.items()) / (8 * 400)
            slopes[r, c] = math.degrees(math.atan(math.hypot(gx, gy)))
    disc = [(i, j) for i in range(-3, 4) for j in range(-5, 6) if (i * 400) ** 2 + (j * 250) ** 2 <= 1000**2]
    want = {}
    for r, c in cells:
        near = [slopes[k] for i, j in disc if (k := (r + i, c + j)) in slopes]
        if near:
            want[r, c] = 1e6 * median(near), 1e6 * min(near), 1e6 * max(near), len(near)
    got = {(r["centre_row"], r["centre_col"]): (r["median_u"], r["least_u"], r["greatest_u"], r["cells"]) for r in queries.slope_neighbourhood(spark, SMALL).collect()}
    assert got.keys() == want.keys() and len(got) > 0.9 * len(cells)
    assert all(got[k][3] == want[k][3] and all(map(close, got[k][:3], want[k][:3])) for k in got)


def plain_fit(t, xy, rms, at):
    knots, c = spline.fit(t, xy, len(t) * rms**2)
    return np.hstack([spline.evaluate(knots, c, at), spline.evaluate(knots, c, at, 1)])


def test_smooth_whole_tracks(spark):
    """Short tracks are one plain fit; a long one lies near a plain fit of all its points, without jumps."""
    rng = np.random.default_rng(9)
    tracks = {}
    for mmsi, n in ((1, 3), (2, 4), (3, 60), (4, 300)):
        t = np.cumsum(rng.uniform(100, 1500, n))
        t -= t[0]
        tracks[mmsi] = t, np.column_stack([5 * t + 20 * rng.standard_normal(n), 3000 * np.sin(t / 20_000) + 20 * rng.standard_normal(n)])
    data = [(m, float(a), float(x), float(y)) for m, (t, xy) in tracks.items() for a, (x, y) in zip(t, xy)]
    df = spark.createDataFrame(data, "mmsi long, t double, x double, y double")
    got = defaultdict(list)
    for r in spline.smooth_whole_tracks(df, 600.0, 25.0).orderBy("mmsi", "t").collect():
        got[r["mmsi"]].append((r["t"], r["x"], r["y"], r["vx"], r["vy"]))
    assert got.keys() == {2, 3, 4}
    for m, found in got.items():
        found = np.array(found)
        t, xy = tracks[m]
        assert np.array_equal(found[:, 0], np.arange(0, t[-1], 600.0))
        want = plain_fit(t, xy, 25.0, found[:, 0])
        if m < 4:
            assert np.allclose(found[:, 1:], want, rtol=1e-9, atol=1e-6)
        else:
            off = np.hypot(*(found[:, 1:3] - want[:, :2]).T)
            assert off.max() < 75 and np.sqrt((off**2).mean()) < 25
            fine = np.array([tuple(r) for r in spline.smooth_whole_tracks(df.where("mmsi = 4"), 60.0, 25.0).orderBy("t").select("x", "y", "vx", "vy").collect()])
            assert np.abs(np.diff(fine[:, :2], axis=0) / 60 - (fine[1:, 2:] + fine[:-1, 2:]) / 2).max() < 0.2


def blended(t, xy, rms, step, core=32, reach=8):
    """Rows of a track by fits of its windows, one after another."""
    last = max(len(t) // core, 1) - 1
    parts = [slice(max(w * core - reach, 0), (w + 1) * core + reach if w < last else len(t)) for w in range(last + 1)]
    fits = [spline.fit(t[s], xy[s], len(t[s]) * rms**2) for s in parts]
    out = []
    for at in np.arange(np.ceil(t[0] / step), np.floor(t[-1] / step) + 1) * step:
        w = max(k for k, s in enumerate(parts) if t[s][0] <= at)
        place, speed = (spline.evaluate(*fits[w], np.array([at]), d)[0] for d in (0, 1))
        if w and at < (b := t[parts[w]][2 * reach - 1]):
            a = t[parts[w]][0]
            old, was = (spline.evaluate(*fits[w - 1], np.array([at]), d)[0] for d in (0, 1))
            share = (at - a) / (b - a)
            place, speed = old + share * (place - old), was + share * (speed - was) + (place - old) / (b - a)
        out.append((at, *place, *speed))
    return np.array(out)


def test_smooth_whole_tracks_in_runs(spark):
    """Runs of windows give the rows of all windows fitted in turn, also where a step falls on a point's time,
    and the rows are finished where they are made: only points are shuffled."""
    rng = np.random.default_rng(4)
    tracks = {}
    for mmsi, n in ((1, 700), (2, 64), (3, 95), (4, 1100)):
        t = np.cumsum(rng.uniform(100, 1500, n)) if mmsi < 3 else 600.0 * np.cumsum(rng.integers(1, 3, n))
        tracks[mmsi] = t, np.column_stack([5 * t + 20 * rng.standard_normal(n), 3000 * np.sin(t / 20_000) + 20 * rng.standard_normal(n)])
    data = [(m, float(a), float(x), float(y)) for m, (t, xy) in tracks.items() for a, (x, y) in zip(t, xy)]
    df = spark.createDataFrame(data, "mmsi long, t double, x double, y double")
    smoothed = spline.smooth_whole_tracks(df, 600.0, 25.0)
    plan = smoothed._jdf.queryExecution().sparkPlan().toString()
    assert plan.splitlines()[0].startswith("FlatMapGroupsInPandas"), plan
    for run in (16, 1, 3):
        got = defaultdict(list)
        for r in spline.smooth_whole_tracks(df, 600.0, 25.0, run=run).orderBy("mmsi", "t").collect():
            got[r["mmsi"]].append((r["t"], r["x"], r["y"], r["vx"], r["vy"]))
        assert got.keys() == tracks.keys()
        for m, (t, xy) in tracks.items():
            found, want = np.array(got[m]), blended(t, xy, 25.0, 600.0)
            assert found.shape == want.shape and np.allclose(found, want, rtol=1e-9, atol=1e-6), (run, m)


def test_smooth_track_shuffles_its_points_once_by_vessel_and_once_by_run(spark):
    """Whatever is broadcast, ranks come without a shuffle of their own, from points dealt by vessel once."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(limit)
    points = spark.createDataFrame([(m, 700.0 * k, 3.0 * k, 1.0 * m) for m in range(3) for k in range(5)] + [(None, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0), (9, 0.0, 1.0, 1.0)], "mmsi long, t double, x double, y double")
    try:
        spark.conf.set(limit, "-1")
        for df in (queries.smooth_track(spark, SMALL), spline.smooth_whole_tracks(points, 600.0, 25.0)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 2 and "Join" not in plan, plan
        assert {(r["mmsi"], r["count"]) for r in df.groupBy("mmsi").count().collect()} == {(m, 5) for m in range(3)}
    finally:
        spark.conf.set(limit, old)


def test_smooth_track_reaches_the_ends(spark):
    ends = {r["mmsi"]: (r["a"], r["b"], r["n"]) for r in bridge.track(spark, SMALL).groupBy("mmsi").agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count_distinct("us").alias("n")).collect()}
    got = {r["mmsi"]: (r["t"], r["n"]) for r in queries.smooth_track(spark, SMALL).groupBy("mmsi").agg(F.max("t").alias("t"), F.count("*").alias("n")).collect()}
    assert got == {m: (600.0 * ((b - a) // 600_000_000), (b - a) // 600_000_000 + 1) for m, (a, b, n) in ends.items() if n >= 4}


def test_smooth_window_is_one_fit_of_a_closed_window(spark):
    start = bridge.micros_of(datetime.fromisoformat(queries.SMOOTHED[0]))
    end = bridge.micros_of(datetime.fromisoformat(queries.SMOOTHED[1]))
    tracks = defaultdict(dict)
    for r in bridge.track(spark, SMALL).collect():
        if start <= r["us"] <= end:
            tracks[r["mmsi"]].setdefault((r["us"] - start) / 1e6, []).append((r["x"], r["y"]))
    got = defaultdict(list)
    for r in queries.smooth_window(spark, SMALL).orderBy("mmsi", "t").collect():
        got[r["mmsi"]].append(tuple(r)[1:])
    assert got.keys() == {m for m, own in tracks.items() if len(own) >= 4} and got
    for mmsi, found in got.items():
        t = np.array(sorted(tracks[mmsi]))
        xy = np.array([np.mean(tracks[mmsi][k], axis=0) for k in sorted(tracks[mmsi])])
        at = np.arange(0, (end - start) / 1e6 + 300, 600.0)
        assert np.allclose(np.array(found)[:, 0], at)
        assert np.allclose(np.array(found)[:, 1:], plain_fit(t, xy, 40.0, at), rtol=1e-6, atol=1e-4)
    edge = spark.createDataFrame([("2024-01-10 00:00:00",), ("2024-01-13 00:00:00",), ("2024-01-13 00:00:01",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert edge.where(positions.closed("t", *queries.SMOOTHED)).count() == 2

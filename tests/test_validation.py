"""Provenance, evidence and geometry against plain Python."""

import hashlib
import json
import math
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatrace.functions import geodesy, geometry
from seatrace.operators import gear, provenance, summaries, validation
from seatrace.plans import bridge, queries
from tests.compare import SMALL


def test_content_hashes(spark):
    rows = sorted(((r["mmsi"], r["us"], r["longitude"], r["latitude"], r["speed"], r["course"]) for r in bridge.speeds(spark, SMALL).collect()), key=lambda r: tuple(-math.inf if v is None else v for v in r))
    want = {}
    for mmsi, us, *values in rows:
        digest = want.setdefault(mmsi, hashlib.sha256(b"positions-v1\0" + struct.pack(">q", mmsi)))
        digest.update(struct.pack(">q4d", us, *(math.nan if v is None else v for v in values)))
    assert {r["mmsi"]: r["sha256"] for r in queries.content_hashes(spark, SMALL).collect()} == {k: v.hexdigest() for k, v in want.items()}


def test_requests_and_manifest(spark):
    windows = spark.sql("SELECT 257L AS mmsi, timestamp_ntz'2022-01-07 03:05:00' AS a, timestamp_ntz'2022-01-07 03:15:00' AS b")
    asked = provenance.position_requests(windows, 0.5)
    payload = json.dumps({"mmsiIds": [257], "start": "202201070305", "end": "202201070315", "minSpeed": 0.5}, sort_keys=True, separators=(",", ":"))
    row = asked.first()
    assert row["payload"] == payload
    assert row["request_id"] == hashlib.sha256(f'{{"endpoint":"{row["endpoint"]}","payload":{payload}}}'.encode()).hexdigest()[:16]
    boxed = provenance.position_requests(windows.withColumn("mmsi", F.lit(None).cast("long")), 0.5, (1.0, 2.0, 3.0, 4.5)).first()
    assert boxed["endpoint"] == "ais/positions/within-bbox-time" and '"bbox":"1.0,2.0,3.0,4.5"' in boxed["payload"] and "mmsiIds" not in boxed["payload"]
    with pytest.raises(Exception, match="a vessel or a box"):
        provenance.position_requests(windows.withColumn("mmsi", F.lit(None).cast("long")), 0.5).collect()
    rows = provenance.manifest_rows(asked.union(asked), "d").collect()
    assert len(rows) == 1 and rows[0]["acquisition_id"] == hashlib.sha256(row["request_id"].encode()).hexdigest()[:16]
    with pytest.raises(Exception, match="whole minutes"):
        provenance.position_requests(windows.withColumn("a", F.expr("a + INTERVAL 1 SECOND")), 0.5).collect()


def test_checked_ids(spark):
    ids = spark.createDataFrame([("run_1",), ("é2",)], "id string")
    assert provenance.checked_ids(ids, "id").count() == 2
    for bad in ("a-b", "", "_", None):
        with pytest.raises(Exception, match="not an id"):
            provenance.checked_ids(spark.createDataFrame([(bad,)], "id string"), "id").collect()


def test_spatial_validation(spark):
    row = queries.spatial_validation(spark, SMALL).first()
    line = [(9 + r["x"] / 10_000, 78 + r["y"] / 10_000) for r in bridge.cable(spark, SMALL).orderBy("seq").collect()]
    utm = lambda lon, lat: tuple(spark.range(1).select(geodesy.utm_forward(F.lit(lon), F.lit(lat)).alias("p")).first()["p"])
    points, here = [utm(*p) for p in line], utm(9.2, 78.1)

    def away(p, a, b):
        d = np.subtract(b, a)
        part = min(1, max(0, np.dot(np.subtract(p, a), d) / np.dot(d, d)))
        return math.dist(p, np.add(a, part * d))

    assert row["track_length_m"] == pytest.approx(sum(map(math.dist, points, points[1:])))
    assert row["candidate_distance_m"] == pytest.approx(min(away(here, a, b) for a, b in zip(points, points[1:])))
    clusters = {r["label"]: (r["lon"], r["lat"]) for r in validation.dwell_clusters(bridge.speeds(spark, SMALL), 0.5, 1000.0).collect()}
    far = lambda a, b: float(geodesy.inverse(*(np.array([v]) for v in (*a, *b)))[0][0])
    metres = {k: far((9.2, 78.1), v) for k, v in clusters.items()}
    assert row["closest_cluster"] == min(metres, key=metres.get) and row["closest_cluster_m"] == pytest.approx(min(metres.values()))
    assert row["core_m"] == pytest.approx(far((9.2, 78.1), (9.94, 78.19))) and row["separation_m"] == pytest.approx(far(*clusters.values()))
    slow = Counter((9 + r["event_id"] % 7 / 10, 78 + r["event_id"] % 5 / 10) for r in bridge.table(spark, SMALL, "events").collect() if r["event_id"] % 11 and r["event_id"] % 5 / 4 <= 0.5)
    assert {n for _, n in slow.most_common(2)} == {r["n"] for r in validation.dwell_clusters(bridge.speeds(spark, SMALL), 0.5, 1000.0).collect()}
    line_df = spark.createDataFrame([("l", k, *p) for k, p in enumerate(line)], "line_id string, seq int, lon double, lat double")
    none = validation.spatial_validation(line_df, validation.dwell_clusters(bridge.speeds(spark, SMALL), 0.5, 1000.0), None, None, (9.94, 78.19)).first()
    assert none["candidate_distance_m"] is None and none["closest_cluster"] is None and none["core_m"] is None and none["track_length_m"] == pytest.approx(row["track_length_m"])
    with pytest.raises(Exception, match="fewer than two"):
        validation.dwell_clusters(bridge.speeds(spark, SMALL).where("lon = 9.0 and lat = 78.0"), 0.5, 1000.0).collect()


def test_geodesics_against_known_distances():
    """A quarter of the meridian, a degree of the equator, and direct against inverse."""
    one = lambda *x: float(geodesy.inverse(*(np.array([float(v)]) for v in x))[0][0])
    assert one(0, 0, 0, 90) == pytest.approx(10_001_965.729, abs=1e-3)
    assert one(0, 0, 1, 0) == pytest.approx(math.pi / 180 * geodesy.A, abs=1e-6)
    rng = np.random.default_rng(3)
    lon, lat, bearing, far = (rng.uniform(a, b, 500) for a, b in ((-170, 170), (-80, 80), (-180, 180), (1, 1e6)))
    there = geodesy.direct(lon, lat, bearing, far)
    metres, back = geodesy.inverse(lon, lat, *there)
    assert np.allclose(metres, far, atol=1e-4) and np.allclose(np.sin(np.radians(back - bearing)), 0, atol=1e-7)


def test_null_places(spark):
    df = spark.createDataFrame([(None, 78.0), (9.0, 78.0)], "lon double, lat double")
    got = [r[0] for r in df.select(geodesy.geodesic_distance(F.col("lon"), F.col("lat"), 9.0, 78.0)).collect()]
    assert got == [None, 0.0]


def test_lines_as_binary_and_text(spark):
    df = spark.createDataFrame([([(1.5, 2.0), (3.0, -4.25)],), (None,), ([],)], "p array<struct<x:double,y:double>>")
    got = df.select(geometry.as_wkb("p").alias("b"), geometry.as_wkt(F.col("p")).alias("t"), geometry.from_wkb(geometry.as_wkb("p")).alias("q")).collect()
    assert bytes(got[0]["b"]) == struct.pack("<BII4d", 1, 2, 2, 1.5, 2.0, 3.0, -4.25) and got[0]["t"] == "LINESTRING (1.5 2.0, 3.0 -4.25)"
    assert [tuple(p) for p in got[0]["q"]] == [(1.5, 2.0), (3.0, -4.25)] and got[1]["b"] is got[1]["t"] is got[1]["q"] is None and got[2]["q"] == []
    text = spark.createDataFrame([("linestring(1 2,3 4)",)], "t string").select(geometry.from_wkt("t").alias("p")).first()["p"]
    assert [tuple(p) for p in text] == [(1, 2), (3, 4)]
    assert geometry.wkb_to_line(struct.pack(">BII2d", 0, 2, 1, 5.0, 6.0)) == [{"x": 5.0, "y": 6.0}]
    with pytest.raises(ValueError):
        geometry.wkb_to_line(struct.pack("<BI2d", 1, 1, 5.0, 6.0))


def test_effort_without_records_and_current_run(spark):
    empty = spark.createDataFrame([], "gear string, hours double, vessel_id string")
    assert summaries.effort_summary(empty).first().asDict() == {"trawler_hours": 0.0, "all_hours": 0.0, "trawlers": 0, "vessels": 0}
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, n int")
    assert summaries.current_run(runs, runs.where("n = 1").select("run_id")).collect() == [("a", 1)]
    for named in (runs, runs.where("false")):
        with pytest.raises(Exception, match="expected one current run"):
            summaries.current_run(runs, named.select("run_id")).collect()


def test_scenarios_without_depths(spark):
    grid = gear.scenario_grid(spark, [2.0, 3.0], [100.0])
    for depths in ([], [(None,)], [(100.0,), (None,)]):
        got = gear.scenario_status(spark.createDataFrame(depths, "depth double"), grid, 3000.0).collect()
        assert len(got) == 2 and all(not r["accepted"] and r["rejection_reason"] == gear.NO_DEPTH for r in got)
    reasons = [r["rejection_reason"] for r in gear.scenario_status(spark.createDataFrame([(1001.0,)], "depth double"), gear.scenario_grid(spark, [3.0], [120.0]), 3000.0).collect()]
    assert reasons == [gear.CEILING]


def test_raster_report_of_a_raster_with_a_hole(spark):
    cells = bridge.raster(spark, SMALL)
    n = cells.select("row").distinct().count()
    assert provenance.raster_report(cells, n, 64).first()["complete"]
    assert not provenance.raster_report(cells.where("not (row = 3 and col = 5)"), n, 64).first()["complete"]
    assert not provenance.raster_report(cells.where("false"), n, 64).first()["complete"]

"""Masks, stitched lines, splines and nested records against known answers."""

import json
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatrace.functions import masks, records, spline
from seatrace.plans import bridge, queries
from tests.compare import SMALL


def flood(mask):
    """Parts of a mask over eight neighbours, as sets of cells, by walking."""
    left, parts = {tuple(c) for c in np.argwhere(mask)}, []
    while left:
        part, queue = set(), deque([left.pop()])
        while queue:
            r, c = queue.popleft()
            part.add((r, c))
            for k in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if k in left:
                    left.remove(k)
                    queue.append(k)
        parts.append(part)
    return parts


def test_labels_by_walking():
    rng = np.random.default_rng(2)
    for share in (0.1, 0.3, 0.5):
        mask = rng.random((20, 31)) < share
        labels = masks.label(mask)
        assert {frozenset(map(tuple, np.argwhere(labels == k))) for k in np.unique(labels[mask])} == {frozenset(p) for p in flood(mask)}


def test_largest_part_counts_cells_before_dilation():
    mask = np.zeros((30, 60), bool)
    mask[5, 2:12] = True  # ten cells in a row
    mask[20, 2:40:4] = True  # ten cells that dilation joins, and one more
    mask[20, 42] = True
    assert (masks.largest_part(mask) == (mask & (np.arange(30) == 20)[:, None])).all()
    assert not masks.largest_part(mask & False).any()
    assert (masks.dilate(np.eye(1, 9, 4, bool), 2)[0] == (np.abs(np.arange(9) - 4) <= 2)).all()


def centreline_by_loops(alpha):
    grown = alpha > 0
    for _ in range(masks.DILATIONS):
        grown = np.array([[any(0 <= r + i < grown.shape[0] and 0 <= c + j < grown.shape[1] and grown[r + i, c + j] for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))) for c in range(grown.shape[1])] for r in range(grown.shape[0])])
    parts = [{k for k in p if alpha[k] > 0} for p in flood(grown)]
    best = max(parts, key=lambda p: (len(p), -min(p)[0] * alpha.shape[1] - min(p)[1]))
    columns = sorted({c for _, c in best})
    out = []
    for c in range(columns[0], columns[-1] + 1, masks.EVERY):
        own = [(r, alpha[r, c]) for r, k in best if k == c]
        if own:
            out.append((c, sum(r * a for r, a in own) / sum(a for _, a in own)))
    return out if len(out) > 1 else []


def test_mask_components(spark):
    cells = bridge.raster(spark, SMALL).collect()
    images = {}
    for r in cells:
        images.setdefault(r["row"] // 64, np.zeros((64, 64), np.int64))[r["row"] % 64, r["col"]] = int(r["elevation"] > 150)
    got = {}
    for r in queries.mask_components(spark, SMALL).collect():
        got.setdefault(r["tile"], []).append((r["col"], r["centre"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: line for k, image in images.items() if (line := centreline_by_loops(image))}


def test_stitching(spark):
    line = [tuple(r) for r in queries.stitched_line(spark, SMALL).orderBy("seq").select("x", "y").collect()]
    assert line == [tuple(r) for r in bridge.cable(spark, SMALL).orderBy("seq").select("x", "y").collect()]
    pieces = [np.array(p, float) for p in ([(4, 0), (2, 0)], [(0, 0), (2, 0)], [(4, 0), (5, 1)], [(9, 9)])]
    assert masks.stitch(pieces, 1.0).tolist() == [[0, 0], [2, 0], [4, 0], [5, 1]]
    with pytest.raises(ValueError, match="apart"):
        masks.stitch([pieces[1], np.array([(8.0, 0), (9, 0)])], 1.0)
    assert masks.stitch([], 1.0).shape == masks.stitch([pieces[3]], 1.0).shape == (0, 2)
    empty = spark.createDataFrame([], "cable_id string, piece int, points array<struct<x:double,y:double>>")
    assert masks.stitch_lines(empty, 1.0).count() == 0


def test_spline_of_a_cubic_and_of_noise():
    t = np.linspace(0, 10, 60)
    cubic = np.column_stack([1 + t - 0.3 * t**2 + 0.02 * t**3, 5 - 2 * t])
    knots, c = spline.fit(t, cubic, 1e-9)
    at = np.linspace(0, 10, 33)
    assert np.allclose(spline.evaluate(knots, c, at), np.column_stack([1 + at - 0.3 * at**2 + 0.02 * at**3, 5 - 2 * at]), atol=1e-6)
    assert np.allclose(spline.evaluate(knots, c, at, 1), np.column_stack([1 - 0.6 * at + 0.06 * at**2, -2 + 0 * at]), atol=1e-6)
    noisy = np.column_stack([np.sin(t), np.cos(t)]) + 0.05 * np.random.default_rng(5).standard_normal((60, 2))
    target = 60 * 2 * 0.05**2
    knots, c = spline.fit(t, noisy, target)
    assert ((spline.evaluate(knots, c, t) - noisy) ** 2).sum() == pytest.approx(target, rel=1e-3)
    with pytest.raises(ValueError):
        spline.fit(t[:3], noisy[:3], 1.0)


def walk(value):
    """Records and keys of a report by plain recursion: (hours records not below others, all keys)."""
    if isinstance(value, dict):
        keys = set(value).union(*(walk(v)[1] for v in value.values()))
        hours = value.get("hours")
        if isinstance(hours, (int, float)) and not isinstance(hours, bool):
            return [(float(hours), value.get("geartype"), value.get("vesselId"))], keys
        return [r for v in value.values() for r in walk(v)[0]], keys
    if isinstance(value, list):
        parts = [walk(v) for v in value]
        return [r for p in parts for r in p[0]], set().union(*(p[1] for p in parts))
    return [], set()


def test_nested_records(spark):
    name = "public-global-fishing-effort:v3"
    reports = [
        {"a": [{name: [{"hours": 1.5, "geartype": "X", "vesselId": "v", "below": {"hours": 9, name + "x": 1}}]}, {"b": {"hours": True, "c": {"hours": 2}}}]},
        [], {}, 7, "text", None, [[[[{"hours": 3}]], {"hours": "4"}], {"hours": None, "x": {"hours": -1e3, "vesselId": None}}], {name + "y": [], "hours": {"hours": 12345678901234567890}}, {"e": {}, "f": [{}, {"hours": 0}]},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in reports] + [(None,)], "json string")
    want = [walk(r) for r in reports]
    got = sorted(((r["hours"], r["gear"], r["vessel_id"]) for r in records.hour_records(df, "json").collect()), key=repr)
    assert got == sorted((r for w in want for r in w[0]), key=repr) and len(got) == 6
    assert {r["dataset"] for r in records.datasets(df, "json").collect()} == {k for w in want for k in w[1] if k.startswith(records.DATASET)}
    assert "Python" not in records.hour_records(df, "json")._jdf.queryExecution().executedPlan().toString()
    assert records.hour_records(df.where("json is null"), "json").count() == 0
    with pytest.raises(Exception, match="more than 2 levels"):
        records.hour_records(df, "json", depth=2).collect()

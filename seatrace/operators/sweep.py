"""Places of many scenarios behind the points of a track, in one sorted pass over track and path.

The rows of a vessel and the segments of its path come in order of their chainage, and a task keeps the path from
the longest lag back, so the product of points and scenarios is neither joined nor shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATH = ("s0", "s1", "x0", "y0", "x1", "y1")


def differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False) & ~both.to_numpy(zero_copy_only=False)


def numbered(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """grid (scenario_id, ratio, spread) as one row with the list _cases, and as rows with their place _no in it.

    A grid is a few hundred rows by its parameters, whatever the tables hold, so it may go to all tasks."""
    listed = grid.agg(F.array_sort(F.collect_list(F.struct("scenario_id", "ratio", "spread"))).alias("_cases"))
    rows = listed.select(F.posexplode("_cases").alias("_no", "_c")).select("_no", "_c.*")
    return F.broadcast(listed), F.broadcast(rows)


def _merged(tow: DataFrame, path: DataFrame, cases: DataFrame, squared: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Rows of tow (_kind 1, with a lag for each case) and of path (_kind 0), sorted by vessel and chainage in each task."""
    lag = lambda c: F.sqrt(F.when(squared(c["ratio"], c["spread"], F.col("depth")) > 0, squared(c["ratio"], c["spread"], F.col("depth"))))
    number = lambda c: F.col(c).cast("double")
    none = lambda kind: F.lit(None).cast(kind)
    kinds = dict(tow.select("event_id", "us").dtypes)
    points = tow.crossJoin(cases).select(
        "mmsi", number("s").alias("_at"), F.lit(1).alias("_kind"), "event_id", "us", number("x").alias("_x"), number("y").alias("_y"), number("depth").alias("_u"), none("double").alias("_v"), none("double").alias("_end"),
        F.transform("_cases", lag).alias("_lags"), F.transform("_cases", lambda c: c["spread"]).alias("_spreads"),
    )
    segments = path.dropna(subset=["mmsi", *PATH]).select(
        "mmsi", number("s0").alias("_at"), F.lit(0).alias("_kind"), none(kinds["event_id"]).alias("event_id"), none(kinds["us"]).alias("us"), number("x0").alias("_x"), number("y0").alias("_y"), number("x1").alias("_u"), number("y1").alias("_v"), number("s1").alias("_end"),
        none("array<double>").alias("_lags"), none("array<double>").alias("_spreads"),
    )
    # A row is few bytes and much work, so its tasks aren't to be merged by their size.
    # They are dealt by a hash of the vessel: both sides of the union may be dealt by vessel already, into other tasks.
    tasks = int(tow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return points.unionByName(segments).repartition(tasks, F.xxhash64("mmsi")).sortWithinPartitions("mmsi", "_at", "_kind", "us", "event_id")


class _Path:
    """The path of the vessel at hand, from the longest lag back, while batches pass."""

    def __init__(self, longest: float, slack: float) -> None:
        self.longest, self.slack, self.kept, self.vessel = longest, slack, np.zeros((6, 0)), None

    def swept(self, batch: pa.RecordBatch) -> tuple[pa.RecordBatch, dict[str, np.ndarray]] | None:
        """The batch's points, and by point and case: lag (NaN if none), found (on the path), ix and iy."""
        mmsi = batch.column("mmsi")
        first = np.ones(batch.num_rows, bool)
        if batch.num_rows > 1:
            first[1:] = differs(mmsi)
        same = (mmsi[0].as_py(),) == self.vessel
        first[0] = not same
        own = np.cumsum(first) - (0 if same else 1)  # 0: the vessel that the batch begins with
        of = lambda rows, c: rows.column(c).to_numpy(zero_copy_only=False)
        is_point = of(batch, "_kind") == 1
        segments, points = batch.filter(pa.array(~is_point)), batch.filter(pa.array(is_point))
        fresh = np.stack([of(segments, c).astype(float) for c in ("_at", "_end", "_x", "_y", "_u", "_v")])
        old = self.kept if same else np.zeros((6, 0))
        path = np.hstack([old, fresh])
        owner = np.concatenate([np.zeros(old.shape[1], np.int64), own[~is_point]])
        self.vessel = (mmsi[batch.num_rows - 1].as_py(),)
        last = path[:, owner == own[-1]]
        if (reached := batch.column("_at")[batch.num_rows - 1].as_py()) is not None:
            last = last[:, last[1] >= reached - self.longest - self.slack]
        self.kept = last
        n = points.num_rows
        if not n or not len(points.column("_lags")[0]):
            return None
        s, x, y = (of(points, c).astype(float)[:, None] for c in ("_at", "_x", "_y"))
        lag = points.column("_lags").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
        if np.any(lag > self.longest):
            raise ValueError(f"a lag beyond the longest, {self.longest}")
        at = s - lag
        vessel = own[is_point]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(vessel)) + 1, [n]])
        lows, highs = np.searchsorted(owner, vessel[cuts[:-1]], "left"), np.searchsorted(owner, vessel[cuts[:-1]], "right")
        hit = np.full(at.shape, -1)
        for a, b, low, high in zip(cuts[:-1], cuts[1:], lows, highs):
            if high > low:
                k = np.searchsorted(path[0, low:high], at[a:b], "right") - 1
                hit[a:b] = np.where(k >= 0, k + low, -1)
        if path.shape[1]:
            s0, s1, x0, y0, x1, y1 = path[:, hit]
            found = (hit >= 0) & (at < s1)
            part = (at - s0) / (s1 - s0)
            ix, iy = x0 + part * (x1 - x0), y0 + part * (y1 - y0)
        else:
            found = np.zeros(at.shape, bool)
            ix = iy = np.full(at.shape, np.nan)
        return points, {"lag": lag, "ix": ix, "iy": iy, "found": found, "x": x, "y": y}


def places_behind(tow: DataFrame, path: DataFrame, grid: DataFrame, squared: Callable[[Column, Column, Column], Column], longest: float = float("inf"), slack: float = 0.0) -> DataFrame:
    """Every point of tow for every scenario with a lag: tow's columns, scenario_id, ratio, spread, _lag, ix and iy.

    tow has mmsi, event_id, us, s, x, y and depth; squared gives the squared lag of a ratio, a spread and a depth;
    ix and iy are null off the path. A lag beyond ``longest`` is an error, and no more of a path than that, and ``slack``, is held.
    """
    listed, rows = numbered(grid)
    kinds = {f.name: f.dataType for f in tow.schema}
    schema = T.StructType([*(T.StructField(c, kinds[c]) for c in ("mmsi", "event_id", "us")), *(T.StructField(c, T.DoubleType()) for c in ("s", "x", "y", "depth")), T.StructField("_no", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("_lag", "ix", "iy"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Path(longest, slack)
        for batch in batches:
            if not batch.num_rows or (swept := held.swept(batch)) is None:
                continue
            points, of = swept
            at, no = np.nonzero(~np.isnan(of["lag"]))
            off = ~of["found"][at, no]
            taken = pa.array(at)
            columns = [points.column(c).take(taken) for c in ("mmsi", "event_id", "us", "_at", "_x", "_y", "_u")]
            columns += [pa.array(no.astype(np.int32)), pa.array(of["lag"][at, no]), *(pa.array(of[c][at, no], mask=off) for c in ("ix", "iy"))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _merged(tow, path, listed, squared).mapInArrow(run, schema).join(rows, "_no").drop("_no")


def swept_parts(tow: DataFrame, path: DataFrame, grid: DataFrame, squared: Callable[[Column, Column, Column], Column], parts: dict[str, tuple[float, float]], longest: float = float("inf"), slack: float = 0.0) -> DataFrame:
    """(scenario_id, mmsi, event_id, us, component, x, y) of each part, for the points that have gear.

    parts gives each part's share of the spread to port and metres ahead of the centre.
    """
    listed, rows = numbered(grid)
    kinds = {f.name: f.dataType for f in tow.schema}
    schema = T.StructType([*(T.StructField(c, kinds[c]) for c in ("mmsi", "event_id", "us")), T.StructField("_no", T.IntegerType()), T.StructField("component", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Path(longest, slack)
        for batch in batches:
            if not batch.num_rows or (swept := held.swept(batch)) is None:
                continue
            points, of = swept
            has, centre = _centres(points, of)
            at, no = np.nonzero(has)
            taken, values = pa.array(at), [v[at, no] for v in centre]
            same = [*(points.column(c).take(taken) for c in ("mmsi", "event_id", "us")), pa.array(no.astype(np.int32))]
            for name, shift in parts.items():
                px, py = _part(values, shift)
                yield pa.RecordBatch.from_arrays([*same, pa.repeat(pa.scalar(name), len(at)), pa.array(px), pa.array(py)], names=schema.names)

    placed = _merged(tow, path, listed, squared).mapInArrow(run, schema).join(rows.select("_no", "scenario_id"), "_no")
    return placed.select("scenario_id", "mmsi", "event_id", "us", "component", "x", "y")


def _centres(points: pa.RecordBatch, of: dict[str, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Whether a point has gear in a case, and its centre a lag behind the point, direction and spread."""
    lag, x, y = of["lag"], of["x"], of["y"]
    dx, dy = x - of["ix"], y - of["iy"]
    chord = np.sqrt(dx * dx + dy * dy)
    with np.errstate(invalid="ignore", divide="ignore"):
        ux, uy = dx / chord, dy / chord
    spread = points.column("_spreads").flatten().to_numpy(zero_copy_only=False).reshape(lag.shape)
    return ~np.isnan(lag) & of["found"] & ~(chord < 1), [x - lag * ux, y - lag * uy, ux, uy, spread]


def _part(centre: list[np.ndarray], shift: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Places of a part. The normal of the direction (ux, uy) is (-uy, ux); port lies on its positive side."""
    cx, cy, ux, uy, spread = centre
    across, along = spread * shift[0], shift[1]
    return cx + across * -uy + along * ux, cy + across * ux + along * uy


def swept_steps(tow: DataFrame, path: DataFrame, grid: DataFrame, squared: Callable[[Column, Column, Column], Column], parts: dict[str, tuple[float, float]], longest: float = float("inf"), slack: float = 0.0) -> DataFrame:
    """(scenario_id, mmsi, component, t0, x0, y0, t1, x1, y1): steps of each part between consecutive points that have gear.

    parts gives each part's share of the spread to port and metres ahead of the centre. Points of a vessel come in order of
    chainage, then time, then event.
    """
    listed, rows = numbered(grid)
    kinds = {f.name: f.dataType for f in tow.schema}
    schema = T.StructType([T.StructField("mmsi", kinds["mmsi"]), T.StructField("_no", T.IntegerType()), T.StructField("component", T.StringType()), *(T.StructField(f"{c}{k}", kinds["us"] if c == "t" else T.DoubleType()) for k in (0, 1) for c in "txy")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vessel_before, before = _Path(longest, slack), None, []  # the vessel of the last point; by case, its last point with gear
        for batch in batches:
            if not batch.num_rows or (swept := held.swept(batch)) is None:
                continue
            points, of = swept
            has, centre = _centres(points, of)
            stamps, mmsi, n, cases = points.column("us"), points.column("mmsi"), *has.shape
            vessel = np.cumsum(np.concatenate([[(mmsi[0].as_py(),) != vessel_before], differs(mmsi)]))  # 0: that of the points before
            columns = [[] for _ in schema]
            ends = [None] * cases
            for k in range(cases):
                at = np.flatnonzero(has[:, k])
                values = [v[at, k] for v in centre]
                own, times, names = vessel[at], stamps.take(pa.array(at)), mmsi.take(pa.array(at))
                if vessel[0] == 0 and before[k] is not None:
                    values = [np.concatenate([[old], new]) for old, new in zip(before[k][2:], values)]
                    own, times, names = np.concatenate([[0], own]), pa.concat_arrays([before[k][0], times]), pa.concat_arrays([before[k][1], names])
                if len(own) and own[-1] == vessel[-1]:
                    ends[k] = (times.slice(len(own) - 1), names.slice(len(own) - 1), *(v[-1] for v in values))
                on = np.flatnonzero(np.diff(own) == 0)
                a, b = pa.array(on), pa.array(on + 1)
                for name, shift in parts.items():
                    px, py = _part(values, shift)
                    made = [names.take(a), pa.array(np.full(len(on), k, np.int32)), pa.repeat(pa.scalar(name), len(on)), times.take(a), pa.array(px[on]), pa.array(py[on]), times.take(b), pa.array(px[on + 1]), pa.array(py[on + 1])]
                    for column, piece in zip(columns, made):
                        column.append(piece)
            vessel_before, before = (mmsi[n - 1].as_py(),), ends
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=schema.names)

    steps = _merged(tow, path, listed, squared).mapInArrow(run, schema).join(rows.select("_no", "scenario_id"), "_no")
    return steps.select("scenario_id", "mmsi", "component", "t0", "x0", "y0", "t1", "x1", "y1")

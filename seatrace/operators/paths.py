"""Paths: steps, chainage, points aft of the antenna, interpolation along the path, distances to lines.

Nulls: a step with a null coordinate has length 0 in a chainage, and a null distance; empty tables give no rows.
Points of equal time keep the order of their further keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrace.functions.geodesy import local_forward
from seatrace.operators.cells import touched_cells


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def consecutive(points: DataFrame, key: str | list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Pairs of a point and the next one of its key: each column as <name>0 and <name>1."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    pairs = points.select(*keys, *(F.col(c).alias(f"{c}0") for c in columns), *(F.lead(c).over(w).alias(f"{c}1") for c in columns), F.lead(F.lit(True)).over(w).alias("_more"))
    return pairs.where("_more").drop("_more")


def polyline_segments(vertices: DataFrame, line: str = "cable_id", seq: str = "seq") -> DataFrame:
    """(line, seg, x0, y0, x1, y1) of a vertex table (line, seq, x, y)."""
    w = Window.partitionBy(line).orderBy(seq)
    ends = vertices.select(line, F.col(seq).alias("seg"), F.col("x").alias("cx0"), F.col("y").alias("cy0"), F.lead("x").over(w).alias("cx1"), F.lead("y").over(w).alias("cy1"))
    return ends.where("cx1 is not null")


def chainage(points: DataFrame, order: list[str]) -> DataFrame:
    """points with step_mm from the point before and chainage_mm from the vessel's first point.

    Steps are whole millimetres, so sums don't depend on the order in which they are added.
    """
    w = Window.partitionBy("mmsi").orderBy(*order)
    step = length(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    stepped = points.withColumn("step_mm", F.coalesce(F.floor(step * 1000 + 0.5), F.lit(0)).cast("long"))
    return stepped.withColumn("chainage_mm", F.sum("step_mm").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def moving_chainage(points: DataFrame, order: list[str]) -> DataFrame:
    """``chainage`` of vessels that move at every step; a step of no length (or none known) is an error when it is read."""
    w = Window.partitionBy("mmsi").orderBy(*order)
    moved = length(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) > 0
    still = F.raise_error(F.concat(F.lit("no move of vessel "), F.col("mmsi").cast("string"))).cast("long")
    checked = chainage(points.withColumn("_moved", F.coalesce(moved, F.row_number().over(w) == 1)), order)
    return checked.withColumn("step_mm", F.when(F.col("_moved"), F.col("step_mm")).otherwise(still)).drop("_moved")


def tow_points(points: DataFrame, offset: float, vx: str = "vx", vy: str = "vy") -> DataFrame:
    """points with tow_x, tow_y: offset aft along the velocity; null where the vessel is stationary."""
    speed = length(F.col(vx), F.col(vy))
    aft = lambda p, v: F.when(speed >= 0.01, F.col(p) - F.col(v) / speed * offset)
    return points.withColumn("tow_x", aft("x", vx)).withColumn("tow_y", aft("y", vy))


def range_join(probes: DataFrame, intervals: DataFrame, key: str, value: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """probes with the intervals of their key where low <= value < high, as an equi-join on buckets.

    An interval is listed in every bucket of ``width`` that it touches, a probe in its own, so work
    follows the matches instead of the product, and a hot bucket is a skewed join.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    listed = intervals.withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    listed = listed.withColumnsRenamed({key: "_key", "_bucket": "_in"})
    met = (F.col(key) == F.col("_key")) & (bucket(value) == F.col("_in")) & (F.col(low) <= F.col(value)) & (F.col(value) < F.col(high))
    return probes.join(listed, met, how).drop("_key", "_in")


def interpolate(probes: DataFrame, path: DataFrame, value: str, width: float, keep: bool = False) -> DataFrame:
    """probes with (ix, iy), the path's place at chainage ``value``; those off the path are left out, or null if kept.

    path has mmsi, s0, s1, x0, y0, x1, y1 for each segment.
    """
    hit = range_join(probes, path, "mmsi", value, "s0", "s1", width, "left" if keep else "inner")
    part = (F.col(value) - F.col("s0")) / (F.col("s1") - F.col("s0"))
    along = lambda a, b: F.col(a) + part * (F.col(b) - F.col(a))
    return hit.withColumn("ix", along("x0", "x1")).withColumn("iy", along("y0", "y1")).drop("s0", "s1", "x0", "y0", "x1", "y1")


def segment_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """From a point to a segment: to its projection, held within the ends."""
    dx, dy = x1 - x0, y1 - y0
    squared = dx * dx + dy * dy
    part = F.when(squared > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (y - y0) * dy) / squared))).otherwise(0.0)
    return length(x - (x0 + part * dx), y - (y0 + part * dy))


def _pairs_of_cells(cell: float) -> tuple[Column, Column]:
    """The least and the greatest distance there can be from a place in a cell (_px, _py) to the nearest place in (_lx, _ly)."""
    across, along = F.abs(F.col("_px") - F.col("_lx")), F.abs(F.col("_py") - F.col("_ly"))
    near = length(F.greatest(across - 1, F.lit(0)).cast("double"), F.greatest(along - 1, F.lit(0)).cast("double"))
    return near * cell, length((across + 1).cast("double"), (along + 1).cast("double")) * cell


def nearest_lines(points: DataFrame, segments: DataFrame, cell: float = 400.0, fan: int = 16, levels: int = 2, salts: int = 64) -> DataFrame:
    """(mmsi, cable_id, distance): the least distance from a vessel's points (mmsi, x, y) to each line.

    Points and segments lie in square cells of width ``cell``, those in cells ``fan`` times as wide, and so on for
    ``levels``. From the widest down, pairs of cells of a vessel and a line are joined by their wider cells,
    and a pair goes on only if it may be nearer than the best of its vessel and line surely is. In the end
    points meet the segments of the few cells left. The widest cells of every vessel meet those of every
    line, since every such pair has a row of the result; they are dealt over ``salts``. Points and segments
    without a place are left out.
    """
    finite = lambda *columns: " and ".join(f"abs({c}) < 'inf'" for c in columns)
    number = lambda c: F.floor(F.col(c) / cell).cast("long")
    placed = points.where(finite("x", "y")).select("mmsi", "x", "y", number("x").alias("_px"), number("y").alias("_py"))
    drawn = touched_cells(segments.where(finite("cx0", "cy0", "cx1", "cy1")), ("cx0", "cy0", "cx1", "cy1"), cell).withColumnsRenamed({"_gx": "_lx", "_gy": "_ly"})

    def coarser(df: DataFrame, key: str, x: str, y: str) -> list[DataFrame]:
        found = [df.select(key, x, y).distinct()]
        for _ in range(levels):
            wide = [F.floor(F.col(c) / fan).cast("long").alias(c) for c in (x, y)]
            found.append(found[-1].select(key, *wide).distinct())
        return found

    vessels, lines = coarser(placed, "mmsi", "_px", "_py"), coarser(drawn, "cable_id", "_lx", "_ly")
    pairs = vessels[-1].withColumn("_salt", F.pmod(F.xxhash64("mmsi", "_px", "_py"), F.lit(salts)).cast("int"))
    pairs = pairs.join(lines[-1].withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "_salt").drop("_salt")
    both = Window.partitionBy("mmsi", "cable_id")
    for level in range(levels, -1, -1):
        if level < levels:
            for df, key, x, y in ((vessels[level], "mmsi", "_px", "_py"), (lines[level], "cable_id", "_lx", "_ly")):
                inner = df.select(key, F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(x) / fan).cast("long").alias(x), F.floor(F.col(y) / fan).cast("long").alias(y))
                pairs = pairs.join(inner, [key, x, y]).drop(x, y).withColumnsRenamed({"_x": x, "_y": y})
        low, high = _pairs_of_cells(cell * fan**level)
        pairs = pairs.withColumn("_best", F.min(high).over(both)).where(low <= F.col("_best") * (1 + 1e-6)).drop("_best")
    gap = segment_distance(*(F.col(c) for c in ("x", "y", "cx0", "cy0", "cx1", "cy1")))
    met = pairs.join(placed, ["mmsi", "_px", "_py"]).join(drawn, ["cable_id", "_lx", "_ly"])
    return met.groupBy("mmsi", "cable_id").agg(F.min(gap).alias("distance"))


def screen_vessels(points: DataFrame, segments: DataFrame, reach: float, **how) -> DataFrame:
    """(mmsi, cable_id, distance, within): least distance of a vessel's points to each line, and whether <= reach."""
    return nearest_lines(points, segments, **how).withColumn("within", F.col("distance") <= reach)


def screen_positions(positions: DataFrame, lines: DataFrame, centre: tuple[float, float], start: str, end: str, reach: float, **how) -> DataFrame:
    """The same of geographic positions (mmsi, ts, lon, lat) within [start, end), against vertices (cable_id, seq, lon, lat).

    Places off the globe are left out, repeated positions count once, and both sides are projected around
    ``centre`` first.
    """
    on_globe = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)
    seen = positions.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")) & on_globe)
    seen = seen.select("mmsi", "ts", "lon", "lat").distinct()
    flat = lambda df: df.withColumn("_p", local_forward(F.col("lon"), F.col("lat"), *centre)).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p")
    return screen_vessels(flat(seen).select("mmsi", "x", "y"), polyline_segments(flat(lines)), reach, **how)

"""Rasters as cells (row, col, elevation): bilinear depths, Horn slopes, neighbourhoods, centrelines.

A null elevation is no data; a cell is given once; empty rasters give null depths and no slopes or lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODATA = -32767


def _beside(values: list[str], along: str, across: str, step: int) -> list[Column]:
    """Each value of the next cell (or the last, for a step of -1) along a row or column; null if none lies there."""
    w = Window.partitionBy(across).orderBy(along)
    near = F.lead(along, step).over(w) == F.col(along) + step
    return [F.when(near, F.lead(v, step).over(w)) for v in values]


def _with_data(cells: DataFrame, nodata: int) -> DataFrame:
    return cells.select("row", "col", F.when(F.col("elevation") != nodata, F.col("elevation")).alias("e"))


def bilinear_depth(points: DataFrame, cells: DataFrame, nodata: int = NODATA) -> DataFrame:
    """points (px, py in pixels) with depth: minus the bilinear elevation of the four nearest centres.

    Null off the raster, next to nodata, and where the elevation isn't below 0. Two windows bring the four
    cells of each place together, so a cell is shuffled twice whatever the stencil.
    """
    right = _with_data(cells, nodata).withColumnRenamed("e", "e0").withColumn("e1", _beside(["e0"], "col", "row", 1)[0])
    below = _beside(["e0", "e1"], "row", "col", 1)
    squares = right.withColumns({"e2": below[0], "e3": below[1]}).dropna(subset=["e0", "e1", "e2", "e3"])
    placed = points.withColumn("col", F.floor(F.col("px") - 0.5).cast("int")).withColumn("row", F.floor(F.col("py") - 0.5).cast("int"))
    dx, dy = F.col("px") - (F.col("col") + 0.5), F.col("py") - (F.col("row") + 0.5)
    e = F.col("e0") * (1 - dx) * (1 - dy) + F.col("e1") * dx * (1 - dy) + F.col("e2") * (1 - dx) * dy + F.col("e3") * dx * dy
    joined = placed.join(squares, ["row", "col"], "left").withColumn("_e", e)
    return joined.withColumn("depth", F.when(F.col("_e") < 0, -F.col("_e"))).drop("_e", "e0", "e1", "e2", "e3", "row", "col")


def horn_slopes(cells: DataFrame, size_x: float, size_y: float, nodata: int = NODATA) -> DataFrame:
    """(row, col, slope): degrees by Horn's 3 x 3 weights; cells without all eight neighbours have none.

    The weights are those of a difference along one axis of sums (1, 2, 1) along the other, so one window
    along rows and one along columns do.
    """
    own = _with_data(cells, nodata).withColumns({"west": _beside(["e"], "col", "row", -1)[0], "east": _beside(["e"], "col", "row", 1)[0]})
    own = own.select("row", "col", (F.col("east") - F.col("west")).alias("d"), (F.col("west") + 2 * F.col("e") + F.col("east")).alias("s"))
    north, south = (_beside(["d", "s"], "row", "col", step) for step in (-1, 1))
    sums = own.select("row", "col", (north[0] + 2 * F.col("d") + south[0]).alias("gx"), (south[1] - north[1]).alias("gy"))
    dx, dy = F.col("gx") / (8 * size_x), F.col("gy") / (8 * size_y)
    return sums.dropna(subset=["gx", "gy"]).select("row", "col", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"))


def neighbourhoods(centres: DataFrame, values: DataFrame, radius: float, size_x: float, size_y: float) -> DataFrame:
    """centres (row, col) with each value (row, col, slope) whose cell lies within radius."""
    reach_r, reach_c = int(radius // size_y) + 1, int(radius // size_x) + 1
    inside = [(r, c) for r in range(-reach_r, reach_r + 1) for c in range(-reach_c, reach_c + 1) if (r * size_y) ** 2 + (c * size_x) ** 2 <= radius**2]
    offsets = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in inside))
    around = centres.select(F.col("row").alias("centre_row"), F.col("col").alias("centre_col"), F.explode(offsets).alias("o"))
    around = around.select("centre_row", "centre_col", (F.col("centre_row") + F.col("o.r")).alias("row"), (F.col("centre_col") + F.col("o.c")).alias("col"))
    return around.join(values, ["row", "col"])


def slope_summary(near: DataFrame) -> DataFrame:
    """Exact median, least, greatest and number of the slopes of each neighbourhood."""
    return near.groupBy("centre_row", "centre_col").agg(F.median("slope").alias("median"), F.min("slope").alias("least"), F.max("slope").alias("greatest"), F.count("*").alias("cells"))


def column_centres(cells: DataFrame, weight: Column, every: int) -> DataFrame:
    """(col, centre): the weighted mean row of each ``every``-th column with any weight."""
    weighed = cells.withColumn("_w", weight).where((F.col("_w") > 0) & (F.col("col") % every == 0))
    return weighed.groupBy("col").agg((F.sum(F.col("row") * F.col("_w")) / F.sum("_w")).alias("centre"))

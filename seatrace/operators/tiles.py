"""Rasters cut into square tiles: slopes around every cell, and parts of a mask that run across tiles.

A task holds one tile with a halo as wide as what it looks at, so a cell is shuffled about once whatever
the neighbourhood, and no task holds a raster. Parts of a mask are numbered inside tiles; only their
meetings across borders go through a search for connected labels.

Nulls: a cell with a null row, column or value is no cell; empty tables give no rows. A cell is given once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrace.functions.masks import dilate, label

#: Label of a cell: its row and column, moved above 0, in one long, in the order of rows.
COLUMN_BITS, COLUMN_ZERO = 32, 1 << 31


def with_halo(cells: DataFrame, tile: int, halo: int) -> DataFrame:
    """cells once for every tile (tile_row, tile_col) that they lie in or less than ``halo`` cells from."""
    reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int"))
    placed = cells.dropna(subset=["row", "col"])
    return placed.withColumn("tile_row", F.explode(reach("row"))).withColumn("tile_col", F.explode(reach("col")))


def _by_tile(cells: DataFrame, tile: int, halo: int, kernel: Callable[[np.ndarray, int, int], pa.Table], value: str, schema: str) -> DataFrame:
    """kernel(image with a halo, first row, first column) over all tiles; cells that aren't there are NaN."""

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        first = [k.as_py() * tile - halo for k in key]
        image = np.full((tile + 2 * halo,) * 2, np.nan)
        image[rows["row"].to_numpy() - first[0], rows["col"].to_numpy() - first[1]] = rows[value].to_numpy()
        return kernel(image, *first)

    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes and much work: not to be merged by size
    haloed = with_halo(cells.select("row", "col", F.col(value).cast("double").alias(value)), tile, halo)
    return haloed.repartition(tasks, "tile_row", "tile_col").groupBy("tile_row", "tile_col").applyInArrow(one, schema)


def slopes_around(cells: DataFrame, radius: float, size_x: float, size_y: float, nodata: int, tile: int = 128) -> DataFrame:
    """(centre_row, centre_col, median, least, greatest, cells) of Horn's slopes, in degrees, within radius of every cell.

    The median is exact. Cells (row, col, elevation) near which no slope is known have no row.
    """
    reach_r, reach_c = int(radius // size_y), int(radius // size_x)
    disc = [(r, c) for r in range(-reach_r, reach_r + 1) for c in range(-reach_c, reach_c + 1) if (r * size_y) ** 2 + (c * size_x) ** 2 <= radius**2]
    halo = max(reach_r, reach_c) + 1
    names = ["centre_row", "centre_col", "median", "least", "greatest", "cells"]

    def around(image: np.ndarray, row: int, col: int) -> pa.Table:
        there = ~np.isnan(image)
        e = np.where(image == nodata, np.nan, image)
        at = lambda i, j: e[1 + i : e.shape[0] - 1 + i, 1 + j : e.shape[1] - 1 + j]
        east = (at(-1, 1) + 2 * at(0, 1) + at(1, 1)) - (at(-1, -1) + 2 * at(0, -1) + at(1, -1))
        south = (at(1, -1) + 2 * at(1, 0) + at(1, 1)) - (at(-1, -1) + 2 * at(-1, 0) + at(-1, 1))
        dx, dy = east / (8 * size_x), south / (8 * size_y)
        slope = np.degrees(np.arctan(np.sqrt(dx * dx + dy * dy)))  # from one cell within the image's edge
        found = []
        for r in range(halo, halo + tile):
            stack = np.stack([slope[r - 1 + i, halo - 1 + j : halo - 1 + j + tile] for i, j in disc])
            stack.sort(axis=0)  # NaN last
            n = len(disc) - np.isnan(stack).sum(0)
            own = np.flatnonzero(there[r, halo : halo + tile] & (n > 0))
            low, high = stack[(n[own] - 1) // 2, own], stack[n[own] // 2, own]
            found.append((np.full(len(own), row + r), col + halo + own, (low + high) / 2, stack[0, own], stack[n[own] - 1, own], n[own]))
        kinds = (np.int32, np.int32, np.float64, np.float64, np.float64, np.int64)
        return pa.table([pa.array(np.concatenate(x).astype(k)) for x, k in zip(zip(*found), kinds)], names)

    schema = "centre_row int, centre_col int, median double, least double, greatest double, cells long"
    return _by_tile(cells.where("elevation is not null"), tile, halo, around, "elevation", schema)


def mask_labels(cells: DataFrame, dilations: int = 4, tile: int = 256) -> DataFrame:
    """(row, col, alpha, label, border) of the cells (row, col, alpha) of a mask, alpha above 0, grown ``dilations`` times.

    Cells that only the growth adds have a null alpha and are listed on a tile's border alone. A label is that of the first
    cell of a part inside its tile.
    """
    names = ["row", "col", "alpha", "label", "border"]

    def parts(image: np.ndarray, row: int, col: int) -> pa.Table:
        mask = np.nan_to_num(image) > 0
        inner = slice(dilations, dilations + tile)
        grown = dilate(mask, dilations)[inner, inner]
        number = label(grown)
        kinds, first = np.unique(number, return_index=True)
        first_r, first_c = np.divmod(first, tile)
        named = (first_r + row + dilations).astype(np.int64) * (1 << COLUMN_BITS) + first_c + col + dilations + COLUMN_ZERO
        edge = np.zeros_like(grown)
        edge[[0, -1], :] = edge[:, [0, -1]] = True
        own, alpha = mask[inner, inner], image[inner, inner]
        r, c = np.nonzero(grown & (own | edge))
        labels = named[np.searchsorted(kinds, number[r, c])]
        weight = pa.array(alpha[r, c], mask=~own[r, c])
        return pa.table([pa.array((r + row + dilations).astype(np.int32)), pa.array((c + col + dilations).astype(np.int32)), weight, pa.array(labels), pa.array(edge[r, c])], names)

    schema = "row int, col int, alpha double, label long, border boolean"
    return _by_tile(cells.where("alpha > 0"), tile, dilations, parts, "alpha", schema)


def border_pairs(labels: DataFrame) -> DataFrame:
    """(a, b), a < b: labels that touch, over any of the eight neighbours, across a border of tiles."""
    edge = labels.where("border").select("row", "col", "label")
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    near = edge.select(F.col("label").alias("a"), F.explode(around).alias("o"), "row", "col").select("a", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    return near.join(edge, ["row", "col"]).where("a < label").select("a", F.col("label").alias("b")).distinct()


def least_connected(pairs: DataFrame) -> DataFrame:
    """(label, part): the least label that each label of the pairs (a, b) is connected with.

    Every round gives larger neighbours the least of a label's neighbourhood, then smaller ones; rounds are
    some logarithm of the longest chain, each cut off by a checkpoint.
    """
    edges = pairs.checkpoint()
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = F.least("a", F.min("b").over(Window.partitionBy("a")))
        large = both.select("a", "b", least.alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        up = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = F.min("b").over(Window.partitionBy("a"))
        small = up.select("a", "b", low.alias("m"))
        edges = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct().checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") / F.lit(2.0**20).cast("double"))).first()
        if state == before:
            return edges.select(F.col("a").alias("label"), F.col("b").alias("part"))
        before = state


def mask_parts(cells: DataFrame, dilations: int = 4, tile: int = 256) -> DataFrame:
    """(row, col, alpha, part) of a mask's own cells; a part is named by its first cell, whatever the tiles."""
    labels = mask_labels(cells, dilations, tile).checkpoint()
    named = least_connected(border_pairs(labels))
    own = labels.where("alpha is not null").join(named, "label", "left")
    return own.select("row", "col", "alpha", F.coalesce("part", "label").alias("part"))


def part_sizes(parts: DataFrame) -> DataFrame:
    """(first_row, first_col, cells): where each part of a mask, grown, begins, and its own cells."""
    sizes = parts.groupBy("part").agg(F.count("*").alias("cells"))
    return sizes.select(F.shiftright("part", COLUMN_BITS).cast("int").alias("first_row"), (F.col("part") - F.shiftleft(F.shiftright("part", COLUMN_BITS), COLUMN_BITS) - COLUMN_ZERO).cast("int").alias("first_col"), "cells")


def largest_part(parts: DataFrame) -> DataFrame:
    """The cells of the part with most of them, ties to the one that begins first."""
    best = parts.groupBy("part").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", (-F.col("part")).alias("part"))).alias("b")).select((-F.col("b.part")).alias("part"))
    return parts.join(best, "part").drop("part")


def visible(bands: Column) -> Column:
    """The weight of a pixel of an image's bands (array): its fourth band, or 255 where any of three is above 0."""
    return F.when(F.size(bands) >= 4, F.get(bands, F.lit(3))).otherwise(F.when(F.exists(F.slice(bands, 1, 3), lambda v: v > 0), 255).otherwise(0))


def mask_line(cells: DataFrame, bounds: tuple[float, float, float, float], width: int, height: int, every: int = 4) -> DataFrame:
    """(col, x, y): the weighted middle of every ``every``-th column of the cells (row, col, alpha) of one part, from its
    first column on, in the coordinates of an image with these bounds. Less than two points are no line."""
    first = cells.agg(F.min("col").alias("_first"))
    weighed = cells.join(first, F.col("col") >= F.col("_first")).where((F.col("col") - F.col("_first")) % every == 0)
    centres = weighed.groupBy("col").agg((F.sum(F.col("row") * F.col("alpha")) / F.sum("alpha")).alias("_row"))
    minx, miny, maxx, maxy = bounds
    x = minx + (F.col("col") + 0.5) * ((maxx - minx) / width)
    y = maxy - (F.col("_row") + 0.5) * ((maxy - miny) / height)
    n = centres.agg(F.count("*").alias("_n"))
    return centres.select("col", x.alias("x"), y.alias("y")).join(n, F.col("_n") > 1).drop("_n")

"""Tiles against whole images: parts of masks over borders, their lines, and slopes around cells."""

import math
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatrace.functions import masks
from seatrace.operators import tiles
from tests.test_masks import flood

CELLS = "row int, col int, alpha int"


def cells_of(spark, image, r0=0, c0=0):
    rows = [(int(r) + r0, int(c) + c0, int(image[r, c])) for r, c in np.argwhere(image > 0)]
    return spark.createDataFrame(rows, CELLS)


def winding(n):
    """One path that winds over all tiles and back, and a spot apart."""
    image = np.zeros((n, n), np.int64)
    image[0:n:4, :] = 1
    for k, r in enumerate(range(0, n - 4, 4)):
        image[r : r + 4, -1 if k % 2 == 0 else 0] = 1
    return image


@pytest.mark.parametrize(("share", "dilations", "tile", "offset"), [(0.02, 1, 16, 0), (0.1, 0, 8, -37), (0.005, 4, 32, 1000), (None, 0, 7, 3)])
def test_parts_are_those_of_the_uncut_mask(spark, share, dilations, tile, offset):
    image = winding(41) if share is None else (np.random.default_rng(7).random((90, 120)) < share).astype(np.int64)
    got = {}
    for r in tiles.mask_parts(cells_of(spark, image, offset, -offset), dilations, tile).collect():
        got.setdefault(r["part"], set()).add((r["row"] - offset, r["col"] + offset))
    padded = np.pad(image > 0, dilations)  # growth isn't cut at the edge of the image
    parts = [{(r - dilations, c - dilations) for r, c in p} for p in flood(masks.dilate(padded, dilations))]
    want = {min(p): {k for k in p if 0 <= k[0] < image.shape[0] and 0 <= k[1] < image.shape[1] and image[k]} for p in parts}
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values()}
    sizes = {(r["first_row"] - offset, r["first_col"] + offset): r["cells"] for r in tiles.part_sizes(tiles.mask_parts(cells_of(spark, image, offset, -offset), dilations, tile)).collect()}
    assert sizes == {k: len(v) for k, v in want.items()}


def test_line_of_the_largest_part(spark):
    rng = np.random.default_rng(3)
    image = np.zeros((60, 200), np.int64)
    for c in range(20, 190):
        image[30 + int(8 * math.sin(c / 15)) + np.arange(3), c] = rng.integers(1, 255, 3)
    image[5, 0:30:3] = 9
    part = tiles.largest_part(tiles.mask_parts(cells_of(spark, image), 4, 32))
    line = {r["col"]: (r["x"], r["y"]) for r in tiles.mask_line(part, (100.0, 50.0, 300.0, 80.0), 200, 60).collect()}
    want = {c: (100 + (c + 0.5) * 1.0, 80 - (r + 0.5) * 0.5) for c, r in masks.centreline(image)}
    assert line.keys() == want.keys() and all(np.allclose(line[c], want[c]) for c in want)
    dot = spark.createDataFrame([(1, 1, 5)], CELLS)
    assert tiles.mask_line(dot, (0.0, 0.0, 1.0, 1.0), 9, 9).count() == 0 and tiles.mask_parts(dot.where("false")).count() == 0


def test_visible_pixels(spark):
    df = spark.createDataFrame([([0, 0, 0, 7],), ([0, 3, 0],), ([0, 0, 0],), ([9, 9, 9, 0],)], "bands array<int>")
    assert [r[0] for r in df.select(tiles.visible(F.col("bands"))).collect()] == [7, 255, 0, 0]


def test_slopes_around_cells_in_small_tiles(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(-500, 0, (40, 33)).astype(float)
    image[7, 9] = -32767
    hole = {(20, 20), (20, 21)}
    rows = [(r, c, int(image[r, c])) for r in range(40) for c in range(33) if (r, c) not in hole] + [(None, 3, 5), (50, 50, None)]
    got = {(r["centre_row"], r["centre_col"]): r for r in tiles.slopes_around(spark.createDataFrame(rows, "row int, col int, elevation int"), 1000.0, 250.0, 400.0, -32767, tile=16).collect()}
    e = {(r, c): v for r, c, v in rows if r is not None and v is not None and v != -32767}
    slopes = {}
    for r, c in [(r, c) for r in range(40) for c in range(33)]:
        ring = {(i, j): e.get((r + i, c + j)) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j}
        if None not in ring.values():
            gx = sum((2 if i == 0 else 1) * j * v for (i, j), v in ring.items()) / 2000
            gy = sum((2 if j == 0 else 1) * i * v for (i, j), v in ring.items()) / 3200
            slopes[r, c] = math.degrees(math.atan(math.hypot(gx, gy)))
    there = {(r, c) for r, c, v in rows if r is not None and v is not None}
    for r, c in there:
        near = [slopes[r + i, c + j] for i in range(-2, 3) for j in range(-4, 5) if (i * 400) ** 2 + (j * 250) ** 2 <= 1000**2 and (r + i, c + j) in slopes]
        if near:
            own = got.pop((r, c))
            assert own["cells"] == len(near) and np.allclose([own["median"], own["least"], own["greatest"]], [median(near), min(near), max(near)])
    assert not got

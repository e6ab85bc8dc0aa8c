"""Lines from rasterised masks: the largest connected part of a tile, its centreline, and stitching.

Edge cases: a null alpha is no mask; a tile whose part has fewer than two columns gives no line; an empty table
gives no rows; pieces of fewer than two points are left out, and a line without any other has no points.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

DILATIONS, EVERY = 4, 4


def dilate(mask: np.ndarray, times: int) -> np.ndarray:
    """Grown by the four neighbours, ``times`` over."""
    for _ in range(times):
        p = np.pad(mask, 1)
        mask = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    return mask


def label(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 for parts connected over the eight neighbours, 0 elsewhere, by spreading the least number."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        p = np.pad(np.where(mask, labels, big), 1, constant_values=big)
        h, w = mask.shape
        least = np.min([p[r : r + h, c : c + w] for r in range(3) for c in range(3)], axis=0)
        new = np.where(mask, least, 0)
        if np.array_equal(new, labels):
            return labels
        labels = new


def largest_part(mask: np.ndarray, dilations: int = DILATIONS) -> np.ndarray:
    """The cells of mask in the part, connected after dilation, that has most of them; ties to the first."""
    labels = label(dilate(mask, dilations)) * mask
    if not labels.any():
        return mask & False
    names, sizes = np.unique(labels[labels > 0], return_counts=True)
    return labels == names[np.argmax(sizes)]


def centreline(alpha: np.ndarray, every: int = EVERY) -> list[tuple[int, float]]:
    """(column, weighted mean row) of every ``every``-th column from the part's first to its last."""
    part = largest_part(alpha > 0)
    columns = np.flatnonzero(part.any(0))
    if not len(columns):
        return []
    out = []
    for c in range(columns[0], columns[-1] + 1, every):
        weights = np.where(part[:, c], alpha[:, c], 0).astype(float)
        if weights.sum() > 0:
            out.append((int(c), float((np.arange(len(weights)) * weights).sum() / weights.sum())))
    return out if len(out) > 1 else []


def tile_centrelines(cells: DataFrame) -> DataFrame:
    """(tile, col, centre) of cells (tile, row, col, alpha); a tile is one image of bounded size."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(rows["row"].max()) + 1, int(rows["col"].max()) + 1), np.int64)
        image[rows["row"], rows["col"]] = rows["alpha"].fillna(0)
        line = centreline(image)
        return pd.DataFrame({"tile": key[0], "col": [c for c, _ in line], "centre": [r for _, r in line]})

    return cells.groupBy("tile").applyInPandas(one, "tile long, col int, centre double")


def stitch(pieces: list[np.ndarray], gap: float) -> np.ndarray:
    """One line of pieces: from the smallest end on, always the piece with the nearest end next."""
    rest = [p for p in pieces if len(p) > 1]
    if not rest:
        return np.zeros((0, 2))
    first = min(range(len(rest)), key=lambda k: min(tuple(rest[k][0]), tuple(rest[k][-1])))
    line = rest.pop(first)
    if tuple(line[-1]) < tuple(line[0]):
        line = line[::-1]
    while rest:
        ends = [(float(np.hypot(*(p[e] - line[-1]))), k, e) for k, p in enumerate(rest) for e in (0, -1)]
        distance, k, e = min(ends)
        if distance > gap:
            raise ValueError(f"pieces of the line are {distance:.1f} apart")
        piece = rest.pop(k)
        line = np.vstack([line, (piece if e == 0 else piece[::-1])[1:]])
    return line


def stitch_lines(pieces: DataFrame, gap: float) -> DataFrame:
    """(cable_id, seq, x, y) of pieces (cable_id, piece, points): one group per cable, tens of pieces."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.array([(p["x"], p["y"]) for p in points]).reshape(-1, 2) for points in rows.sort_values("piece")["points"]]
        line = stitch(parts, gap)
        return pd.DataFrame({"cable_id": key[0], "seq": np.arange(len(line)), "x": line[:, 0], "y": line[:, 1]})

    return pieces.groupBy("cable_id").applyInPandas(one, "cable_id string, seq int, x double, y double")

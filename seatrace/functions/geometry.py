"""Lines as well-known binary and text. A null stays null; another kind of geometry is an error when it is read."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"
LINE = 2


def line_to_wkb(points: list[dict]) -> bytes:
    return struct.pack(f"<BII{2 * len(points)}d", 1, LINE, len(points), *(v for p in points for v in (p["x"], p["y"])))


def wkb_to_line(data: bytes) -> list[dict]:
    order = "<" if data[0] else ">"
    kind, n = struct.unpack_from(f"{order}II", data, 1)
    if kind != LINE:
        raise ValueError(f"a geometry of kind {kind} is no line")
    values = struct.unpack_from(f"{order}{2 * n}d", data, 9)
    return [{"x": x, "y": y} for x, y in zip(values[::2], values[1::2], strict=True)]


def wkt_to_line(text: str) -> list[dict]:
    found = re.fullmatch(r"\s*LINESTRING\s*\((.*)\)\s*", text, re.I | re.S)
    if not found:
        raise ValueError(f"no line: {text[:40]}")
    return [dict(zip("xy", map(float, pair.split()), strict=True)) for pair in found[1].split(",")]


def _each(kind: str, f: Callable, column: Column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return F.pandas_udf(run, kind)(column)


def as_wkb(points: Column) -> Column:
    return _each("binary", line_to_wkb, points)


def from_wkb(data: Column) -> Column:
    return _each(POINTS, wkb_to_line, data)


def from_wkt(text: Column) -> Column:
    return _each(POINTS, wkt_to_line, text)


def as_wkt(points: Column) -> Column:
    pairs = F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.when(points.isNotNull(), F.concat(F.lit("LINESTRING ("), F.array_join(pairs, ", "), F.lit(")")))

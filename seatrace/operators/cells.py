"""Square cells of the plane as keys for spatial joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def touched_cells(df: DataFrame, ends: tuple[str, str, str, str], cell: float) -> DataFrame:
    """df once for each square cell (_gx, _gy) of width ``cell`` that the straight line between the ends touches.

    Columns of cells are listed first, then only the cells that the line meets in each, so a long line in
    any direction has as many rows as cells along it. The line is widened by a millionth of a cell, far
    more than rounding moves it. Lines with a null end have no rows.
    """
    x0, y0, x1, y1 = (F.col(c) for c in ends)
    slack = cell * 1e-6
    number = lambda value: F.floor(value / cell).cast("long")
    columns = df.dropna(subset=list(ends)).withColumn("_gx", F.explode(F.sequence(number(F.least(x0, x1) - slack), number(F.greatest(x0, x1) + slack))))
    inside = lambda x: F.least(F.greatest(x, F.least(x0, x1)), F.greatest(x0, x1))
    height = lambda x: F.when(x1 != x0, y0 + (inside(x) - x0) / (x1 - x0) * (y1 - y0))
    a = F.coalesce(height(F.col("_gx") * cell - slack), y0)
    b = F.coalesce(height((F.col("_gx") + 1) * cell + slack), y1)
    met = columns.withColumn("_low", number(F.least(a, b) - slack)).withColumn("_high", number(F.greatest(a, b) + slack))
    return met.withColumn("_gy", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")

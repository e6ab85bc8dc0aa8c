"""Cleaning of position reports: choosing one report per time, islands of repeats, speed outliers.

Nulls: a report without a type ranks last, null coordinates equal each other in islands, and a speed that
can't be worked out (a null, or equal times) is no jump. Empty tables give no rows, or counts of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Receiver classes by message type: class A, class B, long range; any other (or none) is last.
CLASS_A, CLASS_B, LONG_RANGE = (1, 2, 3), (18, 19), (27,)


def message_priority(message_type: Column) -> Column:
    first = F.when(message_type.isin(*CLASS_A), 0).when(message_type.isin(*CLASS_B), 1)
    return first.when(message_type.isin(*LONG_RANGE), 2).otherwise(3)


def best_reports(reports: DataFrame, keys: list[str], tie_break: list[str]) -> DataFrame:
    """One report for each value of keys: best message class, then type, then tie_break ascending.

    Needs message_type. The priority is a column first because a window can't use a lateral alias;
    ``row_number() = 1`` becomes a group limit that drops most rows before the shuffle.
    """
    ranked = reports.withColumn("priority", message_priority(F.col("message_type")))
    order = ["priority", F.coalesce("message_type", F.lit(999)), *(F.col(c).asc_nulls_last() for c in tie_break)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return ranked.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def half_open(column: str, start: str, end: str) -> Column:
    """start <= column < end, as crossings and the failure minute use it."""
    return (F.col(column) >= F.lit(start).cast("timestamp_ntz")) & (F.col(column) < F.lit(end).cast("timestamp_ntz"))


def closed(column: str, start: str, end: str) -> Column:
    """start <= column <= end, as the smoothing and analysis windows use it."""
    return F.col(column).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def distinct_positions(reports: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct (mmsi, x, y) per time within a half-open window; all kept columns are keys."""
    inside = reports.where(half_open("ts", start, end))
    return inside.dropDuplicates(["mmsi", "ts", "x", "y"]).select("mmsi", "x", "y")


def position_islands(reports: DataFrame, x: str, y: str) -> DataFrame:
    """Runs of consecutive equal positions of a vessel: (mmsi, island, us, x, y, size).

    The time (microseconds) is the midpoint of the run's first and last, rounded down; a place that is
    visited again later is another run. Needs mmsi, us and event_id.
    """
    by_time = Window.partitionBy("mmsi").orderBy("us", "event_id")
    same = F.lag(x).over(by_time).eqNullSafe(F.col(x)) & F.lag(y).over(by_time).eqNullSafe(F.col(y))
    first = F.row_number().over(by_time) == 1
    changed = reports.withColumn("_changed", (first | ~same).cast("long"))
    run = F.sum("_changed").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    grouped = changed.withColumn("island", run).groupBy("mmsi", "island")
    middle = F.floor((F.min("us") + F.max("us")) / 2).cast("long")
    return grouped.agg(middle.alias("us"), F.first(x).alias("x"), F.first(y).alias("y"), F.count("*").alias("size"))


def drop_speed_outliers(points: DataFrame, limit: float, order: list[str], speed_t: str = "t") -> DataFrame:
    """Points of each vessel without isolated jumps: in- and outbound speed both above limit.

    All jumps are judged by the same neighbours and removed together. One pass is the fixed point: a
    point that stays has a slow edge, whose other end therefore stays too, so the edge is still there.
    Vessels with fewer than four points are left as they are, and end points always stay.
    """
    w = Window.partitionBy("mmsi").orderBy(*order)

    def speed(neighbour) -> Column:
        dx, dy = F.col("x") - neighbour("x").over(w), F.col("y") - neighbour("y").over(w)
        return F.sqrt(dx * dx + dy * dy) / F.abs(F.col(speed_t) - neighbour(speed_t).over(w))

    jump = F.coalesce((speed(F.lag) > limit) & (speed(F.lead) > limit), F.lit(False))
    enough = F.count("*").over(Window.partitionBy("mmsi")) >= 4
    return points.withColumn("_jump", jump & enough).where("not _jump").drop("_jump")


def track_quality(reports: DataFrame, islands: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: source rows, groups of repeats, rejected and kept positions."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = one(reports, "source_positions").crossJoin(one(islands, "position_groups")).crossJoin(one(kept, "kept_positions"))
    return counts.withColumn("rejected_positions", F.col("position_groups") - F.col("kept_positions"))

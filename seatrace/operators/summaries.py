"""Aggregates of catch reports, density cells, fishing effort and metric tables.

Nulls: a null meets no condition and differs from every value; points without coordinates share the cell null;
empty tables give counts of 0, sums of 0 hours, and no cells, duplicates or hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(**conditions: Column) -> list[Column]:
    """Counts of the rows that meet each condition (a null is not met)."""
    return [F.count_if(c).alias(name) for name, c in conditions.items()]


def differs(column: Column, value) -> Column:
    """Null-safe inequality: a null differs from any value."""
    return ~column.eqNullSafe(F.lit(value))


def trawl_counts(catches: DataFrame, areas: dict[str, tuple[str, ...]], years: tuple[int, int], months: tuple[int, int], group: str, gear: str, usual: str) -> DataFrame:
    """One row of counts of the catches by a gear in some locations, years and months.

    catches has area, location, year, start, gear_group, gear and specification; codes are strings.
    """
    placed = F.lit(False)
    for area, locations in areas.items():
        placed = placed | ((F.col("area") == area) & F.col("location").isin(*locations))
    chosen = catches.where(placed & F.col("year").between(*years) & F.month("start").between(*months) & (F.col("gear_group") == group))
    return chosen.agg(
        F.count("*").alias("total"),
        *counted(
            gear_rows=F.col("gear") == gear,
            other_gear=differs(F.col("gear"), gear),
            usual_specification=F.col("specification") == usual,
            other_specification=differs(F.col("specification"), usual),
        ),
    )


def density_cells(points: DataFrame, size: float) -> DataFrame:
    """(gx, gy, n): points by the nearest node of a grid, half to even."""
    return points.groupBy(F.rint(F.col("x") / size).cast("long").alias("gx"), F.rint(F.col("y") / size).cast("long").alias("gy")).agg(F.count("*").alias("n"))


def top_two_cells(cells: DataFrame, required: bool = False) -> DataFrame:
    """The two densest cells, labelled west and east by gx (then gy); ties in density by gx, gy.

    If two are required, one alone is an error when it is read.
    """
    top = cells.orderBy(F.desc("n"), "gx", "gy").limit(2)
    side = F.row_number().over(Window.orderBy("gx", "gy"))
    label = F.when(side == 1, "west").otherwise("east")
    if required:
        both = F.count("*").over(Window.partitionBy()) == 2
        label = F.when(both, label).otherwise(F.raise_error(F.lit("fewer than two occupied cells")).cast("string"))
    return top.withColumn("label", label)


#: Gear type of trawlers in effort reports. Fixed value.
TRAWLERS = "TRAWLERS"


def effort_summary(records: DataFrame) -> DataFrame:
    """One row: hours of trawlers to one decimal, of all gear, and vessels of each; empty ids don't count.

    records has gear, hours and vessel_id; without any there are 0 hours.
    """
    trawler = F.col("gear") == TRAWLERS
    vessel = F.nullif(F.col("vessel_id"), F.lit(""))
    return records.agg(
        F.round(F.coalesce(F.sum(F.when(trawler, F.col("hours"))), F.lit(0.0)), 1).alias("trawler_hours"),
        F.coalesce(F.sum("hours"), F.lit(0.0)).alias("all_hours"),
        F.countDistinct(F.when(trawler, vessel)).alias("trawlers"),
        F.countDistinct(vessel).alias("vessels"),
    )


def merge_metrics(*groups: DataFrame) -> DataFrame:
    """The union of metric tables (name, value); a name that comes twice is an error when it is read."""
    union = groups[0]
    for group in groups[1:]:
        union = union.unionByName(group)
    merged = union.groupBy("name").agg(F.min("value").alias("value"), F.count("*").alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("metric given twice: "), F.col("name"))).cast("string")).otherwise(F.col("name"))
    return merged.select(checked.alias("name"), "value")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def current_runs(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """The runs (run_id and more) that the metric table names, with its other columns."""
    return runs.join(metrics.distinct(), "run_id")


def exactly_one(df: DataFrame, what: str) -> DataFrame:
    """df's one row; none, or more, is an error when it is read."""
    two = df.limit(2)
    n = two.agg(F.count("*").alias("_n"))
    message = F.concat(F.lit(f"expected one {what}, found "), F.when(F.col("_n") == 0, "none").otherwise("several"))
    # From the side of the count, so that an empty df has a row to fail.
    checked = n.withColumn("_ok", F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).where("_ok")
    return checked.join(two.withColumn("_ok", F.lit(True)), "_ok", "left").select(*df.columns)


def at_least(df: DataFrame, n: int, what: str) -> DataFrame:
    """df, if it has n rows or more; fewer are an error when it is read, even if it is empty."""
    found = df.limit(n).agg(F.count("*").alias("_n"))
    enough = F.when(F.col("_n") >= n, F.lit(True)).otherwise(F.raise_error(F.lit(f"fewer than {n} {what}")).cast("boolean"))
    guard = found.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema), enough.alias("_ok")).where("not _ok").drop("_ok")
    return df.union(guard)


def current_run(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """The one run that the metric table names; another number of runs is an error."""
    return exactly_one(current_runs(runs, metrics.select("run_id")).distinct(), "current run")


def same_run(metrics: DataFrame, run_id: str, config_sha256: str) -> DataFrame:
    """metrics (name, value, run_id, config_sha256) as (name, value); one of another run is an error when it is read."""
    ok = F.col("run_id").eqNullSafe(F.lit(run_id)) & F.col("config_sha256").eqNullSafe(F.lit(config_sha256))
    stale = F.raise_error(F.concat(F.lit("not of the current run: "), "name")).cast("string")
    return metrics.select(F.when(ok, F.col("name")).otherwise(stale).alias("name"), "value")


def manifest_hash(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, sha256, run_id): SHA-256 of each key's texts in order, comma-joined, and the id made of it."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda s: s["t"])
    hashed = rows.groupBy(key).agg(F.sha2(F.array_join(parts, ","), 256).alias("sha256"))
    return hashed.withColumn("run_id", F.concat(F.lit("run_"), F.substring("sha256", 1, 16)))


def day_windows(start: Column, end: Column) -> Column:
    """Days that [start, end) touches, as an array of dates."""
    last = F.to_date(end - F.expr("INTERVAL 1 MICROSECOND"))
    return F.sequence(F.to_date(start), last, F.expr("INTERVAL 1 DAY"))

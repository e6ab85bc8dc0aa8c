"""Records at any depth of JSON reports, by variants: every level is one more explode of the level above.

No row leaves the JVM or is shuffled. A path through a report that is longer than ``depth`` levels is an error,
so nothing is missed. Null reports have no records; a text that is no JSON is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATASET = "public-global-fishing-effort:"
#: Levels of objects and arrays that are searched.
DEPTH = 12
#: Types of a number in a variant. Fixed values.
NUMBERS = ("BIGINT", "DOUBLE", "FLOAT")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _is_record(value: Column) -> Column:
    """An object with a number as its ``hours``."""
    hours = _kind(F.try_variant_get(value, "$.hours", "variant"))
    return _kind(value).startswith("OBJECT") & (hours.isin(*NUMBERS) | hours.startswith("DECIMAL"))


def _opened(nodes: DataFrame, inner: Column, depth: int, prefix: str | None = None) -> DataFrame:
    """nodes (v, keys) with v once for each end of its paths: what isn't ``inner`` stays as it is."""
    spark = nodes.sparkSession
    for level in range(depth + 1):
        open_ = (_kind(F.col("v")).startswith("OBJECT") | _kind(F.col("v")).startswith("ARRAY")) & inner
        if level == depth:
            deep = F.raise_error(F.lit(f"a report of more than {depth} levels")).cast("variant")
            return nodes.withColumn("v", F.when(open_, deep).otherwise(F.col("v")))
        marked = nodes.withColumn("_in", F.when(open_, F.col("v")))
        found = marked.lateralJoin(spark.tvf.variant_explode_outer(F.col("_in").outer()))
        keys = F.when(F.col("key").startswith(prefix), F.array_append("keys", F.col("key"))).otherwise(F.col("keys")) if prefix else F.col("keys")
        nodes = found.select(F.when(F.col("_in").isNull(), F.col("v")).otherwise(F.col("value")).alias("v"), keys.alias("keys"))
    raise AssertionError("unreachable")


def _reports(reports: DataFrame, column: str) -> DataFrame:
    return reports.where(F.col(column).isNotNull()).select(F.parse_json(column).alias("v"), F.array().cast("array<string>").alias("keys"))


def hour_records(reports: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """(gear, hours, vessel_id) of every object with a number as its hours; nothing below such an object is searched."""
    found = _opened(_reports(reports, column), ~_is_record(F.col("v")), depth).where(_is_record(F.col("v")))
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string").alias(name)
    return found.select(text("geartype"), F.variant_get("v", "$.hours", "double").alias("hours"), text("vesselId")).toDF("gear", "hours", "vessel_id")


def datasets(reports: DataFrame, column: str, prefix: str = DATASET, depth: int = DEPTH) -> DataFrame:
    """(dataset), the distinct keys at any depth that start with prefix."""
    found = _opened(_reports(reports, column), F.lit(True), depth, prefix)
    return found.select(F.explode("keys").alias("dataset")).distinct()

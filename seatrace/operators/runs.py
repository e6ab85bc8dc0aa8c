"""Runs: what names one, whether results are still its own, and the one metric table made of all of them.

A run is named by the hashes of its configuration, its positions, their requests, the line, the raster and the
code, so another input makes another run. Metrics are rows of dotted names and JSON values; a name that
comes twice, or a run that isn't the only one, is an error when the table is read.
"""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatrace.operators.summaries import exactly_one

#: What a run is named by, in this order, with a NUL between. Fixed values.
IDENTITY = ("config_sha256", "ais_content_sha256", "ais_source_manifest_sha256", "cable_sha256", "bathymetry_sha256", "implementation_sha256")


def config_sha256(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def implementation_sha256(folder: str) -> str:
    """Of the names and contents of a package's Python files, in order."""
    digest = hashlib.sha256()
    for path in sorted(Path(folder).rglob("*.py")):
        digest.update(f"{path.relative_to(folder).as_posix()}\0".encode() + path.read_bytes() + b"\0")
    return digest.hexdigest()


def with_run_id(run: DataFrame) -> DataFrame:
    """run (a row of the hashes of IDENTITY and more) with run_id; a hash that isn't there is an error."""
    there = [F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is missing")).cast("string")) for c in IDENTITY]
    digest = F.sha2(F.concat_ws("\0", *there), 256)
    return run.withColumn("run_id", F.concat(F.lit("run_"), F.substring(digest, 1, 16)))


def json_value(value: Column) -> Column:
    """A column as a JSON text; null as JSON has it."""
    return F.when(value.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def metric_rows(values: DataFrame, prefix: str, by: str | None = None) -> DataFrame:
    """(name, value): one row for each column of ``values``, under prefix, and under the value of ``by`` if named."""
    columns = [c for c in values.columns if c != by]
    within = F.concat(F.lit(f"{prefix}."), F.col(by).cast("string"), F.lit(".")) if by else F.lit(f"{prefix}.")
    rows = F.array(*(F.struct(F.concat(within, F.lit(c)).alias("name"), json_value(F.col(c)).alias("value")) for c in columns))
    return values.select(F.explode(rows).alias("m")).select("m.name", "m.value")


def metric_table(groups: list[DataFrame], run: DataFrame, generated_at: datetime | None = None) -> DataFrame:
    """(run_id, config_sha256, name, value, generated_at) of all groups of metrics (name, value), in order of names."""
    rows = groups[0]
    for more in groups[1:]:
        rows = rows.union(more)
    own = exactly_one(run.select("run_id", "config_sha256"), "run")
    twice = F.raise_error(F.concat(F.lit("a metric comes twice: "), "name")).cast("string")
    once = rows.groupBy("name").agg(F.count("*").alias("_n"), F.first("value").alias("value"))
    once = once.select(F.when(F.col("_n") == 1, F.col("name")).otherwise(twice).alias("name"), "value")
    at = F.lit(generated_at or datetime.now(UTC)).cast("timestamp")
    return once.join(own.hint("broadcast"), F.lit(True)).select("run_id", "config_sha256", "name", "value", at.alias("generated_at")).orderBy("name")


def stale(results: DataFrame, run: DataFrame) -> DataFrame:
    """The rows of results (run_id and more) that aren't of the one run."""
    own = exactly_one(run.select(F.col("run_id").alias("_own")), "run")
    return results.join(own.hint("broadcast"), ~F.col("run_id").eqNullSafe(F.col("_own"))).drop("_own")

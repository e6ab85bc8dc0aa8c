"""Readers of the raw inputs; files are read where Spark finds them, never by the driver."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width of a position row in the API's JSON, and what its first values are. Fixed values.
ROW_WIDTH = 12
FIELDS = (("mmsi", "long"), ("ts", "string"), ("longitude", "double"), ("latitude", "double"), ("course", "double"), ("speed", "double"), ("message_type", "short"))


def read_catches(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All columns of catch files as strings, with source_path and source_year.

    Each file is read by itself and united by name: one read of files whose headers differ would bind
    columns by position. Empty strings are null.
    """
    tables = [spark.read.csv(p, sep=";", header=True, nullValue="").withColumn("source_path", F.lit(p)) for p in paths]
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table, allowMissingColumns=True)
    year = F.regexp_extract("source_path", r"ers-(20[0-9]{2})", 1)
    return union.withColumn("source_year", F.nullif(year, F.lit("")).try_cast("int"))


def clean_catches(raw: DataFrame, names: dict[str, str], start: str) -> DataFrame:
    """names (raw column: ours) of raw, the column ``start`` as a time; days and months needn't be padded."""
    out = raw.select("source_year", *(F.col(f"`{a}`").alias(b) for a, b in names.items()))
    return out.withColumn(start, F.try_to_timestamp(start, F.lit("d.M.yyyy H:m:s")).cast("timestamp_ntz"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """One row per position of API responses ``{"success": true, "data": [[...], ...]}``.

    A response without success, a row of another width and a value that isn't a number are errors when
    they are read. Times are in UTC whatever the session's zone: one with an offset is moved there, one
    without is taken for UTC.
    """
    responses = spark.read.schema("success boolean, data array<array<string>>").json(path, multiLine=True)
    good = F.coalesce(F.col("success") & F.col("data").isNotNull(), F.lit(False))
    data = F.when(good, F.col("data")).otherwise(F.raise_error(F.lit("a response without success or data")).cast("array<array<string>>"))
    rows = responses.select(F.explode(data).alias("r"))
    width = F.when(F.size("r") == ROW_WIDTH, F.col("r")).otherwise(F.raise_error(F.lit("a position row of another width")).cast("array<string>"))
    values = [F.col("r")[k].cast(kind).alias(name) for k, (name, kind) in enumerate(FIELDS)]
    return rows.select(width.alias("r")).select(*values).withColumn("ts", utc(F.col("ts")))


def utc(text: Column) -> Column:
    """A time as text, in UTC without a zone; a text that is no time is an error."""
    zoned = text.rlike(r"(?i)[0-9](z|utc|[+-][0-9]{2}:?[0-9]{2})$")
    moved = F.to_utc_timestamp(text.cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    return F.when(zoned, moved).otherwise(text.cast("timestamp_ntz"))


def with_dataset(rows: DataFrame, dataset_id: str) -> DataFrame:
    """rows with dataset_id as their first column."""
    return rows.select(F.lit(dataset_id).alias("dataset_id"), *[c for c in rows.columns if c != "dataset_id"])


def extract_member(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(path, content) of the one member with that base name in each archive; none or several are an error.

    Archives are unpacked in tasks, one at a time.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as bundle:
                    members = [m for m in bundle.namelist() if m.rpartition("/")[2] == name]
                    if len(members) != 1:
                        raise ValueError(f"{own} must hold one {name}; found {len(members)}")
                    yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([bundle.read(members[0])], pa.binary())], ["path", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, "path string, content binary")


def select_positions(positions: DataFrame, start: str, end: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """start <= ts < end, then the world's bounds (an error beyond), then west, south, east, north inclusive."""
    time = lambda t: F.lit(t).cast("timestamp_ntz")
    inside = positions.where((F.col("ts") >= time(start)) & (F.col("ts") < time(end)))
    world = F.col("longitude").between(-180, 180) & F.col("latitude").between(-90, 90)
    checked = F.when(world, F.col("longitude")).otherwise(F.raise_error(F.lit("a position off the world")).cast("double"))
    inside = inside.withColumn("longitude", checked)
    if box is None:
        return inside
    west, south, east, north = box
    return inside.where(F.col("longitude").between(west, east) & F.col("latitude").between(south, north))


def read_notice(spark: SparkSession, path: str, number: int) -> DataFrame:
    """(seq, x, y) of the first notice with that number and two finite points; the source swaps the names of its axes.

    First means by file, then by the notice's place in it as read. No such notice is an error when the
    result is read.
    """
    point = "struct<positionPoint: struct<latitudeDecimal: double, longitudeDecimal: double>>"
    schema = f"noticeIdentifier struct<noticeNumber: int>, positions struct<position: array<{point}>>"
    notices = spark.read.format("xml").option("rowTag", "notice").schema(schema).load(path)
    finite = lambda p: (F.abs(p["latitudeDecimal"]) < float("inf")) & (F.abs(p["longitudeDecimal"]) < float("inf"))
    points = F.filter(F.coalesce("positions.position.positionPoint", F.array().cast("array<struct<latitudeDecimal:double,longitudeDecimal:double>>")), lambda p: F.coalesce(finite(p), F.lit(False)))
    own = notices.where(F.col("noticeIdentifier.noticeNumber") == number).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"), points.alias("points"))
    first = own.where(F.size("points") >= 2).agg(F.min(F.struct("file", "place", "points"))["points"].alias("points"))
    missing = F.raise_error(F.lit(f"no notice {number} with two points")).cast(first.schema["points"].dataType)
    found = first.select(F.posexplode(F.coalesce("points", missing)).alias("seq", "p"))
    return found.select("seq", F.col("p.latitudeDecimal").alias("x"), F.col("p.longitudeDecimal").alias("y"))


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def unlike_manifest(hashes: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, sha256, expected) of files (path, sha256) that a manifest (path, sha256) doesn't have so, and of missing ones."""
    wanted = manifest.select("path", F.col("sha256").alias("expected"))
    return hashes.join(wanted, "path", "full").where(~F.col("sha256").eqNullSafe(F.col("expected")))


def annual_windows(start: Column, end: Column) -> Column:
    """[start, end) cut at each first of January, as an array of structs (a, b)."""
    years = F.sequence(F.year(start), F.year(end))
    at = lambda y: F.make_date(y, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    cut = F.transform(years, lambda y: F.struct(F.greatest(start, at(y)).alias("a"), F.least(end, at(y + 1)).alias("b")))
    return F.filter(cut, lambda w: w["a"] < w["b"])

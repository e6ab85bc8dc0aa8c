"""Where data came from: requests and their manifests, summaries and content hashes of what was stored.

Edge cases: an empty table has no requests, summaries or hashes; a null is hashed as NaN, and a row without an id
or a time is an error of the hash.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUES = ("longitude", "latitude", "speed", "course")


def canonical_json(**fields: Column) -> Column:
    """A compact JSON object with sorted keys; what is null stays out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def short_id(text: Column) -> Column:
    """The first 16 hex digits of a text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def position_requests(windows: DataFrame, min_speed: float, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """windows (mmsi, a, b) with endpoint, payload and request_id of the request for each.

    A window without a vessel asks for the box (west, south, east, north); one with neither, and bounds with
    seconds, can't be asked for and are an error when the row is read.
    """
    exact = lambda c: F.col(c) == F.date_trunc("minute", c).cast("timestamp_ntz")
    stamp = lambda c: F.date_format(c, "yyyyMMddHHmm")
    start = F.when(exact("a") & exact("b"), stamp("a")).otherwise(F.raise_error(F.lit("bounds of a request are whole minutes")).cast("string"))
    asked_box = F.lit(None if box is None else ",".join(map(str, box))).cast("string")
    named = F.coalesce(F.col("mmsi").cast("string"), asked_box, F.raise_error(F.lit("a request needs a vessel or a box")).cast("string")).isNotNull()
    payload = canonical_json(mmsiIds=F.when(F.col("mmsi").isNotNull(), F.array("mmsi")), bbox=F.when(F.col("mmsi").isNull(), asked_box), start=start, end=stamp("b"), minSpeed=F.lit(float(min_speed)))
    endpoint = F.when(F.col("mmsi").isNotNull(), "ais/positions/for-mmsis-time").when(named, "ais/positions/within-bbox-time")
    asked = windows.withColumn("endpoint", endpoint).withColumn("payload", payload)
    return asked.withColumn("request_id", short_id(F.concat(F.lit('{"endpoint":"'), "endpoint", F.lit('","payload":'), "payload", F.lit("}"))))


def manifest_rows(requests: DataFrame, dataset_id: str) -> DataFrame:
    """(dataset_id, acquisition_id, request_id, payload): the acquisition is named by all its requests in order."""
    own = requests.select("request_id", "payload").distinct()
    ids = own.agg(F.array_join(F.array_sort(F.collect_list("request_id")), ",").alias("ids"))  # 16 letters a request
    return own.crossJoin(ids).select(F.lit(dataset_id).alias("dataset_id"), short_id(F.col("ids")).alias("acquisition_id"), "request_id", "payload")


def ingest_summary(rows: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """(dataset, positions, vessels, first, last) of positions with mmsi and ts."""
    return rows.groupBy(dataset).agg(F.count("*").alias("positions"), F.count_distinct("mmsi").alias("vessels"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def content_hashes(positions: DataFrame, prefix: bytes) -> DataFrame:
    """(mmsi, sha256) of each vessel's positions in order of time: big-endian microseconds, then VALUES as doubles.

    A hash in order can't be combined from parts, but it needs no memory: partitions are sorted and every
    vessel's rows run through it as they come.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mmsi, digest, done = None, None, []
        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != mmsi:
                    done += [(mmsi, digest.hexdigest())] if digest else []
                    mmsi, digest = own, hashlib.sha256(prefix + struct.pack(">q", own))
                digest.update(struct.pack(">q4d", row[0], *(float("nan") if v is None else v for v in row[1:])))
        done += [(mmsi, digest.hexdigest())] if digest else []
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in ((0, pa.int64()), (1, pa.string()))], ["mmsi", "sha256"])

    rows = positions.select(F.col("mmsi").cast("long"), F.col("us").cast("long"), *(F.col(c).cast("double") for c in VALUES))
    return rows.repartition("mmsi").sortWithinPartitions("mmsi", "us", *VALUES).mapInArrow(hashed, "mmsi long, sha256 string")


def raster_report(cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """One row: whether the cells (row, col, elevation) are a whole raster of that size, its range and a hash.

    The hash is that of the SHA-256s of the raster's rows, each of its elevations in order.
    """
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "elevation"))), lambda s: s["elevation"].cast("string")), ",")
    lines = cells.groupBy("row").agg(F.sha2(line, 256).alias("h"), F.count("*").alias("n"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("elevation").alias("least"), F.max("elevation").alias("most"))
    whole = (F.count("*") == rows) & (F.min("row") == 0) & (F.max("row") == rows - 1) & F.bool_and((F.col("n") == columns) & (F.col("c0") == 0) & (F.col("c1") == columns - 1))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "h"))), lambda s: s["h"]), ","), 256)
    return lines.agg(F.coalesce(whole, F.lit(False)).alias("complete"), F.min("least").alias("least"), F.max("most").alias("greatest"), digest.alias("sha256"))


def checked_ids(df: DataFrame, column: str) -> DataFrame:
    """df, whose ids are letters, digits and underscores only; another id is an error when it is read."""
    bad = F.raise_error(F.concat(F.lit("not an id: "), F.coalesce(column, F.lit("null")))).cast("string")
    return df.withColumn(column, F.when(F.col(column).rlike(r"^_*[\p{L}\p{N}][\p{L}\p{N}_]*$"), F.col(column)).otherwise(bad))

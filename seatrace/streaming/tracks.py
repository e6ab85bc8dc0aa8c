"""Position reports as a stream: late reports up to a watermark, one report per vessel and time, hourly counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_reports(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(mmsi, hour, reports) of reports (mmsi, ts timestamp), each (mmsi, ts) counted once within the watermark."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["mmsi", "ts"])
    counted = once.groupBy("mmsi", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("reports"))
    return counted.select("mmsi", F.col("w.start").alias("hour"), "reports")

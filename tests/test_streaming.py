from seatrace.streaming.tracks import hourly_reports


def test_hourly_reports(spark, tmp_path):
    data = spark.sql("SELECT * FROM VALUES (1L, timestamp'2022-01-07 03:05:00'), (1L, timestamp'2022-01-07 03:05:00'), (1L, timestamp'2022-01-07 03:50:00'), (2L, timestamp'2022-01-07 04:00:00') AS t(mmsi, ts)")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    query = hourly_reports(stream).writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["mmsi"], r["reports"]) for r in spark.table("hourly").collect()) == [(1, 2), (2, 1)]

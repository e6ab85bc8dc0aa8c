import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from seatrace.sources import readers, sinks


def test_catch_files_with_other_headers_unite_by_name(spark, tmp_path):
    (tmp_path / "ers-2020.csv").write_text("Start;B\n7.1.2022 03:05:00;x\nnever;\n")
    (tmp_path / "ers-2021.csv").write_text("B;Start;C\ny;07.01.2022 3:5:0;z\n")
    raw = readers.read_catches(spark, [str(tmp_path / f"ers-202{k}.csv") for k in (0, 1)])
    got = sorted((r["source_year"], str(r["start"]), r["b"]) for r in readers.clean_catches(raw, {"Start": "start", "B": "b"}, "start").collect() if r["b"])
    assert got == [(2020, "2022-01-07 03:05:00", "x"), (2021, "2022-01-07 03:05:00", "y")]
    assert raw.where("source_year = 2020 and B is null").count() == 1


def position(ts, lon=9.0, lat=78.0):
    return [257, ts, lon, lat, None, 3.5, 1, 0, 0, 0, 0, 0]


def test_positions(spark, tmp_path):
    data = [position("2022-01-07T03:00:00Z"), position("2022-01-07T05:00:00+01:00"), position("2022-01-08T00:00:00Z"), position("2022-01-07T04:00:00Z", lon=50.0)]
    (tmp_path / "a.json").write_text(json.dumps({"success": True, "data": data}))
    rows = readers.read_positions(spark, str(tmp_path / "a.json"))
    inside = readers.select_positions(rows, "2022-01-07", "2022-01-08", (6, 76, 12, 79))
    assert sorted(str(r["ts"]) for r in inside.collect()) == ["2022-01-07 03:00:00", "2022-01-07 04:00:00"]
    (tmp_path / "b.json").write_text(json.dumps({"success": True, "data": [[1, 2]]}))
    with pytest.raises(Exception, match="another width"):
        readers.read_positions(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "c.json").write_text(json.dumps({"success": True, "data": [position("2022-01-07T03:00:00Z", lat=91.0)]}))
    with pytest.raises(Exception, match="off the world"):
        readers.select_positions(readers.read_positions(spark, str(tmp_path / "c.json")), "2022-01-07", "2022-01-08").collect()


def test_notice_and_hash(spark, tmp_path):
    points = "".join(f"<position><positionPoint><latitudeDecimal>{x}</latitudeDecimal><longitudeDecimal>{y}</longitudeDecimal></positionPoint></position>" for x, y in ((9.1, 78.1), (9.2, 78.2)))
    xml = f"<notices><notice><noticeIdentifier><noticeNumber>5</noticeNumber></noticeIdentifier><positions>{points}</positions></notice></notices>"
    (tmp_path / "n.xml").write_text(xml)
    assert [tuple(r) for r in readers.read_notice(spark, str(tmp_path / "n.xml"), 5).orderBy("seq").collect()] == [(0, 9.1, 78.1), (1, 9.2, 78.2)]
    with pytest.raises(Exception, match="no notice 6"):  # none is an error, as is one with a single point
        readers.read_notice(spark, str(tmp_path / "n.xml"), 6).collect()
    other = xml.replace("9.1", "1.5").replace("<notices>", "").replace("</notices>", "")
    (tmp_path / "two.xml").write_text(xml.replace("</notices>", other + "</notices>"))
    assert [tuple(r) for r in readers.read_notice(spark, str(tmp_path / "two.xml"), 5).orderBy("seq").collect()] == [(0, 9.1, 78.1), (1, 9.2, 78.2)]
    assert readers.content_hash(spark, str(tmp_path / "n.xml")).first()["sha256"] == hashlib.sha256(xml.encode()).hexdigest()


def test_times_do_not_depend_on_the_session_zone(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"success": True, "data": [position(t) for t in ("2022-01-07T03:00:00Z", "2022-01-07T05:30:00+01:00", "2022-01-07T06:00:00")]}))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sorted(str(r["ts"]) for r in readers.read_positions(spark, str(tmp_path / "a.json")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2022-01-07 03:00:00", "2022-01-07 04:30:00", "2022-01-07 06:00:00"]


def test_archives_manifests_and_dataset(spark, tmp_path):
    for name, members in (("a", {"x/r.csv": "1"}), ("b", {"r.csv": "2", "o.csv": "3"}), ("c", {"p/r.csv": "4", "q/r.csv": "5"})):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as bundle:
            for member, text in members.items():
                bundle.writestr(member, text)
    got = readers.extract_member(spark, str(tmp_path / "[ab].zip"), "r.csv").collect()
    assert sorted(bytes(r["content"]) for r in got) == [b"1", b"2"]
    with pytest.raises(Exception, match="must hold one"):
        readers.extract_member(spark, str(tmp_path / "c.zip"), "r.csv").collect()
    hashes = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, sha256 string")
    manifest = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3")], "path string, sha256 string")
    assert sorted(r["path"] for r in readers.unlike_manifest(hashes, manifest).collect()) == ["b", "c", "d"]
    assert readers.with_dataset(hashes, "x").columns == ["dataset_id", "path", "sha256"]


def test_documents(spark, tmp_path):
    facts = {c: c[:3] for c in sinks.PROVENANCE} | {"run_id": "run_1", "config_sha256": "c1"}
    run = spark.createDataFrame([(*facts.values(), '{"b": [1, 2]}', "n")], ", ".join(f"{c} string" for c in (*facts, "effective_config_json", "note")))
    metrics = spark.createDataFrame([("a.b", "1.5", "run_1", "c1"), ("a.c", "null", "run_1", "c1")], "name string, value string, run_id string, config_sha256 string")
    matrix = spark.createDataFrame([(2.5, "x"), (2.0, "y")], "ratio double, cells string")
    document = sinks.publication_document(run, metrics, matrix)
    assert document["metrics"] == {"a": {"b": 1.5, "c": None}} and [r["ratio"] for r in document["result_matrix"]] == [2.0, 2.5]
    assert document["provenance"] == facts and document["config"] == {"b": [1, 2]}
    for lost in (run.drop("cable_sha256"), run.withColumn("bathymetry_sha256", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="doesn't say its"):
            sinks.publication_document(lost, metrics, matrix)
    with pytest.raises(Exception, match="not of the current run: a.b"):
        sinks.publication_document(run, metrics.withColumn("config_sha256", F.lit("c2")).where("name = 'a.b'"), matrix)
    for bad in (run.union(run.withColumn("run_id", F.lit("run_2"))), run.where("false")):
        with pytest.raises(Exception, match="expected one run"):
            sinks.publication_document(bad, metrics, matrix)
    with pytest.raises(ValueError, match="missing"):
        sinks.publication_document(run, metrics.where("false"), matrix)
    crossings = spark.createDataFrame([("G1", "b", 2.0, 1.0005, 2.0015, True), ("G1", "a", 2.0, 1.0, 2.0, True), ("G0", "a", 3.0, 1.0, 2.0, False)], "scenario_id string, component string, t double, cx double, cy double, inside boolean")
    frames = spark.createDataFrame([("a", 1.0, 0.12345, 2.0)], "component string, t double, x double, y double")
    replay = sinks.playback_document(document, "run_1", crossings, frames)
    assert [(r["component"], r["x"], r["y"]) for r in replay["failure_interval_crossings"]] == [("a", 1.0, 2.0), ("b", 1.0, 2.002)]
    assert replay["replay"] == [{"component": "a", "t": 1.0, "x": 0.123, "y": 2.0}]
    with pytest.raises(ValueError):
        sinks.playback_document(document, "run_2", crossings, frames)
    for n in (1, 2):
        sinks.write_report(spark, {"n": n}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 2} and not (tmp_path / "r.json.part").exists()


def test_tables(spark):
    with pytest.raises(ValueError, match="missing"):
        sinks.require_table(spark, "no_such_table")
    try:
        for _ in range(2):
            sinks.ensure_tables(spark, {"core_runs": "run_id string, n int"})
        assert sinks.require_table(spark, "core_runs").columns == ["run_id", "n"]
        with pytest.raises(ValueError):
            sinks.ensure_tables(spark, {"core_runs": "run_id string"})
    finally:
        spark.sql("DROP TABLE IF EXISTS core_runs")


def test_annual_windows(spark):
    ends = spark.sql("SELECT timestamp_ntz'2012-01-01' AS a, timestamp_ntz'2022-01-07 03:10:00' AS b")
    windows = ends.select(readers.annual_windows(F.col("a"), F.col("b")).alias("w")).first()["w"]
    assert len(windows) == 11 and str(windows[-1]["b"]) == "2022-01-07 03:10:00" and str(windows[0]["b"]) == "2013-01-01 00:00:00"


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    table = lambda rows: spark.createDataFrame(rows, "dataset_id string, v int")
    sinks.replace_dataset(table([("a", 1), ("b", 2)]), path)
    sinks.replace_dataset(table([("a", 3)]), path)
    assert sorted((r["dataset_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]
    other = str(tmp_path / "u")
    for _ in range(2):
        sinks.insert_absent(table([("a", 1), ("a", 9)]).limit(1), other, ["dataset_id"])
    sinks.insert_absent(table([("a", 5), ("c", 5)]), other, ["dataset_id"])
    assert sorted(r["dataset_id"] for r in spark.read.parquet(other).collect()) == ["a", "c"]
    for run in ("run_1", "run_2"):
        sinks.publish(spark, {"m": spark.createDataFrame([(run, 1)], "run_id string, v int")}, str(tmp_path / "p"), run)
    assert [r["run_id"] for r in sinks.published(spark, str(tmp_path / "p"), "m").collect()] == ["run_2"]
    assert json.loads(sinks.report_json({"a.b": 1, "a.c": None})) == {"a": {"b": 1, "c": None}}
    with pytest.raises(ValueError):
        sinks.report_json({"a": 1, "a.b": 2})
    with pytest.raises(ValueError):
        sinks.require_columns(table([]), ["v"])

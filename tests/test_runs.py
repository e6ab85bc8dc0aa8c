"""Identity of runs and their metric table."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from seatrace.operators import runs


def run_of(spark, **changed):
    facts = {c: f"{k:064x}" for k, c in enumerate(runs.IDENTITY)} | changed
    return spark.createDataFrame([tuple(facts.values())], ", ".join(f"{c} string" for c in facts))


def test_a_run_is_named_by_all_its_inputs(spark):
    row = runs.with_run_id(run_of(spark)).first()
    assert row["run_id"] == "run_" + hashlib.sha256("\0".join(row[c] for c in runs.IDENTITY).encode()).hexdigest()[:16]
    assert len({runs.with_run_id(run_of(spark, **{c: "x"})).first()["run_id"] for c in runs.IDENTITY} | {row["run_id"]}) == 7
    with pytest.raises(Exception, match="cable_sha256 is missing"):
        runs.with_run_id(run_of(spark, cable_sha256=None)).collect()


def test_hashes_of_configurations_and_code(tmp_path):
    assert runs.config_sha256({"b": 1, "a": [2.5]}) == hashlib.sha256(b'{"a":[2.5],"b":1}').hexdigest()
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.py").write_text("x = 1")
    first = runs.implementation_sha256(str(tmp_path))
    (tmp_path / "p" / "note.txt").write_text("x")
    assert runs.implementation_sha256(str(tmp_path)) == first
    (tmp_path / "p" / "a.py").rename(tmp_path / "p" / "b.py")
    assert runs.implementation_sha256(str(tmp_path)) != first


def test_metric_table(spark):
    run = runs.with_run_id(run_of(spark))
    values = spark.createDataFrame([(1, 2.5, None, "a \"b\"", [1, 2], True)], "n int, x double, none string, text string, list array<int>, yes boolean")
    parts = spark.createDataFrame([("port", 3), ("clump", 4)], "part string, crossings long")
    table = runs.metric_table([runs.metric_rows(values, "m"), runs.metric_rows(parts, "m.by", by="part")], run)
    rows = table.collect()
    assert [r["name"] for r in rows] == sorted(r["name"] for r in rows) and {r["run_id"] for r in rows} == {run.first()["run_id"]} and all(r["generated_at"] for r in rows)
    assert {r["name"]: json.loads(r["value"]) for r in rows} == {"m.n": 1, "m.x": 2.5, "m.none": None, "m.text": 'a "b"', "m.list": [1, 2], "m.yes": True, "m.by.port.crossings": 3, "m.by.clump.crossings": 4}
    with pytest.raises(Exception, match="a metric comes twice: m\\."):
        runs.metric_table([runs.metric_rows(values, "m")] * 2, run).collect()
    for bad in (run.union(run), run.where("false")):
        with pytest.raises(Exception, match="expected one run"):
            runs.metric_table([runs.metric_rows(values, "m")], bad).collect()
    results = table.select("run_id", "name").union(spark.createDataFrame([("run_old", "z"), (None, "y")], "run_id string, name string"))
    assert {r["name"] for r in runs.stale(results, run).collect()} == {"z", "y"} and runs.stale(table, run).count() == 0
    assert runs.metric_table([runs.metric_rows(values.where(F.lit(False)), "m")], run).count() == 0

"""Writers: replacing one dataset's rows, inserting what is absent, and publishing tables together."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatrace.operators.summaries import exactly_one, same_run

POINTER = "CURRENT"  # names that begin with _ are hidden from readers


def replace_dataset(df: DataFrame, path: str, key: str = "dataset_id") -> None:
    """Replace the partitions of key that df has and leave others as they are, so a reload can be repeated."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def insert_absent(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table at path doesn't have; repeats within df count once."""
    new = df.dropDuplicates(keys)
    if _exists(df.sparkSession, path):
        new = new.join(df.sparkSession.read.parquet(path).select(*keys), keys, "left_anti").select(*df.columns)
    new.write.mode("append").parquet(path)


def require_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    if set(df.columns) != set(expected):
        raise ValueError(f"columns are {sorted(df.columns)}, not {sorted(expected)}")
    return df


def require_table(spark: SparkSession, name: str) -> DataFrame:
    if not spark.catalog.tableExists(name):
        raise ValueError(f"table {name} is missing")
    return spark.table(name)


def ensure_tables(spark: SparkSession, schemas: dict[str, str]) -> None:
    """Make the tables that don't exist; one that does must have the columns of its schema."""
    for name, schema in schemas.items():
        if spark.catalog.tableExists(name):
            require_columns(spark.table(name), spark.createDataFrame([], schema).columns)
        else:
            spark.createDataFrame([], schema).write.saveAsTable(name)


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Write all tables of a run, then name it in one pointer file, so a reader never sees tables of two runs.

    The pointer is replaced by one rename over it, so there is always one.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{run_id}/{name}")
    write_text(spark, f"{root}/{POINTER}", run_id)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all: beside its place first, then renamed over what is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    fs, at = _file_system(spark, path)
    part = at(f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = hadoop.fs.Options.Rename.OVERWRITE
    hadoop.fs.FileContext.getFileContext(part.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, at(path), rename)


def write_report(spark: SparkSession, document: dict, path: str) -> None:
    write_text(spark, path, json.dumps(document, indent=2, sort_keys=True) + "\n")


#: Rows of a table that a document may hold; the driver makes documents.
DOCUMENT_ROWS = 100_000


def _small(df: DataFrame, what: str) -> list[dict]:
    rows = df.limit(DOCUMENT_ROWS + 1).collect()
    if len(rows) > DOCUMENT_ROWS:
        raise ValueError(f"a document holds {DOCUMENT_ROWS} {what} at most")
    return [r.asDict(recursive=True) for r in rows]


#: What a published run must say of itself. Fixed values.
PROVENANCE = ("run_id", "config_sha256", "implementation_sha256", "ais_acquisition_id", "ais_content_sha256", "ais_source_manifest_sha256", "cable_sha256", "bathymetry_sha256")


def publication_document(run: DataFrame, metrics: DataFrame, matrix: DataFrame) -> dict:
    """provenance, config, metrics (nested by their dotted names) and result matrix of one run.

    run is one row with PROVENANCE and effective_config_json; metrics has name, value (JSON), run_id and
    config_sha256, all of that run; matrix has ratio and cells.
    """
    own = _small(exactly_one(run, "run"), "runs")[0]
    if missing := [c for c in (*PROVENANCE, "effective_config_json") if own.get(c) is None]:
        raise ValueError(f"the run doesn't say its {', '.join(missing)}")
    values = _small(same_run(metrics, own["run_id"], own["config_sha256"]), "metrics")
    if not values:
        raise ValueError("metrics are missing")
    return {
        "provenance": {k: own[k] for k in PROVENANCE},
        "config": json.loads(own["effective_config_json"]),
        "metrics": nested({m["name"]: json.loads(m["value"]) for m in values}),
        "result_matrix": sorted(_small(matrix, "rows of the matrix"), key=lambda r: r["ratio"]),
    }


def playback_document(published: dict, run_id: str, crossings: DataFrame, frames: DataFrame) -> dict:
    """Crossings within the failure's interval and the frames to replay, coordinates to the millimetre, half to even.

    crossings has scenario_id, component, t, cx, cy and inside; frames has component, t, x and y. The run must
    be the published one.
    """
    if published["provenance"]["run_id"] != run_id:
        raise ValueError("the replay is not of the published run")
    inside = crossings.where("inside").select("scenario_id", "component", "t", F.bround("cx", 3).alias("x"), F.bround("cy", 3).alias("y"))
    places = frames.select("component", "t", F.bround("x", 3).alias("x"), F.bround("y", 3).alias("y"))
    by = lambda *keys: lambda r: tuple(r[k] for k in keys)
    return {
        "provenance": {"run_id": run_id},
        "failure_interval_crossings": sorted(_small(inside, "crossings"), key=by("scenario_id", "t", "component")),
        "replay": sorted(_small(places, "frames"), key=by("component", "t")),
    }


def published(spark: SparkSession, root: str, table: str) -> DataFrame:
    run_id = spark.read.text(f"{root}/{POINTER}").first()[0]
    return spark.read.parquet(f"{root}/{run_id}/{table}").where(F.col("run_id") == run_id)


def nested(metrics: dict[str, object]) -> dict:
    """Dotted names as nested objects; a name that is also a prefix is an error."""
    root: dict = {}
    for name, value in metrics.items():
        *above, last = name.split(".")
        at = root
        for part in above:
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                raise ValueError(f"{name} is below a value")
        if last in at:
            raise ValueError(f"{name} comes twice")
        at[last] = value
    return root


def report_json(metrics: dict[str, object]) -> str:
    """Dotted names as nested objects, keys sorted."""
    return json.dumps(nested(metrics), indent=2, sort_keys=True) + "\n"


def _file_system(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, root: str) -> bool:
    fs, path = _file_system(spark, root)
    return fs.exists(path(root))

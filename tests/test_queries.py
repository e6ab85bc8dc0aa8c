from datetime import datetime, timedelta

import pytest

from seatrace.plans.queries import ORACLE_SQL, QUERIES
from tests.compare import SMALL, assert_same

@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SMALL), SMALL, ORACLE_SQL[name])


def test_every_query_without_sql_has_a_test_of_its_own():
    assert set(QUERIES) - set(ORACLE_SQL) == {"smooth_track", "smooth_window", "mask_components", "stitched_line", "content_hashes", "spatial_validation"}


@pytest.mark.parametrize("name", ["crossing_counts", "crossing_summary", "clipped_crossings"])
def test_tracks_with_a_report_on_the_cable(spark, tmp_path, name):
    """A report at a vertex of the cable, met by two steps and two segments, is one crossing however many tasks there are."""
    start = datetime(2024, 1, 9, 20)
    rows = [(21 * v + k, start + timedelta(hours=10 * n, seconds=v), v, value) for v in range(60) for n, (k, value) in enumerate([(6, 173.68), (10, 26.32), (19, 83.49)])]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    (tmp_path / "nation.parquet").symlink_to(f"{SMALL}/nation.parquet")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert_same(QUERIES[name](spark, str(tmp_path)), str(tmp_path), ORACLE_SQL[name])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)

"""Scratch tables: written once, read back, and removed."""

import os

import pytest

from seatrace.llm import common


def test_scratch_tables_are_removed(spark):
    kept, gone = (common.scratch(spark.range(k), "t") for k in (5, 7))
    folders = [os.path.dirname(df.inputFiles()[0].removeprefix("file://")) for df in (kept, gone)]
    assert kept.count() == 5 and gone.count() == 7 and folders[0] != folders[1]
    common.discard(gone)
    assert os.path.exists(folders[0]) and not os.path.exists(folders[1])
    with pytest.raises(ValueError, match="no scratch table"):
        common.discard(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))
    common.clear_scratch(spark)
    assert not os.path.exists(os.path.dirname(folders[0]))
    again = common.scratch(spark.range(3), "t")
    assert again.count() == 3

"""Tables of narrow rows are dealt out before texts are made of them, and what is made is never sent whole to all tasks."""

import pytest

from quillsift.operators import fuse
from quillsift.plans import catalog
from quillsift.sources import tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("customers"))
    spark.range(9000).selectExpr("id + 1 AS c_custkey").coalesce(1).write.parquet(f"{path}/customer.parquet")
    return path


def test_profiles_are_dealt_out(spark, folder):
    assert tables.profiles(spark, folder).rdd.getNumPartitions() == 4  # one file of one row group was one task
    assert tables.spread(spark.range(20_001).toDF("k"), "k").rdd.getNumPartitions() == 6
    assert tables.spread(spark.range(0).toDF("k"), "k").rdd.getNumPartitions() == 1
    assert sorted(r.k for r in tables.spread(spark.range(3000).toDF("k"), "k").collect()) == list(range(3000))


@pytest.mark.parametrize("name", ["ocr_detections", "visual_detections", "masked_pixels", "align_exact", "align_spans", "all_detections", "redact_tagged"])
def test_no_broadcast_of_what_is_made(spark, folder, name):
    plan = catalog.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_small_frames_need_no_grids(monkeypatch):
    """Most frames hold a few detections; a grid for each took most of the fold's time."""

    def grids():
        raise AssertionError("a grid for few detections")

    monkeypatch.setattr(fuse, "_Near", grids)
    boxes = [[10.0 * (k % 4), 0.0, 10.0 * (k % 4) + 8, 12.0] for k in range(fuse.FEW)]
    out = fuse.fold([("pan", ("rule", "visual")[k % 2], 0.98, b) for k, b in enumerate(boxes)])
    assert [r[-1] for r in out] == [4, 4, 4, 4] and all(r[2] == 0.98 for r in out)

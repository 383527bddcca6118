"""Where lineage is cut."""

import pytest

from answerloom import cut_lineage
from answerloom.session import checkpoint_dir, work_folder


def test_checkpoints_go_to_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert named in checkpoint_dir(spark)
    df = spark.range(10).selectExpr("id * 2 AS x")
    cut = cut_lineage(df)
    assert sorted(r.x for r in cut.collect()) == list(range(0, 20, 2))
    assert "Range" not in cut._jdf.queryExecution().executedPlan().toString()


def test_work_folders_are_new(spark):
    a, b = work_folder(spark), work_folder(spark)
    assert a != b and a.startswith(checkpoint_dir(spark))
    with pytest.raises(Exception):
        spark.read.parquet(a).count()

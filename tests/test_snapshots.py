"""Updates of a stored knowledge base."""

import os
from pathlib import Path

import pytest

from answerloom.operators import knowledge
from answerloom.sources import files, snapshots

ROW = "category string, section string, key string, entry string, source string, added bigint, seq bigint"


def rows(spark, given):
    return spark.createDataFrame([(c, s, k, f"{k}@{a}", "t", a, q) for c, s, k, a, q in given], ROW)


def state(df):
    return sorted((r.category, r.section, r.key, r.entry, r.versions) for r in df.collect())


def parts(path):
    return {p: (os.stat(p).st_mtime_ns, os.stat(p).st_size) for p in sorted(map(str, Path(path, "data").rglob("*.parquet")))}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "kb")
    assert snapshots.read_snapshot(spark, path).count() == 0 and snapshots.versions(spark, path) == []
    first = rows(spark, [("design_patterns", f"s{i}", "k", 1, i) for i in range(40)] + [("unknown", "s", "k", 1, 99)])
    assert snapshots.update_snapshot(first, path, buckets=16) == 0
    before, old = parts(path), state(snapshots.read_snapshot(spark, path))
    assert len(old) == 40 and {r[0] for r in old} == {"design_patterns"}
    again = rows(spark, [("design_patterns", "s3", "k", 5, 200), ("design_patterns", "s3", "new", 5, 201), ("design_patterns", "s3", "k", 0, 202)])
    assert snapshots.update_snapshot(again, path, buckets=16) == 1
    after = parts(path)
    assert all(after[p] == s for p, s in before.items()) and 1 <= len(after) - len(before) <= 2
    now = state(snapshots.read_snapshot(spark, path))
    assert state(snapshots.read_snapshot(spark, path, 0)) == old  # earlier readers keep what they had
    want = [r for r in old if r[1] != "s3"] + [("design_patterns", "s3", "k", "k@5", 3), ("design_patterns", "s3", "new", "new@5", 1)]
    assert now == sorted(want)
    kept = set(snapshots._listed(spark, path, 0).items()) & set(snapshots._listed(spark, path, 1).items())
    assert len(kept) == len(snapshots._listed(spark, path, 0)) - 1


def test_snapshots_equal_one_upsert(spark, tmp_path):
    import random

    draw = random.Random(3)
    given = [(draw.choice(["design_patterns", "cost_benchmarks", "else"]), draw.choice("ab"), draw.choice("xyz"), draw.randrange(5), i) for i in range(90)]
    known = spark.createDataFrame([("design_patterns",), ("cost_benchmarks",)], "category string")
    for a in range(0, 90, 30):
        snapshots.update_snapshot(rows(spark, given[a : a + 30]), str(tmp_path / "kb"), known, buckets=4)
    at_once = knowledge.upsert(rows(spark, given).limit(0), rows(spark, given), known)
    assert state(snapshots.read_snapshot(spark, str(tmp_path / "kb"))) == state(at_once)
    assert {r.category for r in knowledge.rejected(rows(spark, given), known).collect()} == {"else"}


def test_a_slower_update_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kb")
    snapshots.update_snapshot(rows(spark, [("design_patterns", "s", "k", 1, 1)]), path)
    old = snapshots.versions
    monkeypatch.setattr(snapshots, "versions", lambda s, p: [v for v in old(s, p) if v < 0])
    with pytest.raises(RuntimeError, match="another update"):
        snapshots.update_snapshot(rows(spark, [("design_patterns", "s", "k", 2, 2)]), path)
    monkeypatch.undo()
    assert state(snapshots.read_snapshot(spark, path)) == [("design_patterns", "s", "k", "k@1", 1)]


def test_line_numbers_move_no_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"prompt":"p{i}"}}\n' for i in range(3000)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = files.read_prompts_json(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = {r.prompt: r.id for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[1])
    assert got == {f"p{i}": f"q_{i + 1:04d}" for i in range(3000)}
    # Exchanges carry the table of blocks alone: none of them has a line's text.
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_work_folders_lie_in_one_that_is_deleted(spark):
    from answerloom.session import work_folder

    a, b = work_folder(spark), work_folder(spark)
    assert os.path.dirname(a) == os.path.dirname(b) and os.path.basename(os.path.dirname(a)).startswith("work-")

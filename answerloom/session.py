"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "answerloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; a cluster's own master, memory and shuffle settings are left alone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, read from the session.

    Only a session that runs inside the driver (a test) gets a folder of its own where it is unset.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="answerloom-checkpoint-")
            sc.setCheckpointDir(named)
            deleted_at_exit(spark, named)
        else:
            sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: The folder of each application that holds its work folders.
_WORK: dict[str, str] = {}


def deleted_at_exit(spark: SparkSession, folder: str) -> None:
    """Have an existing folder removed with all that is in it when the application ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def work_folder(spark: SparkSession) -> str:
    """A new folder name beside the checkpoints, for tables a run writes and reads back; removed when the application ends."""
    name = spark.sparkContext.applicationId
    if name not in _WORK:
        root = f"{checkpoint_dir(spark)}/work-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        deleted_at_exit(spark, root)
        _WORK[name] = root
    return f"{_WORK[name]}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()

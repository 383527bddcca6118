"""What the operators share on the Spark side: inputs, intermediate tables, shards of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.session import work_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new folder beside the checkpoints and go on from there.

    The folder is shared by all executors, so a lost one costs no recomputation; it is removed
    when the application ends.
    """
    spark = df.sparkSession
    folder = work_folder(spark)
    df.write.parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def partitions(spark: SparkSession) -> int:
    """The cluster's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(df: DataFrame, least: int) -> int:
    """Number of pieces to cut ``df`` into: ``least``, or more if a piece would then hold over ``spark.answerloom.pieceBytes`` (16 MB) of input.

    The input's size is what Spark's planner knows of the files and tables that ``df`` reads; no job is started.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.length())]
    piece = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(df.sparkSession.conf.get("spark.answerloom.pieceBytes", "16m"))
    known = sum(size for size in sizes if size < 1 << 60)  # rows of unknown size count as so many bytes
    return max(least, -(-known // piece))


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` in ``n`` partitions by ``keys`` if that is more than the shuffle width, so that a partition of a hash join stays bounded."""
    return df.repartition(n, *keys) if n > partitions(df.sparkSession) else df


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def rest(columns: Sequence[str]) -> list[Column]:
    """Columns that an operator carries along, in a struct so that no name clashes; none: nothing."""
    return [F.struct(*columns).alias("rest")] if columns else []


def in_shards(docs: DataFrame, doc_id: str, text: str, shards: int, carry: Sequence[str] = ()) -> DataFrame:
    """(shard, doc_id, text) and ``rest`` of the documents that have an id. Called twice with the same arguments it is one exchange in a plan."""
    return docs.filter(F.col(doc_id).isNotNull()).select(
        F.pmod(F.xxhash64(F.col(doc_id)), F.lit(shards)).cast("int").alias("shard"),
        F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), *rest(carry),
    )

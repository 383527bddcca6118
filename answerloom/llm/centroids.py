"""Centroid clustering of integer vectors: distances are gathered from tables of squared differences and summed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.tables import stored

#: Vectors whose distances are held together: so many rows by centroids stay in a core's cache.
ROWS = 4096
#: Components beyond this would let a squared distance leave 64 bits.
LIMIT = 1 << 27


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of exactly ``dims`` finite components as integers floor(scale * x)."""
    finite = F.forall(embedding, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) <= LIMIT, F.floor(y)).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}")).cast("long"))

    kept = vectors.filter((F.size(embedding) == dims) & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, whole).alias("v"))


def lookup_table(column: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one dimension: each row's place in the table, and the squared differences of every value that occurs to every centroid."""
    low, span = int(column.min()), int(column.max()) - int(column.min()) + 1
    if span <= 8 * ROWS:
        occurs = np.zeros(span, bool)
        occurs[column - low] = True
        values, place = np.flatnonzero(occurs) + low, (np.cumsum(occurs) - 1)[column - low]
    else:
        values, place = np.unique(column, return_inverse=True)
    return place, (values[:, None] - centroids[None, :]) ** 2


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (of equal ones the first) and the squared distance to it."""
    cluster, distance = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
    for a in range(0, len(vectors), ROWS):
        part = vectors[a : a + ROWS]
        total = np.zeros((len(part), len(centroids)), np.int64)
        for d in range(part.shape[1]):
            place, table = lookup_table(part[:, d], centroids[:, d])
            total += table[place]
        cluster[a : a + ROWS] = total.argmin(1)
        distance[a : a + ROWS] = total.min(1)
    return cluster, distance


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(-1, dims)


def _cluster_sums(centroids: np.ndarray):
    """A partition's vectors to the number and the componentwise sum of each cluster's."""
    k, dims = centroids.shape
    names = ["cluster", "n", *[f"s{d}" for d in range(dims)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            vectors = _rows(batch, dims)
            cluster, _ = nearest(vectors, centroids)
            order = np.argsort(cluster, kind="stable")
            here, begin = np.unique(cluster[order], return_index=True)
            if len(here):
                total[here] += np.add.reduceat(vectors[order], begin)
                count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, count[some], *total[some].T)], names)

    return run, ", ".join(f"{name} long" for name in names)


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_rows(batch, centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def moved(centroids: np.ndarray, vectors: DataFrame) -> np.ndarray:
    """Every centroid with vectors becomes their exact mean, rounded down; the others stay. One row a cluster comes to the driver."""
    run, schema = _cluster_sums(centroids)
    sums = vectors.mapInArrow(run, schema).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{d}").alias(f"s{d}") for d in range(centroids.shape[1])])
    out = centroids.copy()
    for cluster, n, *total in sums.collect():
        out[cluster] = [s // n for s in total]
    return out


def cluster_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: int = 2
) -> DataFrame:
    """One row per vector that counts: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    A vector counts if it has exactly ``dims`` components, none null, NaN or infinite; component x becomes
    floor(scale * x). Centroids start as the ``k`` vectors with the smallest hash of ``seed:vec_id``. In each round every
    vector goes to the nearest centroid (squared distance; ties: the smaller number), and centroids with vectors move to
    their mean, rounded down. Distances are whole numbers: a task tabulates, for each dimension, the squared
    difference of each value that occurs in a slice to each centroid, and gathers and sums the tables' rows.
    Tasks send one sum a cluster, so a vector that a third of all rows repeat costs no more than others;
    the driver sees ``k`` rows a round.

    Null vectors and those of another length are left out. Repeated rows of an id each give a row; if they
    differ, the lesser vector stands first among the starting centroids. Rows without an id are clustered but no starting
    centroid. With fewer than ``k`` ids there are fewer centroids; without any, or on an empty table, the result is empty.
    Components beyond 2^27 / ``scale`` raise an error, as distances would leave 64 bits. Other columns are ignored.
    """
    spark = vectors.sparkSession
    whole = stored(integer_vectors(vectors, vec_id, embedding, dims, scale))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = whole.filter("vec_id is not null").orderBy(order, "v").limit(k).select("v").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.v for r in first], np.int64)
    for _ in range(rounds):
        centroids = moved(centroids, whole)
    assigned = stored(whole.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per_cluster = spark.createDataFrame([(c, total, sum(inertia.values()), digests[c]) for c, total in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

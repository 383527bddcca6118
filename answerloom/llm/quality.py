"""Quality of documents: a discriminant over text statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm import discriminant
from answerloom.llm.features import FEATURES, matrix, with_statistics
from answerloom.llm.tables import text_or_empty

#: Labelled documents a model is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def labelled_matrix(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``max_rows`` labelled documents, on the driver.

    Rows of ``labels`` without an id or a label are left out, of repeated ids the largest label counts; of
    repeated documents one does. The ids that are broadcast number ``max_rows`` at most.
    """
    chosen = (
        labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, stats in with_statistics(batches, "text"):
            x = matrix(stats)
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), values], ["doc_id", "label", "x"])

    rows = (
        texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
        .mapInArrow(measure, "doc_id long, label int, x array<double>")
        .groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x")).orderBy("doc_id").toArrow()
    )
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return x, np.array(rows.column("label").to_pylist(), float)


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int) -> discriminant.Discriminant:
    """The discriminant of labelled rows that aren't held out."""
    return discriminant.fit(*labelled_matrix(docs, labels.filter(~held_out(F.col(doc_id).cast("long"))), doc_id, text, label, max_rows))


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, max_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted); score is the probability of label 1.

    The discriminant is fitted on at most ``max_rows`` labelled rows that aren't held out (see
    ``held_out``); whole texts' statistics are its only inputs. Null text counts as empty and is
    scored like any other. Repeated rows are scored alike; a row without an id has null ``held_out``.
    Without labelled rows all scores are 0.5. Other columns are ignored; an empty table gives an empty result.
    """
    model = fitted(docs, labels, doc_id, text, label, max_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, stats in with_statistics(batches, "text"):
            p = model.score(matrix(stats))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, max_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, whole, that ``quality_scores`` predicts as label 1; nothing is shuffled."""
    model = fitted(docs, labels, doc_id, text, label, max_rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, stats in with_statistics(batches, text):
            yield part.filter(pa.array(model.score(matrix(stats)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)

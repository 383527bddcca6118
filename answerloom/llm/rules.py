"""Quality rules: plain limits on counts, then boosted trees over the same statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm import trees
from answerloom.llm.features import COUNTS, FEATURES, matrix, with_statistics
from answerloom.llm.quality import SAMPLE_ROWS, labelled_matrix
from answerloom.llm.tables import text_or_empty

#: Statistics of which more is never better.
FALLING = ("symbols", "upper", "dup_lines", "repeat_words", "top_word", "bangs")


def quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", min_words: int = 50, max_repeat_percent: int = 50, threshold: float = 0.5, max_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: (doc_id, the counts of ``features.COUNTS``, base_failed, score, kept).

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated
    three-word windows. Others are kept at a score of ``threshold`` or more: boosted trees over text
    statistics, whose score can't rise with any of ``FALLING``, fitted on ``max_rows`` labelled rows at
    most. Null text is empty; repeated rows are judged alike; a null id is returned as it is. Without
    labelled rows every document that passes the limits is kept. Other columns are ignored; an empty
    table gives an empty result.
    """
    x, y = labelled_matrix(docs, labels, doc_id, text, label, max_rows)
    forest = trees.fit(x, y, np.array([-1 if name in FALLING else 0 for name in FEATURES]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, stats in with_statistics(batches, "text"):
            failed = (stats["n_words"] < min_words) | (100 * stats["n_repeat_words"] > max_repeat_percent * stats["n_words"])
            score = forest.score(matrix(stats))
            counts = [pa.array(stats[name].astype(np.int64)) for name in COUNTS]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(judge, f"doc_id {kind}, {', '.join(f'{name} long' for name in COUNTS)}, base_failed boolean, score double, kept boolean")

"""A training corpus from raw documents: five stages, each one of the training-data operators.

What holds for all stages: columns besides doc_id and text are carried along under their names, whatever those are. A null
text counts as an empty one. Repeated rows are rows of their own. A row without a doc_id is neither a copy of another nor
changed by passages, but loses shared lines and is judged like any other. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm.lines import drop_shared_lines
from answerloom.llm.neardup import near_duplicates
from answerloom.llm.packing import pack_documents
from answerloom.llm.quality import keep_good
from answerloom.llm.substring import remove_repeated_passages
from answerloom.llm.tables import dealt, pieces, stored, table


def with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The carried columns of documents with their new text, and its length."""
    fresh = {"text": F.col("kept_text").alias("text"), "n_chars": F.char_length("kept_text").cast("long").alias("n_chars")}
    return rows.select(*[fresh.get(name, F.col(f"rest.{name}").alias(name)) for name in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good, at a score of 0.7 or more; rows as they are. Without labels none is."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; repeated rows count as one. No row goes, a text may become empty."""
    return with_text(drop_shared_lines(docs, carry=others(docs)), docs.columns)


def others(docs: DataFrame) -> list[str]:
    return [name for name in docs.columns if name != "text"]


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies, with its repeated rows; rows without an id stay. Empty texts are copies of each other."""
    n = pieces(docs, 1)
    kept = dealt(near_duplicates(docs).filter("kept").select("doc_id").filter(F.col("doc_id").isNotNull()), n, "doc_id")
    return dealt(docs, n, "doc_id").join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words or more that also stand earlier, by id and place; repeated rows aren't earlier than each other. No row goes."""
    return with_text(remove_repeated_passages(docs, separators="original", carry=others(docs)), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their tokens. An empty text is one token, the end of its document."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_copies), ("substring dedup", passages), ("packing", packed),
]

#: No SQL: the classifier, the sampling and the tokenizer have none. Tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, which may be empty, repeated or without text; each stage's result is stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

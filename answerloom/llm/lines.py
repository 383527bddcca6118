"""Lines that many documents share, dropped everywhere. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.llm.tables import dealt, pieces, rest, stored, text_or_empty

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else; texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    """What two lines must share to count as the same: blanks at both ends and the case of A-Z don't matter."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def drop_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: (doc_id, n_lines, n_dropped, dropped_bits, kept_text) and, as
    the struct ``rest``, the columns named in ``carry``.

    A key of at least ``min_chars`` characters that ``min_docs`` documents or more contain loses
    all its lines. Hashes of keys (128 bits) are range-partitioned together with the document, so
    a key that a third of all lines share covers many partitions. There the rows lie sorted by
    key, document and position, and the first of each key and document streams out to be counted.
    The lines of counted keys come back as a bitmap per document, its words with a bit only, in
    ``dropped_bits`` as a map from word number to the 64 bits of lines that go. Texts are moved once.

    Null or empty text is one empty line. Repeated rows of one id count as one document; a row
    without an id counts for no key, but loses its lines. Other columns are ignored; an empty table
    gives an empty result.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"), *rest(carry)).withColumn("digest", F.xxhash64("text"))
    lines = stored(
        source.select("doc_id", "digest", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "digest", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("doc_id", "digest", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )
    firsts = (
        lines.filter(F.col("doc_id").isNotNull()).select("h1", "h2", "doc_id", "pos")
        .repartitionByRange("h1", "h2", "doc_id")
        .withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")))
        .filter("nth = 1")
    )
    shared = stored(firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs).select("h1", "h2"))
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = (
        lines.join(shared, ["h1", "h2"], "left_semi")
        .groupBy("doc_id", "digest", F.expr("pos div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    )
    bitmaps = words.groupBy("doc_id", "digest").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"), F.sum(F.bit_count("bits")).alias("n_dropped")
    )
    n = pieces(docs, 1)
    left, right = dealt(source, n, "doc_id", "digest").alias("s"), dealt(bitmaps, n, "doc_id", "digest").hint("shuffle_hash").alias("b")
    met = left.join(right, F.col("s.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("s.digest") == F.col("b.digest")), "left")
    kept = F.expr(
        "array_join(filter(split(s.text, '\\n', -1), (line, i) -> "
        "getbit(coalesce(element_at(b.dropped, cast(i div 64 as bigint)), 0L), i % 64) = 0), '\\n')"
    )
    return met.select(
        F.col("s.doc_id").alias("doc_id"),
        (F.char_length("s.text") - F.char_length(F.translate("s.text", "\n", "")) + 1).cast("long").alias("n_lines"),
        F.coalesce("b.n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.col("b.dropped").alias("dropped_bits"),
        F.when(F.col("b.dropped").isNull(), F.col("s.text")).otherwise(kept).alias("kept_text"), *(["s.rest"] if carry else []),
    )

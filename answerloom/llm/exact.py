"""Exact copies of texts, found by counting quotient filters and settled by comparing bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.tables import dealt, partitions, pieces, stored, text_or_empty

WHITE_RUN = "[\\x20\\x09-\\x0D]+"
#: Fingerprints of one filter; a partition with more of them builds several.
FILTER_CAPACITY = 1 << 20


@dataclass
class QuotientFilter:
    """Counts of 64-bit fingerprints, each kept as a quotient (its high bits) and a remainder (its low bits).

    ``occupied`` has a bit for each quotient from ``base`` on. Remainders lie in runs, one for each
    occupied quotient, sorted within; ``run_end`` marks the last of a run. So every fingerprint can
    be read back, and merging loses nothing.
    """

    remainder_bits: int
    base: int
    occupied: np.ndarray
    run_end: np.ndarray
    remainder: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """From distinct sorted fingerprints (one at least) and how often each occurs."""
        quotient_bits = max(1, len(fingerprints).bit_length())
        bits = 64 - quotient_bits
        quotient = fingerprints >> np.uint64(bits)
        base = int(quotient[0])
        occupied = np.zeros(int(quotient[-1]) - base + 1, bool)
        occupied[(quotient - np.uint64(base)).astype(np.int64)] = True
        run_end = np.append(quotient[1:] != quotient[:-1], True)
        return cls(bits, base, occupied, run_end, fingerprints & np.uint64((1 << bits) - 1), counts.astype(np.int64))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        run = np.concatenate([[0], np.cumsum(self.run_end)[:-1]]).astype(np.int64)
        quotient = np.flatnonzero(self.occupied).astype(np.uint64)[run] + np.uint64(self.base)
        return (quotient << np.uint64(self.remainder_bits)) | self.remainder, self.count

    @staticmethod
    def merged(filters: Iterable[QuotientFilter]) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints of several filters, sorted, with their counts added up."""
        # Two sorted runs merge by where each entry falls in the other, neighbours first.
        runs = [f.items() for f in filters]
        while len(runs) > 1:
            runs = [_merged(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
        return runs[0]

    def to_bytes(self) -> bytes:
        """Remainders in whole bytes; counts in one byte each, those of 255 or more in full at the end."""
        width = (self.remainder_bits + 7) // 8
        low = np.ascontiguousarray(self.remainder, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return b"".join((
            struct.pack("<BQQQ", self.remainder_bits, self.base, len(self.occupied), len(self.remainder)),
            np.packbits(self.occupied).tobytes(), np.packbits(self.run_end).tobytes(), low.tobytes(),
            np.minimum(self.count, 255).astype(np.uint8).tobytes(), self.count[self.count >= 255].astype("<i8").tobytes(),
        ))

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        bits, base, quotients, n = struct.unpack_from("<BQQQ", data)
        at, width = struct.calcsize("<BQQQ"), (bits + 7) // 8

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        occupied = np.unpackbits(take((quotients + 7) // 8), count=quotients).astype(bool)
        run_end = np.unpackbits(take((n + 7) // 8), count=n).astype(bool)
        remainder = np.zeros((n, 8), np.uint8)
        remainder[:, :width] = take(n * width).reshape(n, width)
        count = take(n).astype(np.int64)
        count[count == 255] = np.frombuffer(data, "<i8", offset=at)
        return cls(bits, base, occupied, run_end, remainder.view("<u8").reshape(-1).astype(np.uint64), count)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of distinct keys and counts as one; equal keys add up."""
    at = np.searchsorted(a[0], b[0])
    same = at < len(a[0])
    same[same] = a[0][at[same]] == b[0][same]
    counts = a[1].copy()
    counts[at[same]] += b[1][same]
    return np.insert(a[0], at[~same], b[0][~same]), np.insert(counts, at[~same], b[1][~same])


def _filters(buckets: int):
    """Fingerprint rows to filters, cut at equal ranges of quotients."""
    from answerloom.llm.arrays import bucket_cuts

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            cuts = bucket_cuts(keys, buckets)
            rows = [(b, QuotientFilter.of(keys[i:j], counts[i:j]).to_bytes()) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
            return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32()), "filter": pa.array([f for _, f in rows], pa.binary())})

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(held[-1])
            if size >= FILTER_CAPACITY:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return build


def _repeated(group: pa.Table) -> pa.Table:
    """All filters of one range of quotients to the fingerprints with a count above one."""
    keys, counts = QuotientFilter.merged(QuotientFilter.from_bytes(f) for f in group.column("filter").to_pylist())
    return pa.table({"fingerprint": keys[counts > 1].view(np.int64)})


def repeated_fingerprints(fingerprints: DataFrame, ranges: int | None = None) -> DataFrame:
    """Of a one-column table of 64-bit fingerprints, those that occur more than once.

    Every partition builds counting quotient filters; their pieces meet by range of quotients. A
    fingerprint that a third of all rows share is one entry of each filter.
    """
    buckets = ranges or partitions(fingerprints.sparkSession)
    filters = fingerprints.mapInArrow(_filters(buckets), "bucket int, filter binary")
    return filters.groupBy("bucket").applyInArrow(_repeated, "fingerprint long")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are after each run of ASCII white space became one space (null:
    empty); of equal ones the row with the smallest id stays. Fingerprints that repeat send their
    documents to the byte comparison, a grouping by whole text that combines on the map side;
    all others are known to be unique. Rows are found again by SHA-256 of the compared text.

    Repeated rows: each counts; all rows that have the smallest id stay. A row without an id stays
    only if no equal row has one; keep_id is null then. Other columns are ignored, an empty table
    gives an empty result.
    """
    normal = F.regexp_replace(text_or_empty(text), WHITE_RUN, " ")
    narrow = stored(
        docs.select(F.col(doc_id).alias("doc_id"), normal.alias("normal")).select(
            "doc_id", F.xxhash64("normal").alias("fingerprint"), F.sha2("normal", 256).alias("text_sha256")
        )
    )
    repeated = repeated_fingerprints(narrow.select("fingerprint"), pieces(docs, partitions(docs.sparkSession)))
    # Rows whose text has to be compared, by id and digest: no key here is shared by many rows of one side.
    suspects = stored(narrow.join(repeated, "fingerprint", "left_semi").select("doc_id", "text_sha256"))
    n = pieces(docs, 1)
    ids = dealt(suspects.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct(), n, "doc_id").hint("shuffle_hash")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("raw"))
    texts = dealt(texts.filter(F.col("doc_id").isNotNull()), n, "doc_id").join(ids, "doc_id", "left_semi").unionByName(texts.filter(F.col("doc_id").isNull()))
    compared = (
        texts.select("doc_id", F.regexp_replace(F.coalesce(F.col("raw").cast("string"), F.lit("")), WHITE_RUN, " ").alias("normal"))
        .groupBy("normal").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.sha2("normal", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    return narrow.join(compared, "text_sha256", "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )

"""CSV records of any size of file: every split reads its own lines, and the parity of quotes tells which line ends are inside a field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COUNTS = "file long, block long, odd int, starts_outside long, starts_inside long"
PIECES = "file long, number long, block long, whole boolean, value string"


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): lines as they stand, the hash of their file's path and where their split begins in it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


class _Run:
    """Consecutive lines of one split: quotes before each line, counted from the split's beginning, and which lines are blank."""

    def __init__(self, lines: pa.RecordBatch, quotes_before: int) -> None:
        self.file, self.block = lines.column("file")[0].as_py(), lines.column("block")[0].as_py()
        value = lines.column("value")
        if self.block == 0 and not quotes_before and len(value) and value[0].as_py().startswith("\ufeff"):
            value = pa.concat_arrays([pa.array([value[0].as_py()[1:]]), value[1:]])
        quotes = pc.count_substring(value, '"').to_numpy()
        self.value, self.after = value, quotes_before + int(quotes.sum())
        self.before = quotes_before + np.cumsum(quotes) - quotes
        self.blank = pc.equal(pc.binary_length(pc.utf8_trim_whitespace(value)), 0).to_numpy(zero_copy_only=False)

    def starts(self, parity: int) -> np.ndarray:
        """Lines that begin a record if the split begins inside (1) or outside (0) of quotes."""
        return ((self.before + parity) % 2 == 0) & ~self.blank


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Run, bool]]:
    """The lines of a task as runs of one split each, and whether a run is the first of its split."""
    held, quotes = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column("file").to_numpy(), batch.column("block").to_numpy()])
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            first = tuple(key[a]) != held
            run = _Run(batch.slice(a, z - a), 0 if first else quotes)
            held, quotes = tuple(key[a]), run.after
            yield run, first


def _split_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split the parity of its quotes and the records that begin in it, for either parity before it."""
    rows: list[list[int]] = []
    for run, first in _runs(batches):
        if first:
            rows.append([run.file, run.block, 0, 0, 0])
        last = rows[-1]
        last[2] = run.after % 2
        last[3] += int(run.starts(0).sum())
        last[4] += int(run.starts(1).sum())
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(columns)], ["file", "block", "odd", "starts_outside", "starts_inside"])


def split_offsets(lines: DataFrame) -> DataFrame:
    """(file, block, inside, before): whether a split begins inside quotes, and how many records begin before it in its file."""
    counts = lines.mapInArrow(_split_counts, COUNTS)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parity = counts.withColumn("inside", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int"))
    starts = F.when(F.col("inside") == 1, F.col("starts_inside")).otherwise(F.col("starts_outside"))
    return parity.select("file", "block", "inside", F.coalesce(F.sum(starts).over(earlier), F.lit(0)).alias("before"))


def _pieces(offsets: dict[tuple[int, int], tuple[int, int]]):
    """A task's lines to records. What a split begins or ends within becomes a piece, to be put together with those of its neighbours."""

    def emit(file: int, block: int, rows: list[tuple[int, bool, str]]) -> pa.RecordBatch:
        number, whole, value = zip(*rows, strict=True) if rows else ((), (), ())
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n, pa.int64()), pa.array(number, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(whole, pa.bool_()), pa.array(value, pa.string())],
            ["file", "number", "block", "whole", "value"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []  # the split, and the lines of the record that isn't closed yet
        parity, number, tail = 0, 0, False

        def rest() -> Iterator[pa.RecordBatch]:
            if held:
                yield emit(*at, [(number, False, "\n".join(held))])

        for lines, first in _runs(batches):
            if first:
                if at:
                    yield from rest()
                at, held = (lines.file, lines.block), []
                parity, before = offsets.get(at, (0, 0)) if lines.block == 0 else offsets[at]
                number, tail = before - 1, parity == 1
            done = []
            inside = (lines.before + parity) % 2 == 1
            closes = np.append(lines.before[1:], lines.after) + parity
            for text, within, blank, quotes in zip(lines.value.to_pylist(), inside.tolist(), lines.blank.tolist(), closes.tolist(), strict=True):
                if not within:
                    if blank:
                        continue
                    number, tail = number + 1, False
                held.append(text)
                if quotes % 2 == 0:
                    done.append((number, not tail, "\n".join(held)))
                    held, tail = [], False
            if done:
                yield emit(*at, done)
        if at:
            yield from rest()

    return run


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, value): each record's text, numbered within its file from 0, which is the header.

    Fields may hold line ends in quotes; a quote inside a field is doubled, as RFC 4180 has it. A file is read by as many tasks as
    it has splits. The first pass counts, for each split, its quotes and the records that begin in it for either
    parity of the quotes before; the running parity over a file's splits decides. The second pass cuts the records. A
    record belongs to the split it begins in; only the pieces of records that cross a split's end are shuffled.

    Blank lines between records are no records. A file in which a quote is never closed ends in one long record. What a task has
    to know of the splits that begin within a file is four numbers each, for Spark's 128 MB a split 32 bytes
    for each 128 MB of input.
    """
    lines = file_lines(spark, path)
    offsets = {(r.file, r.block): (r.inside, r.before) for r in split_offsets(lines).filter("block > 0").collect()}
    pieces = lines.mapInArrow(_pieces(offsets), PIECES)
    whole = pieces.filter("whole").select("file", "number", "value")
    parts = pieces.filter("not whole").groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "value"))).alias("parts"))
    crossing = parts.select("file", "number", F.array_join(F.col("parts.value"), "\n").alias("value"))
    return whole.unionByName(crossing).withColumn("value", F.regexp_replace("value", "\r$", ""))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of CSV files with a header, as text, and ``line``, the record's number in its file from 1."""
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    rows = csv_records(spark, path).filter("number > 0")
    parsed = rows.select("number", F.from_csv("value", schema, {"escape": '"'}).alias("_r"))
    return parsed.select(F.col("number").alias("line"), *[F.col("_r").getField(name).alias(name) for name in names])

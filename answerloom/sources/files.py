"""Readers and writers: JSON lines, CSV, knowledge documents, scenario files, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerloom.functions.text import strip
from answerloom.operators.knowledge import CATEGORY_SECTIONS
from answerloom.sources import schemas
from answerloom.sources.records import read_csv

ENOUGH_ROWS = 9000


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``line`` (from 1 within the file) and ``seq`` (from 1 over all files by path).

    ``df`` comes straight from a file reader. Rows of one file block are consecutive, so a block
    needs only its row count and first row id. The rows are neither sorted nor shuffled: they meet the table of
    blocks, five numbers for each file and each 128 MB of input, as a broadcast, whatever Spark's threshold for others is.
    A block that the counting pass cut otherwise raises an error.
    """
    marked = df.select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    blocks = marked.groupBy("file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_lines"),
    )
    small = offsets.select(F.xxhash64("file").alias("_file"), "_block", "_first", "_before", "_lines")
    placed = marked.withColumn("_file", F.xxhash64("file")).join(F.broadcast(small), ["_file", "_block"], "left")
    lost = F.raise_error(F.concat(F.lit("file block changed between passes: "), F.col("file"))).cast("bigint")
    at = F.col("_row") - F.coalesce("_first", lost) + 1
    return placed.select(
        *df.columns, "file", (F.col("_lines") + at).alias("line"), (F.col("_before") + at).alias("seq")
    )


def read_json_lines(
    spark: SparkSession, path: str, schema: str, line_numbers: bool = True
) -> tuple[DataFrame, DataFrame]:
    """S1. (rows, rejected lines). Blank lines are skipped, lines that are no JSON are set aside.

    Line numbers cost a counting pass over the files. Without them ``seq`` is a unique row id
    that rises within a file block, and ``line`` is null.
    """
    raw = spark.read.text(path)
    if line_numbers:
        lines = numbered(raw)
    else:
        lines = raw.select(
            "value", F.col("_metadata.file_path").alias("file"), F.lit(None).cast("bigint").alias("line"),
            F.monotonically_increasing_id().alias("seq"),
        )
    lines = lines.withColumn("value", strip(F.col("value"))).filter("value <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.withColumn("_r", F.from_json("value", schema + ", _corrupt string", options))
    fields = [f for f in parsed.schema["_r"].dataType.names if f != "_corrupt"]
    good = parsed.filter("_r._corrupt IS NULL").select("seq", "line", *[F.col("_r")[f].alias(f) for f in fields])
    bad = parsed.filter("_r._corrupt IS NOT NULL").select("file", "line", "value")
    return good, bad


def read_samples(spark: SparkSession, path: str, line_numbers: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1."""
    return read_json_lines(spark, path, schemas.SAMPLE, line_numbers)


def write_samples(df: DataFrame, path: str, split: str | None = None) -> None:
    """S2. JSON lines, one folder per split when ``split`` names the column. Never the input path."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(split) if split else writer).json(path)


def _line_id(c: Column) -> Column:
    digits = F.col("line").cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.coalesce(c, F.concat(F.lit("q_"), padded))


def read_prompts_json(spark: SparkSession, path: str) -> DataFrame:
    """S3. Prompt falls back to the first message, id to the line number."""
    rows, _ = read_json_lines(spark, path, schemas.PROMPT)
    first = F.try_element_at("messages", F.lit(1))["content"]
    return rows.select(
        _line_id(F.col("id")).alias("id"), F.coalesce("category", F.lit("general")).alias("category"),
        F.coalesce("prompt", first).alias("prompt"),
    )


def read_prompts_csv(spark: SparkSession, path: str) -> DataFrame:
    """S4. Prompt from the first of prompt, query, question that is a column, id else from the record's number.

    Fields may hold line ends in quotes; large files are read by many tasks all the same.
    """
    rows = read_csv(spark, path)
    named = next((c for c in ("prompt", "query", "question") if c in rows.columns), None)
    given = F.coalesce(F.col("id"), F.lit("")) if "id" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        _line_id(given).alias("id"),
        (F.col("category") if "category" in rows.columns else F.lit("general")).alias("category"),
        (F.coalesce(F.col(named), F.lit("")) if named else F.lit("")).alias("prompt"),
    )


def read_test_cases(
    spark: SparkSession, path: str, category: str | None = None, case_id: str | None = None
) -> DataFrame:
    """S5. Cases have ids of their own, so lines aren't numbered."""
    rows, _ = read_json_lines(spark, path, schemas.TEST_CASE, line_numbers=False)
    if category is not None:
        rows = rows.filter(F.lower("category") == category.lower())
    if case_id is not None:
        rows = rows.filter(F.col("id") == case_id)
    return rows


def read_knowledge(
    spark: SparkSession, folder: str, categories: list[str] | None = None
) -> DataFrame:
    """S6. (category, doc): one JSON file per category, a missing file is an empty document."""
    categories = categories or list(CATEGORY_SECTIONS)
    names = spark.createDataFrame([(c,) for c in categories], "category string")
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    docs = files.select(name.alias("category"), F.col("value").alias("doc"))
    return names.join(docs, "category", "left").select("category", F.coalesce("doc", F.lit("{}")).alias("doc"))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """S11. A scenario file of a few cases, YAML (or JSON, which YAML contains), wherever Spark can read it."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    try:
        import yaml
    except ImportError:
        doc = json.loads(text)
    else:
        doc = yaml.safe_load(text)
    rows = []
    for case in doc["scenarios"]:
        given = {k: v if isinstance(v, str) else json.dumps(v) for k, v in case.get("input", {}).items()}
        rows.append(
            (case["id"], case.get("name"), case.get("type", "design"), given, case.get("expected_keywords", []),
             float(case.get("min_confidence", 0.0)), bool(case.get("requires_human_review", False)))
        )
    return spark.createDataFrame(rows, schemas.SCENARIO_CASE)


def write_report(report: DataFrame, path: str) -> None:
    """S7. A one-row report as a single JSON document."""
    report.coalesce(1).write.mode("errorifexists").json(path)


RESULT_FIELDS = [
    "test_id", "category", "overall_score", "keyword_score", "source_score", "confidence",
    "has_think", "reasoning_steps", "latency_ms", "pass_fail", "keywords_missing",
]


def write_results(scored: DataFrame, path: str) -> None:
    """S7. Per-test rows with the eleven fields of the stored report."""
    scored.select(*RESULT_FIELDS).write.mode("errorifexists").json(path)


def write_batch(records: DataFrame, path: str) -> None:
    """S8. Results and error records inline; absent fields are left out of a line."""
    records.write.mode("errorifexists").option("ignoreNullFields", True).json(path)


def enough(df: DataFrame, rows: int = ENOUGH_ROWS) -> DataFrame:
    """S9. One row (rows_seen, enough); reading stops at ``rows``."""
    return df.limit(rows).agg(F.count(F.lit(1)).alias("rows_seen")).withColumn("enough", F.col("rows_seen") >= rows)


def has_enough(df: DataFrame, rows: int = ENOUGH_ROWS) -> bool:
    """S9."""
    return enough(df, rows).first()["enough"]

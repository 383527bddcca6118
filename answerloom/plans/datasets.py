"""Whole runs: build a dataset, validate one, evaluate responses, score a suite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.facts import check_facts
from answerloom.functions.parse import parse_responses
from answerloom.functions.scores import (
    alignment_score, keyword_score, with_confidence_suite, with_reasoning_score,
)
from answerloom.operators import curate, evaluate, validate
from answerloom.session import cut_lineage, work_folder
from answerloom.sources import files


def curate_file(spark: SparkSession, source: str, target: str, seed: int = 42, stratified: bool = True) -> DataFrame:
    """Read, deduplicate, filter, split and write samples; returns the statistics of what was kept.

    The lines are parsed once into a columnar table. Every later step reads the few digest
    columns it needs; whole samples are read again only to be written.
    """
    samples, _ = files.read_samples(spark, source)
    # Without messages the whole sample is its own fingerprint.
    prompt = F.coalesce(
        curate.first_message(F.col("messages"))["content"], F.to_json(F.struct("messages", "metadata"))
    )
    parsed = samples.withColumn("print", curate.fingerprint(prompt))
    path, digest_path = work_folder(spark), work_folder(spark)
    parsed.write.parquet(path)
    stored = spark.read.parquet(path)
    digest = curate.digest_messages(stored, keep=("print",))
    digest.drop("sample_facts", "accuracy_facts", "compliance", "sources_used").write.parquet(digest_path)
    digest = spark.read.parquet(digest_path)
    unique = curate.deduplicate(digest, F.col("print"), "sample_id")
    valid = curate.validate_samples(unique)
    if stratified:
        split = curate.split_stratified(valid, "sample_id", curate.stratum_of(), seed=seed)
    else:
        split = curate.split_random(valid, "sample_id", seed=seed)
    kept = stored.join(split.select(F.col("sample_id").alias("seq"), "split"), "seq")
    files.write_samples(kept.drop("seq", "line", "print"), target, split="split")
    return curate.dataset_stats(valid)


def validate_file(spark: SparkSession, source: str, strict: bool = False, limit: int | None = None) -> dict[str, DataFrame]:
    """The validation reports of one file; ``limit`` counts input lines, blank ones included (P3).

    The checks run once; the reports read their stored results.
    """
    samples, _ = files.read_samples(spark, source)
    if limit is not None:
        samples = samples.filter(F.col("seq") <= limit)
    both = validate.check_accuracy(validate.validate(curate.digest_messages(samples), strict))
    results = cut_lineage(
        both.select("sample_id", "checks", "score", "passed", "errors", "accuracy_score", "critical_failures")
    )
    report, rates = validate.validation_report(results), validate.check_rates(results)
    return {
        "report": report, "gate": validate.passes_rate_gate(report), "rates": rates,
        "recommendations": validate.recommendations(rates), "errors": validate.frequent_errors(results),
        "accuracy": validate.accuracy_report(results),
    }


def evaluate_responses(responses: DataFrame, category: str = "category") -> DataFrame:
    """Parsed responses (``raw``, ``latency_ms``, category) with all evaluation scores."""
    rows = parse_responses(responses, "basic")
    rows = rows.select(
        "*", F.concat_ws(" ", "answer", "reasoning").alias("_facts"), F.concat_ws(" ", "reasoning", "answer").alias("_claims")
    )
    rows = alignment_score(check_facts(rows, "_facts", category), "_claims")
    scored = with_reasoning_score(rows, F.concat_ws("\n", "reasoning", "answer"))
    return scored.drop("_facts", "_claims")


def gate_report(responses: DataFrame, category: str = "category") -> DataFrame:
    """Metrics of the responses against the gates."""
    metrics = evaluate.metrics_long(evaluate.evaluation_metrics(evaluate_responses(responses, category)))
    return evaluate.evaluate_gates(metrics, evaluate.gate_targets(responses.sparkSession))


def score_suite(responses: DataFrame, cases: DataFrame, on: str = "case_id") -> DataFrame:
    """Parse, confidence, keyword score and band of responses joined with their cases."""
    rows = with_confidence_suite(parse_responses(responses, "suite"))
    return keyword_score(evaluate.with_cases(rows, cases, on))

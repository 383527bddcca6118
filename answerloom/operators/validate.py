"""Dataset reports over checked samples (``functions.checks``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.functions.checks import accuracy_checks, sample_checks, score_checks
from answerloom.functions.text import one_decimal
from answerloom.operators.reports import top_counts

__all__ = [
    "validate", "validation_report", "check_rates", "frequent_errors", "recommendations",
    "passes_rate_gate", "check_accuracy", "accuracy_report", "merge_checks",
]


def validate(digest: DataFrame, strict: bool = False) -> DataFrame:
    """R14 to R17."""
    return score_checks(sample_checks(digest, strict))


def validation_report(checked: DataFrame) -> DataFrame:
    """A3."""
    return checked.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if("passed").alias("passed_samples"),
        F.count_if(~F.col("passed")).alias("failed_samples"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"),
    )


def passes_rate_gate(report: DataFrame, rate: float = 0.80) -> DataFrame:
    """A18."""
    share = F.col("passed_samples") / F.greatest(F.col("total_samples"), F.lit(1))
    return report.select(share.alias("pass_rate"), (share >= rate).alias("ok"))


def check_rates(checked: DataFrame) -> DataFrame:
    """A4. Pass rate of a check among the samples that emitted it, and its P4 verdict."""
    rates = (
        checked.select(F.explode("checks").alias("c"))
        .groupBy(F.col("c.name").alias("check"))
        .agg(
            F.count(F.lit(1)).alias("emitted"),
            (F.count_if(F.col("c.passed")) / F.count(F.lit(1)) * 100).alias("pass_rate"),
        )
    )
    return rates.withColumn("status", F.when(F.col("pass_rate") >= 80, "GOOD").otherwise("NEEDS WORK"))


def recommendations(rates: DataFrame) -> DataFrame:
    """P8."""
    return rates.filter("pass_rate < 80.0").select(
        "check",
        F.format_string("Improve '%s': currently %s%% pass rate", "check", one_decimal(F.col("pass_rate"))).alias("recommendation"),
    )


def frequent_errors(checked: DataFrame, k: int = 5) -> DataFrame:
    """A5. Error keys are what stands before the first colon."""
    keys = F.transform("errors", lambda e: F.substring_index(e, ":", 1))
    return top_counts(checked.select(keys.alias("keys")), "keys", k, "error").select(
        "error", "n", F.format_string("%s: %d occurrences", "error", "n").alias("text")
    )


def merge_checks(*parts: DataFrame) -> DataFrame:
    """U4. Long check rows (sample_id, name, passed, message, part) merged, later parts win."""
    rows = None
    for i, part in enumerate(parts):
        numbered = part.withColumn("part", F.lit(i))
        rows = numbered if rows is None else rows.unionByName(numbered)
    kept = rows.groupBy("sample_id", "name").agg(
        F.max_by(F.struct("passed", "message"), "part").alias("v")
    )
    return kept.select("sample_id", "name", "v.passed", "v.message")


def check_accuracy(digest: DataFrame) -> DataFrame:
    """R22."""
    return accuracy_checks(digest)


def accuracy_report(checked: DataFrame) -> DataFrame:
    """A6. The last count is samples below 60 points, whatever its name says."""
    return checked.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.coalesce(F.avg("accuracy_score"), F.lit(0.0)).alias("average_accuracy_score"),
        F.coalesce(F.sum("critical_failures"), F.lit(0)).alias("total_critical_failures"),
        F.count_if(F.col("accuracy_score") < 60.0).alias("samples_with_critical_failures"),
    )

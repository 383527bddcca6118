"""Ranked counts used by several reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_counts(df: DataFrame, values: str, k: int, name: str) -> DataFrame:
    """W7. The ``k`` most frequent entries of an array column; ties by name.

    Counts combine on the map side, so a value that is in every row is no hot key.
    """
    return (
        df.select(F.explode(values).alias(name))
        .groupBy(name)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), name)
        .limit(k)
    )


def score_summary(df: DataFrame, score: str) -> DataFrame:
    """A7, A8, A10: mean, least and greatest score; zero without rows."""
    zero = F.lit(0.0)
    return df.agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.coalesce(F.avg(score), zero).alias("avg_score"),
        F.coalesce(F.min(score), zero).alias("min_score"),
        F.coalesce(F.max(score), zero).alias("max_score"),
    )

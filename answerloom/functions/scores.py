"""Heuristic scores of a response, all as Column expressions.

The weights and thresholds are fixed values; they are added in the order they are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.fixed.claims import CLAIMS
from answerloom.fixed.sources import DOMAIN_TITLES, TECHNICAL_TERMS
from answerloom.functions.text import (
    all_matches, contains_any, count_matches, round_exact, word_count,
)

# Patterns.
STEP_LINE = r"(?dmU)^Step\s+\d+:"
CITATIONS_SHORT = r"(?diuU)\[Source:|Source:|from .{3,30} chapter|per .{3,30} §"
CITATIONS_LONG = (
    r"(?diuU)\[Source:|Source:|from .{3,60} chapter|per .{3,60} §|according to .{3,60}"
)
VERSIONS_SHORT = (
    r"(?iuU)PCI-DSS\s+\d+\.\d+|HIPAA\s+\d{4}|SOX\s+\d{4}|NIST\s+CSF\s+\d+|ISO\s+27001:\d{4}"
)
VERSIONS_LONG = (
    r"(?diuU)PCI.DSS\s+\d+\.\d+|HIPAA\s+\d{4}|NIST\s+CSF\s+\d+\.\d+|ISO\s+27001:\d{4}"
)


def _add_when(parts: list[tuple[Column, float]], start: float) -> Column:
    """Add the weights one after the other, in the order given."""
    score = F.lit(start)
    for condition, weight in parts:
        score = score + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
    return score


def with_confidence_strict(df: DataFrame) -> DataFrame:
    """R4 on strictly parsed columns: adds ``confidence``."""
    reasoning, answer, steps, sources = F.col("reasoning"), F.col("answer"), F.col("reasoning_steps"), F.size("sources")
    hits = sum(
        (F.contains(answer, F.lit(t)) | F.contains(reasoning, F.lit(t))).cast("int")
        for t in TECHNICAL_TERMS
    )
    score = _add_when(
        [
            (reasoning != "", 0.15),
            (steps >= 3, 0.10),
            (steps >= 5, 0.05),
            (sources > 0, 0.10),
            (sources > 2, 0.05),
            (F.length(answer) > 200, 0.05),
        ],
        0.5,
    )
    return df.withColumn(
        "confidence", F.least(score + F.least(hits * F.lit(0.02), F.lit(0.10)), F.lit(1.0))
    )


def with_confidence_suite(df: DataFrame) -> DataFrame:
    """R5 on columns of the suite flavour: adds ``confidence``. Words are counted once."""
    counted = df.withColumn("_words", word_count(F.col("answer")))
    steps, words = F.col("reasoning_steps"), F.col("_words")
    score = F.lit(0.35) + F.when(F.col("has_think_block"), 0.20).otherwise(0.0)
    score = score + F.when(steps >= 3, 0.15).when(steps >= 1, 0.08).otherwise(0.0)
    score = score + F.when(F.size("sources") > 0, 0.15).otherwise(0.0)
    score = score + F.when(words >= 200, 0.10).when(words >= 80, 0.05).otherwise(0.0)
    summed = counted.withColumn("_sum", score)
    return summed.withColumn("confidence", F.least(round_exact(F.col("_sum"), 2), F.lit(1.0))).drop("_words", "_sum")


def with_reasoning_score(df: DataFrame, response: Column, name: str = "reasoning_score") -> DataFrame:
    """R6. 1 to 5 from structure alone; every pattern runs once over the text."""
    staged = df.withColumn("_text", response)
    c = F.col("_text")
    seen = staged.select(
        "*", F.lower(c).alias("_low"), count_matches(c, STEP_LINE).alias("_steps"),
        count_matches(c, CITATIONS_SHORT).alias("_cites"), c.rlike(VERSIONS_SHORT).alias("_version"),
    )
    low, steps, cites = F.col("_low"), F.col("_steps"), F.col("_cites")
    shows_config = (
        F.contains(low, F.lit("```")) | F.contains(low, F.lit("interface ")) | F.contains(low, F.lit("router bgp"))
    )
    score = F.lit(1.0) + F.when(F.contains(low, F.lit("<think>")), 1.0).otherwise(0.0)
    score = score + F.when(steps >= 8, 1.0).when(steps >= 5, 0.7).when(steps >= 3, 0.4).otherwise(0.0)
    score = score + F.when(cites >= 5, 1.0).when(cites >= 3, 0.6).when(cites >= 1, 0.3).otherwise(0.0)
    score = score + F.when(F.col("_version"), 0.5).otherwise(0.0)
    score = score + F.when(shows_config, 0.5).otherwise(0.0)
    return seen.withColumn(name, F.least(F.lit(5.0), score)).drop("_text", "_low", "_steps", "_cites", "_version")


def band(score: Column, good: float = 0.70, fair: float = 0.45) -> Column:
    """P4."""
    return F.when(score >= good, "PASS").when(score >= fair, "WARN").otherwise("FAIL")


def keyword_score(
    df: DataFrame,
    raw: str = "raw",
    expected: str = "expected_key_facts",
    required: str = "sources_required",
    confidence: str = "confidence",
    has_think: str = "has_think_block",
) -> DataFrame:
    """R7 with J3/J4: keywords and sources found in the response, weighted total and band."""
    lowered = df.withColumn("_lower", F.lower(F.col(raw)))
    none = F.array().cast("array<string>")
    keywords, sources = F.coalesce(F.col(expected), none), F.coalesce(F.col(required), none)
    text = F.col("_lower")

    def source_named(source: Column) -> Column:
        long_words = F.filter(F.split(F.lower(source), r"(?U)\s+"), lambda w: F.length(w) > 4)
        return F.exists(long_words, lambda w: F.contains(text, w))

    found = lowered.select(
        "*",
        F.filter(keywords, lambda k: F.contains(text, F.lower(k))).alias("keywords_found"),
        F.filter(keywords, lambda k: ~F.contains(text, F.lower(k))).alias("keywords_missing"),
        F.filter(sources, source_named).alias("sources_found"),
    ).drop("_lower")
    one = F.lit(1)
    scored = found.select(
        "*",
        (F.size("keywords_found") / F.greatest(F.size(keywords), one)).alias("keyword_score"),
        (F.size("sources_found") / F.greatest(F.size(sources), one)).alias("source_score"),
    )
    total = (
        F.lit(0.50) * F.col("keyword_score")
        + F.lit(0.20) * F.col("source_score")
        + F.lit(0.20) * F.col(confidence)
        + F.when(F.col(has_think), 0.10).otherwise(0.0)
    )
    summed = scored.withColumn("_total", total)
    rounded = summed.withColumn("overall_score", round_exact(F.col("_total"), 3)).drop("_total")
    return rounded.withColumn("pass_fail", band(F.col("overall_score")))


def source_attribution(df: DataFrame, text: str) -> DataFrame:
    """R8. Domains cited, citation count, version strings."""
    staged = df.withColumn("_lower", F.lower(F.col(text)))
    c, lowered = F.col(text), F.col("_lower")
    cited = F.filter(
        F.array(*[F.when(contains_any(lowered, t), d) for d, t in DOMAIN_TITLES.items()]),
        lambda d: d.isNotNull(),
    )
    return staged.select(
        *df.columns,
        cited.alias("domains_cited"),
        count_matches(c, CITATIONS_LONG).alias("citation_count"),
        all_matches(c, VERSIONS_LONG).alias("compliance_versions"),
    )


def claim_alignment(df: DataFrame, text: str, claims: list[tuple] = CLAIMS) -> DataFrame:
    """R9 with J5: per claim null when it does not apply, else whether the text states it."""
    lowered = df.withColumn("_lower", F.lower(F.col(text)))
    c = F.col("_lower")
    verdicts = F.array(
        *[
            F.when(
                contains_any(c, context),
                F.struct(F.lit(f"{domain}/{claim}").alias("claim"), c.rlike("(?dU)" + pattern).alias("aligned")),
            )
            for domain, claim, pattern, context in claims
        ]
    )
    judged = lowered.withColumn("_v", F.filter(verdicts, lambda v: v.isNotNull())).drop("_lower")
    failed = F.transform(F.filter("_v", lambda v: ~v.aligned), lambda v: v.claim)
    with_lists = judged.select(
        "*", F.size("_v").alias("applicable"), failed.alias("failed_claims")
    ).drop("_v")
    aligned = F.col("applicable") - F.size("failed_claims")
    return with_lists.select(
        "*",
        aligned.alias("aligned"),
        F.when(F.col("applicable") == 0, 1.0).otherwise(aligned / F.col("applicable")).alias("claim_score"),
    )


def alignment_score(df: DataFrame, text: str) -> DataFrame:
    """R10. Half claims, three tenths domains, one fifth citations."""
    scored = claim_alignment(source_attribution(df, text), text)
    one = F.lit(1.0)
    return scored.withColumn(
        "alignment_score",
        F.col("claim_score") * 0.50
        + F.least(one, F.size("domains_cited") / 3) * 0.30
        + F.least(one, F.col("citation_count") / 5) * 0.20,
    )

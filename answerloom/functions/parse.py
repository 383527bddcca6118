"""Raw model responses into columns: three flavours of parsing, costs, steps, judge output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.fixed.sources import CITATION_WORDS
from answerloom.functions.text import all_matches, count_matches, strip

# Patterns.
THINK = r"(?s)<think>(.*?)</think>"
THINK_ANY_CASE = r"(?isu)<think>(.*?)</think>"
AFTER_THINK = r"(?s)<think>.*?</think>(.*)"
STEP_COLON = r"(?dmU)^Step\s+\d+:"
STEP_COLON_OR_DOT = r"(?dmU)^Step\s+\d+[:\.]"
STEP_WORD = r"(?iuU)\bStep\s+\d+"
SOURCE_MARK = r"(?iuU)\[Source:\s*([^\]]+)\]|Source:\s*([^\n]+)"
SPECIAL_TOKEN = r"<\|[^|]+\|>"
BRACKET_CITATION = r"\[([^\[\]]+(?:" + "|".join(CITATION_WORDS) + r")[^\[\]]*)\]"
RFC = r"(?U)RFC\s+\d{3,5}"
STANDARD = r"(?U)(?:PCI-DSS|HIPAA|NIST CSF|ISO 27001)\s+[\d.]+"
BRACKET_ANY = r"\[([^\]]{4,80})\]"
RFC_WORD = r"(?iuU)\bRFC\s+\d{3,5}\b"
STANDARD_WORD = r"(?iuU)\b(PCI-DSS|HIPAA|NIST CSF|IEEE 802\.\S+|3GPP|ITU-T)\b"
CAPEX_API = r"(?U)CAPEX[:\s\$]*([0-9,]+(?:\.[0-9]+)?)\s*([MKmk]?)"
OPEX_API = r"(?U)(?:annual\s+)?OPEX[:\s\$]*([0-9,]+(?:\.[0-9]+)?)\s*([MKmk]?)"
CAPEX_AGENT = r"(?iuU)CAPEX[:\s]+\$?([\d,]+(?:\.\d+)?)\s*([MK]?)"
OPEX_AGENT = r"(?iuU)annual\s+OPEX[:\s]+\$?([\d,]+(?:\.\d+)?)\s*([MK]?)"
STEP_BLOCK = r"(?U)Step\s+\d+[^\n]*(?:\n(?!Step\s+\d)[^\n]*)*"
JUDGE_SCORE = r'"score"(?U)\s*:\s*([1-5](?:\.\d)?)'


def _source_marks(raw: Column) -> Column:
    bracketed = all_matches(raw, SOURCE_MARK, 1)
    to_line_end = all_matches(raw, SOURCE_MARK, 2)
    picked = F.zip_with(
        bracketed, to_line_end, lambda b, e: strip(F.when(b != "", b).otherwise(e))
    )
    return F.array_sort(F.array_distinct(picked))


def parse_basic(df: DataFrame, raw: str = "raw") -> DataFrame:
    """R1. ``reasoning`` keeps its tags; an answer without a block stays as it is."""
    c = F.col(raw)
    has = c.rlike(THINK)
    think = F.regexp_extract(c, THINK, 1)
    return df.select(
        "*",
        F.regexp_extract(c, THINK, 0).alias("reasoning"),
        F.when(has, strip(F.regexp_extract(c, AFTER_THINK, 1))).otherwise(c).alias("answer"),
        _source_marks(c).alias("sources"),
        has.alias("has_think_block"),
        count_matches(think, STEP_COLON).alias("reasoning_steps"),
    )


def parse_strict(df: DataFrame, raw: str = "raw") -> DataFrame:
    """R2. ``reasoning`` without tags; special tokens leave the answer."""
    c = F.col(raw)
    has = c.rlike(THINK)
    reasoning = strip(F.regexp_extract(c, THINK, 1))
    rest = F.when(has, F.regexp_extract(c, AFTER_THINK, 1)).otherwise(c)
    sources = F.array_distinct(
        F.concat(all_matches(c, BRACKET_CITATION, 1), all_matches(c, RFC), all_matches(c, STANDARD))
    )
    return df.select(
        "*",
        reasoning.alias("reasoning"),
        strip(F.regexp_replace(strip(rest), SPECIAL_TOKEN, "")).alias("answer"),
        sources.alias("sources"),
        has.alias("has_think_block"),
        count_matches(reasoning, STEP_COLON_OR_DOT).alias("reasoning_steps"),
    )


def parse_suite(df: DataFrame, raw: str = "raw") -> DataFrame:
    """R3. Any-case tags, every block removed, steps looked for in the answer as well."""
    c = F.col(raw)
    parsed = df.select(
        "*",
        strip(F.regexp_extract(c, THINK_ANY_CASE, 1)).alias("reasoning"),
        strip(F.regexp_replace(c, THINK_ANY_CASE, "")).alias("answer"),
        F.array_distinct(
            F.concat(
                all_matches(c, BRACKET_ANY, 1),
                all_matches(c, RFC_WORD),
                all_matches(c, STANDARD_WORD, 1),
            )
        ).alias("sources"),
        c.rlike(THINK_ANY_CASE).alias("has_think_block"),
    )
    where = F.when(F.col("reasoning") != "", F.col("reasoning")).otherwise(F.col("answer"))
    return parsed.withColumn("reasoning_steps", count_matches(where, STEP_WORD))


PARSERS = {"basic": parse_basic, "strict": parse_strict, "suite": parse_suite}


def parse_responses(df: DataFrame, flavor: str = "basic", raw: str = "raw") -> DataFrame:
    return PARSERS[flavor](df, raw)


def _amount(c: Column, pattern: str) -> Column:
    number = F.regexp_replace(F.regexp_extract(c, pattern, 1), ",", "").try_cast("double")
    suffix = F.upper(F.regexp_extract(c, pattern, 2))
    return number * F.when(suffix == "M", 1_000_000.0).when(suffix == "K", 1_000.0).otherwise(1.0)


def extract_cost(answer: Column, flavor: str = "api") -> Column:
    """R23. struct<capex, annual_opex, currency>; the agent flavour is null without figures."""
    if flavor == "api":
        capex, opex = _amount(answer, CAPEX_API), _amount(answer, OPEX_API)
    else:
        capex, opex = _amount(answer, CAPEX_AGENT), _amount(answer, OPEX_AGENT)
    cost = F.struct(
        capex.alias("capex"), opex.alias("annual_opex"), F.lit("USD").alias("currency")
    )
    if flavor == "api":
        return cost
    zero = F.lit(0.0)
    return F.when((F.coalesce(capex, zero) != 0) | (F.coalesce(opex, zero) != 0), cost)


def remediation_steps(answer: Column) -> Column:
    """R24. ``Step N`` blocks, or the whole answer when there is none."""
    steps = all_matches(answer, STEP_BLOCK)
    return F.when(F.size(steps) > 0, steps).otherwise(F.array(answer))


def parse_judgement(raw: Column) -> Column:
    """R25. struct<score, rationale>: JSON, else the score by pattern, else 3.0.

    Output that parses as JSON but is no object, or whose score is no number, counts as an
    error of the judge and gets 3.0 too.
    """
    doc = F.try_parse_json(raw)
    as_object = F.try_variant_get(doc, "$", "map<string,variant>")
    given = F.try_variant_get(doc, "$.score", "double")
    has_score = F.array_contains(F.map_keys(as_object), "score")
    clamped = F.greatest(F.lit(1.0), F.least(F.lit(5.0), given))
    by_pattern = F.regexp_extract(raw, JUDGE_SCORE, 1).try_cast("double")
    rationale = F.coalesce(F.try_variant_get(doc, "$.rationale", "string"), F.lit(""))

    def verdict(score: Column, why: Column) -> Column:
        return F.struct(score.cast("double").alias("score"), why.alias("rationale"))

    default = F.lit(3.0)
    return (
        F.when(as_object.isNotNull() & ~has_score, verdict(default, rationale))
        .when(as_object.isNotNull() & given.isNotNull(), verdict(clamped, rationale))
        .when(doc.isNotNull(), verdict(default, F.lit("Error: no usable score")))
        .when(by_pattern.isNotNull(), verdict(by_pattern, F.lit("Parsed from malformed JSON")))
        .otherwise(verdict(default, F.lit("Parse error")))
    )

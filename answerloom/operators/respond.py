"""Responders and judges: user functions from prompts to raw text, one failure per row."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.fixed import templates
from answerloom.functions.parse import parse_judgement, parse_responses
from answerloom.functions.prompts import filled
from answerloom.functions.text import cut
from answerloom.session import cut_lineage


def respond(df: DataFrame, fn: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """X2. Adds ``raw``, ``latency_ms`` and ``error``; a prompt that fails does not stop others.

    Spark spreads the rows; each task calls ``fn`` on its Arrow batches.
    """
    added = [
        T.StructField("raw", T.StringType()), T.StructField("latency_ms", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
    schema = T.StructType(df.schema.fields + added)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws, times, errors = [], [], []
            for text in batch[prompt]:
                begun = time.perf_counter()
                try:
                    raw, error = (fn(text), None) if text else (None, None)
                except Exception as exc:
                    raw, error = None, str(exc)
                raws.append(raw)
                times.append((time.perf_counter() - begun) * 1000 if raw is not None else None)
                errors.append(error)
            yield batch.assign(raw=raws, latency_ms=times, error=errors)

    return df.mapInPandas(run, schema)


NO_ANSWER = "no recorded answer"


def prompt_key(prompt: Column) -> Column:
    """What a prompt is known by in a table of recorded answers; null for no prompt."""
    return F.when(prompt != "", F.sha2(prompt, 256))


def answer_from(df: DataFrame, answers: DataFrame, prompt: str = "prompt") -> DataFrame:
    """X2 with recorded answers (prompt_key, raw, latency_ms, error), one row a key, batch or stream.

    Adds ``raw``, ``latency_ms`` and ``error``; a prompt without a record has the error ``NO_ANSWER``. The prompts' texts
    are not part of the table.
    """
    keyed = df.withColumn("prompt_key", prompt_key(F.col(prompt)))
    known = answers.select("prompt_key", "raw", "latency_ms", F.col("error").alias("_error"), F.lit(True).alias("_known"))
    missing = F.col("_known").isNull() & F.col("prompt_key").isNotNull()
    joined = keyed.join(known, "prompt_key", "left")
    return joined.withColumn("error", F.when(missing, NO_ANSWER).otherwise(F.col("_error"))).drop("_error", "_known", "prompt_key")


def new_answers(df: DataFrame, fn: Callable[[str], str], answers: DataFrame | None = None, prompt: str = "prompt") -> DataFrame:
    """X2. Answers (prompt_key, raw, latency_ms, error) to the distinct prompts without a record: each is asked once, however often it stands in ``df``."""
    asked = df.select(prompt_key(F.col(prompt)).alias("prompt_key"), F.col(prompt).alias("prompt")).filter("prompt_key is not null")
    distinct = asked.groupBy("prompt_key").agg(F.any_value("prompt").alias("prompt"))
    if answers is not None:
        distinct = distinct.join(answers.select("prompt_key"), "prompt_key", "left_anti")
    return respond(distinct, fn).select("prompt_key", "raw", "latency_ms", "error")


def ask_once(df: DataFrame, fn: Callable[[str], str], answers: DataFrame | None = None, prompt: str = "prompt") -> DataFrame:
    """X2. ``answer_from`` recorded answers and, for prompts without one, new ones. What is asked is written down first, so that no
    retry or second use of the result asks again."""
    fresh = cut_lineage(new_answers(df, fn, answers, prompt))
    every = fresh if answers is None else answers.select(*fresh.columns).unionByName(fresh)
    return answer_from(df, every, prompt)


def batch_records(answered: DataFrame, flavor: str = "basic") -> DataFrame:
    """S8, U2. Result records and error records in one table; empty prompts write nothing.

    One projection tells them apart, so a responder behind ``answered`` is asked once per row.
    """
    asked = answered.filter(F.coalesce(F.col("prompt"), F.lit("")) != "")
    parsed = parse_responses(asked.withColumn("raw", F.coalesce("raw", F.lit(""))), flavor)
    good = F.col("error").isNull()
    return parsed.select(
        "id", "category", "prompt",
        *[F.when(good, F.col(c)).otherwise("").alias(c) for c in ("reasoning", "answer")],
        *[F.when(good, F.col(c)).alias(c) for c in ("sources", "latency_ms", "has_think_block", "reasoning_steps")],
        "error",
    )


def judge_form(question: Column, reasoning: Column, answer: Column, question_chars: int = 500, response_chars: int = 3000) -> Column:
    """X3, W9. The form shows beginnings, by default of the lengths it was made for."""
    response = F.concat_ws("\n\n", reasoning, answer)
    return filled(templates.JUDGE, question=cut(question, question_chars), response=cut(response, response_chars))


def judge(
    df: DataFrame, fn: Callable[[str], str] | None = None, recorded: DataFrame | None = None, question: str = "prompt", reasoning: str = "reasoning",
    answer: str = "answer", error_chars: int = 50,
) -> DataFrame:
    """X3, R25. Adds ``score``, ``rationale`` and ``judge_error``.

    Forms are looked up among ``recorded`` judgements (prompt_key, raw, latency_ms, error); equal forms without one go to ``fn`` once.
    A judgement that fails scores 3, as an unreadable one does; without ``fn`` a form that has none has no score.
    """
    form = judge_form(F.col(question), F.col(reasoning), F.col(answer))
    rows = df.drop("raw", "latency_ms", "error").withColumn("judge_prompt", form)
    judged = answer_from(rows, recorded, "judge_prompt") if fn is None else ask_once(rows, fn, recorded, "judge_prompt")
    failed = F.struct(F.lit(3.0).alias("score"), F.concat(F.lit("Error: "), cut(F.col("error"), error_chars)).alias("rationale"))
    verdict = (
        F.when(F.col("error") == NO_ANSWER, F.lit(None)).when(F.col("error").isNotNull(), failed)
        .otherwise(parse_judgement(F.coalesce("raw", F.lit(""))))
    )
    scored = judged.withColumn("judgement", verdict).withColumnRenamed("error", "judge_error")
    return scored.select("*", "judgement.score", "judgement.rationale").drop("raw", "latency_ms", "judgement")

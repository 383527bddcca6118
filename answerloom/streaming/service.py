"""Structured Streaming forms: task intake, metric windows, counters.

A bounded input gives the same rows as the batch operators. Event time carries a watermark
only to let Spark drop old state; rows later than that are dropped there. ``write_windows`` keeps no state and counts late rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from answerloom.fixed.wording import TASK_SYSTEM
from answerloom.functions.parse import parse_responses
from answerloom.functions.prompts import single_turn_prompt
from answerloom.functions.scores import with_confidence_strict
from answerloom.operators.monitor import combined, longer_windows, metric_parts, value_parts, window_start
from answerloom.operators.requests import (
    agent_requires_review, normalize_tasks, route, task_compliance, task_prompt, with_error_policy,
)
from answerloom.operators.respond import NO_ANSWER, answer_from, respond

LATENESS = "10 minutes"
#: Size of the quantile sketches, see ``monitor.value_parts``.
RANK_K = 4096


def read_tasks(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """S10. Queue messages as text lines; a Kafka source gives the same ``value`` column."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def system_text(task_type: Column) -> Column:
    """The system text of a task type, design's for an unknown one."""
    pairs = [F.lit(x) for pair in TASK_SYSTEM.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[task_type], F.lit(TASK_SYSTEM["design"]))


def asked_tasks(messages: DataFrame) -> DataFrame:
    """P9, R30, R27. Tasks with ``model_prompt``, null for a message that cannot be read."""
    tasks = task_prompt(normalize_tasks(messages).withColumnRenamed("error", "message_error"))
    whole = single_turn_prompt(system_text(F.col("type")), F.col("prompt"))
    return tasks.withColumn("model_prompt", F.when(F.col("message_error").isNull(), whole))


def answer_tasks(messages: DataFrame, answers: DataFrame | Callable[[str], str], threshold: float = 0.80) -> DataFrame:
    """T10. P9, R30, R27, X2, R2, R4, P6, P7 in one projection chain, batch or stream.

    ``answers`` are recorded ones (see ``respond.answer_from``), which a stream is joined with, or a responder. A message that cannot
    be read and a prompt that fails become error rows. A prompt without a record yet waits: its row has the status ``waiting``, the
    queue ``retry``, and ``message`` with the text to try again.
    """
    asked = asked_tasks(messages.withColumn("message", F.col("value")))
    answered = answer_from(asked, answers, "model_prompt") if isinstance(answers, DataFrame) else respond(asked, answers, "model_prompt")
    parsed = parse_responses(answered.withColumn("raw", F.coalesce("raw", F.lit(""))), "strict")
    scored = with_confidence_strict(parsed).withColumn("error", F.coalesce("message_error", "error"))
    reviewed = scored.withColumn(
        "requires_approval",
        agent_requires_review(F.col("confidence"), F.col("priority"), task_compliance(F.col("context")), threshold),
    )
    waits = F.coalesce(F.col("error") == NO_ANSWER, F.lit(False))
    routed = route(with_error_policy(reviewed))
    marked = {"status": F.when(waits, "waiting").otherwise(F.col("status")), "queue": F.when(waits, "retry").otherwise(F.col("queue")), "message": F.when(waits, F.col("message"))}
    return routed.withColumns(marked).select(
        "task_id", "type", "requestor", "correlation_id", "status", "queue", "error", "reasoning", "answer",
        "sources", "confidence", "requires_approval", "latency_ms", "message",
    )


def write_routed(answers: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """P7, T10. Each micro-batch goes once to ``path/batch=N``, partitioned by queue; ``queue=retry`` is the table of waiting messages.

    Writing a batch again replaces its own folder, so a restart leaves no copies.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("queue").json(f"{path}/batch={number}")

    return (
        answers.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(sink)
        .start()
    )


ROUTED = (
    "task_id string, type string, requestor string, correlation_id string, status string, error string, reasoning string, answer string, "
    "sources array<string>, confidence double, requires_approval boolean, latency_ms double, message string, batch bigint, queue string"
)


def read_routed(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_routed`` has written so far."""
    return spark.read.schema(ROUTED).json(path)


def retry_tasks(spark: SparkSession, path: str, answers: DataFrame) -> DataFrame:
    """T10. The waiting messages once more, with the answers recorded by now."""
    waiting = read_routed(spark, path).filter("queue = 'retry'").select(F.col("message").alias("value"))
    return answer_tasks(waiting, answers)


def windowed_parts(metrics: DataFrame, seconds: int = 300, lateness: str = LATENESS, rank_k: int = RANK_K) -> DataFrame:
    """T1 as a stream with state: the merging rows of tumbling windows. ``combined`` makes windows of any multiple of them."""
    timed = metrics.withWatermark("ts", lateness)
    parts = value_parts(timed, [F.window("ts", f"{seconds} seconds").alias("w"), "metric"], rank_k=rank_k)
    return parts.select("metric", F.unix_seconds("w.start").alias("window_start"), *[c for c in parts.columns if c not in ("w", "metric")])


def write_windows(metrics: DataFrame, path: str, checkpoint: str, seconds: int = 60, lateness: str = LATENESS, rank_k: int = RANK_K, **trigger) -> StreamingQuery:
    """T1 without state: each micro-batch adds its merging rows to ``path/parts/batch=N``.

    A row is late if its time lies more than ``lateness`` before the latest of all earlier micro-batches. Late rows are told
    apart before anything is added up, and counted in ``path/late/batch=N`` by metric and window: on time and late are all rows. Writing a
    batch again replaces its own folders, so a restart leaves no copies.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        latest = None
        if number:
            latest = spark.read.parquet(f"{path}/marks/batch={number - 1}").first()["latest"]
        late = F.lit(False) if latest is None else F.coalesce(F.col("ts") < F.lit(latest) - F.expr(f"INTERVAL {lateness}"), F.lit(False))
        metric_parts(rows.filter(~late), seconds, rank_k=rank_k).write.mode("overwrite").parquet(f"{path}/parts/batch={number}")
        behind = rows.filter(late).groupBy("metric", window_start(F.col("ts"), seconds).alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
        behind.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        now = rows.agg(F.greatest(F.max("ts"), F.lit(latest).cast("timestamp")).alias("latest"))
        now.write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        rows.unpersist()

    return metrics.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(sink).start()


def read_windows(spark: SparkSession, path: str, seconds: int, points: list[float]) -> DataFrame:
    """T1. Windows of ``seconds``, a multiple of those written, from all micro-batches so far."""
    parts = spark.read.parquet(f"{path}/parts")
    return combined(parts.withColumn("window_start", longer_windows(F.col("window_start"), seconds)), ["metric", "window_start"], points)


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """T1. Late rows by metric and window."""
    return spark.read.parquet(f"{path}/late").groupBy("metric", "window_start").agg(F.sum("n").alias("n"))


def sliding_error_rate(events: DataFrame, seconds: int = 300, lateness: str = LATENESS) -> DataFrame:
    """T6 as a stream: server errors per second, sliding by the minute."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", f"{seconds} seconds", "60 seconds").alias("w"))
        .agg((F.count_if(F.col("status_code") >= 500) / float(seconds)).alias("value"))
        .select(F.unix_seconds("w.end").alias("window_end"), "value")
    )


def counters(events: DataFrame, labels: list[str]) -> DataFrame:
    """T3 as a stream, for update mode."""
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))

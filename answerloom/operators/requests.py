"""Service requests and queue tasks: defaults, checks, review rules, routing, prompts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.functions.json_text import indented_json, python_text
from answerloom.functions.prompts import design_prompt, estimate_prompt, troubleshoot_prompt

# Defaults of request fields.
DEFAULTS = {
    "sites": 1, "uptime": 99.9, "budget": "flexible", "data_center": False, "wireless": True,
    "cloud_connectivity": False, "redundancy_level": "N+1", "max_tokens": 2048, "temperature": 0.7,
    "use_cache": True, "device": "unknown", "currency": "USD", "include_opex": True,
    "include_implementation": True,
}

# Limits of request fields (field, least, greatest).
LIMITS = [("uptime", 90.0, 100.0), ("max_tokens", 256, 4096), ("temperature", 0.0, 1.0), ("confidence", 0.0, 1.0)]
SYMPTOM_LENGTH = 10
CURRENCY = r"^[A-Z]{3}\z"


def validate_requests(df: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """P5. Fill defaults of the columns present, then list every broken rule in ``violations``.

    ``required`` names columns that must not be null. Rows are kept: filter on
    ``size(violations) = 0`` for the valid side and on the rest for the quarantine.
    """
    filled = df.select(
        *[
            F.coalesce(F.col(c), F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS
            else F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) if c == "compliance"
            else F.col(c)
            for c in df.columns
        ]
    )
    rules = [F.when(F.col(c).isNull(), f"{c}: required") for c in required]
    for field, least, greatest in LIMITS:
        if field in df.columns:
            rules.append(F.when(~F.col(field).between(least, greatest), f"{field}: not in {least}..{greatest}"))
    if "symptom" in df.columns:
        rules.append(F.when(F.length("symptom") < SYMPTOM_LENGTH, f"symptom: shorter than {SYMPTOM_LENGTH}"))
    if "currency" in df.columns:
        rules.append(F.when(~F.col("currency").rlike(CURRENCY), "currency: not three capital letters"))
    return filled.withColumn("violations", F.array_compact(F.array(*rules)))


def _named(compliance: Column) -> Column:
    return F.coalesce(F.size(compliance), F.lit(0)) > 0


def api_requires_review(confidence: Column, compliance: Column, uptime: Column) -> Column:
    """P6."""
    return (confidence < 0.80) | _named(compliance) | (uptime >= 99.99)


def agent_requires_review(
    confidence: Column, priority: Column, compliance: Column, threshold: float = 0.80
) -> Column:
    """P6. Always a boolean."""
    return (confidence < threshold) | (F.coalesce(priority, F.lit("medium")) == "high") | _named(compliance)


def policy_requires_review(confidence: Column, compliance: Column, uptime: Column) -> Column:
    """P6. Only the standards the approval policy lists."""
    listed = F.coalesce(F.arrays_overlap(compliance, F.array(F.lit("PCI-DSS"), F.lit("HIPAA"))), F.lit(False))
    return listed | (uptime >= 99.99) | (confidence < 0.80)


def with_error_policy(results: DataFrame) -> DataFrame:
    """P7. An error row has confidence zero and always needs approval."""
    failed = F.col("error").isNotNull()
    return results.select(
        *[c for c in results.columns if c not in ("confidence", "requires_approval")],
        F.when(failed, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        (failed | F.col("requires_approval")).alias("requires_approval"),
        F.when(failed, "error").otherwise("success").alias("status"),
    )


def route(results: DataFrame) -> DataFrame:
    """P7. ``queue`` is where the row goes; write it partitioned by this column, one pass."""
    return results.withColumn("queue", F.when(F.col("requires_approval"), "approval").otherwise("done"))


MESSAGE = T.StructType(
    [
        T.StructField("message_id", T.StringType()), T.StructField("message_type", T.StringType()),
        T.StructField("from_agent", T.StringType()), T.StructField("task_id", T.StringType()),
        T.StructField("correlation_id", T.StringType()), T.StructField("payload", T.StringType()),
    ]
)
PAYLOAD = T.StructType(
    [
        T.StructField("task_type", T.StringType()), T.StructField("type", T.StringType()),
        T.StructField("context", T.StringType()), T.StructField("priority", T.StringType()),
    ]
)


def normalize_tasks(messages: DataFrame, value: str = "value") -> DataFrame:
    """P9. Queue message text to (task_id, type, context, priority, requestor, correlation_id).

    Nested context stays JSON text. A message without a task id gets one from its own text, so
    a retried batch gives the same id. Text that is no message gives an error row.
    """
    m = messages.withColumn("_m", F.from_json(F.col(value), MESSAGE))
    p = m.withColumn("_p", F.from_json("_m.payload", PAYLOAD))
    broken = F.coalesce(F.col("_m.payload"), F.col("_m.task_id"), F.col("_m.message_id")).isNull()
    task_id = F.coalesce("_m.task_id", "_m.message_id", F.sha2(F.coalesce(F.col(value), F.lit("")), 256))
    return p.select(
        *[c for c in messages.columns if c != value],
        task_id.alias("task_id"),
        F.coalesce("_p.task_type", "_p.type", F.lit("design")).alias("type"),
        F.coalesce("_p.context", "_m.payload", F.lit("{}")).alias("context"),
        F.coalesce("_p.priority", F.lit("medium")).alias("priority"),
        F.coalesce("_m.from_agent", F.lit("team_leader")).alias("requestor"),
        F.coalesce(F.col("_m.correlation_id"), task_id).alias("correlation_id"),
        F.when(broken, "not a task message").alias("error"),
    )


PROMPT_FIELDS = ["users", "sites", "compliance", "uptime", "budget"]


def task_compliance(context: Column) -> Column:
    """Compliance named in the context or in its requirements."""
    return F.coalesce(
        F.from_json(F.get_json_object(context, "$.compliance"), "array<string>"),
        F.from_json(F.get_json_object(context, "$.requirements.compliance"), "array<string>"),
        F.array().cast("array<string>"),
    )


def task_prompt(tasks: DataFrame) -> DataFrame:
    """R30 for normalised tasks: adds ``prompt`` by task type. The context is parsed once."""
    parsed = tasks.withColumn("_c", F.from_json("context", "map<string,string>"))
    nested = parsed.withColumn(
        "_r", F.coalesce(F.from_json(F.col("_c")["requirements"], "map<string,string>"), F.col("_c"))
    )
    r, c = F.col("_r"), F.col("_c")
    design = {
        "users": r["users"], "sites": r["sites"], "uptime": r["uptime"].try_cast("double"), "uptime_shown": r["uptime"], "budget": r["budget"],
        "compliance": F.from_json(r["compliance"], "array<string>"),
        "extras": F.map_filter(r, lambda k, v: ~k.isin(PROMPT_FIELDS)),
    }
    fault = {n: c[n] for n in ("device", "symptom", "message", "protocol", "impact", "logs")}
    prompt = (
        F.when(F.col("type") == "design", design_prompt(design, "agent"))
        .when(F.col("type") == "troubleshoot", troubleshoot_prompt(fault, "agent"))
        .when(F.col("type") == "estimate", estimate_prompt({"context_json": indented_json(F.col("context"))}, "agent"))
        .otherwise(python_text(F.col("context")))
    )
    return nested.withColumn("prompt", prompt).drop("_r", "_c")

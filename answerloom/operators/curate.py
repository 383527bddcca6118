"""Clean, describe and split chat samples.

A *sample digest* has one row per sample with the few values the rules need instead of its
messages: ``sample_id, n_messages, has_user, first_print, first_given, last_chars, thinks,
steps, citations, total_chars``, metadata columns, and ``sample_facts`` and ``accuracy_facts``, what
the rules read of the first answer. It is built from an array column or, for samples kept one
message per row, by aggregates that combine on the map side: a conversation of any length is
never collected, and its texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.fixed.rules import DATASET_GATES, TOPIC_TARGETS
from answerloom.functions.checks import with_answer_facts
from answerloom.functions.scores import CITATIONS_SHORT
from answerloom.functions.text import count_matches, cut, strip, text_or_empty

STEP_LINE = r"(?dmU)^Step\s+\d+:"


def first_message(messages: Column) -> Column:
    """P1."""
    return F.try_element_at(messages, F.lit(1))


def last_message(messages: Column) -> Column:
    """P1."""
    return F.try_element_at(messages, F.lit(-1))


def first_of_role(messages: Column, role: str) -> Column:
    """P1."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))


def has_role(messages: Column, role: str) -> Column:
    """P1."""
    return F.coalesce(F.exists(messages, lambda m: m["role"] == role), F.lit(False))


def fingerprint(prompt: Column, prefix_chars: int | None = None) -> Column:
    """W1: SHA-256 of the whole text, lower-cased and stripped; null counts as empty.

    ``prefix_chars`` compares beginnings instead, cut before they are stripped; 200 is the original's choice.
    """
    given = text_or_empty(prompt)
    return F.sha2(strip(F.lower(given if prefix_chars is None else cut(given, prefix_chars))), 256)


def _first_facts(content: Column) -> Column:
    given = text_or_empty(content)
    return F.struct(fingerprint(given).alias("first_print"), (given != "").alias("first_given"))


def _last_facts(content: Column) -> Column:
    """Steps count only where the last message opens a reasoning block."""
    given = text_or_empty(content)
    thinks = F.contains(given, F.lit("<think>"))
    return F.struct(
        F.length(given).alias("last_chars"), thinks.alias("thinks"),
        F.when(thinks, count_matches(given, STEP_LINE)).otherwise(0).alias("steps"),
    )


def _citations(content: Column) -> Column:
    return count_matches(text_or_empty(content), CITATIONS_SHORT)


def digest_messages(samples: DataFrame, sample_id: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """Digest of samples with a ``messages`` array and a ``metadata`` struct; ``keep`` passes columns on."""
    m, meta = F.col("messages"), F.col("metadata")
    scenario = meta["scenario"]
    picked = samples.select(
        F.col(sample_id).alias("sample_id"), "metadata", "messages", *keep,
        _first_facts(first_message(m)["content"]).alias("_first"),
        _last_facts(last_message(m)["content"]).alias("_last"),
        first_of_role(m, "assistant")["content"].alias("_a"),
    )
    return with_answer_facts(picked, "_a").select(
        "sample_id", *keep,
        F.greatest(F.coalesce(F.size(m), F.lit(0)), F.lit(0)).alias("n_messages"),
        has_role(m, "user").alias("has_user"),
        "_first.first_print", "_first.first_given", "_last.last_chars", "_last.thinks", "_last.steps",
        _citations(F.col("_a")).alias("citations"),
        F.aggregate(
            F.coalesce(m, F.array().cast(samples.schema["messages"].dataType)),
            F.lit(0).cast("bigint"),
            lambda acc, x: acc + F.length(text_or_empty(x["content"])),
        ).alias("total_chars"),
        "sample_facts", "accuracy_facts",
        meta["type"].alias("type"),
        meta["category"].alias("category"),
        scenario["user_count"].cast("bigint").alias("user_count"),
        scenario["compliance"].alias("compliance"),
        meta["sources_used"].alias("sources_used"),
        meta["reasoning_steps"].cast("bigint").alias("reasoning_steps"),
    )


def digest_turns(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Digest of samples stored one message per row; partial aggregates, nothing collected."""
    is_assistant = F.col(role) == "assistant"
    rows = with_answer_facts(turns.withColumn("_a", F.when(is_assistant, F.col(text))), "_a").select(
        F.col(key).alias("sample_id"), F.col(order).alias("_order"), F.col(role).alias("_role"),
        F.length(text_or_empty(F.col(text))).alias("_chars"),
        _first_facts(F.col(text)).alias("_f"), _last_facts(F.col(text)).alias("_l"),
        F.when(is_assistant, _citations(F.col(text))).alias("_c"), "sample_facts", "accuracy_facts",
    )
    at_assistant = F.when(F.col("_role") == "assistant", F.col("_order"))
    merged = rows.groupBy("sample_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_messages"),
        F.bool_or(F.col("_role") == "user").alias("has_user"),
        F.min_by("_f", "_order").alias("_first"),
        F.max_by("_l", "_order").alias("_last"),
        F.coalesce(F.min_by("_c", at_assistant), F.lit(0)).alias("citations"),
        F.sum("_chars").cast("bigint").alias("total_chars"),
        *[F.min_by(name, at_assistant).alias(name) for name in ("sample_facts", "accuracy_facts")],
    )
    return merged.select(
        "sample_id", "n_messages", "has_user", "_first.first_print", "_first.first_given", "_last.last_chars",
        "_last.thinks", "_last.steps", "citations", "total_chars", "sample_facts", "accuracy_facts",
    )


def pick_turns(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """P1 for samples stored one message per row: first, last and first assistant text."""
    by_assistant = F.when(F.col(role) == "assistant", F.col(order))
    return turns.groupBy(F.col(key).alias("sample_id")).agg(
        F.min_by(text, order).alias("first_content"),
        F.max_by(text, order).alias("last_content"),
        F.min_by(F.col(text), by_assistant).alias("assistant_content"),
        F.bool_or(F.col(role) == "user").alias("has_user"),
    )


def duplicate_groups(df: DataFrame, prompt: Column, order: str, prefix_chars: int | None = None) -> DataFrame:
    """Fingerprints that occur more than once, with the row to keep and the number of rows."""
    # The second key follows from the first. It keeps the result from being partitioned as a later join by
    # fingerprint wants it, so both sides of that join are plain exchanges, which Spark splits at hot keys.
    return (
        df.select(fingerprint(prompt, prefix_chars).alias("_fp"), F.col(order))
        .groupBy("_fp", F.substring("_fp", 1, 1))
        .agg(F.min(order).alias("_keep"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").select("_fp", "_keep", "_n")
    )


def deduplicate(df: DataFrame, prompt: Column, order: str, prefix_chars: int | None = None) -> DataFrame:
    """W1. Keep the first row of every fingerprint in ``order`` (unique per row).

    Copies combine on the map side, and the whole rows meet nothing but the list of repeated
    fingerprints; how they meet is Spark's choice by size. Pass ``to_json(struct(*))`` as prompt for
    rows without messages.
    """
    groups = duplicate_groups(df, prompt, order, prefix_chars).select("_fp", "_keep")
    marked = df.withColumn("_fp", fingerprint(prompt, prefix_chars)).join(groups, "_fp", "left")
    return marked.filter(F.col("_keep").isNull() | (F.col(order) == F.col("_keep"))).drop("_fp", "_keep")


def is_valid_sample() -> Column:
    """P2 on a digest: two messages, something asked, an answer of 100 characters."""
    return (F.col("n_messages") >= 2) & F.col("first_given") & (F.col("last_chars") >= 100)


def validate_samples(digest: DataFrame) -> DataFrame:
    return digest.filter(is_valid_sample())


def count_valid(digest: DataFrame) -> DataFrame:
    """P2: both counts in one pass."""
    return digest.agg(
        F.count_if(is_valid_sample()).alias("valid"),
        F.count_if(~is_valid_sample()).alias("invalid"),
    )


def dataset_stats(digest: DataFrame) -> DataFrame:
    """A1."""
    totals = digest.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("thinks").alias("t"),
        F.coalesce(F.sum("steps"), F.lit(0)).alias("s"),
        F.coalesce(F.sum("total_chars"), F.lit(0)).alias("chars"),
    )
    n = F.greatest(F.col("total"), F.lit(1))
    return totals.select(
        "total",
        (F.col("t") / n).alias("think_block_rate"),
        (F.col("chars") / n).alias("avg_response_chars"),
        (F.col("s") / F.greatest(F.col("t"), F.lit(1))).alias("avg_reasoning_steps"),
    )


def count_by_type(digest: DataFrame) -> DataFrame:
    """A2. Type alone, without the category fallback of the split."""
    return digest.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(
        F.count(F.lit(1)).alias("n")
    )


def stratum_of() -> Column:
    return F.coalesce(F.col("type"), F.col("category"), F.lit("unknown"))


def seeded_order(seed: int, key: Column) -> Column:
    """W8: the sort key of a seeded shuffle, the same on every run and partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """W8. A range sort by the seeded key."""
    return df.orderBy(seeded_order(seed, F.col(key)), key)


def seeded_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """W4. ``k`` rows by seeded order: a top-k, no full sort."""
    return df.orderBy(seeded_order(seed, F.col(key)), key).limit(k)


def first_rows(df: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """P3. The first ``n`` input rows, for the reports that ask for a limited run."""
    return df.orderBy(order).limit(n)


def _split_points(
    df: DataFrame, key: str, stratum: Column, train: float, val: float, seed: int, stratified: bool,
    hex_digits: int,
) -> DataFrame:
    """Per stratum the (hash, key) of its last train row and its last validation row."""
    keyed = df.select(
        stratum.alias("_stratum"), F.col(key).alias("_key"),
        seeded_order(seed, F.col(key)).alias("_hash"),
    ).withColumn("_bucket", F.substring("_hash", 1, hex_digits))
    counts = keyed.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy("_stratum").orderBy("_bucket")
    running = counts.withColumn("_end", F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    sized = running.withColumn("_total", F.sum("_n").over(Window.partitionBy("_stratum")))
    train_end = F.floor(F.col("_total") * F.lit(train))
    val_end = F.floor(F.col("_total") * F.lit(train + val))
    if stratified:
        train_end = F.greatest(F.lit(1), train_end)
        val_end = F.greatest(train_end + 1, val_end)
    cuts = sized.withColumn("_train_end", train_end).withColumn("_val_end", val_end)
    begins = F.col("_end") - F.col("_n")
    holding = cuts.select(
        "_stratum", "_bucket", begins.alias("_begin"), "_train_end",
        F.least("_val_end", "_total").alias("_val_end"), "_end",
    ).filter(
        ((F.col("_begin") < F.col("_train_end")) & (F.col("_train_end") <= F.col("_end")))
        | ((F.col("_begin") < F.col("_val_end")) & (F.col("_val_end") <= F.col("_end")))
    )
    # Only the one or two buckets per stratum that hold a cut are ranked.
    near = keyed.join(holding, ["_stratum", "_bucket"])
    place = F.col("_begin") + F.row_number().over(
        Window.partitionBy("_stratum", "_bucket").orderBy("_hash", "_key")
    )
    mark = F.struct("_hash", "_key")
    return (
        near.withColumn("_place", place)
        .groupBy("_stratum")
        .agg(
            F.max(F.when(F.col("_place") == F.col("_train_end"), mark)).alias("_train_mark"),
            F.max(F.when(F.col("_place") == F.col("_val_end"), mark)).alias("_val_mark"),
        )
    )


def _split(
    df: DataFrame, key: str, stratum: Column | None, train: float, val: float, seed: int, stratified: bool,
    hex_digits: int,
) -> DataFrame:
    """Without a stratum both marks are single values, read as subqueries: there is nothing to join on."""
    points = _split_points(df, key, F.lit("all") if stratum is None else stratum, train, val, seed, stratified, hex_digits)
    mark = F.struct(
        seeded_order(seed, F.col(key)).alias("_hash"), F.col(key).alias("_key")
    )
    if stratum is None:
        placed = df.withColumns({name: points.select(name).scalar() for name in ("_train_mark", "_val_mark")})
    else:
        placed = df.withColumn("_stratum", stratum).join(points, "_stratum", "left")
    return placed.withColumn(
        "split",
        F.when(mark <= F.col("_train_mark"), "train").when(mark <= F.col("_val_mark"), "val").otherwise("test"),
    ).drop("_stratum", "_train_mark", "_val_mark")


def split_stratified(
    df: DataFrame, key: str, stratum: Column, train: float = 0.8, val: float = 0.1, seed: int = 42,
    hex_digits: int = 4,
) -> DataFrame:
    """W2. Exact counts per stratum: at least one train row, then at least one validation row.

    No stratum is sorted as a whole. Rows are counted per hash bucket, the buckets that hold a
    cut are ranked, and every row is then compared with the two cut marks of its stratum.
    """
    return _split(df, key, stratum, train, val, seed, True, hex_digits)


def split_random(
    df: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42, hex_digits: int = 4
) -> DataFrame:
    """W3. One stratum, plain cut points."""
    return _split(df, key, None, train, val, seed, False, hex_digits)


def dataset_gates(digest: DataFrame, gates: dict = DATASET_GATES) -> DataFrame:
    """A17. Citations, step range and duplicate ratio against the declared limits."""
    rows = digest.select(
        F.col("first_print").alias("fp"), F.col("citations").alias("cites"),
        F.coalesce("reasoning_steps", F.lit(0)).alias("steps"),
    )
    enough = F.col("cites") >= gates["min_citations_per_sample"]
    in_range = F.col("steps").between(gates["min_reasoning_steps"], gates["max_reasoning_steps"])
    # Copies meet on the map side; the second aggregate sees one row per fingerprint.
    per_print = rows.groupBy("fp").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(enough).alias("c"), F.count_if(in_range).alias("s")
    )
    totals = per_print.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("samples"),
        F.count(F.lit(1)).alias("distinct_samples"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("enough_citations"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("steps_in_range"),
    )
    ratio = F.lit(1.0) - F.col("distinct_samples") / F.greatest(F.col("samples"), F.lit(1))
    shown = totals.withColumn("duplicate_ratio", F.when(F.col("samples") == 0, 0.0).otherwise(ratio))
    return shown.withColumn(
        "passed",
        (F.col("duplicate_ratio") <= gates["max_duplicate_ratio"])
        & (F.col("enough_citations") == F.col("samples"))
        & (F.col("steps_in_range") == F.col("samples")),
    )


def plan_vs_actual(topics: DataFrame, targets: DataFrame) -> DataFrame:
    """A20. ``targets(kind, topic, target)`` beside the counts of ``topics(kind, topic)``."""
    counts = topics.groupBy("kind", "topic").agg(F.count(F.lit(1)).alias("actual"))
    return targets.join(counts, ["kind", "topic"], "left").select(
        "kind", "topic", "target",
        F.coalesce("actual", F.lit(0)).alias("actual"),
        (F.col("target") - F.coalesce("actual", F.lit(0))).alias("missing"),
    )


def topic_targets(spark) -> DataFrame:
    return spark.createDataFrame(TOPIC_TARGETS, "kind string, topic string, target bigint")

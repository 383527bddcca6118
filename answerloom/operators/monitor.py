"""Metrics of served requests: windows, percentiles, histograms, rates, alarms."""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerloom.fixed.alarms import CHANNELS, DURATION_ALARMS, THRESHOLD_ALARMS
from answerloom.functions import exact
from answerloom.session import cut_lineage

INFINITY = "+Inf"


def derive_metrics(events: DataFrame, endpoint: str = "task_type") -> DataFrame:
    """T2. One row per metric: (ts, metric, value, endpoint)."""

    def metric(name: str, value: Column, when: Column | None = None) -> Column:
        row = F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
        return row if when is None else F.when(when, row)

    rows = F.array(
        metric("InferenceLatency", F.col("latency_ms")),
        metric("ConfidenceScore", F.col("confidence")),
        metric("ThinkBlockPresent", F.col("has_think").cast("int")),
        metric("RequestCount", F.lit(1)),
        metric("ErrorCount", F.lit(1), F.col("status_code") >= 400),
    )
    return events.select("ts", F.col(endpoint).alias("endpoint"), F.inline(F.array_compact(rows)))


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window, as epoch seconds."""
    micros = F.unix_micros(ts)
    return ((micros - F.pmod(micros, F.lit(seconds * 1_000_000))) / 1_000_000).cast("bigint")


def value_parts(metrics: DataFrame, keys: list, value: str = "value", rank_k: int | None = None) -> DataFrame:
    """T1. Rows that merge: (keys, bin, n, counted, least, greatest, sums of the bin), one for each group and bin of exponents.

    One map-side aggregate. With ``rank_k`` each also has a KLL sketch of its values, which merge as well; a quantile's rank is off by
    2.3 / ``rank_k`` ^ 0.97 at most, with 99 % confidence (0.07 % for 4096), and by nothing up to about ``rank_k`` values.
    """
    x = F.col("_x")
    rows = metrics.withColumn("_x", F.col(value).cast("double")).withColumn("bin", exact.exponent_bin(x))
    rows = rows.withColumn("_whole", exact.scaled(x, F.col("bin")))
    sketch = [] if rank_k is None else [F.kll_sketch_agg_double(x, F.lit(rank_k)).alias("sketch")]
    return rows.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.count(x).alias("counted"), F.min(x).alias("least"), F.max(x).alias("greatest"),
        *exact.piece_sums(F.col("_whole"), x), *sketch,
    )


def metric_parts(metrics: DataFrame, seconds: int, by: tuple[str, ...] = ("metric",), rank_k: int | None = None) -> DataFrame:
    """T1. The merging rows of tumbling windows: (by, window_start, bin, ...)."""
    return value_parts(metrics, [*by, window_start(F.col("ts"), seconds).alias("window_start")], rank_k=rank_k)


def longer_windows(start: Column, seconds: int | Column) -> Column:
    return start - F.pmod(start, F.lit(seconds) if isinstance(seconds, int) else seconds)


def combined(parts: DataFrame, keys: list[str], points: list[float] | None = None) -> DataFrame:
    """T1. Groups of any parts: (keys, n, sum, average, least, greatest) and, from sketches, the quantiles ``points`` as p50, p95, ...

    The sum is that of all values, rounded once, whatever parts they came in. ``counted`` parts have a value; the average is over
    those, and NaN or infinite as the sum is.
    """
    sketch = [] if points is None else [F.kll_merge_agg_double("sketch").alias("sketch")]
    merge = [F.sum(c).alias(c) for c in ("n", "counted")]
    one_bin = parts.groupBy(*keys, "bin").agg(*merge, F.min("least").alias("least"), F.max("greatest").alias("greatest"), *exact.merged_sums(), *sketch)
    bins = F.collect_list(F.struct("bin", *exact.PIECES, *exact.SPECIAL)).alias("_bins")  # a row for each bin that occurs, 270 at most
    groups = one_bin.groupBy(*keys).agg(*merge, F.min("least").alias("least"), F.max("greatest").alias("greatest"), bins, *sketch)
    total = F.when(F.col("counted") > 0, exact.exact_total(F.col("_bins")))
    quantiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"p{round(p * 100)}") for p in points or []]
    return groups.withColumn("sum", total).select(*keys, "n", "sum", (F.col("sum") / F.col("counted")).alias("average"), "least", "greatest", *quantiles)


def metric_windows(metrics: DataFrame, seconds: int, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """T1. Tumbling windows with count, sum, average, least and greatest value."""
    return combined(metric_parts(metrics, seconds, by), [*by, "window_start"])


def _bin(value: Column) -> Column:
    """A bin number that never falls when the value rises: about 0.1 % wide at every size."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * 1024).cast("bigint")


def exact_percentiles(df: DataFrame, by: list[str], value: str, points: list[float]) -> DataFrame:
    """T1. Exact interpolated percentiles per group as columns ``p50``, ``p95``, ...

    No group is gathered or sorted. Rows are counted per value bin (map side), the running
    counts tell which bin holds each wanted rank, and only rows of those bins are looked at
    again, counted per value. A group of any size, or one value repeated without end, stays a
    handful of counts.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    binned = rows.withColumn("_bin", _bin(F.col("_v")))
    bins = binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    counted = bins.select(
        *by, "_bin", "_n",
        F.sum("_n").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)).alias("_end"),
        F.sum("_n").over(group).alias("_total"),
    ).withColumn("_begin", F.col("_end") - F.col("_n"))
    place = {p: (F.col("_total") - 1) * F.lit(float(p)) for p in points}
    wanted = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("_p"), F.lit(side).alias("_side"),
                (turn(at) + 1).cast("bigint").alias("_rank"), (at - F.floor(at)).alias("_part"),
            )
            for p, at in place.items() for side, turn in (("low", F.floor), ("high", F.ceil))
        ]
    )
    inside = F.filter(wanted, lambda w: (w["_rank"] > F.col("_begin")) & (w["_rank"] <= F.col("_end")))
    targets = counted.filter(F.size(inside) > 0).select(*by, "_bin", "_begin", inside.alias("_wanted"))
    bin_key = [*by, "_bin"]
    asked = binned.join(targets, bin_key, "left_semi").groupBy(*bin_key, "_v").agg(F.count(F.lit(1)).alias("_n"))
    near = asked.join(targets, bin_key)
    in_bin = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = near.withColumn("_to", F.col("_begin") + F.sum("_n").over(in_bin))
    hits = placed.select(
        *by, "_v",
        F.inline(F.filter("_wanted", lambda w: (w["_rank"] > F.col("_to") - F.col("_n")) & (w["_rank"] <= F.col("_to")))),
    )
    columns = []
    for p in points:
        low = F.max(F.when((F.col("_p") == float(p)) & (F.col("_side") == "low"), F.col("_v")))
        high = F.max(F.when((F.col("_p") == float(p)) & (F.col("_side") == "high"), F.col("_v")))
        part = F.max(F.when(F.col("_p") == float(p), F.col("_part")))
        columns.append((low + (high - low) * part).alias(f"p{round(p * 100)}"))
    return hits.groupBy(*by).agg(*columns)


def metric_percentiles(
    metrics: DataFrame, seconds: int, points: list[float], by: tuple[str, ...] = ("metric",)
) -> DataFrame:
    """T1. Exact percentiles per tumbling window."""
    keyed = metrics.withColumn("window_start", window_start(F.col("ts"), seconds))
    return exact_percentiles(keyed, [*by, "window_start"], "value", points)


def labelled_counts(events: DataFrame, labels: list[str]) -> DataFrame:
    """T3."""
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def histogram_wide(df: DataFrame, value: Column, bounds: list[float], by: list) -> DataFrame:
    """T4. One row per group: cumulative bucket counts as an array, total and sum."""
    return df.withColumn("_v", value).groupBy(*by).agg(
        F.array(*[F.count_if(F.col("_v") <= b) for b in bounds], F.count("_v")).alias("cumulative"),
        F.sum("_v").alias("sum"),
    )


def histograms(df: DataFrame, measured: dict[str, tuple[Column, list[float]]], by: list[str]) -> DataFrame:
    """T4. Long form (..., name, le, n) of several histograms, ``measured`` as name: (value, bounds), in one pass.

    Every row adds to counts, none is multiplied.
    """
    values = df.withColumns({f"_v{i}": value for i, (value, _) in enumerate(measured.values())})
    counts = values.groupBy(*by).agg(*[
        F.array(*[F.count_if(F.col(f"_v{i}") <= b) for b in bounds], F.count(f"_v{i}")).alias(f"_c{i}")
        for i, (_, bounds) in enumerate(measured.values())
    ])
    rows = [
        F.arrays_zip(
            F.array_repeat(F.lit(name), len(bounds) + 1).alias("name"),
            F.array(*[F.lit(str(b)) for b in bounds], F.lit(INFINITY)).alias("le"), F.col(f"_c{i}").alias("n"),
        )
        for i, (name, (_, bounds)) in enumerate(measured.items())
    ]
    return counts.select(*by, F.inline(F.concat(*rows)))


def histogram(df: DataFrame, value: Column, bounds: list[float], by: list[str]) -> DataFrame:
    """T4. Long form (..., le, n) of one."""
    return histograms(df, {"": (value, bounds)}, by).drop("name")


def histogram_quantile(cumulative: Column, bounds: list[float], q: float) -> Column:
    """T5. Linear inside the bucket that holds the rank; the last bound when the rank is above it.

    Null when nothing was counted.
    """
    total = F.element_at(cumulative, -1)
    rank = total * F.lit(float(q))
    answer = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        below = cumulative[i - 1] if i else F.lit(0)
        start = bounds[i - 1] if i else 0.0
        width = F.nullif(cumulative[i] - below, F.lit(0))
        inside = F.lit(float(start)) + (bounds[i] - start) * ((rank - below) / width)
        answer = F.when(cumulative[i] >= rank, inside).otherwise(answer)
    return F.when(total > 0, answer)


def sliding(per_minute: DataFrame, seconds: int, sums: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Sliding windows that end at every minute, from per-minute sums: (window_end, ...).

    Raw rows are not repeated per window: only the per-minute rows are.
    """
    steps = F.sequence(F.lit(0), F.lit(seconds // 60 - 1))
    ends = F.transform(steps, lambda i: F.col("minute") + (i + 1) * 60)
    return (
        per_minute.withColumn("window_end", F.explode(ends))
        .groupBy(*by, "window_end")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )


def minute(ts: Column) -> Column:
    return window_start(ts, 60)


def minute_profile(
    events: DataFrame, inference_bounds: list[float], confidence_bounds: list[float], by: tuple[str, ...] = ()
) -> DataFrame:
    """Everything the sliding signals need, counted per minute in one pass over the events."""
    seconds, confidence = F.col("latency_ms") / 1000, F.col("confidence")
    return events.groupBy(*by, minute(F.col("ts")).alias("minute")).agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if("has_think").alias("thinking"),
        F.count_if(F.col("status_code") >= 500).alias("errors"),
        *[F.count_if(seconds <= b).alias(f"inference_{i}") for i, b in enumerate(inference_bounds)],
        F.count(seconds).alias(f"inference_{len(inference_bounds)}"),
        *[F.count_if(confidence <= b).alias(f"confidence_{i}") for i, b in enumerate(confidence_bounds)],
        F.count(confidence).alias(f"confidence_{len(confidence_bounds)}"),
    )


def error_rate(profile: DataFrame, seconds: int = 300) -> DataFrame:
    """T6. Server errors per second over the sliding window, from the minute profile."""
    return sliding(profile, seconds, ["errors"]).select(
        "window_end", (F.col("errors") / float(seconds)).alias("value")
    )


def think_ratio(profile: DataFrame, seconds: int = 900) -> DataFrame:
    """T6. Share of answers with a reasoning block, as a ratio of rates."""

    def rate(name: str) -> Column:
        return F.col(name) / float(seconds)

    return sliding(profile, seconds, ["thinking", "answers"]).select(
        "window_end", (rate("thinking") / (rate("answers") + F.lit(1e-9))).alias("value")
    )


def sliding_quantile(
    profile: DataFrame, name: str, bounds: list[float], q: float, seconds: int, by: tuple[str, ...] = ()
) -> DataFrame:
    """T5. Histogram quantile over the sliding window; ``name`` is inference or confidence."""
    counts = [f"{name}_{i}" for i in range(len(bounds) + 1)]
    windows = sliding(profile, seconds, counts, by)
    return windows.select(
        *by, "window_end", histogram_quantile(F.array(*counts), bounds, q).alias("value")
    ).filter("value IS NOT NULL")


def running_total(df: DataFrame, order: str, value: str, block: Column) -> DataFrame:
    """Running sum in two levels: inside a block, plus the sum of the blocks before it."""
    keyed = df.withColumn("_block", block)
    sums = keyed.groupBy("_block").agg(F.sum(value).alias("_sum"))
    # One row per block; the window without partition sees nothing else.
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.join(offsets, "_block").withColumn(
        "total", F.col("_before") + F.sum(value).over(inside)
    ).drop("_block", "_before")


def active_requests(events: DataFrame) -> DataFrame:
    """T11. Requests in progress at the end of every minute with a change."""
    start = F.unix_micros("ts")
    end = start + (F.col("latency_ms") * 1000).cast("bigint")
    moves = events.select(
        F.inline(
            F.array(
                F.struct(F.floor(start / 60_000_000).alias("m"), F.lit(1).alias("change")),
                F.struct(F.floor(end / 60_000_000).alias("m"), F.lit(-1).alias("change")),
            )
        )
    )
    net = moves.groupBy((F.col("m") * 60).alias("minute")).agg(F.sum("change").alias("change"))
    days = running_total(net, "minute", "change", F.floor(F.col("minute") / 86400))
    return days.select("minute", "change", F.col("total").alias("active"))


def service_signals(events: DataFrame, inference_bounds: list[float], confidence_bounds: list[float]) -> DataFrame:
    """The signals the duration rules watch: (signal, quantile, seconds, window_end, value).

    The events are read twice, once for the minute profile and once for the requests in
    progress; all signals come from those per-minute rows.
    """
    profile = cut_lineage(minute_profile(events, inference_bounds, confidence_bounds))

    def named(df: DataFrame, signal: str, seconds: int, quantile: float | None = None) -> DataFrame:
        return df.select(
            F.lit(signal).alias("signal"), F.lit(quantile).cast("double").alias("quantile"),
            F.lit(seconds).alias("seconds"), "window_end", F.col("value").cast("double").alias("value"),
        )

    up = profile.select((F.col("minute") + 60).alias("window_end"), (F.col("errors") < F.col("answers")).cast("int").alias("value"))
    active = active_requests(events).select((F.col("minute") + 60).alias("window_end"), F.col("active").alias("value"))
    parts = [
        named(sliding_quantile(profile, "inference", inference_bounds, 0.95, 300), "inference_seconds", 300, 0.95),
        named(sliding_quantile(profile, "confidence", confidence_bounds, 0.50, 600), "confidence", 600, 0.50),
        named(error_rate(profile, 300), "errors_per_second", 300),
        named(think_ratio(profile, 900), "think_ratio", 900),
        named(up, "up", 60),
        named(active, "active_requests", 60),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- alarms -------------------------------------------------------------------------------------


def threshold_rules(spark: SparkSession, rules: list[tuple] = THRESHOLD_ALARMS) -> DataFrame:
    return spark.createDataFrame(
        rules,
        "alarm string, metric string, stat string, period int, periods int, threshold double, comparison string, severity string",
    )


def duration_rules(spark: SparkSession, rules: list[tuple] = DURATION_ALARMS) -> DataFrame:
    return spark.createDataFrame(
        rules,
        "alarm string, signal string, quantile double, seconds int, threshold double, comparison string, hold int, severity string",
    )


def _breaches(value: Column, comparison: Column, threshold: Column) -> Column:
    return (
        F.when(comparison.isin("GreaterThanThreshold", ">"), value > threshold)
        .when(comparison.isin("LessThanThreshold", "<"), value < threshold)
        .when(comparison == "==", value == threshold)
    )


def window_statistics(metrics: DataFrame, rules: list[tuple] = THRESHOLD_ALARMS) -> DataFrame:
    """(metric, period, stat, window_start, value) for every statistic the rules ask for.

    Sums and averages of all periods add up from one set of small windows, so the raw rows are
    aggregated once whatever the number of periods.
    """
    plain = [r for r in rules if r[2] in ("Average", "Sum")]
    parts = []
    if plain:
        unit = gcd(*[r[3] for r in plain])
        named = metrics.filter(F.col("metric").isin(sorted({r[1] for r in plain})))
        small = metric_parts(named, unit)
        asked = F.create_map(
            *[
                x for m in sorted({r[1] for r in plain})
                for x in (F.lit(m), F.array(*[F.lit(p) for p in sorted({r[3] for r in plain if r[1] == m})]))
            ]
        )
        per_period = small.withColumn("period", F.explode(asked[F.col("metric")]))
        placed = per_period.withColumn("window_start", longer_windows(F.col("window_start"), F.col("period")))
        windows = combined(placed, ["metric", "period", "window_start"]).withColumnsRenamed({"sum": "Sum", "average": "Average"})
        parts.append(windows.unpivot(["metric", "period", "window_start"], ["Sum", "Average"], "stat", "value"))
    ranked = [r for r in rules if r[2].startswith("p")]
    for period in sorted({r[3] for r in ranked}):
        asked_here = [r for r in ranked if r[3] == period]
        points = sorted({int(r[2][1:]) / 100 for r in asked_here})
        named = metrics.filter(F.col("metric").isin(sorted({r[1] for r in asked_here})))
        wide = metric_percentiles(named, period, points)
        columns = [f"p{round(p * 100)}" for p in points]
        parts.append(
            wide.unpivot(["metric", "window_start"], columns, "stat", "value").withColumn("period", F.lit(period))
        )
    return reduce(DataFrame.unionByName, parts)


def threshold_alarms(statistics: DataFrame, rules: DataFrame) -> DataFrame:
    """J11, W5. Breaching windows with their run length; firing from ``periods`` in a row on.

    A window without data breaks the run. Runs are found among window rows, never raw rows.
    """
    joined = statistics.join(rules, ["metric", "stat", "period"])
    bad = joined.filter(_breaches(F.col("value"), F.col("comparison"), F.col("threshold"))).withColumn(
        "_slot", F.floor(F.col("window_start") / F.col("period"))
    )
    order = Window.partitionBy("alarm").orderBy("_slot")
    runs = bad.withColumn("_run", F.col("_slot") - F.row_number().over(order))
    length = F.row_number().over(Window.partitionBy("alarm", "_run").orderBy("_slot"))
    return runs.withColumn("run", length).select(
        "alarm", "severity", "window_start", "value", "run", (F.col("run") >= F.col("periods")).alias("firing")
    )


def duration_alarms(signals: DataFrame, rules: DataFrame, step: int = 60) -> DataFrame:
    """W6. ``signals(signal, quantile, seconds, window_end, value)`` evaluated every ``step`` seconds.

    A run of breaching evaluations is pending until it lasts ``hold`` seconds, then firing.
    """
    on = [signals[c].eqNullSafe(rules[c]) for c in ("signal", "quantile", "seconds")]
    joined = signals.join(rules, reduce(Column.__and__, on)).select(
        "alarm", "severity", "hold", "window_end", "value", "comparison", "threshold"
    )
    bad = joined.filter(_breaches(F.col("value"), F.col("comparison"), F.col("threshold"))).withColumn(
        "_slot", F.floor(F.col("window_end") / step)
    )
    runs = bad.withColumn("_run", F.col("_slot") - F.row_number().over(Window.partitionBy("alarm").orderBy("_slot")))
    since = F.min("window_end").over(Window.partitionBy("alarm", "_run"))
    return runs.withColumn("since", since).select(
        "alarm", "severity", "window_end", "value", "since",
        F.when(F.col("window_end") - F.col("since") >= F.col("hold"), "firing").otherwise("pending").alias("state"),
    )


def notifications(alarms: DataFrame) -> DataFrame:
    """T7. One row per channel the severity goes to."""
    pairs = [x for s, names in CHANNELS.items() for x in (F.lit(s), F.array(*[F.lit(n) for n in names]))]
    return alarms.select("*", F.explode(F.create_map(*pairs)[F.col("severity")]).alias("channel"))

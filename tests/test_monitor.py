"""Percentiles, histograms and alarms on fixtures made to be awkward."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.operators import monitor


def test_percentiles_of_skewed_groups(spark):
    rng = np.random.default_rng(1)
    groups = {
        "same": np.full(400, 7.25), "tail": rng.lognormal(3, 3, 700), "signed": rng.normal(0, 50, 301),
        "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "zeros": np.zeros(5),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("two", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r for r in monitor.exact_percentiles(df, ["g"], "v", [0.0, 0.5, 0.95, 0.99, 1.0]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for p in (0, 50, 95, 99, 100):
            assert got[g][f"p{p}"] == pytest.approx(np.percentile(values, p), rel=1e-12, abs=1e-12), (g, p)


def test_histogram_quantile(spark):
    bounds = [1.0, 2.0, 5.0]
    rows = [([0, 4, 4, 4],), ([0, 0, 0, 3],), ([0, 0, 0, 0],), ([2, 2, 4, 4],), ([4, 4, 4, 4],)]
    df = spark.createDataFrame(rows, "c array<bigint>")
    got = [r[0] for r in df.select(monitor.histogram_quantile(F.col("c"), bounds, 0.5)).collect()]
    assert got == [1.5, 5.0, None, 1.0, 0.5]


def test_histogram_counts_are_cumulative(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.5), ("a", 99.0), ("a", None)], "k string, v double")
    got = {r.le: r.n for r in monitor.histogram(df, F.col("v"), [1.0, 2.0, 5.0], ["k"]).collect()}
    assert got == {"1.0": 1, "2.0": 1, "5.0": 2, "+Inf": 3}


def test_missing_window_breaks_a_run(spark):
    rule = [("A", "m", "Sum", 60, 2, 1.0, "GreaterThanThreshold", "critical")]
    stats = [("m", 60, "Sum", w * 60, v) for w, v in [(0, 5.0), (2, 5.0), (3, 5.0), (4, 1.0), (5, 5.0)]]
    df = spark.createDataFrame(stats, "metric string, period int, stat string, window_start bigint, value double")
    got = monitor.threshold_alarms(df, monitor.threshold_rules(spark, rule)).orderBy("window_start").collect()
    assert [(r.window_start // 60, r.run, r.firing) for r in got] == [(0, 1, False), (2, 1, False), (3, 2, True), (5, 1, False)]
    sent = monitor.notifications(monitor.threshold_alarms(df, monitor.threshold_rules(spark, rule)).filter("firing"))
    assert sorted(r.channel for r in sent.collect()) == ["ops-email", "ops-slack", "pagerduty"]


def test_duration_alarm(spark):
    rule = [("A", "s", None, 60, 1.0, ">", 120, "warning")]
    signal = [("s", None, 60, t * 60, v) for t, v in [(1, 2.0), (2, 2.0), (3, 2.0), (4, 0.0), (5, 2.0)]]
    df = spark.createDataFrame(signal, "signal string, quantile double, seconds int, window_end bigint, value double")
    got = monitor.duration_alarms(df, monitor.duration_rules(spark, rule)).orderBy("window_end").collect()
    assert [(r.window_end // 60, r.state) for r in got] == [(1, "pending"), (2, "pending"), (3, "firing"), (5, "pending")]


def test_active_requests_and_running_total(spark):
    start = datetime(2024, 1, 1, 23, 59, 30, tzinfo=timezone.utc)
    rows = [(start, 90_000.0), (start + timedelta(seconds=20), 1000.0), (start + timedelta(minutes=5), 1.0)]
    got = monitor.active_requests(spark.createDataFrame(rows, "ts timestamp, latency_ms double")).orderBy("minute").collect()
    assert [(r.change, r.active) for r in got] == [(1, 1), (-1, 0), (0, 0)]


def test_window_statistics_add_up(spark):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(start + timedelta(seconds=37 * i), m, float(i % 11)) for i in range(300) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "ts timestamp, metric string, value double")
    rules = [("x", "a", "Average", 600, 1, 0.0, ">", "info"), ("y", "a", "Sum", 900, 1, 0.0, ">", "info"),
             ("z", "b", "p50", 600, 1, 0.0, ">", "info")]
    stats = monitor.window_statistics(df, rules).collect()
    direct = {r.window_start: r for r in monitor.metric_windows(df.filter("metric = 'a'"), 900).collect()}
    sums = {r.window_start: r.value for r in stats if r.stat == "Sum" and r.period == 900}
    assert sums == {w: r["sum"] for w, r in direct.items()}
    assert {r.period for r in stats if r.stat == "p50"} == {600}


@pytest.mark.parametrize("seed", range(4))
def test_exact_sums(spark, seed):
    """To the last bit, in any order and any parts: tiny, huge, cancelling, special and missing values."""
    import math
    import random

    draw = random.Random(seed)
    groups = {
        "plain": [draw.gauss(0, 1) for _ in range(500)], "wide": [draw.gauss(0, 1) * 10.0 ** draw.randrange(-300, 290) for _ in range(300)],
        "cancel": [x for _ in range(60) for x in (lambda v: (v, -v, 1e-10))(draw.uniform(-1e30, 1e30))], "tiny": [1e-10] * 4, "denormal": [5e-324, 2.5e-310, -5e-324, 5e-324],
        "tie": [1.0, 2.0**-53, 2.0**-106 if seed % 2 else -(2.0**-106)], "powers": [2.0**k for k in range(-1000, 1000, 7)], "zero": [0.0, -0.0], "big": [1e30, 1.0, -1e30, 0.1],
        "nan": [1.0, float("nan"), 3.0], "up": [1.0, float("inf")], "down": [float("-inf"), 2.0], "both": [float("inf"), float("-inf")], "missing": [None, 4.0], "none": [None, None],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    draw.shuffle(rows)
    parts = monitor.value_parts(spark.createDataFrame(rows, "g string, value double").repartition(5), ["g"])
    half = monitor.value_parts(spark.createDataFrame(rows[::2], "g string, value double"), ["g"]).unionByName(monitor.value_parts(spark.createDataFrame(rows[1::2], "g string, value double"), ["g"]))
    for made in (parts, half):
        got = {r.g: r for r in monitor.combined(made, ["g"]).collect()}
        for g, values in groups.items():
            present = [v for v in values if v is not None]
            if not present:
                assert got[g]["sum"] is None and got[g].average is None and got[g].n == 2
                continue
            try:
                want = math.fsum(present)
            except ValueError:  # infinities of both signs
                want = math.nan
            assert got[g].n == len(values) and got[g]["sum"] == pytest.approx(want, rel=0, abs=0, nan_ok=True), g
            assert got[g].average == pytest.approx(want / len(present), rel=0, abs=0, nan_ok=True), g


def test_sketches_keep_their_rank_error(spark):
    rng = np.random.default_rng(5)
    values = rng.lognormal(3, 2, 60_000)
    df = spark.createDataFrame([(i % 7, float(v)) for i, v in enumerate(values)], "p int, value double").withColumn("g", F.lit(1))
    r = monitor.combined(monitor.value_parts(df, ["g", "p"], rank_k=256).drop("p"), ["g"], [0.5, 0.95, 0.99]).first()
    ordered = np.sort(values)
    for p in (50, 95, 99):
        rank = np.searchsorted(ordered, r[f"p{p}"], side="right") / len(values)
        assert abs(rank - p / 100) < 2.3 / 256**0.97

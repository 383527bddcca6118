"""A stream over a bounded input gives what the batch operator gives."""

import json

from pyspark.sql import functions as F

from answerloom.operators import monitor
from answerloom.plans import catalog, inputs
from answerloom.streaming import service

SF = "/root/testdata/sf0.001"


def event_stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{SF}/events*.parquet")
    return inputs.as_served(e), inputs.service_events(spark, SF)


def run(spark, df, name, mode, tmp_path):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.table(name)


def windows_of(df):
    return sorted((r.metric, r.window_start, r.n, r["sum"], r.average, r.least, r.greatest) for r in df.collect())


def test_windows(spark, tmp_path):
    stream, batch = event_stream(spark)
    got = run(spark, service.windowed_parts(monitor.derive_metrics(stream), 3600), "w", "complete", tmp_path)
    want = monitor.metric_windows(monitor.derive_metrics(batch), 3600)
    assert windows_of(monitor.combined(got, ["metric", "window_start"])) == windows_of(want)
    late = run(spark, service.windowed_parts(monitor.derive_metrics(stream), 3600), "wa", "append", tmp_path)
    assert 0 < monitor.combined(late, ["metric", "window_start"]).count() <= want.count()


def test_late_rows_are_counted(spark, tmp_path):
    """Micro-batches one file each: minutes merge to hours exactly, and on time and late are all rows."""
    import datetime as dt
    import random

    from answerloom.operators.monitor import metric_windows

    draw, inbox, begin = random.Random(7), tmp_path / "in", dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
    rows = []
    for k in range(5):
        made = [(begin + dt.timedelta(minutes=30 * k + draw.uniform(0, 30) - (60 if draw.random() < 0.2 else 0)), draw.choice("ab"), draw.gauss(0, 10.0 ** draw.randrange(-9, 9))) for _ in range(400)]
        rows.append(made)
        spark.createDataFrame(made, "ts timestamp, metric string, value double").coalesce(1).write.mode("append").parquet(str(inbox))
    stream = spark.readStream.schema("ts timestamp, metric string, value double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(inbox))
    out = str(tmp_path / "out")
    for _ in range(2):  # a second start finds nothing new
        service.write_windows(stream, out, str(tmp_path / "marks"), 60).awaitTermination()
    on_time, latest = [], None
    for made in rows:
        on_time += [r for r in made if latest is None or r[0] >= latest - dt.timedelta(minutes=10)]
        latest = max([r[0] for r in made] + ([latest] if latest else []))
    got = service.read_windows(spark, out, 3600, [0.5, 0.95])
    n, n_late = got.agg(F.sum("n")).first()[0], service.read_late(spark, out).agg(F.sum("n")).first()[0]
    assert n == len(on_time) and n + n_late == 2000 and n_late > 50
    want = metric_windows(spark.createDataFrame(on_time, "ts timestamp, metric string, value double"), 3600)
    assert windows_of(got) == windows_of(want)
    for r in got.collect():
        values = sorted(v for ts, m, v in on_time if m == r.metric and int(ts.timestamp()) // 3600 * 3600 == r.window_start)
        assert r.p50 == values[-(-len(values) // 2) - 1]


def test_error_rate(spark, tmp_path):
    stream, batch = event_stream(spark)
    got = run(spark, service.sliding_error_rate(stream), "e", "complete", tmp_path)
    want = monitor.error_rate(monitor.minute_profile(batch, [1.0], [1.0]))
    pick = lambda df: sorted((r.window_end, r.value) for r in df.collect())
    assert pick(got) == pick(want)


def test_counters(spark, tmp_path):
    stream, batch = event_stream(spark)
    got = run(spark, service.counters(stream, ["task_type", "status_code"]), "c", "update", tmp_path)
    want = monitor.labelled_counts(batch, ["task_type", "status_code"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_intake(spark, tmp_path):
    def responder(prompt):
        if "boom" in prompt:
            raise RuntimeError("device lost")
        steps = "Step 1: look.\nStep 2: weigh.\nStep 3: pick."
        return f"<think>{steps}</think>Use BGP and OSPF. See [Campus Design] RFC 4271 HIPAA 2013. {len(prompt)}"

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    messages = [
        {"task_id": "a", "payload": {"task_type": "design", "context": {"requirements": {"users": 5}}}},
        {"task_id": "b", "payload": {"type": "troubleshoot", "context": {"symptom": "boom"}, "priority": "low"}},
        {"task_id": "c", "payload": {"type": "estimate", "context": {"compliance": ["HIPAA"]}}},
        {"task_id": "d", "payload": {"type": "design", "context": {"users": 1}, "priority": "high"}},
    ]
    for i, m in enumerate(messages):
        (inbox / f"{i}.json").write_text(json.dumps(m) + "\n" + ("not a message\n" if i == 0 else ""))
    tasks = service.read_tasks(spark, str(inbox), files_per_trigger=1)
    out = tmp_path / "out"
    query = service.write_routed(service.answer_tasks(tasks, responder), str(out), str(tmp_path / "cp"))
    query.awaitTermination()
    rows = {r.task_id: r for r in spark.read.json(str(out)).collect()}
    # Partition folders hold the queue; each batch was written once.
    routed = {}
    for f in out.glob("batch=*/queue=*/*.json"):
        for line in f.read_text().splitlines():
            routed[json.loads(line)["task_id"]] = f.parent.name.split("=")[1]
    assert len(list(out.glob("batch=*"))) == 4 and len(rows) == 5
    assert routed["a"] == "done" and rows["a"].status == "success" and rows["a"].confidence >= 0.8
    assert routed["b"] == "approval" and rows["b"].status == "error" and rows["b"].confidence == 0.0
    assert routed["c"] == "approval" and routed["d"] == "approval"
    broken = next(r for k, r in rows.items() if k not in "abcd")
    assert broken.status == "error" and broken.requires_approval
    batch = service.answer_tasks(spark.read.text(str(inbox)), responder)
    keep = lambda r: (r.task_id, r.status, r.answer, r.confidence)
    assert sorted(map(keep, batch.collect())) == sorted(map(keep, rows.values()))


def test_messages_wait_for_answers(spark, tmp_path):
    """A stream joined with recorded answers; what has none yet is tried again once it is there."""
    from answerloom.operators import respond

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(6):
        (inbox / f"{i}.json").write_text(json.dumps({"task_id": f"t{i}", "payload": {"type": "review", "context": {"note": i % 3}}}) + "\n")
    messages = spark.read.text(str(inbox))
    every = service.asked_tasks(messages).select("model_prompt").distinct().select(
        "model_prompt", respond.prompt_key(F.col("model_prompt")).alias("prompt_key"), F.concat(F.lit("<think>Step 1: x</think>ok"), F.md5("model_prompt")).alias("raw"),
        F.lit(2.0).alias("latency_ms"), F.lit(None).cast("string").alias("error"),
    )
    some = every.filter(~F.contains("model_prompt", F.lit("{'note': 2}")))
    some.write.parquet(str(tmp_path / "answers"))
    answers = service.answer_tasks(service.read_tasks(spark, str(inbox), files_per_trigger=2), spark.read.parquet(str(tmp_path / "answers")))
    out = str(tmp_path / "out")
    service.write_routed(answers, out, str(tmp_path / "cp")).awaitTermination()
    routed = {r.task_id: r for r in service.read_routed(spark, out).collect()}
    assert {k for k, r in routed.items() if r.queue == "retry"} == {"t2", "t5"} and len(routed) == 6
    assert routed["t0"].answer == routed["t3"].answer and routed["t2"].status == "waiting"
    again = {r.task_id: r for r in service.retry_tasks(spark, out, every).collect()}
    assert set(again) == {"t2", "t5"} and all(r.status == "success" and r.queue != "retry" for r in again.values())


def test_queue_messages_are_dealt_evenly(spark, tmp_path):
    """Messages of one small file of orders are answered in several parts, none lost."""
    n = F.col("id")
    orders = spark.range(0, 2000, 1, 1).select(
        n.alias("o_orderkey"), (n % 50).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"),
        F.lit("1-URGENT").alias("o_orderpriority"), F.timestamp_seconds(n).cast("timestamp_ntz").alias("o_orderdate"),
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(50).select(n.alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(str(tmp_path / "customer.parquet"))
    dealt = catalog.queue_messages(spark, str(tmp_path))
    assert sorted(r.value for r in dealt.collect()) == sorted(r.value for r in inputs.task_messages(spark, str(tmp_path)).select("value").collect())
    parts = [r["count"] for r in dealt.groupBy(F.input_file_name()).count().collect()]
    assert len(parts) > 1 and max(parts) < 1000

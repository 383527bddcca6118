"""Readers, writers and whole runs."""

import json

import pytest
from pyspark.sql import functions as F

from answerloom.fixed import templates
from answerloom.functions import json_text
from answerloom.operators import knowledge, respond
from answerloom.plans import datasets
from answerloom.sources import files


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def sample(q, a, kind="design"):
    return json.dumps({"messages": [{"role": "user", "content": q}, {"role": "assistant", "content": a}],
                       "metadata": {"type": kind}}, ensure_ascii=False)


def test_json_lines(spark, tmp_path):
    path = write(tmp_path / "s.jsonl", "\n".join([sample("é", "x"), "", "   ", "{broken", sample("b", "y"), '"text"']))
    good, bad = files.read_samples(spark, path)
    rows = good.orderBy("seq").collect()
    assert [(r.line, r.messages[0].content) for r in rows] == [(1, "é"), (5, "b")]
    assert [r.line for r in bad.orderBy("line").collect()] == [4, 6]


def test_line_numbers_over_blocks_and_files(spark, tmp_path):
    for name in ("a", "b"):
        write(tmp_path / f"{name}.txt", "".join(f"{name}{i}\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.numbered(spark.read.text(str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r.line == int(r.value[1:]) + 1 for r in rows)
    assert sorted(r.seq for r in rows) == list(range(1, 8001))
    assert all(r.seq == r.line + (4000 if r.value[0] == "b" else 0) for r in rows)


def test_prompts(spark, tmp_path):
    lines = ['{"prompt":"p","id":"x"}', "", '{"messages":[{"role":"user","content":"m"}],"category":"c"}', '{"id":"z"}']
    got = files.read_prompts_json(spark, write(tmp_path / "p.jsonl", "\n".join(lines))).collect()
    assert sorted(map(tuple, got)) == [("q_0003", "c", "m"), ("x", "general", "p"), ("z", "general", None)]
    path = write(tmp_path / "q.csv", 'query,question\n"one\nline",b\ntwo,c\n')
    got = files.read_prompts_csv(spark, path).collect()
    assert sorted(map(tuple, got)) == [("q_0001", "general", "one\nline"), ("q_0002", "general", "two")]
    path = write(tmp_path / "r.csv", "id,prompt,category\n7,hello,x\n")
    assert [tuple(r) for r in files.read_prompts_csv(spark, path).collect()] == [("7", "x", "hello")]


def test_test_cases(spark, tmp_path):
    rows = [{"id": f"t{i}", "category": c, "messages": [{"role": "user", "content": "q"}]} for i, c in enumerate(["BGP", "qos", "bgp"])]
    path = write(tmp_path / "t.jsonl", "\n".join(map(json.dumps, rows)))
    assert files.read_test_cases(spark, path, category="bgp").count() == 2
    assert files.read_test_cases(spark, path, case_id="t1").first().category == "qos"


def test_knowledge_files(spark, tmp_path):
    write(tmp_path / "design_patterns.json", json.dumps(
        {"metadata": {"v": 1}, "_x": {"a": []}, "topology_patterns": {"core": {"users": "Up to (2000) users", "list": ["a", {"b": None}]}}}
    ))
    docs = files.read_knowledge(spark, str(tmp_path))
    assert docs.count() == 6 and docs.filter("doc = '{}'").count() == 5
    leaves = knowledge.flatten(docs)
    got = {r.path for r in leaves.collect()}
    base = "design_patterns.topology_patterns.core"
    assert got == {"design_patterns.metadata.v", f"{base}.users", f"{base}.list[0]", f"{base}.list[1].b"}
    index = knowledge.build_index(leaves)
    assert sorted(r.term for r in index.collect()) == ["2000", "users"]
    found = knowledge.topic_matches(index, "(users) BGP")
    assert [tuple(r) for r in found.collect()] == [("design_patterns", 1)]
    sections = knowledge.topic_sections(index, "users", knowledge.sections(docs))
    assert [tuple(r) for r in sections.collect()] == [("design_patterns", "topology_patterns")]
    cover = {r.category: r for r in knowledge.coverage(docs).collect()}
    assert tuple(cover["design_patterns"])[1:] == (2, 4, True)
    assert tuple(cover["cost_benchmarks"])[1:] == (0, 0, False)
    assert {r["slice"] for r in knowledge.slice_leaves(leaves).collect()} == {"topology_patterns"}


def test_deep_documents(spark):
    deep = '{"a":' * 7 + '{"l":[1,2]}' + "}" * 7
    docs = spark.createDataFrame([("c", deep), ("d", '{"k":[[]],"e":{}}'), ("t", "not json")], "category string, doc string")
    got = {r.category: r.entries for r in knowledge.count_entries(docs).groupBy("category").agg(F.sum("entries").alias("entries")).collect()}
    assert got == {"c": 1, "d": 1, "t": 0}
    want = {"c" + ".a" * 7 + ".l[0]", "c" + ".a" * 7 + ".l[1]"}
    for levels in (1, 5, 9):
        assert {r.path for r in knowledge.flatten(docs, levels=levels).collect()} == want


def test_documents_of_any_depth(spark):
    """Brackets in strings, escapes, lists and objects, 40 and 300 levels, beside flat and broken documents."""
    quoted = "[[{{\" }}\\"
    rows = [("c", 1, '{"a":' * 40 + '[{"b":null},[],"x"]' + "}" * 40), ("c", 2, json.dumps({"s": quoted, "t": "]" * 20})), ("c", 3, "[" * 300 + "7" + "]" * 300),
            ("d", 4, "{broken" + "{" * 20), ("d", 5, None), ("d", 6, "3"), ("d", 7, '{"e":{},"l":[]}')]
    docs = spark.createDataFrame(rows, "category string, n int, doc string")
    got = sorted((r.n, r.path, r.leaf or "") for r in knowledge.flatten(docs).select("n", "path", knowledge.leaf_text(F.col("node")).alias("leaf")).collect())
    assert got == [(1, "c" + ".a" * 40 + "[0].b", ""), (1, "c" + ".a" * 40 + "[2]", "x"), (2, "c.s", quoted), (2, "c.t", "]" * 20), (3, "c" + "[0]" * 300, "7"), (6, "d", "3")]
    deep = docs.select("n", knowledge.deeper(F.col("doc"), 8).alias("deep"))
    assert {r.n for r in deep.filter("deep").collect()} == {1, 3, 4}


def test_stored_index_reads_matching_row_groups(spark, tmp_path):
    leaves = knowledge.flatten(spark.range(20_000).select(
        F.concat(F.lit("c"), F.col("id") % 3).alias("category"), F.col("id").alias("doc_no"),
        F.concat(F.lit('{"body":"common word'), F.col("id").cast("string"), F.lit(" and term"), F.md5(F.col("id").cast("string")), F.lit('"}')).alias("doc"),
    ))
    postings = knowledge.build_index(leaves)
    folder = str(tmp_path / "index")
    knowledge.store_index(postings, folder, terms=1 << 12, row_group_bytes=16 << 10)
    stored = spark.read.parquet(folder)
    total = stored.count()
    assert total == postings.filter("first").count() == 60_000
    found = knowledge.topic_matches(stored, "WORD77", ("doc_no", "path"))
    assert [tuple(r) for r in found.collect()] == [("c2", 1)]
    plan = found._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName().startswith("Adaptive") else plan
    assert "PushedFilters: [" in plan.toString() and "term" in plan.toString().split("PushedFilters: [")[1].split("]")[0]

    def leaves_of(node):
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return leaves_of(node.plan())
        children = node.children()
        return [x for k in range(children.length()) for x in leaves_of(children.apply(k))] or [node]

    read = sum(n.metrics().get("numOutputRows").get().value() for n in leaves_of(plan) if n.metrics().contains("numOutputRows"))
    assert 0 < read < total / 10


def test_upsert_entry_text(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('"text"',), ("{}",)], "v string")
    got = [json.loads(r[0]) for r in df.select(knowledge.manual_entry(F.col("v"), F.lit("src"), F.lit("2024"))).collect()]
    assert got[0]["a"] == 1 and got[1]["value"] == "text" and set(got[2]) == {"_metadata"}
    assert all(g["_metadata"] == {"source": "src", "added": "2024"} for g in got)


def test_scenarios(spark, tmp_path):
    path = write(tmp_path / "s.yaml", "scenarios:\n  - id: a\n    name: n\n    input:\n      users: 3\n      tags: [x]\n    expected_keywords: [k]\n    min_confidence: 0.5\n")
    row = files.read_scenarios(spark, path).first()
    assert row.input == {"users": "3", "tags": '["x"]'} and row.expected_keywords == ["k"] and row.type == "design"


def test_curate_file(spark, tmp_path):
    body = "<think>\nStep 1: a</think>" + "z" * 120
    lines = [sample(f"question {i % 40}", body, "design" if i % 3 else "troubleshooting") for i in range(60)] + [sample("short", "no")]
    path = write(tmp_path / "in.jsonl", "\n".join(lines))
    out = str(tmp_path / "out")
    stats = datasets.curate_file(spark, path, out).first()
    assert stats.total == 40 and stats.think_block_rate == 1.0
    back = spark.read.json(out)
    assert back.count() == 40 and {r.split for r in back.select("split").collect()} == {"train", "val", "test"}
    with pytest.raises(Exception):
        datasets.curate_file(spark, path, out)
    reports = datasets.validate_file(spark, path, limit=10)
    assert reports["report"].first().total_samples == 10 and not reports["gate"].first().ok


def test_reports_on_disk(spark, tmp_path):
    files.write_report(spark.createDataFrame([(1, "é")], "n int, t string"), str(tmp_path / "r"))
    parts = list((tmp_path / "r").glob("part-*"))
    assert len(parts) == 1 and json.loads(parts[0].read_text(encoding="utf-8")) == {"n": 1, "t": "é"}
    assert files.has_enough(spark.range(10), 10) and not files.has_enough(spark.range(9), 10)


def test_responder_isolates_failures(spark):
    def fn(text):
        if "bad" in text:
            raise RuntimeError("device lost")
        return f"<think>Step 1: x</think>{text}"

    df = spark.createDataFrame([("1", "c", "hi"), ("2", "c", "bad"), ("3", "c", "")], "id string, category string, prompt string")
    answered = respond.respond(df, fn)
    records = {r.id: r for r in respond.batch_records(answered).collect()}
    assert set(records) == {"1", "2"}
    assert records["1"].answer == "hi" and records["1"].error is None and records["1"].latency_ms >= 0
    assert records["2"].error == "device lost" and records["2"].answer == "" and records["2"].latency_ms is None


def test_responder_is_asked_once_per_row(spark):
    asked = spark.sparkContext.accumulator(0)

    def fn(text):
        asked.add(1)
        if text.endswith("3"):
            raise RuntimeError("no")
        return text

    df = spark.range(20).select(
        F.col("id").cast("string").alias("id"), F.lit("c").alias("category"), F.concat(F.lit("p"), "id").alias("prompt")
    )
    records = respond.batch_records(respond.respond(df, fn)).collect()
    assert len(records) == 20 and sum(r.error is not None for r in records) == 2 and asked.value == 20


def test_judge(spark):
    df = spark.createDataFrame([("q" * 900, "r", "a" * 9000), ("fail", "r", "a")], "prompt string, reasoning string, answer string")

    def fn(text):
        if "fail" in text:
            raise ValueError("x" * 80)
        return json.dumps({"score": 4.5, "rationale": str(len(text))})

    got = {r.prompt[:4]: r for r in respond.judge(df, fn).collect()}
    assert got["qqqq"].score == 4.5 and got["qqqq"].rationale == str(500 + 3000 + len(templates.JUDGE.replace("${question}", "").replace("${response}", "")))
    assert got["fail"].score == 3.0 and got["fail"].rationale == "Error: " + "x" * 50


def test_prompts_are_asked_once(spark):
    """Recorded answers first, then each other prompt once, however often it stands there; the judge likewise."""
    asked = spark.sparkContext.accumulator(0)

    def fn(text):
        asked.add(1)
        if "bad" in text:
            raise RuntimeError("lost")
        return "raw " + text

    rows = [(i, p) for i, p in enumerate(["a", "b", "bad", "", None, "known", "fails"] * 30)]
    df = spark.createDataFrame(rows, "id int, prompt string").repartition(5)
    known = spark.createDataFrame([("known", "kept", 1.0, None), ("fails", None, None, "was lost")], "p string, raw string, latency_ms double, error string")
    known = known.select(respond.prompt_key(F.col("p")).alias("prompt_key"), "raw", "latency_ms", "error")
    got = respond.ask_once(df, fn, known)
    want = {"a": ("raw a", None), "b": ("raw b", None), "bad": (None, "lost"), "": (None, None), None: (None, None), "known": ("kept", None), "fails": (None, "was lost")}
    for _ in range(2):
        assert {r.prompt: (r.raw, r.error) for r in got.collect()} == want and got.count() == len(rows)
    assert asked.value == 3
    assert {r.error for r in respond.answer_from(df.filter("prompt in ('a', 'known')"), known).collect()} == {None, respond.NO_ANSWER}
    forms = spark.createDataFrame([("q", "r", "a")] * 20 + [("bad", "r", "a")] * 5, "prompt string, reasoning string, answer string")
    asked.value = 0
    judged = respond.judge(forms, fn=lambda text: fn(text) and '{"score": 2, "rationale": "so"}')
    assert {(r.prompt, r.score, r.rationale) for r in judged.collect()} == {("q", 2.0, "so"), ("bad", 3.0, "Error: lost")} and asked.value == 2
    silent = respond.judge(forms, recorded=known)
    assert {(r.score, r.judge_error) for r in silent.collect()} == {(None, respond.NO_ANSWER)}


JSONS = [
    {}, [], {"a": []}, {"a": {}, "b": [1, 2.5, -3, 0.001, 1e6]}, {"users": 500, "compliance": ["HIPAA", "PCI-DSS"], "deep": {"x": [{"y": None}, True, False]}},
    {"quote": 'say "hi"', "it's": "it's", "both": "it's \"so\"", "lines": "a\nb\tc\\d", "é": "日本 ü 🙂", "brackets": "[{,:}]", "empty": ""}, [[[]], [{}]], {"n": 12345678901234567890},
]


def test_json_texts(spark):
    texts = [json.dumps(x, ensure_ascii=e, separators=s) for x in JSONS for e in (True, False) for s in ((",", ":"), (" , ", " : "))]
    df = spark.createDataFrame([(t,) for t in texts] + [("plain text",), ("",), (None,), ('{"broken"',)], "t string")
    for r in df.select("t", json_text.indented_json(F.col("t")).alias("i"), json_text.python_text(F.col("t")).alias("p")).collect():
        try:
            value = json.loads(r.t)
        except (ValueError, TypeError):
            assert (r.i, r.p) == (r.t, r.t)
        else:
            assert r.i == json.dumps(value, indent=2) and r.p == str(value)


def test_knowledge_file_of_several_lines_is_one_document(spark, tmp_path):
    (tmp_path / "cost_benchmarks.json").write_text('{\n "a": {\n  "b": 1\n }\n}\n')
    rows = files.read_knowledge(spark, str(tmp_path), ["cost_benchmarks"]).collect()
    assert len(rows) == 1 and '"b": 1' in rows[0].doc


def test_stored_index_spreads_a_term_of_one_path(spark, tmp_path):
    """Leaves of one term, category and path lie in several ranges."""
    rows = spark.range(0, 40_000, 1, 4).select(F.lit("c").alias("category"), F.col("id").alias("doc_no"), F.lit('{"who":"user User, x"}').alias("doc"))
    folder, part = str(tmp_path / "index"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(part)
    spark.conf.set(part, "false")
    try:
        knowledge.store_index(knowledge.build_index(knowledge.flatten(rows), repeats=False), folder)
    finally:
        spark.conf.set(part, before)
    stored = spark.read.parquet(folder)
    assert stored.columns == ["category", "doc_no", "path", "term"] and stored.distinct().count() == stored.count() == 40_000
    per_file = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert len(per_file) > 1 and max(per_file) < 30_000


def test_index_without_repeats(spark):
    """The first occurrences alone: trimmed forms of one word count once a leaf."""
    docs = spark.createDataFrame([("c", 1, '{"a":"Word (word) word. two\\u2003Word","b":["two two, tree","",7,null]}'), ("c", 1, '{"a":"word"}'), ("d", 2, None)], "category string, n int, doc string")
    leaves = knowledge.flatten(docs)
    whole = knowledge.build_index(leaves, 3)
    assert sorted(map(tuple, knowledge.build_index(leaves, 3, repeats=False).collect())) == sorted(map(tuple, whole.filter("first").collect()))
    assert whole.count() == 9 and whole.filter("first").count() == 5

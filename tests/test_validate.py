"""Sample rules, accuracy rules and reports."""

from pyspark.sql import functions as F

from answerloom.functions.checks import address_checks, public_addresses
from answerloom.operators import curate, validate
from answerloom.sources import schemas


def digest(spark, *rows):
    """(assistant text, type of metadata: users, compliance, sources, steps)."""
    out = []
    for i, (text, users, compliance, sources, steps) in enumerate(rows):
        scenario = (users, None, None, compliance, None, None, None, None, None, None, None, None)
        messages = [("user", "q"), ("assistant", text)] if text is not None else [("user", "q"), ("user", "r")]
        out.append((i, messages, ("design", None, scenario, sources, None, None, steps)))
    return curate.digest_messages(spark.createDataFrame(out, "seq bigint, " + schemas.SAMPLE))


def checks_of(df):
    return [{c.name: c.passed for c in r.checks} for r in df.orderBy("sample_id").collect()]


def test_emitted_checks(spark):
    good = "<think>" + "".join(f"Step {i}: x\nSource: RFC\nPer Cisco guide\n" for i in range(5)) + "</think>" + "y" * 200
    rows = digest(
        spark, (good, 100, None, ["a", "b"], 5), ("spine leaf with TLS and HIPAA", 100, None, [], 0),
        (None, None, None, None, None), ("eBGP", 400, None, None, None), ("", None, None, None, None),
    )
    checked = validate.validate(rows)
    got = checks_of(checked)
    assert all(got[0].values()) and len(got[0]) == 8
    assert got[1]["spine_leaf_context"] is False and got[1]["compliance_version_HIPAA"] is False
    assert got[1]["tls_version_specified"] is False and "compliance_version_SOX" not in got[1]
    assert got[2]["has_assistant_message"] is False and "has_think_tags" not in got[2] and got[2]["has_user_question"]
    assert got[4]["has_assistant_message"] is False
    rows = checked.orderBy("sample_id").collect()
    assert rows[0].score == 100.0 and rows[0].passed and not rows[1].passed
    assert len(rows[3].warnings) == 1 and not rows[0].warnings
    assert "min_reasoning_steps: Only 0 steps found (minimum 5)" in rows[1].errors


def test_short_sample_still_gets_the_other_rules(spark):
    df = spark.createDataFrame([(1, [("user", "tls")], None)], "seq bigint, " + schemas.SAMPLE)
    got = checks_of(validate.validate(curate.digest_messages(df)))[0]
    assert got["has_messages"] is False and got["has_user_question"] and "tls_version_specified" not in got


def test_strict_has_higher_limits(spark):
    text = "<think>Cisco RFC</think>" + "y" * 300
    rows = digest(spark, (text, None, None, None, None))
    loose, strict = checks_of(validate.validate(rows))[0], checks_of(validate.validate(rows, strict=True))[0]
    assert loose["has_source_references"] and loose["has_answer_content"]
    assert not strict["has_source_references"] and not strict["has_answer_content"]


def test_reports(spark):
    rows = digest(spark, ("a", None, None, None, None), ("b", None, None, ["x", "y"], 9))
    checked = validate.validate(rows)
    report = validate.validation_report(checked)
    assert tuple(report.first())[:3] == (2, 0, 2)
    assert tuple(validate.passes_rate_gate(report).first()) == (0.0, False)
    rates = {r.check: (r.emitted, r.pass_rate) for r in validate.check_rates(checked).collect()}
    assert rates["has_user_question"] == (2, 100.0) and rates["metadata_sources_populated"] == (2, 50.0)
    top = validate.frequent_errors(checked).collect()
    assert len(top) == 5 and [r.n for r in top] == sorted((r.n for r in top), reverse=True)
    empty = validate.validation_report(checked.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0.0)


def test_addresses(spark):
    text = "8.8.8.8 10.1.2.3 8.8.8.8 192.0.2.5 100.64.0.1 224.0.0.1 08.8.8.8 300.1.1.1 172.32.0.1 172.31.0.1 192.0.0.9 1.2.3"
    df = spark.createDataFrame([(text,)], "t string")
    got = [c.evidence for c in df.select(address_checks(public_addresses(F.col("t")))).first()[0]]
    assert got == ["8.8.8.8", "8.8.8.8", "100.64.0.1", "224.0.0.1", "172.32.0.1", "192.0.0.9"]


def test_accuracy(spark):
    rows = digest(
        spark, ("nothing", 10, None, None, None), ("three tier and collapsed core", 2000, None, None, None),
        ("spine-leaf", None, ["PCI-DSS"], None, None), ("EIGRP with Arista, VXLAN in the data center", 10, [], None, None),
        ("three-tier", None, None, None, None),
    )
    checked = validate.check_accuracy(rows).orderBy("sample_id").collect()
    assert checked[0].accuracy_score == 100.0 and checked[0].accuracy_checks == []
    assert [c.passed for c in checked[1].accuracy_checks] == [True, True]
    assert checked[2].critical_failures == 5 and checked[2].accuracy_score == 0.0
    assert [(c.name, c.passed) for c in checked[3].accuracy_checks] == [("vxlan_context", True), ("eigrp_multi_vendor", False)]
    assert checked[4].accuracy_checks == []
    report = validate.accuracy_report(validate.check_accuracy(rows)).first()
    assert report.total_critical_failures == 5 and report.samples_with_critical_failures == 2


def test_merge_checks(spark):
    schema = "sample_id int, name string, passed boolean, message string"
    a = spark.createDataFrame([(1, "x", True, ""), (1, "y", True, "")], schema)
    b = spark.createDataFrame([(1, "x", False, "later")], schema)
    got = {(r.name, r.passed) for r in validate.merge_checks(a, b).collect()}
    assert got == {("x", False), ("y", True)}


def test_answers_are_not_shuffled(spark):
    """What travels to a sample's other values is what the rules found, not the text they read."""
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id bigint, turn bigint, role string, text string")
    digest = curate.digest_turns(turns).selectExpr("*", "1L AS user_count", "array('SOX') AS compliance", "array('x') AS sources_used", "1 AS reasoning_steps")
    for checked in (validate.validate(digest), validate.check_accuracy(digest)):
        plan = checked._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        sent = [lines[i + 1] for i, line in enumerate(lines) if "Exchange" in line]
        assert sent and not any("text#" in line or "_a#" in line or "_body#" in line for line in sent)


def test_sample_without_an_answer_counts_as_empty(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "user", "r")], "conv_id bigint, turn bigint, role string, text string")
    digest = curate.digest_turns(turns).selectExpr("*", "1L AS user_count", "array('PCI-DSS') AS compliance", "array('x') AS sources_used", "1 AS reasoning_steps")
    assert checks_of(validate.validate(digest))[0]["has_assistant_message"] is False
    assert validate.check_accuracy(digest).first().critical_failures > 0

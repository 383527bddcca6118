"""Parsing and scoring against literals."""

import random

import pytest
from pyspark.sql import functions as F

from answerloom.functions import facts, parse, prompts, scores
from answerloom.functions.text import one_decimal, round_exact, strip

GOLDEN = (
    "<think>Step 1: Analyze scale.\nStep 2: Select topology.</think>\nThree-tier is best. "
    "See [CCNP Enterprise Design ENSLD] and RFC 4271."
)


def one(spark, flavor, raw):
    return parse.parse_responses(spark.createDataFrame([(raw,)], "raw string"), flavor).first()


def test_strict_golden(spark):
    r = one(spark, "strict", GOLDEN)
    assert r.has_think_block and r.reasoning_steps == 2
    assert r.sources == ["CCNP Enterprise Design ENSLD", "RFC 4271"]
    assert r.answer.startswith("Three-tier") and r.reasoning.startswith("Step 1")
    df = parse.parse_strict(spark.createDataFrame([(GOLDEN,)], "raw string"))
    assert scores.with_confidence_strict(df).first().confidence == pytest.approx(0.75)


def test_strict_edges(spark):
    assert one(spark, "strict", "<think>never closed").reasoning == ""
    r = one(spark, "strict", "<think>a</think> b <|end|><think>c</think>")
    assert r.reasoning == "a" and r.answer == "b <think>c</think>"
    assert one(spark, "strict", "[Design] [x Design]").sources == ["x Design"]


def test_basic_keeps_tags_and_spaces(spark):
    r = one(spark, "basic", "<think>Step 1: x\nSource: B \n</think> ok [Source: A]")
    assert r.reasoning.startswith("<think>") and r.sources == ["A", "B"] and r.reasoning_steps == 1
    assert one(spark, "basic", "  plain ").answer == "  plain "


def test_suite(spark):
    r = one(spark, "suite", "<THINK>one</THINK> a <think>two</think> b Step 3")
    assert r.reasoning == "one" and r.answer == "a  b Step 3" and r.reasoning_steps == 0
    assert one(spark, "suite", "Step 1 then step 2").reasoning_steps == 2
    assert one(spark, "suite", "[abc] [abcd] rfc 2328 hipaa HIPAA").sources == ["abcd", "rfc 2328", "hipaa", "HIPAA"]


# Keyword share, source share, confidence, reasoning block, stored total and band.
STORED = [
    (0.75, 1.0, 0.7, True, 0.815, "PASS"), (0.3333333333333333, 0.5, 0.6, True, 0.487, "WARN"),
    (0.0, 0.5, 0.7, True, 0.34, "FAIL"), (0.0, 1.0, 0.7, True, 0.44, "FAIL"),
    (0.25, 1.0, 0.75, True, 0.575, "WARN"), (0.0, 1.0, 0.6, True, 0.42, "FAIL"),
    (0.25, 0.0, 0.45, False, 0.215, "FAIL"), (0.0, 1.0, 0.55, True, 0.41, "FAIL"),
    (0.0, 0.0, 0.7, True, 0.24, "FAIL"), (0.0, 1.0, 0.75, True, 0.45, "WARN"),
    (0.0, 0.5, 0.55, True, 0.31, "FAIL"), (0.0, 0.5, 0.75, True, 0.35, "FAIL"),
    (0.25, 0.5, 0.55, True, 0.435, "FAIL"), (0.25, 0.5, 0.6, True, 0.445, "FAIL"),
    (0.4, 1.0, 0.7, True, 0.64, "WARN"), (0.25, 1.0, 0.7, True, 0.565, "WARN"),
    (0.2, 0.5, 0.6, True, 0.42, "FAIL"),
]


def test_stored_totals(spark):
    df = spark.createDataFrame(STORED, "kw double, src double, conf double, think boolean, want double, pf string")
    total = F.lit(0.50) * F.col("kw") + F.lit(0.20) * F.col("src") + F.lit(0.20) * F.col("conf") + F.when(
        F.col("think"), 0.10
    ).otherwise(0.0)
    got = df.withColumn("got", round_exact(total, 3)).withColumn("band", scores.band(F.col("got"))).collect()
    assert [(r.got, r.band) for r in got] == [(r.want, r.pf) for r in got]


def test_round_exact_is_python_round(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(500)] + [i / 80 for i in range(160)] + [0.4125, 0.0625, 2.5, 0.0045, 3.9995]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(round_exact(F.col("v"), 3)).collect()]
    assert got == [round(v, 3) for v in values]


def test_one_decimal_is_python_format(spark):
    rng = random.Random(2)
    values = [rng.random() * 10 ** rng.randint(0, 4) for _ in range(400)] + [31.25, 31.35, 84.35, 8.25, 12.5, 16383.95, 2000.45]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(one_decimal(F.col("v"))).collect()] == [f"{v:.1f}" for v in values]


def test_strip_is_python_strip(spark):
    values = [" x ", "\x1c a \x85", "", " \t\n", "y"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(strip(F.col("v"))).collect()] == [v.strip() for v in values]


def test_costs(spark):
    rows = ["CAPEX: $1,500.5K", "annual  opex 2M; Capex: 3", "OPEX $7", "CAPEX: ,", ""]
    df = spark.createDataFrame([(v,) for v in rows], "a string")
    got = df.select(parse.extract_cost(F.col("a"), "api").alias("x"), parse.extract_cost(F.col("a"), "agent").alias("y")).collect()
    assert [(r.x.capex, r.x.annual_opex) for r in got] == [(1500500.0, None), (None, None), (None, 7.0), (None, None), (None, None)]
    assert got[0].y.capex == 1500500.0 and got[1].y.annual_opex == 2e6 and got[1].y.capex == 3.0
    assert got[2].y is None and got[3].y is None


def test_remediation_steps(spark):
    text = "Intro\nStep 1: look\nmore\nStep 2: fix\n\nend"
    df = spark.createDataFrame([(text,), ("no parts",)], "a string")
    got = [r[0] for r in df.select(parse.remediation_steps(F.col("a"))).collect()]
    assert got == [["Step 1: look\nmore", "Step 2: fix\n\nend"], ["no parts"]]


def test_judgement(spark):
    rows = ['{"score": 9, "rationale": "r"}', '{"score": 0}', 'x "score": 4.5 y', "none", '{"score": null}', "[1]", '{"a": 1}', ""]
    df = spark.createDataFrame([(v,) for v in rows], "a string")
    got = [r[0].score for r in df.select(parse.parse_judgement(F.col("a"))).collect()]
    assert got == [5.0, 1.0, 4.5, 3.0, 3.0, 3.0, 3.0, 3.0]


def config(spark, *blocks):
    df = spark.createDataFrame([(b,) for b in blocks], "a string")
    return [r[0] for r in df.select(facts.config_syntax_ok(F.col("a"))).collect()]


def test_config_syntax(spark):
    assert config(
        spark, "no block", "```\na (b\n```", "```\n! (comment\n```", "```cisco\nrouter bgp 1\n```",
        "```ios\nrouter ospf 1\n area 0\n```", "```python\n(\n```", "```\n\n```", "```\n(a\rb)\n```",
    ) == [True, False, False, False, True, True, True, False]


def fact(spark, name, text):
    df = facts.check_facts(spark.createDataFrame([(text,)], "t string"), "t")
    return name not in df.first().failed_facts


def test_facts(spark):
    assert fact(spark, "collapsed_core_max_users", "collapsed core to 01900 users")
    assert not fact(spark, "collapsed_core_max_users", "collapsed core to 190 or 2201 users")
    assert not fact(spark, "bgp_tcp_port", "BGP on " + "9" * 99)
    assert fact(spark, "bgp_tcp_port", "BGP on 00179")
    assert not fact(spark, "n_plus_1_optimal", "nothing")
    assert fact(spark, "hsrp_default_preemption", "HSRP only")
    assert not fact(spark, "hsrp_default_preemption", "HSRP preempt on")
    assert not fact(spark, "sdwan_planes", "SD-WAN vBond vEdge")


def test_facts_by_category_and_own_rules(spark):
    df = spark.createDataFrame([("x", "ospf"), ("x", ""), ("x", None), ("x", "other")], "t string, c string")
    assert [r.num_checked for r in facts.check_facts(df, "t", "c").collect()] == [2, 19, 19, 0]
    own = [facts.Fact("short", "general", "house rule", lambda t, low: F.length(t) < 5)]
    assert [r.fact_score for r in facts.check_facts(df, "t", "c", own).collect()] == [1.0] * 4


def test_chat_template(spark):
    chats = [
        [("user", "u"), ("system", "s"), ("system", "t"), ("tool", "x"), ("user", "v")],
        [("user", "u"), ("assistant", "a")],
    ]
    df = spark.createDataFrame([(c,) for c in chats], "m array<struct<role:string,content:string>>")
    got = [r[0] for r in df.select(prompts.chat_template(F.col("m"))).collect()]
    assert got[0] == (
        "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\nx<|end|>\n<|user|>\nv<|end|>\n<|assistant|>"
    )
    assert got[1] == "<|user|>\nu<|end|>\n<|assistant|>\na<|end|>"


def test_chat_pieces_equal_template(spark):
    turns = [(1, 0, "user", "u"), (1, 1, "system", "s"), (1, 2, "system", "t"), (1, 3, "user", "v")]
    long = prompts.chat_pieces(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string"))
    got = "\n".join(r.piece for r in long.orderBy("position").collect())
    assert got == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|user|>\nv<|end|>\n<|assistant|>"


def test_span_weights(spark):
    df = spark.createDataFrame([("a<think>b c</think>d",), ("x <think> y",), ("",)], "t string")
    got = [tuple(r[0]) for r in df.select(prompts.span_weights(F.col("t"))).collect()]
    assert got == [(6, 10.0), (3, 5.0), (0, 0.0)]


def test_downtime(spark):
    df = spark.createDataFrame([(99.99,), (99.9,), (100.0,)], "u double")
    assert [r[0] for r in df.select(prompts.downtime(F.col("u"))).collect()] == ["52.6 min/year", "8.8 hours/year", "0.0 min/year"]


def test_prompts_show_what_was_sent(spark):
    """An integer uptime stays one; an estimate's context is indented by two."""
    from answerloom.operators.requests import task_prompt

    rows = [("design", '{"requirements":{"uptime":100,"users":5}}'), ("design", "{}"), ("estimate", '{"users":5,"compliance":["HIPAA"]}')]
    got = [r.prompt for r in task_prompt(spark.createDataFrame(rows, "type string, context string")).collect()]
    assert "- Uptime requirement: 100% (" in got[0] and "- Uptime requirement: 99.9% (" in got[1]
    assert '\n\n{\n  "users": 5,\n  "compliance": [\n    "HIPAA"\n  ]\n}\n\n' in got[2]

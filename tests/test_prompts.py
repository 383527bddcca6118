"""Prompts letter by letter."""

from pyspark.sql import functions as F

from answerloom.functions import prompts
from answerloom.operators.respond import judge_form


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def fields(**given):
    names = "users sites compliance uptime budget data_center wan_type cloud_connectivity redundancy_level extras wireless device symptom message protocol impact logs currency include_opex"
    null = {n: F.lit(None) for n in names.split()} | {"compliance": F.lit(None).cast("array<string>"), "extras": F.lit(None).cast("map<string,string>")}
    return null | {k: v if hasattr(v, "_jc") else F.lit(v) for k, v in given.items()}


def test_design_prompts(spark):
    r = fields(users=500, compliance=F.array(F.lit("HIPAA"), F.lit("SOX")), uptime=99.9, data_center=True, wireless=False, cloud_connectivity=False, extras=F.create_map(F.lit("racks"), F.lit("4")))
    assert one(spark, prompts.design_prompt(r, "agent")) == (
        "Design a complete enterprise network architecture for:\n- Users/endpoints: 500\n- Sites/locations: 1\n- Required compliance: HIPAA, SOX\n"
        "- Uptime requirement: 99.9% (8.8 hours/year)\n- Budget: flexible\n\nProvide topology selection rationale, redundancy design, routing protocol selection,\n"
        "security architecture, and implementation roadmap. Include configuration examples.\nAdditional requirement — racks: 4"
    )
    assert one(spark, prompts.design_prompt(r, "api")) == (
        "Design a complete enterprise network architecture:\n- Users/endpoints: 500\n- Sites: 1\n- Compliance: HIPAA, SOX\n- Uptime SLA: 99.9%\n- Budget: flexible\n"
        "- Data center: True\n- WAN type: not specified\n- Cloud connectivity: False\n- Redundancy level: N+1\n- racks: 4\n"
    )
    assert one(spark, prompts.design_prompt(r, "tool")) == (
        "Design a complete enterprise network architecture:\nUsers: 500\nSites: 1\nCompliance: HIPAA, SOX\nUptime SLA: 99.9%\nBudget: flexible\nData center needed: True\n"
        "Wireless coverage: False\n\nProvide: topology selection, routing design, redundancy, security segmentation,\nhardware recommendations, and phased implementation plan."
    )


def test_troubleshoot_prompts(spark):
    r = fields(device="r1", symptom="flaps", logs="x" * 900)
    assert one(spark, prompts.troubleshoot_prompt(r, "agent")) == "Troubleshoot this network issue:\n\nDevice: r1\nSymptom: flaps\nProtocol: unknown\nImpact: unknown\n"
    assert one(spark, prompts.troubleshoot_prompt(r, "api")) == "Troubleshoot: flaps\nDevice: r1\nProtocol: unknown\nLogs:\n" + "x" * 500
    assert one(spark, prompts.troubleshoot_prompt(r, "tool", logs_chars=7)) == "Troubleshoot network design issue:\nDevice: r1\nSymptom: flaps\nProtocol: unknown\n\nRelevant logs:\n" + "x" * 7


def test_estimate_prompts(spark):
    r = fields(users=0, sites=2, compliance=F.array(F.lit("SOX"))) | {"context_json": F.lit("{}")}
    assert one(spark, prompts.estimate_prompt(r, "agent")) == "Provide a detailed cost estimate for:\n\n{}\n\nBreak down CAPEX and annual OPEX. Include hardware, licensing, and implementation."
    assert one(spark, prompts.estimate_prompt(r, "api")) == "Cost estimate for ? users, 2 sites, compliance=['SOX']"
    assert one(spark, prompts.estimate_prompt(r, "tool")) == (
        "Provide detailed cost estimate (USD):\nUsers: unspecified, Sites: 2\nCompliance: SOX\nInclude: CAPEX itemization, annual OPEX, hardware, licensing, implementation labor"
    )


def test_judge_form(spark):
    form = one(spark, judge_form(F.lit("why?"), F.lit("r"), F.lit("a" * 5000), 500, 10))
    assert form.startswith("## Evaluation Task\n\nRate this network architect AI response on a 1-5 scale.\n\n**Question:** why?\n\n**Response:** r\n\naaaaaaa\n\n**Scoring Rubric:**\n- 5:")
    assert form.endswith('**Required format:** JSON only: {"score": <1-5>, "rationale": "<25 words max>"}') and "${" not in form

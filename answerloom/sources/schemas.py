"""Schemas of the files; readers never infer."""

from __future__ import annotations

MESSAGES = "array<struct<role:string,content:string>>"

SCENARIO = (
    "struct<user_count:bigint,site_count:bigint,industry:string,compliance:array<string>,"
    "uptime_requirement:string,budget:string,is_datacenter:boolean,cloud_heavy:boolean,scale:string,"
    "protocol:string,issue_type:string,symptoms:array<string>>"
)

SAMPLE = (
    f"messages {MESSAGES}, metadata struct<type:string,category:string,scenario:{SCENARIO},"
    "sources_used:array<string>,design_patterns:array<string>,compliance_requirements:array<string>,"
    "reasoning_steps:int>"
)

PROMPT = f"id string, category string, prompt string, messages {MESSAGES}"

TEST_CASE = (
    f"id string, category string, messages {MESSAGES}, expected_key_facts array<string>, "
    "sources_required array<string>, metadata struct<domain:string,difficulty:string>"
)

SCENARIO_CASE = (
    "id string, name string, type string, input map<string,string>, expected_keywords array<string>, "
    "min_confidence double, requires_human_review boolean"
)

#: S7. A row of the stored report.
RESULT = (
    "test_id string, category string, overall_score double, keyword_score double, source_score double, confidence double, "
    "has_think boolean, reasoning_steps bigint, latency_ms double, pass_fail string, keywords_missing array<string>"
)

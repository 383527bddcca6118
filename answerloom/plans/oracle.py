"""The same results in DuckDB SQL, written for that engine and independent of the operators."""

from __future__ import annotations

import re

from answerloom.fixed import alarms as al
from answerloom.fixed import chain_text as ct
from answerloom.fixed import scenarios as sc
from answerloom.fixed import templates
from answerloom.fixed.claims import CLAIMS
from answerloom.fixed.rules import (
    CONTROL_PREFIX, CONTROLS, EIGRP_WORDS, GATE_TARGETS, NON_PUBLIC_BLOCKS, OTHER_VENDORS,
    OVERLAY_CONTEXT, OVERLAY_WORDS, PUBLIC_EXCEPTIONS, SPINE_LEAF_CONTEXT, SPINE_LEAF_REQUIRED,
    TOPIC_TARGETS,
)
from answerloom.fixed.wording import TASK_SYSTEM
from answerloom.fixed.sources import CITABLE_NAMES, DOMAIN_TITLES, STANDARD_VERSIONS, TECHNICAL_TERMS
from answerloom.operators.knowledge import SLICES
from answerloom.plans.inputs import REMARKS

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


WS = (
    "concat(chr(9),chr(10),chr(11),chr(12),chr(13),chr(28),chr(29),chr(30),chr(31),' ',chr(133),chr(160),"
    "chr(5760)," + ",".join(f"chr({c})" for c in range(8192, 8203)) + ",chr(8232),chr(8233),chr(8239),chr(8287),chr(12288))"
)


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


RAW = f"""concat(
  CASE WHEN conv_id % 10 = 0 THEN '' ELSE concat('<think>', chr(10),
    array_to_string(list_transform(range(1, conv_id % 10 + 1),
      lambda i: concat('Step ', i, ': check item', chr(10), '- Source: RFC ', 2000 + i, chr(10))), ''),
    '</think>', chr(10), chr(10)) END,
  text,
  CASE turn % 4 WHEN 1 THEN ' Use TLS 1.3 and PCI-DSS 4.0.1 at 8.8.8.8.'
                WHEN 3 THEN ' CAPEX: $1.5M, annual OPEX: $250K on 10.0.0.1.' ELSE '' END,
  chr(10), ({arr(REMARKS)})[(conv_id * 7 + turn) % {len(REMARKS)} + 1])"""

RESP = f"""resp AS (SELECT conv_id, turn, {RAW} AS raw,
  (['', 'bgp', 'qos', 'topology', 'ha'])[conv_id % 5 + 1] AS category
  FROM conversations WHERE role = 'assistant'),
responses AS (SELECT *, length(raw) * 2.5::DOUBLE AS latency_ms FROM resp)"""

DIGEST = f"""turns AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN {RAW} ELSE text END AS text
  FROM conversations),
digest AS (SELECT conv_id AS sample_id, count(*) AS n_messages,
  min_by(text, turn) AS first_content, max_by(text, turn) AS last_content,
  min_by(text, turn) FILTER (role = 'assistant') AS assistant_content,
  bool_or(role = 'user') AS has_user, sum(length(text))::BIGINT AS total_chars
  FROM turns GROUP BY conv_id),
samples AS (SELECT *,
  CASE sample_id % 3 WHEN 0 THEN 'troubleshooting' WHEN 1 THEN 'design' END AS type,
  CASE WHEN sample_id % 3 = 2 AND sample_id % 2 = 0 THEN 'mixed' END AS category,
  50 + sample_id * 7919 % 60000 AS user_count,
  CASE sample_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['PCI-DSS'] WHEN 2 THEN ['HIPAA']
    ELSE ['PCI-DSS', 'HIPAA'] END AS compliance,
  sample_id % 4 AS n_sources, sample_id % 10 AS reasoning_steps FROM digest)"""


def stats_of(source: str) -> str:
    return f"""SELECT count(*)::BIGINT AS total,
  round(coalesce(sum(t), 0)::DOUBLE / greatest(count(*), 1), 6) AS think_block_rate,
  round(coalesce(sum(total_chars), 0)::DOUBLE / greatest(count(*), 1), 6) AS avg_response_chars,
  round(coalesce(sum(s), 0)::DOUBLE / greatest(coalesce(sum(t), 0), 1), 6) AS avg_reasoning_steps
FROM (SELECT total_chars, (contains(last_content, '<think>'))::INT AS t,
  CASE WHEN contains(last_content, '<think>')
    THEN len(regexp_extract_all(last_content, '(?m)^Step\\s+\\d+:')) ELSE 0 END AS s FROM {source})"""


def fp(x: str) -> str:
    return f"sha256({trim(f"lower(coalesce({x}, ''))")})"


ORACLE["curate_statistics"] = f"""WITH {DIGEST},
uniq AS (SELECT * FROM digest QUALIFY row_number() OVER (PARTITION BY {fp('first_content')} ORDER BY sample_id) = 1),
valid AS (SELECT * FROM uniq WHERE n_messages >= 2 AND first_content <> '' AND length(last_content) >= 100)
{stats_of('valid')}"""

ORACLE["p1_message_pickers"] = f"""WITH {DIGEST}
SELECT sample_id, md5(first_content) AS first_md5, md5(last_content) AS last_md5, md5(assistant_content) AS assistant_md5, has_user FROM digest"""

ORACLE["p1_sample_digest"] = f"""WITH {DIGEST}
SELECT sample_id, n_messages, has_user, md5({fp('first_content')}) AS print_md5, first_content <> '' AS first_given,
  length(last_content) AS last_chars, contains(last_content, '<think>') AS thinks,
  CASE WHEN contains(last_content, '<think>') THEN len(regexp_extract_all(last_content, '(?m)^Step\\s+\\d+:')) ELSE 0 END AS steps,
  coalesce(len(regexp_extract_all(assistant_content, '(?i)\\[Source:|Source:|from .{{3,30}} chapter|per .{{3,30}} §')), 0) AS citations,
  total_chars FROM digest"""

ORACLE["p2_valid_samples"] = f"""WITH {DIGEST},
v AS (SELECT n_messages >= 2 AND first_content <> '' AND length(last_content) >= 100 AS ok FROM digest)
SELECT count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid FROM v"""

ORACLE["p3_first_rows"] = "SELECT doc_id, source, lang FROM documents ORDER BY doc_id LIMIT 20"
ORACLE["a1_dataset_stats"] = f"WITH {DIGEST} {stats_of('digest')}"
ORACLE["a2_types"] = f"""WITH {DIGEST}
SELECT coalesce(type, 'unknown') AS type, count(*) AS n FROM samples GROUP BY 1"""

ORACLE["w1_deduplicate"] = f"""SELECT doc_id, source FROM documents
QUALIFY row_number() OVER (PARTITION BY {fp('text')} ORDER BY doc_id) = 1"""
ORACLE["w1_duplicate_groups"] = f"""SELECT {fp('text')} AS fingerprint, min(doc_id) AS kept, count(*) AS copies
FROM documents GROUP BY {fp('text')} HAVING count(*) > 1"""


def split_sql(source: str, key: str, stratum: str, seed: int, stratified: bool, keep: str) -> str:
    train = "floor(n * 0.8::DOUBLE)::BIGINT"
    val = "floor(n * (0.8::DOUBLE + 0.1::DOUBLE))::BIGINT"
    if stratified:
        train = f"greatest(1, {train})"
        val = f"greatest({train} + 1, {val})"
    return f"""SELECT {keep}, CASE WHEN rn <= {train} THEN 'train' WHEN rn <= {val} THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY md5(concat('{seed}|', {key})), {key}) AS rn,
  count(*) OVER (PARTITION BY {stratum}) AS n FROM {source})"""


ORACLE["w2_split_stratified"] = split_sql("documents", "doc_id", "source", 42, True, "doc_id, source")
ORACLE["w2_split_samples"] = f"""WITH {DIGEST}, st AS (SELECT sample_id, coalesce(type, category, 'unknown') AS stratum FROM samples)
SELECT stratum, split, count(*) AS n, min(sample_id) AS first_id, max(sample_id) AS last_id
FROM ({split_sql('st', 'sample_id', 'stratum', 7, True, 'sample_id, stratum')}) GROUP BY 1, 2"""
ORACLE["w3_split_random"] = split_sql("documents", "doc_id", "1", 11, False, "doc_id")
ORACLE["w4_seeded_sample"] = """SELECT doc_id, source FROM documents ORDER BY md5(concat('42|', doc_id)), doc_id LIMIT 128"""
ORACLE["w8_seeded_shuffle"] = "SELECT o_orderkey, md5(concat('42|', o_orderkey)) AS order_key FROM orders"

ORACLE["a17_dataset_gates"] = f"""WITH {DIGEST},
r AS (SELECT {fp('first_content')} AS fp, reasoning_steps,
  len(regexp_extract_all(assistant_content, '(?i)\\[Source:|Source:|from .{{3,30}} chapter|per .{{3,30}} §')) AS cites FROM samples),
t AS (SELECT count(*) AS samples, count(DISTINCT fp) AS distinct_samples,
  count(*) FILTER (cites >= 5) AS enough_citations,
  count(*) FILTER (reasoning_steps BETWEEN 5 AND 15) AS steps_in_range FROM r)
SELECT *, round(1 - distinct_samples::DOUBLE / samples, 6) AS duplicate_ratio,
  (1 - distinct_samples::DOUBLE / samples) <= 0.02 AND enough_citations = samples AND steps_in_range = samples AS passed FROM t"""

_TARGETS = ", ".join(f"({q(k)}, {q(t)}, {n}, {i})" for i, (k, t, n) in enumerate(TOPIC_TARGETS))
ORACLE["a20_plan_vs_actual"] = f"""WITH t(kind, topic, target, i) AS (VALUES {_TARGETS}),
c AS (SELECT doc_id % 9 AS i, count(*) AS n FROM documents GROUP BY 1)
SELECT kind, topic, target::BIGINT AS target, coalesce(n, 0)::BIGINT AS actual, (target - coalesce(n, 0))::BIGINT AS missing
FROM t LEFT JOIN c USING (i)"""


# --- response parsing and scores ----------------------------------------------------------------

THINK = "regexp_extract(raw, '(?s)<think>(.*?)</think>', 1)"
HAS = "regexp_matches(raw, '(?s)<think>.*?</think>')"
AFTER = "regexp_extract(raw, '(?s)<think>.*?</think>(.*)', 1)"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


def matches(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def n_matches(x: str, pattern: str) -> str:
    return f"len({matches(x, pattern)})"


_MARKS = matches("raw", r"(?i)\[Source:\s*[^\]]+\]|Source:\s*[^\n]+")
_MARK_TEXT = (
    f"list_transform({_MARKS}, lambda m: {trim('''regexp_replace(CASE WHEN m[1] = '[' THEN m[2:-2] ELSE m END, '(?i)^Source:', '')''')})"
)
PARSED_BASIC = f"""{RESP}, basic AS (SELECT *, regexp_extract(raw, '(?s)<think>.*?</think>') AS reasoning,
  CASE WHEN {HAS} THEN {trim(AFTER)} ELSE raw END AS answer,
  list_sort(list_distinct({_MARK_TEXT})) AS sources, {HAS} AS has_think_block,
  {n_matches(THINK, r'(?m)^Step\s+\d+:')}::BIGINT AS reasoning_steps FROM responses)"""

_STRICT_SOURCES = "list_concat({}, {}, {})".format(
    matches("raw", r"\[([^\[\]]+(?:Design|Guide|RFC|CCDE|CCNP|CCIE|PCI|HIPAA|NIST|IEEE|Cisco)[^\[\]]*)\]", 1),
    matches("raw", r"RFC\s+\d{3,5}"),
    matches("raw", r"(?:PCI-DSS|HIPAA|NIST CSF|ISO 27001)\s+[\d.]+"),
)
_STRICT_REST = f"CASE WHEN {HAS} THEN {AFTER} ELSE raw END"
PARSED_STRICT = f"""{RESP}, s0 AS (SELECT *, {_STRICT_SOURCES} AS found, {trim(THINK)} AS reasoning FROM responses),
strict AS (SELECT *, {trim(f"regexp_replace({trim(_STRICT_REST)}, '<[|][^|]+[|]>', '', 'g')")} AS answer,
  {distinct_in_order('found')} AS sources, {HAS} AS has_think_block,
  {n_matches('reasoning', r'(?m)^Step\s+\d+[:.]')}::BIGINT AS reasoning_steps FROM s0)"""

_SUITE_SOURCES = "list_concat({}, {}, {})".format(
    matches("raw", r"\[([^\]]{4,80})\]", 1),
    matches("raw", r"(?i)\bRFC\s+\d{3,5}\b"),
    matches("raw", r"(?i)\b(PCI-DSS|HIPAA|NIST CSF|IEEE 802\.\S+|3GPP|ITU-T)\b", 1),
)
PARSED_SUITE = f"""{RESP}, u0 AS (SELECT *, {_SUITE_SOURCES} AS found,
  {trim("regexp_extract(raw, '(?is)<think>(.*?)</think>', 1)")} AS reasoning,
  {trim("regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g')")} AS answer,
  regexp_matches(raw, '(?is)<think>.*?</think>') AS has_think_block FROM responses),
u1 AS (SELECT *, {distinct_in_order('found')} AS sources,
  {n_matches("CASE WHEN reasoning <> '' THEN reasoning ELSE answer END", r'(?i)\bStep\s+\d+')}::BIGINT AS reasoning_steps FROM u0),
suite AS (SELECT *, least(round(0.35::DOUBLE + CASE WHEN has_think_block THEN 0.2 ELSE 0 END
    + CASE WHEN reasoning_steps >= 3 THEN 0.15 WHEN reasoning_steps >= 1 THEN 0.08 ELSE 0 END
    + CASE WHEN len(sources) > 0 THEN 0.15 ELSE 0 END
    + CASE WHEN {n_matches('answer', r'\S+')} >= 200 THEN 0.1 WHEN {n_matches('answer', r'\S+')} >= 80 THEN 0.05 ELSE 0 END, 2), 1.0)
  AS confidence FROM u1)"""

_PARSE_OUT = f"""conv_id, turn, md5(reasoning) AS reasoning_md5, md5(answer) AS answer_md5, {joined('sources')} AS sources,
  has_think_block, reasoning_steps"""
ORACLE["r1_parse_basic"] = f"WITH {PARSED_BASIC} SELECT {_PARSE_OUT} FROM basic"
ORACLE["r2_parse_strict"] = f"WITH {PARSED_STRICT} SELECT {_PARSE_OUT} FROM strict"
ORACLE["r3_parse_suite"] = f"WITH {PARSED_SUITE} SELECT {_PARSE_OUT} FROM suite"

_HITS = " + ".join(
    f"(contains(answer, {q(t)}) OR contains(reasoning, {q(t)}))::INT" for t in TECHNICAL_TERMS
)
ORACLE["r4_confidence_strict"] = f"""WITH {PARSED_STRICT}
SELECT conv_id, turn, round(least(0.5::DOUBLE + CASE WHEN reasoning <> '' THEN 0.15 ELSE 0 END
  + CASE WHEN reasoning_steps >= 3 THEN 0.1 ELSE 0 END + CASE WHEN reasoning_steps >= 5 THEN 0.05 ELSE 0 END
  + CASE WHEN len(sources) > 0 THEN 0.1 ELSE 0 END + CASE WHEN len(sources) > 2 THEN 0.05 ELSE 0 END
  + CASE WHEN length(answer) > 200 THEN 0.05 ELSE 0 END + least(({_HITS}) * 0.02::DOUBLE, 0.1), 1.0), 6) AS confidence
FROM strict"""
ORACLE["r5_confidence_suite"] = f"WITH {PARSED_SUITE} SELECT conv_id, turn, round(confidence, 6) AS confidence FROM suite"


def reasoning_score(x: str) -> str:
    steps = n_matches(x, r"(?m)^Step\s+\d+:")
    cites = n_matches(x, r"(?i)\[Source:|Source:|from .{3,30} chapter|per .{3,30} §")
    versions = q(r"(?i)PCI-DSS\s+\d+\.\d+|HIPAA\s+\d{4}|SOX\s+\d{4}|NIST\s+CSF\s+\d+|ISO\s+27001:\d{4}")
    return f"""least(5.0::DOUBLE, 1.0 + CASE WHEN contains(lower({x}), '<think>') THEN 1.0 ELSE 0 END
  + CASE WHEN {steps} >= 8 THEN 1.0 WHEN {steps} >= 5 THEN 0.7 WHEN {steps} >= 3 THEN 0.4 ELSE 0 END
  + CASE WHEN {cites} >= 5 THEN 1.0 WHEN {cites} >= 3 THEN 0.6 WHEN {cites} >= 1 THEN 0.3 ELSE 0 END
  + CASE WHEN regexp_matches({x}, {versions}) THEN 0.5 ELSE 0 END
  + CASE WHEN contains({x}, '```') OR contains(lower({x}), 'interface ') OR contains(lower({x}), 'router bgp') THEN 0.5 ELSE 0 END)"""


ORACLE["r6_reasoning_score"] = f"WITH {RESP} SELECT conv_id, turn, round({reasoning_score('raw')}, 6) AS score FROM responses"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w.lower())})" for w in words) + ")"


def attribution(x: str) -> str:
    domains = ", ".join(f"CASE WHEN {any_of('lower(' + x + ')', t)} THEN {q(dom)} END" for dom, t in DOMAIN_TITLES.items())
    cites = n_matches(x, r"(?i)\[Source:|Source:|from .{3,60} chapter|per .{3,60} §|according to .{3,60}")
    versions = matches(x, r"(?i)PCI.DSS\s+\d+\.\d+|HIPAA\s+\d{4}|NIST\s+CSF\s+\d+\.\d+|ISO\s+27001:\d{4}")
    return f"list_filter([{domains}], lambda v: v IS NOT NULL) AS domains, {cites}::BIGINT AS citations, {versions} AS versions"


def claims(x: str) -> str:
    rows = ", ".join(
        f"CASE WHEN {any_of('lower(' + x + ')', ctx)} THEN {{'c': {q(dom + '/' + claim)}, 'a': regexp_matches(lower({x}), {q(pat)})}} END"
        for dom, claim, pat, ctx in CLAIMS
    )
    return f"list_filter([{rows}], lambda v: v IS NOT NULL) AS verdicts"


def aligned(source: str, x: str) -> str:
    return f"""al0 AS (SELECT *, {attribution(x)}, {claims(x)} FROM {source}),
al1 AS (SELECT *, len(verdicts)::BIGINT AS applicable, len(list_filter(verdicts, lambda v: v.a))::BIGINT AS aligned,
  list_transform(list_filter(verdicts, lambda v: NOT v.a), lambda v: v.c) AS failed_claims FROM al0),
al2 AS (SELECT *, CASE WHEN applicable = 0 THEN 1.0 ELSE aligned::DOUBLE / applicable END AS claim_score FROM al1),
al AS (SELECT *, claim_score * 0.5::DOUBLE + least(1.0::DOUBLE, len(domains)::DOUBLE / 3) * 0.3::DOUBLE
  + least(1.0::DOUBLE, citations::DOUBLE / 5) * 0.2::DOUBLE AS alignment_score FROM al2)"""


ORACLE["r8_source_attribution"] = f"""WITH {RESP}, {aligned('responses', 'raw')}
SELECT conv_id, turn, {joined('domains')} AS domains, citations, {joined('versions')} AS versions FROM al"""
ORACLE["r9_claim_alignment"] = f"""WITH {RESP}, {aligned('responses', 'raw')}
SELECT conv_id, turn, applicable, aligned, {joined('failed_claims')} AS failed, round(claim_score, 6) AS score FROM al"""
ORACLE["r10_alignment_score"] = f"""WITH {RESP}, {aligned('responses', 'raw')}
SELECT conv_id, turn, round(alignment_score, 6) AS score FROM al"""


# Facts, written here as rules on (low)er-cased and (raw) text; numbers are compared as numbers.
def has_number(x: str, n: int) -> str:
    return f"list_contains(list_transform({matches(x, r'\b(\d+)\b', 1)}, lambda v: try_cast(v AS HUGEINT)), {n})"


def fact_rules(x: str) -> list[tuple[str, str, str]]:
    low = f"lower({x})"

    def w(*words):
        return any_of(low, words)

    in_range = f"len(list_filter({matches(x, r'\b(\d{3,5})\b', 1)}, lambda v: v::INT BETWEEN 1800 AND 2200)) > 0"
    near = lambda letter, word: (
        f"regexp_matches({low}, 'option.{{0,30}}{letter}.{{0,50}}{word}|{word}.{{0,50}}option.{{0,30}}{letter}')"
    )
    planes = " + ".join(f"contains({low}, '{p}')::INT" for p in ("vbond", "vmanage", "vsmart", "vedge", "cedge"))
    return [
        ("collapsed_core_max_users", "topology", f"NOT {w('collapsed core', 'two-tier')} OR {in_range}"),
        ("spine_leaf_64port_max_servers", "topology", f"NOT {w('spine', 'leaf')} OR {has_number(x, 2048)}"),
        ("three_tier_max_endpoints", "topology", f"NOT {w('three-tier', 'three tier')} OR {has_number(x, 50000)}"),
        ("n_plus_1_optimal", "ha", w("n+1", "n plus 1", "two parallel paths")),
        ("hsrp_default_preemption", "ha", f"NOT {w('hsrp')} OR NOT {w('preempt')} OR {w('disabled', 'not enabled')}"),
        ("vrrp_preemption_enabled_default", "ha", f"NOT {w('vrrp')} OR NOT {w('preempt')} OR {w('enabled')}"),
        ("active_active_capacity_planning", "ha", f"NOT {w('active-active', 'capacity')} OR {has_number(x, 50)}"),
        ("bgp_tcp_port", "bgp", f"NOT {w('bgp')} OR {has_number(x, 179)}"),
        ("ebgp_default_ttl", "bgp", f"NOT {w('ebgp', 'external bgp')} OR NOT {w('ttl')} OR {w('1', 'ebgp-multihop')}"),
        ("bgp_next_hop_iBGP", "bgp", f"NOT {w('ibgp')} OR {w('next-hop unchanged', 'next-hop-self')}"),
        ("ospf_lsa_refresh_interval", "ospf", f"NOT {w('lsa')} OR {has_number(x, 30)}"),
        ("ospf_lsa_max_age", "ospf", "true"),
        ("voice_dscp", "qos", f"NOT {w('voice', 'voip')} OR {w('ef', 'expedited forwarding', '46')}"),
        ("llq_max_bandwidth_percent", "qos", f"NOT {w('llq', 'priority queue')} OR {has_number(x, 33)}"),
        ("scavenger_dscp", "qos", "true"),
        ("inter_as_option_a_most_secure", "mpls", f"NOT {w('option a', 'back-to-back vrf')} OR {near('a', 'secure')}"),
        ("inter_as_option_c_most_scalable", "mpls", f"NOT {w('option c', 'multihop mp-ebgp')} OR {near('c', 'scalab')}"),
        ("sdwan_planes", "sdwan", f"NOT {w('sd-wan', 'sdwan')} OR ({planes}) >= 3"),
        ("symmetric_irb_no_all_vteps", "vxlan", "true"),
    ]


def fact_check(source: str, x: str, category: str | None) -> str:
    rows = []
    for name, kind, rule in fact_rules(x):
        verdict = f"{{'f': {q(name)}, 'p': ({rule})}}"
        if category:
            verdict = f"CASE WHEN coalesce({category}, '') IN ('', {q(kind)}) THEN {verdict} END"
        rows.append(verdict)
    return f"""fc0 AS (SELECT *, list_filter([{', '.join(rows)}], lambda v: v IS NOT NULL) AS fv FROM {source}),
fc AS (SELECT *, len(fv)::BIGINT AS num_checked, list_transform(list_filter(fv, lambda v: NOT v.p), lambda v: v.f) AS failed_facts,
  CASE WHEN len(fv) = 0 THEN 1.0 ELSE len(list_filter(fv, lambda v: v.p))::DOUBLE / len(fv) END AS fact_score FROM fc0)"""


ORACLE["r11_technical_facts"] = f"""WITH {RESP}, {fact_check('responses', 'raw', 'category')}
SELECT conv_id, turn, category, num_checked, {joined('failed_facts')} AS failed, round(fact_score, 6) AS score FROM fc"""
ORACLE["r11_facts_on_documents"] = f"""WITH {fact_check('documents', 'text', None)}
SELECT doc_id, {joined('failed_facts')} AS failed, round(fact_score, 6) AS score FROM fc"""


def syntax_ok(x: str) -> str:
    def times(line, ch):
        return f"length({line}) - length(replace({line}, '{ch}', ''))"

    return f"""coalesce(list_bool_and(list_transform({matches(x, '(?s)```(?:cisco|ios|nxos|juniper|text)?\n(.*?)```', 1)}, lambda b:
  {trim('b')} = '' OR (len(list_filter(string_split(b, chr(10)), lambda l: {times('l', '(')} <> {times('l', ')')})) = 0
  AND (NOT contains(b, 'router bgp') OR contains(b, 'neighbor') OR contains(b, 'network'))
  AND (NOT contains(b, 'router ospf') OR contains(b, 'network') OR contains(b, 'area'))))), true)"""


ORACLE["r13_config_syntax"] = f"WITH {RESP} SELECT conv_id, turn, {syntax_ok('raw')} AS ok FROM responses"


def amount(pattern: str) -> str:
    num = f"try_cast(replace(regexp_extract(raw, {q(pattern)}, 1), ',', '') AS DOUBLE)"
    return f"{num} * CASE upper(regexp_extract(raw, {q(pattern)}, 2)) WHEN 'M' THEN 1e6 WHEN 'K' THEN 1e3 ELSE 1.0 END"


ORACLE["r23_extract_cost"] = f"""WITH {RESP}, c AS (SELECT conv_id, turn,
  {amount(r'CAPEX[:\s$]*([0-9,]+(?:\.[0-9]+)?)\s*([MKmk]?)')} AS api_capex,
  {amount(r'(?:annual\s+)?OPEX[:\s$]*([0-9,]+(?:\.[0-9]+)?)\s*([MKmk]?)')} AS api_opex,
  {amount(r'(?i)CAPEX[:\s]+[$]?([\d,]+(?:\.\d+)?)\s*([MK]?)')} AS ac,
  {amount(r'(?i)annual\s+OPEX[:\s]+[$]?([\d,]+(?:\.\d+)?)\s*([MK]?)')} AS ao FROM responses)
SELECT conv_id, turn, api_capex, api_opex, CASE WHEN f THEN ac END AS agent_capex, CASE WHEN f THEN ao END AS agent_opex, f AS agent_found
FROM (SELECT *, coalesce(ac, 0) <> 0 OR coalesce(ao, 0) <> 0 AS f FROM c)"""

JUDGED = """judged AS (SELECT event_id, CASE event_id % 6
  WHEN 0 THEN greatest(1.0, least(5.0, value)) WHEN 1 THEN event_id % 5 + 1.5 WHEN 5 THEN greatest(1.0, least(5.0, event_id % 7))
  ELSE 3.0 END::DOUBLE AS given, event_id % 6 AS k FROM events),
judgement AS (SELECT event_id, given AS score, CASE k WHEN 0 THEN 'fine' WHEN 1 THEN 'Parsed from malformed JSON'
  WHEN 2 THEN 'Parse error' WHEN 3 THEN 'score left out' WHEN 4 THEN 'Error: no usable score' ELSE '' END AS rationale FROM judged)"""
ORACLE["r25_parse_judgement"] = f"WITH {JUDGED} SELECT event_id, round(score, 6) AS score, rationale FROM judgement"
ORACLE["a9_judge_report"] = f"""WITH {JUDGED} SELECT count(*) AS num_evaluated, round(avg(score), 6) AS avg_score,
  min(score) AS min_score, max(score) AS max_score,
  {', '.join(f'count(*) FILTER (floor(score) = {i}) AS score_{i}' for i in range(1, 6))},
  count(*) FILTER (score >= 4) AS samples_above_4, count(*) FILTER (score < 3) AS samples_below_3 FROM judgement"""

_JUDGE_PARTS = re.split(r"\$\{\w+\}", templates.JUDGE)
_FORM = f"concat({q(_JUDGE_PARTS[0])}, substr(question, 1, 500), {q(_JUDGE_PARTS[1])}, substr(concat(reasoning, chr(10), chr(10), answer), 1, 3000), {q(_JUDGE_PARTS[2])})"
_ASKED = f"""{PARSED_BASIC}, asked AS (SELECT b.*, coalesce(c.text, '') AS question FROM basic b LEFT JOIN
  (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS text FROM conversations) c USING (conv_id, turn))"""
ORACLE["x3_w9_judge_forms"] = f"WITH {_ASKED} SELECT conv_id, turn, md5({_FORM}) AS form_md5, length({_FORM})::BIGINT AS chars FROM asked"
ORACLE["x3_judged_responses"] = f"""WITH {_ASKED}, f AS (SELECT conv_id, turn, length({_FORM}) AS n FROM asked)
SELECT conv_id, turn, CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN 3.0::DOUBLE ELSE 1 + n % 9 / 2.0::DOUBLE END AS score,
  CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Error: judge was away' ELSE concat('form of ', n) END AS rationale,
  CASE n % 4 WHEN 0 THEN 'no recorded answer' WHEN 1 THEN 'judge was away' END AS judge_error FROM f"""

ORACLE["r26_chat_template"] = """WITH t AS (SELECT *, max(turn) OVER w AS last,
  min(turn) FILTER (role = 'system') OVER w AS sys FROM conversations WINDOW w AS (PARTITION BY conv_id)),
p AS (SELECT conv_id, CASE WHEN role = 'system' THEN -1 ELSE turn END AS position,
  concat('<|', CASE WHEN role IN ('system', 'user') THEN role ELSE 'assistant' END, '|>', chr(10), text, '<|end|>') AS piece
  FROM t WHERE role <> 'system' OR turn = sys
  UNION ALL SELECT conv_id, turn + 1, '<|assistant|>' FROM t WHERE turn = last AND role = 'user')
SELECT conv_id, position, md5(piece) AS piece_md5 FROM p"""

_RENDERED = """SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN concat('<|system|>', chr(10), lang, '<|end|>', chr(10)) ELSE '' END,
  '<|user|>', chr(10), source, '<|end|>', CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat(chr(10), '<|assistant|>', chr(10), text, '<|end|>') END,
  CASE WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 THEN concat(chr(10), '<|assistant|>') ELSE '' END) AS rendered FROM documents"""
ORACLE["r26_rendered_samples"] = f"SELECT doc_id, md5(rendered) AS rendered_md5, length(rendered)::BIGINT AS chars FROM ({_RENDERED})"
ORACLE["w4_calibration_texts"] = f"SELECT * FROM ({_RENDERED}) ORDER BY md5(concat('42|', doc_id)), doc_id LIMIT 128"
ORACLE["r28_span_weights"] = f"""WITH {RESP}, m AS (SELECT conv_id, turn, replace(replace(raw, '<think>', ' <think> '), '</think>', ' </think> ') AS s FROM responses),
n AS (SELECT *, {n_matches('s', r'\S+')} AS tokens, {n_matches("regexp_extract(s, '(?s)<think>.*?</think>')", r'\S+')} AS heavy FROM m)
SELECT conv_id, turn, tokens::BIGINT AS tokens, (tokens + heavy)::DOUBLE AS weight FROM n"""


# --- sample validation --------------------------------------------------------------------------


def check_rows(strict: bool) -> str:
    refs, chars = (3, 500) if strict else (2, 200)
    names = " + ".join(f"contains(think_low, {q(n.lower())})::INT" for n in CITABLE_NAMES)
    versions = "\n".join(
        f"UNION ALL SELECT sample_id, 'compliance_version_{s}', {any_of('low', v)}, '{s} mentioned without version number' "
        f"FROM b WHERE contains(low, {q(s.lower())})"
        for s, v in STANDARD_VERSIONS.items()
    )
    return f"""b AS (SELECT *, coalesce(assistant_content, '') AS body, lower(coalesce(assistant_content, '')) AS low,
  regexp_extract(coalesce(assistant_content, ''), '(?s)<think>(.*?)</think>', 1) AS think,
  lower(regexp_extract(coalesce(assistant_content, ''), '(?s)<think>(.*?)</think>', 1)) AS think_low FROM samples),
m AS (SELECT sample_id, body, {n_matches('think', r'(?i)Step\s+\d+:')} AS steps, {names} AS refs,
  length({trim("string_split(body, '</think>')[-1]")}) AS tail FROM b WHERE n_messages >= 2 AND body <> ''),
checks AS (
SELECT sample_id, 'has_messages' AS name, false AS passed, 'Sample must have at least 2 messages' AS message FROM b WHERE n_messages < 2
UNION ALL SELECT sample_id, 'has_assistant_message', false, 'No assistant message found' FROM b WHERE n_messages >= 2 AND body = ''
UNION ALL SELECT sample_id, 'has_think_tags', contains(body, '<think>') AND contains(body, '</think>'), 'Missing <think>...</think> tags in assistant response' FROM m
UNION ALL SELECT sample_id, 'min_reasoning_steps', steps >= 5, concat('Only ', steps, ' steps found (minimum 5)') FROM m
UNION ALL SELECT sample_id, 'has_source_references', refs >= {refs}, concat('Only ', refs, ' source references found (minimum {refs})') FROM m
UNION ALL SELECT sample_id, 'has_answer_content', tail >= {chars}, concat('Answer section too short: ', tail, ' chars (min {chars})') FROM m
UNION ALL SELECT sample_id, 'spine_leaf_context', {any_of('low', SPINE_LEAF_CONTEXT)}, 'Spine-leaf topology mentioned without data center context'
  FROM b WHERE contains(low, 'spine-leaf') OR contains(low, 'spine leaf')
{versions}
UNION ALL SELECT sample_id, 'tls_version_specified', regexp_matches(low, 'tls\\s*1\\.[2-3]'),
  'TLS mentioned without version (should specify TLS 1.2 or 1.3)' FROM b WHERE contains(low, 'tls') OR contains(low, 'ssl')
UNION ALL SELECT sample_id, 'has_user_question', has_user, 'No user question found' FROM b
UNION ALL SELECT sample_id, 'explicit_source_citations', n >= 2, concat('Only ', n, ' explicit source citations in think block')
  FROM (SELECT sample_id, {n_matches('think', r'(?i)(?:Source|Reference|Ref|Per|From|Chapter|Section)[:.]?\s*[^\n]+')} AS n FROM b)
UNION ALL SELECT sample_id, 'metadata_sources_populated', n_sources >= 2, 'metadata.sources_used has fewer than 2 entries' FROM b
UNION ALL SELECT sample_id, 'metadata_reasoning_steps', reasoning_steps >= 5, concat('metadata.reasoning_steps = ', reasoning_steps, ' (min 5)') FROM b),
scored AS (SELECT sample_id, count(*) FILTER (passed)::DOUBLE / count(*) * 100 AS score, count(*) FILTER (NOT passed) AS errors FROM checks GROUP BY 1),
warned AS (SELECT sample_id, (contains(low, 'ebgp') AND user_count > 0 AND user_count < 500)::BIGINT AS warnings FROM b)"""


_CHECKS = f"WITH {DIGEST}, {check_rows(False)}"
ORACLE["r14_r16_sample_checks"] = f"{_CHECKS} SELECT * FROM checks"
ORACLE["r14_r16_strict_checks"] = f"WITH {DIGEST}, {check_rows(True)} SELECT sample_id, name, passed FROM checks"
ORACLE["r17_validate_samples"] = f"""{_CHECKS} SELECT sample_id, round(score, 6) AS score, score >= 70 AS passed, errors, warnings
FROM scored JOIN warned USING (sample_id)"""
_REPORT = """SELECT count(*) AS total_samples, count(*) FILTER (score >= 70) AS passed_samples,
  count(*) FILTER (score < 70) AS failed_samples, round(avg(score), 6) AS average_score FROM scored"""
ORACLE["a3_validation_report"] = f"{_CHECKS} {_REPORT}"
ORACLE["a18_pass_rate_gate"] = f"""{_CHECKS} SELECT round(passed_samples::DOUBLE / total_samples, 6) AS pass_rate,
  passed_samples::DOUBLE / total_samples >= 0.8 AS ok FROM ({_REPORT})"""
_RATES = """SELECT name AS "check", count(*) AS emitted, round(count(*) FILTER (passed)::DOUBLE / count(*) * 100, 6) AS pass_rate,
  CASE WHEN count(*) FILTER (passed)::DOUBLE / count(*) * 100 >= 80 THEN 'GOOD' ELSE 'NEEDS WORK' END AS status FROM checks GROUP BY 1"""
ORACLE["a4_check_rates"] = f"{_CHECKS} {_RATES}"
ORACLE["p8_recommendations"] = f"""{_CHECKS} SELECT "check", printf('Improve ''%s'': currently %.1f%% pass rate', "check", pass_rate) AS recommendation
FROM ({_RATES}) WHERE pass_rate < 80"""
ORACLE["a5_frequent_errors"] = f"""{_CHECKS} SELECT name AS error, count(*) AS n, concat(name, ': ', count(*), ' occurrences') AS text
FROM checks WHERE NOT passed GROUP BY name ORDER BY n DESC, name LIMIT 5"""


def public_rows(source: str, x: str, key: str) -> str:
    """Addresses outside the listed blocks, by integer division."""
    octet = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
    found = matches(x, rf"\b(?:{octet}\.){{3}}{octet}\b")
    blocks = []
    for first, bits in NON_PUBLIC_BLOCKS:
        a, b, c, e = (int(v) for v in first.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + e
        blocks.append(f"n // {2 ** (32 - bits)} = {low // 2 ** (32 - bits)}")
    number = " + ".join(f"string_split(ip, '.')[{i + 1}]::BIGINT * {256 ** (3 - i)}" for i in range(4))
    return f"""SELECT {key}, concat('public_ip_in_design_', ip) AS name, ip
FROM (SELECT *, {number} AS n FROM (SELECT {key}, unnest({found}) AS ip FROM {source})
  WHERE NOT regexp_matches(ip, '(^|[.])0[0-9]'))
WHERE NOT (({' OR '.join(blocks)}) AND ip NOT IN ({', '.join(q(p) for p in PUBLIC_EXCEPTIONS)}))"""


ORACLE["r19_public_addresses"] = f"SELECT doc_id, name, ip AS evidence FROM ({public_rows('documents', 'text', 'doc_id')})"

_CONTROL_ROWS = "\n".join(
    f"UNION ALL SELECT sample_id, '{CONTROL_PREFIX[s]}_{c}', {any_of('low', w)}, 'error', "
    f"'{s} {c.replace('_', ' ')} not addressed', '{s} {c.replace('_', ' ')} addressed', '' FROM b WHERE list_contains(compliance, '{s}')"
    for s, c, w in CONTROLS
)
_ACC = f"""WITH {DIGEST}, b AS (SELECT *, lower(coalesce(assistant_content, '')) AS low FROM samples),
g(sample_id, name, passed, grade, bad, good, evidence) AS (
SELECT sample_id, 'vxlan_context', {any_of('low', OVERLAY_CONTEXT)}, 'warning', 'VXLAN/EVPN mentioned without clear data center context',
  'VXLAN/EVPN used appropriately in DC context', '' FROM b WHERE {any_of('low', OVERLAY_WORDS)}
UNION ALL SELECT sample_id, 'eigrp_multi_vendor', false, 'warning', 'EIGRP mentioned alongside non-Cisco vendors (EIGRP is Cisco proprietary)', '', ''
  FROM b WHERE {any_of('low', EIGRP_WORDS)} AND {any_of('low', OTHER_VENDORS)}
UNION ALL SELECT sample_id, name, false, 'warning', concat('Public IP ', ip, ' used - verify if intentional (internet-facing)'), '', ip
  FROM ({public_rows('b', "coalesce(assistant_content, '')", 'sample_id')})
UNION ALL SELECT sample_id, 'spine_leaf_appropriate', {any_of('low', SPINE_LEAF_REQUIRED)}, 'error', 'Spine-leaf is a DC topology, not campus/branch',
  'Spine-leaf correctly used in DC context', '' FROM b WHERE {any_of('low', ['spine-leaf', 'spine leaf'])}
UNION ALL SELECT sample_id, 'three_tier_scale', user_count >= 2000, 'warning',
  concat('Three-tier for ', user_count, ' users is oversized (recommended: 2000+ users)'),
  concat('Three-tier correctly sized for ', user_count, ' users'), user_count::VARCHAR FROM b WHERE {any_of('low', ['three-tier', 'three tier'])}
UNION ALL SELECT sample_id, 'collapsed_core_scale', user_count <= 2000, 'warning',
  concat('Collapsed core for ', user_count, ' users exceeds recommended max (2000 users)'),
  concat('Collapsed core appropriate for ', user_count, ' users'), user_count::VARCHAR FROM b WHERE contains(low, 'collapsed core')
{_CONTROL_ROWS}),
acc AS (SELECT sample_id, coalesce(count(*) FILTER (passed)::DOUBLE / nullif(count(name), 0) * 100, 100) AS score,
  count(*) FILTER (NOT passed AND grade = 'error') AS critical FROM b LEFT JOIN g USING (sample_id) GROUP BY 1)"""
ORACLE["r18_r21_accuracy_checks"] = f"""{_ACC} SELECT sample_id, name, passed, CASE WHEN passed THEN 'info' ELSE grade END AS severity,
  CASE WHEN passed THEN good ELSE bad END AS message, evidence FROM g"""
ORACLE["r22_accuracy_scores"] = f"{_ACC} SELECT sample_id, round(score, 6) AS score, critical FROM acc"
ORACLE["a6_accuracy_report"] = f"""{_ACC} SELECT count(*) AS total_samples, round(avg(score), 6) AS average_accuracy_score,
  sum(critical)::BIGINT AS total_critical_failures, count(*) FILTER (score < 60) AS samples_with_critical_failures FROM acc"""


# --- evaluation ---------------------------------------------------------------------------------

# Half-even on the binary value: x * 2^60 is a whole number, the rest is integer arithmetic.
_ROUND3 = """(SELECT (w * 1000 // h + CASE WHEN (w * 1000 % h) * 2 > h OR ((w * 1000 % h) * 2 = h AND (w * 1000 // h) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 1000
  FROM (SELECT (total * 1152921504606846976::DOUBLE)::HUGEINT AS w, 1152921504606846976::HUGEINT AS h))"""
SCORED = f"""{PARSED_SUITE}, words AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda v: length(v) > 4) AS w FROM benchmark),
cases AS (SELECT item_id AS case_id, (['topology', 'bgp', 'qos', 'ha'])[item_id % 4 + 1] AS case_category,
  list_concat(kw, ['TLS 1.3', 'Step 3', 'BGP']) AS expected, ['Source list', concat('RFC ', item_id + 2000), 'Campus ' || kw[1]] AS required
  FROM (SELECT item_id, {distinct_in_order('w')} AS kw FROM words)),
k0 AS (SELECT s.*, c.*, lower(raw) AS low FROM suite s JOIN cases c ON s.conv_id % (SELECT count(*) FROM benchmark) = c.case_id),
k1 AS (SELECT *, list_filter(expected, lambda v: contains(low, lower(v))) AS kfound,
  list_filter(expected, lambda v: NOT contains(low, lower(v))) AS kmissing,
  list_filter(required, lambda v: len(list_filter(string_split(lower(v), ' '), lambda p: length(p) > 4 AND contains(low, p))) > 0) AS sfound FROM k0),
k2 AS (SELECT *, len(kfound)::DOUBLE / greatest(len(expected), 1) AS keyword_score, len(sfound)::DOUBLE / greatest(len(required), 1) AS source_score FROM k1),
k3 AS (SELECT *, 0.5::DOUBLE * keyword_score + 0.2::DOUBLE * source_score + 0.2::DOUBLE * confidence
  + CASE WHEN has_think_block THEN 0.1::DOUBLE ELSE 0 END AS total FROM k2),
k4 AS (SELECT *, {_ROUND3} AS overall_score FROM k3),
scored AS (SELECT *, CASE WHEN overall_score >= 0.7 THEN 'PASS' WHEN overall_score >= 0.45 THEN 'WARN' ELSE 'FAIL' END AS pass_fail FROM k4)"""
ORACLE["j1_r7_keyword_scores"] = f"""WITH {SCORED} SELECT conv_id, turn, case_id, {joined('kfound')} AS found, {joined('kmissing')} AS missing,
  {joined('sfound')} AS sources, round(keyword_score, 6) AS keyword_score, round(source_score, 6) AS source_score, overall_score, pass_fail FROM scored"""
_A12 = """count(*) AS cases, round(avg(overall_score), 6) AS avg_score, round(avg(keyword_score), 6) AS avg_keyword,
  round(avg(confidence), 6) AS avg_confidence, round(avg(latency_ms), 6) AS avg_latency_ms,
  round(count(*) FILTER (has_think_block)::DOUBLE / count(*), 6) AS think_rate,
  count(*) FILTER (pass_fail = 'PASS') AS passes, count(*) FILTER (pass_fail = 'WARN') AS warns, count(*) FILTER (pass_fail = 'FAIL') AS fails FROM scored"""
ORACLE["a12_quality_report"] = f"""WITH {SCORED} SELECT case_category AS category, false AS is_total, {_A12} GROUP BY 1
UNION ALL SELECT 'ALL', true, {_A12}"""
ORACLE["a13_missing_keywords"] = f"""WITH {SCORED} SELECT keyword, count(*) AS n FROM (SELECT unnest(kmissing) AS keyword FROM scored)
GROUP BY 1 ORDER BY n DESC, keyword LIMIT 8"""


def summary(col: str, source: str) -> str:
    return f"""SELECT count(*) AS num_samples, round(avg({col}), 6) AS avg_score, round(min({col}), 6) AS min_score,
  round(max({col}), 6) AS max_score FROM {source}"""


_FACTS = f"WITH {RESP}, {fact_check('responses', 'raw', 'category')}"
_ALIGN = f"WITH {RESP}, {aligned('responses', 'raw')}"
ORACLE["a7_fact_report"] = f"{_FACTS} {summary('fact_score', 'fc')}"
ORACLE["a7_failed_facts"] = f"{_FACTS} SELECT fact, count(*) AS n FROM (SELECT unnest(failed_facts) AS fact FROM fc) GROUP BY 1 ORDER BY n DESC, fact LIMIT 10"
ORACLE["a8_alignment_report"] = f"{_ALIGN} {summary('alignment_score', 'al')}"
ORACLE["a8_failed_claims"] = f"{_ALIGN} SELECT claim, count(*) AS n FROM (SELECT unnest(failed_claims) AS claim FROM al) GROUP BY 1 ORDER BY n DESC, claim LIMIT 5"
ORACLE["a10_reasoning_report"] = f"WITH {RESP}, r AS (SELECT {reasoning_score('raw')} AS s FROM responses) {summary('s', 'r')}"

_BATCH = f"""{PARSED_BASIC}, asked AS (SELECT concat(conv_id, '-', turn) AS id, conv_id, turn + 1 AS turn,
  CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE text END AS prompt FROM conversations WHERE role = 'user'),
batch AS (SELECT a.*, b.raw, b.answer, b.latency_ms, b.has_think_block, b.reasoning_steps FROM asked a LEFT JOIN basic b USING (conv_id, turn))"""
ORACLE["s8_u2_batch_records"] = f"""WITH {_BATCH} SELECT id, md5(prompt) AS prompt_md5, md5(coalesce(answer, '')) AS answer_md5,
  CASE WHEN raw IS NULL THEN 'no recorded answer' END AS error, round(latency_ms, 6) AS latency_ms, has_think_block, reasoning_steps
FROM batch WHERE prompt <> ''"""
ORACLE["a11_batch_stats"] = f"""WITH {_BATCH}, d AS (SELECT *, prompt <> '' AND raw IS NOT NULL AS done FROM batch)
SELECT count(*) AS total, count(*) FILTER (done) AS completed, count(*) FILTER (NOT done) AS failed,
  round(avg(latency_ms) FILTER (done), 6) AS avg_latency_ms, round(min(latency_ms) FILTER (done), 6) AS min_latency_ms,
  round(max(latency_ms) FILTER (done), 6) AS max_latency_ms,
  round(count(*) FILTER (done AND has_think_block)::DOUBLE / count(*) FILTER (done), 6) AS think_block_rate FROM d"""

_EVAL = f"""WITH {PARSED_BASIC}, ev AS (SELECT *, concat(answer, ' ', reasoning) AS full_text, concat(reasoning, ' ', answer) AS claim_text FROM basic),
{fact_check('ev', 'full_text', 'category')}, {aligned('fc', 'claim_text')},
mx AS (SELECT avg(fact_score) AS technical_accuracy, avg(alignment_score) AS knowledge_alignment,
  avg(greatest(1, turn % 6)) AS reasoning_quality,
  avg(has_think_block::INT) AS think_block_present, avg((reasoning_steps >= 5)::INT) AS steps_sufficient,
  coalesce(avg(CASE WHEN contains(answer, '```') THEN {syntax_ok('answer')}::INT END), 1.0) AS config_syntax_valid,
  avg(latency_ms) AS avg_latency_ms FROM al),
metrics AS (UNPIVOT mx ON technical_accuracy, knowledge_alignment, reasoning_quality, think_block_present, steps_sufficient,
  config_syntax_valid, avg_latency_ms INTO NAME metric VALUE value)"""
ORACLE["a14_evaluation_metrics"] = f"{_EVAL} SELECT metric, round(value, 6) AS value FROM metrics"
_GATES = ", ".join(f"({q(k)}, {v}::DOUBLE)" for k, v in GATE_TARGETS.items())
ORACLE["q1_gates"] = f"""{_EVAL}, t(metric, target) AS (VALUES {_GATES})
SELECT metric, target, round(value, 6) AS value, coalesce(value >= target, true) AS passed, value IS NULL AS skipped
FROM t LEFT JOIN metrics USING (metric)"""
ORACLE["q1_overall"] = f"""{_EVAL}, t(metric, target) AS (VALUES {_GATES})
SELECT bool_and(coalesce(value >= target, true)) AS overall_pass, count(*) FILTER (value IS NULL) AS skipped_gates
FROM t LEFT JOIN metrics USING (metric)"""


# --- generation ---------------------------------------------------------------------------------


def hash_draw(field: str, n: int, seed: int = 42) -> str:
    return f"(('0x' || substr(md5(concat('{seed}|{field}|', o_orderkey)), 1, 8))::BIGINT % {n})"


def lookup(values, field: str) -> str:
    return f"([{', '.join(q(v) if isinstance(v, str) else (arr(v) + '::VARCHAR[]' if isinstance(v, list) else str(v)) for v in values)}])[{hash_draw(field, len(values))} + 1]"


def case_map(x: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {x} {whens} {f'ELSE {q(default)} ' if default is not None else ''}END"


_SCALE_I = hash_draw("scale", 4)
SCENARIOS = f"""d0 AS (SELECT o_orderkey, {lookup([s for s, _, _ in sc.SCALES], 'scale')} AS scale,
  ({arr([lo for _, lo, _ in sc.SCALES])})[{_SCALE_I} + 1] AS lo, ({arr([hi for _, _, hi in sc.SCALES])})[{_SCALE_I} + 1] AS hi,
  {lookup(sc.SITE_COUNTS, 'sites')}::BIGINT AS site_count, {lookup(sc.INDUSTRIES, 'industry')} AS industry,
  {lookup(sc.COMPLIANCE_SETS, 'compliance')} AS comp, {lookup(sc.UPTIMES, 'uptime')} AS uptime_requirement,
  {lookup(sc.BUDGETS, 'budget')} AS budget, {hash_draw('datacenter', 2 ** 32)} / 4294967296.0::DOUBLE < 0.15 AS is_datacenter,
  {hash_draw('cloud', 2 ** 32)} / 4294967296.0::DOUBLE < 0.3 AS cloud_heavy FROM orders),
scen AS (SELECT o_orderkey, scale, (lo + {hash_draw('users', 2 ** 32)} % (hi - lo + 1))::BIGINT AS user_count, site_count, industry,
  uptime_requirement, budget, is_datacenter, cloud_heavy,
  CASE WHEN len(comp) = 0 AND industry = 'financial_services' THEN ['PCI-DSS', 'SOX']
       WHEN len(comp) = 0 AND industry = 'healthcare' THEN ['HIPAA'] ELSE comp END AS compliance FROM d0)"""
FAULTS = f"""fault AS (SELECT o_orderkey, {lookup([p for p, _, _ in sc.FAULTS], 'fault')} AS protocol,
  {lookup([i for _, i, _ in sc.FAULTS], 'fault')} AS issue_type, {lookup([s for _, _, s in sc.FAULTS], 'fault')} AS symptoms FROM orders)"""

ORACLE["g1_design_scenarios"] = f"WITH {SCENARIOS} SELECT * REPLACE ({joined('compliance')} AS compliance) FROM scen"
ORACLE["g2_fault_scenarios"] = f"WITH {FAULTS} SELECT * REPLACE ({joined('symptoms')} AS symptoms) FROM fault"
_KINDS = """kinds AS (SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(concat('42|', o_orderkey)), o_orderkey)
  <= floor((SELECT count(*) FROM orders) * 0.7::DOUBLE) THEN 'design' ELSE 'troubleshooting' END AS kind FROM orders)"""
ORACLE["g3_plan_kinds"] = f"WITH {_KINDS} SELECT * FROM kinds"

_COMPLY = "CASE WHEN len(compliance) > 0 THEN concat(' We must comply with ', array_to_string(compliance, ' and '), '.') ELSE '' END"
_BUDGET = case_map("budget", sc.BUDGET_PHRASES, "moderate budget")
_IND, _USERS = "replace(industry, '_', ' ')", "format('{:,}', user_count)"
_QUESTION = f"""CASE {hash_draw('question', 3)}
 WHEN 0 THEN concat('Design a network for a ', {_IND}, ' company with ', {_USERS}, ' users across ', site_count,
   CASE WHEN site_count > 1 THEN ' sites' ELSE ' site' END, '.', {_COMPLY}, ' We need ', uptime_requirement, ' uptime and have a ', {_BUDGET}, '.')
 WHEN 1 THEN concat('I''m building network infrastructure for a ', {_IND}, ' organization. We have ', {_USERS}, ' employees ',
   CASE WHEN site_count > 1 THEN concat('distributed across ', site_count, ' locations') ELSE 'at a single location' END, '.', {_COMPLY},
   ' Reliability target: ', uptime_requirement, '. Budget: ', {_BUDGET}, '. What architecture do you recommend?')
 ELSE concat('Recommend a complete network architecture for a ', {_IND}, ' enterprise: ', {_USERS}, ' users, ', site_count, ' sites.', {_COMPLY},
   ' Required uptime: ', uptime_requirement, '. Budget constraints: ', {_BUDGET},
   '. Include topology, WAN design, security, hardware recommendations, and cost estimates.') END"""
_SYM, _PROTO, _ISSUE = "array_to_string(symptoms, '; ')", "upper(protocol)", "replace(issue_type, '_', ' ')"
_FAULT_QUESTION = f"""CASE {hash_draw('question', 3)}
 WHEN 0 THEN concat('We''re experiencing ', {_ISSUE}, ' on our ', {_PROTO}, ' network. Symptoms: ', {_SYM}, '. Walk me through the troubleshooting methodology.')
 WHEN 1 THEN concat('Our network team is seeing: ', {_SYM}, '. This appears to be a ', {_PROTO}, ' ', {_ISSUE},
   ' issue. What is the systematic approach to diagnose and resolve this?')
 ELSE concat('Help me troubleshoot a ', {_PROTO}, ' problem. We''re observing: ', {_SYM}, '. Provide step-by-step diagnostic commands and expected outputs.') END"""
ORACLE["g4_design_questions"] = f"WITH {SCENARIOS} SELECT o_orderkey, {_QUESTION} AS question FROM scen"
ORACLE["g4_fault_questions"] = f"WITH {FAULTS} SELECT o_orderkey, {_FAULT_QUESTION} AS question FROM fault"

REQUESTS = """requests AS (SELECT o_orderkey AS req_id, (50 + o_orderkey * 7919 % 60000)::BIGINT AS users, (1 + o_custkey % 25)::BIGINT AS sites,
  CASE c_mktsegment WHEN 'BUILDING' THEN ['PCI-DSS'] WHEN 'MACHINERY' THEN ['HIPAA'] WHEN 'AUTOMOBILE' THEN ['PCI-DSS', 'HIPAA'] ELSE []::VARCHAR[] END AS compliance,
  CASE o_orderpriority[1] WHEN '1' THEN 99.99 WHEN '2' THEN 99.999 WHEN '5' THEN 89.5 ELSE 99.9 END::DOUBLE AS uptime,
  o_orderpriority[1] AS priority_code, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS ts
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def label(u: str) -> str:
    return f"CASE WHEN {u} < 500 THEN 'small' WHEN {u} < 5000 THEN 'medium' WHEN {u} < 50000 THEN 'large' ELSE 'enterprise' END"


def costs(source: str, users: str, per_user: str, keep: str) -> str:
    return f"""c0 AS (SELECT *, {per_user} AS per_user, 1.0::DOUBLE + CASE WHEN list_contains(compliance, 'PCI-DSS') THEN 0.3 ELSE 0 END
  + CASE WHEN list_contains(compliance, 'HIPAA') THEN 0.25 ELSE 0 END AS multiplier FROM {source}),
c1 AS (SELECT *, per_user * {users} AS base_capex, floor(per_user * {users} * multiplier)::BIGINT AS capex FROM c0),
c2 AS (SELECT *, floor(capex * 0.15::DOUBLE)::BIGINT AS opex FROM c1), {keep} AS (SELECT *, capex + 3 * opex AS tco FROM c2)"""


def per_user(u: str) -> str:
    return f"CASE {label(u)} WHEN 'small' THEN 350 WHEN 'large' THEN 1000 ELSE 600 END::BIGINT"


ORACLE["g5_g9_choices"] = f"""WITH {REQUESTS}, {costs('requests', 'users', per_user('users'), 'c')}
SELECT req_id, {label('users')} AS scale, CASE WHEN req_id % 7 = 0 THEN 'spine_leaf' WHEN users < 2000 THEN 'collapsed_core' ELSE 'three_tier' END AS topology,
  CASE WHEN sites > 10 OR req_id % 3 = 0 THEN 'sd_wan' WHEN len(compliance) > 0 THEN 'mpls' WHEN sites > 3 THEN 'hybrid_wan' ELSE 'mpls' END AS wan,
  users // sites AS users_per_site, users // sites * 2 AS mbps,
  round_even(least(users // sites * 2 * 1.2::DOUBLE, users // sites * 2 + 100.0), 0)::BIGINT AS recommended,
  per_user, base_capex, round(multiplier, 6) AS multiplier, capex, opex, tco FROM c"""
ORACLE["j6_cost_benchmark"] = f"""WITH {REQUESTS}, l AS (SELECT *, {label('users')} AS scale FROM requests),
b(scale, typical) AS (VALUES ('small', '$350'), ('medium', '$600'), ('large', '$1000')),
j AS (SELECT l.*, b.typical FROM l LEFT JOIN b USING (scale)),
{costs('j', 'users', "replace(coalesce(typical, '$600'), '$', '')::BIGINT", 'c')} SELECT req_id, scale, typical, capex FROM c"""


def sql_step(n_title: str, source: str, content: str, sub: str = "[]") -> str:
    return f"{{'t': {n_title}, 's': {source}, 'c': {content}, 'b': {sub}::VARCHAR[]}}"


RENDERED = """concat('<think>', array_to_string(list_transform(chain, lambda s, i: concat(chr(10), chr(10), 'Step ', i, ': ', s.t, chr(10),
  '- Source: ', s.s, chr(10), s.c, array_to_string(list_transform(s.b, lambda x: concat(chr(10), '  * ', x)), ''))), ''), chr(10), '</think>')"""

_PCI, _HIPAA = "list_contains(compliance, 'PCI-DSS')", "list_contains(compliance, 'HIPAA')"
_WAN = f"CASE WHEN site_count > 10 OR cloud_heavy THEN 'SD WAN' WHEN {_PCI} OR {_HIPAA} THEN 'MPLS' WHEN site_count > 3 THEN 'HYBRID WAN' ELSE 'MPLS' END"
_PER = "(user_count // site_count)"


def hardware(i: int) -> str:
    return "CASE " + " ".join(f"WHEN user_count > {r[0]} THEN {q(r[i])}" for r in ct.HARDWARE[:-1]) + f" ELSE {q(ct.HARDWARE[-1][i])} END"


_DESIGN_STEPS = ", ".join([
    sql_step(q(ct.SCALE_TITLE), q(ct.SCALE_SOURCE),
             f"concat('- User count: ', user_count, ' → ''', {label('user_count')}, ''' category', chr(10), '- Recommended topology: ', "
             "CASE WHEN is_datacenter THEN 'Spine Leaf' WHEN user_count < 2000 THEN 'Collapsed Core' ELSE 'Three Tier' END, chr(10), '- Decision basis: ', "
             "CASE WHEN is_datacenter THEN 'Data center workloads' WHEN user_count < 2000 THEN '50-2000' ELSE '2000-100000' END, ' user range')",
             "[CASE WHEN user_count > 2000 THEN 'Alternative 1 considered: collapsed core - Rejected: exceeds 2000-user threshold' "
             "ELSE 'Alternative 1 considered: collapsed core - Viable option' END, CASE WHEN is_datacenter THEN 'Alternative 2 considered: spine-leaf - Applicable' "
             "ELSE 'Alternative 2 considered: spine-leaf - Rejected: data center topology only' END]"),
    f"CASE WHEN {_PCI} THEN {sql_step(q(ct.PCI_TITLE), q(ct.PCI_SOURCE), q(ct.PCI_BODY), arr(ct.PCI_SUB))} END",
    f"CASE WHEN {_HIPAA} THEN {sql_step(q(ct.HIPAA_TITLE), q(ct.HIPAA_SOURCE), q(ct.HIPAA_BODY), arr(ct.HIPAA_SUB))} END",
    sql_step("concat('High Availability Design for ', uptime_requirement, ' Uptime')", q(ct.HA_SOURCE),
             f"concat('- Uptime target: ', uptime_requirement, ' = ', {case_map('uptime_requirement', ct.UPTIME_NOTES)}, chr(10), {q(ct.UPTIME_TAIL)})",
             f"CASE WHEN uptime_requirement LIKE '%99.99%' THEN {arr(ct.HA_SUB + ct.HA_SUB_STRICT)} ELSE {arr(ct.HA_SUB)} END"),
    "CASE WHEN site_count > 1 THEN " + sql_step(
        q(ct.WAN_TITLE), q(ct.WAN_SOURCE),
        f"concat('- Site count: ', site_count, ' → ', {_WAN}, chr(10), '- Average users per site: ', {_PER}, chr(10), '- Bandwidth calculation: ', {_PER}, "
        f"' users × 2 Mbps = ', {_PER} * 2, ' Mbps minimum', chr(10), '- Recommended: ', "
        f"round_even(least({_PER} * 2 * 1.2::DOUBLE, {_PER} * 2 + 100.0), 0)::BIGINT, ' Mbps with 20% headroom')",
        f"CASE {_WAN} WHEN 'SD WAN' THEN {arr(ct.WAN_SUB['sd_wan'])} WHEN 'MPLS' THEN {arr(ct.WAN_SUB['mpls'])} ELSE []::VARCHAR[] END") + " END",
    sql_step(q(ct.SECURITY_TITLE), q(ct.SECURITY_SOURCE),
             f"concat({q(ct.SECURITY_HEAD)}, chr(10), '- Compliance-driven segmentation: ', CASE WHEN {_PCI} THEN 'CDE isolation required' ELSE 'Standard VLAN segmentation' END, "
             f"chr(10), '- PHI data isolation: ', CASE WHEN {_HIPAA} THEN 'HIPAA-compliant separate VLAN required' ELSE 'Not required' END, chr(10), {q(ct.SECURITY_TAIL)})",
             f"list_filter(list_concat({arr(ct.SECURITY_SUB)}, [CASE WHEN {_PCI} THEN {q(ct.SECURITY_PCI)} END, CASE WHEN {_HIPAA} THEN {q(ct.SECURITY_HIPAA)} END]), lambda x: x IS NOT NULL)"),
    sql_step(q(ct.VENDOR_TITLE), q(ct.VENDOR_SOURCE),
             f"concat('- Core: ', {hardware(1)}, chr(10), '- Distribution: ', {hardware(2)}, chr(10), '- Access: ', {hardware(3)}, chr(10), {q(ct.HARDWARE_TAIL)})"),
    sql_step(q(ct.COST_TITLE), q(ct.COST_SOURCE),
             f"concat('- Scale: ', {label('user_count')}, ' (', user_count, ' users) → $', format('{{:,}}', per_user), '/user benchmark', chr(10), '- Base CapEx: $', "
             "format('{:,}', base_capex), chr(10), '- Compliance premium: ', round((multiplier - 1) * 100)::INT, '%', chr(10), '- Estimated total CapEx: $', "
             "format('{:,}', capex), chr(10), '- Annual OpEx estimate: $', format('{:,}', opex), ' (15% of CapEx)', chr(10), '- 3-Year TCO: $', format('{:,}', tco))"),
    sql_step(q(ct.PHASE_TITLE), q(ct.PHASE_SOURCE),
             f"CASE WHEN user_count > 10000 OR site_count > 10 THEN {q(ct.PHASES_LARGE)} WHEN user_count > 1000 THEN {q(ct.PHASES_MEDIUM)} ELSE {q(ct.PHASES_SMALL)} END"),
])
DESIGN_CHAINS = f"""{SCENARIOS}, {costs('scen', 'user_count', per_user('user_count'), 'priced')},
chains AS (SELECT *, list_filter([{_DESIGN_STEPS}], lambda s: s IS NOT NULL) AS chain FROM priced)"""
ORACLE["g11_design_chains"] = f"WITH {DESIGN_CHAINS} SELECT o_orderkey, len(chain)::BIGINT AS steps, md5({RENDERED}) AS think_md5 FROM chains"


def sql_route(route: str) -> str:
    out = []
    for r, _, check, commands, expected, bad in ct.DIAGNOSTICS:
        if r == route:
            body = f"Command: {', '.join(commands)}\nExpected: {expected}" + (f"\nIf fail: {bad}" if bad else "")
            title, source = ct.ROUTE_WORDING[r.split("_")[0]]
            out.append(sql_step(q(title + check), q(source), q(body)))
    return f"[{', '.join(out)}]"


_LAYER_STEPS = "[" + ", ".join(
    sql_step(q(f"Layer {n} ({name}) Verification"), q(ct.ROUTE_WORDING["layers"][1]), q(f"Checks: {', '.join(c)}\nCommands: {', '.join(k)}"))
    for n, name, c, k in ct.LAYERS
) + "]"
_GENERIC = "[" + ", ".join(
    sql_step(q(f"Diagnostic Step {i}: Systematic Verification"), q(ct.GENERIC_SOURCE),
             f"concat('Verify ', {_PROTO}, ' ', issue_type, ' from multiple angles:', chr(10), {q(ct.GENERIC_TAIL)})")
    for i in range(1, 5)
) + "]"
FAULT_CHAINS = f"""{FAULTS}, fault_chains AS (SELECT *, list_concat(
  [{sql_step(q(ct.TRIAGE_TITLE), q(ct.TRIAGE_SOURCE), f"concat('- Protocol affected: ', {_PROTO}, chr(10), '- Issue category: ', issue_type, chr(10), '- Symptoms: ', array_to_string(symptoms, ', '), chr(10), {q(ct.TRIAGE_TAIL)})")},
   {sql_step(q(ct.LINK_TITLE), q(ct.LINK_SOURCE), q(ct.LINK_BODY))}],
  CASE WHEN protocol = 'bgp' AND issue_type LIKE '%neighbor%' THEN {sql_route('bgp_neighbor_down')} WHEN protocol = 'bgp' THEN {sql_route('bgp_route_missing')}
    WHEN protocol = 'ospf' AND (issue_type LIKE '%exstart%' OR issue_type LIKE '%exchange%') THEN {sql_route('ospf_exstart')}
    WHEN protocol = 'ospf' THEN {sql_route('ospf_neighbor_down')} WHEN protocol IN ('interface', 'connectivity') THEN {_LAYER_STEPS} ELSE {_GENERIC} END,
  [{sql_step(q(ct.RESOLUTION_TITLE), f"concat({_PROTO}, {q(ct.RESOLUTION_SOURCE_TAIL)})",
             f"concat('- Root cause category: ', issue_type, chr(10), '- Common causes for ', {_PROTO}, ': ', {case_map('protocol', ct.CAUSES, ct.CAUSE_DEFAULT)}, chr(10), {q(ct.RESOLUTION_TAIL)})",
             f"CASE protocol WHEN 'bgp' THEN {arr(ct.VERIFY['bgp'])} WHEN 'ospf' THEN {arr(ct.VERIFY['ospf'])} WHEN 'interface' THEN {arr(ct.VERIFY['interface'])} ELSE {arr(ct.VERIFY_DEFAULT)} END")}]) AS chain FROM fault)"""
ORACLE["g12_fault_chains"] = f"WITH {FAULT_CHAINS} SELECT o_orderkey, len(chain)::BIGINT AS steps, md5({RENDERED}) AS think_md5 FROM fault_chains"
_ASSEMBLED = f"""WITH {_KINDS}, {DESIGN_CHAINS}, {FAULT_CHAINS},
a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN concat(o_orderpriority, ' ', o_orderstatus) END AS answer FROM orders),
both_kinds AS (SELECT o_orderkey, kind, {_QUESTION} AS question, {RENDERED} AS think, len(chain)::BIGINT AS steps,
    {q(sc.DESIGN_SOURCES[0])} AS src FROM chains JOIN kinds USING (o_orderkey) WHERE kind = 'design'
  UNION ALL SELECT o_orderkey, kind, {_FAULT_QUESTION}, {RENDERED}, len(chain)::BIGINT, concat({_PROTO}, ' Troubleshooting Decision Tree')
    FROM fault_chains JOIN kinds USING (o_orderkey) WHERE kind <> 'design')"""
ORACLE["g14_u1_assembled_samples"] = f"""{_ASSEMBLED} SELECT o_orderkey, kind, CASE WHEN answer IS NULL THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN answer IS NOT NULL THEN md5(question) END AS question_md5, md5(think || chr(10) || chr(10) || answer) AS answer_md5,
  CASE WHEN answer IS NOT NULL THEN steps END AS reasoning_steps, CASE WHEN answer IS NOT NULL THEN src END AS first_source
FROM both_kinds LEFT JOIN a USING (o_orderkey)"""
ORACLE["g14_curated_samples"] = f"""{_ASSEMBLED}, digest AS (SELECT o_orderkey AS sample_id, kind, question, concat(think, chr(10), chr(10), answer) AS last_content, steps
  FROM both_kinds JOIN a USING (o_orderkey) WHERE answer IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {fp('question')} ORDER BY o_orderkey) = 1)
SELECT kind AS type, count(*) AS n, sum(length(question) + length(last_content))::BIGINT AS chars,
  sum(len(regexp_extract_all(last_content, '(?m)^Step\\s+\\d+:')))::BIGINT AS steps, sum(steps)::BIGINT AS reasoning_steps,
  sum(CASE WHEN kind = 'design' THEN user_count END)::BIGINT AS users, count(CASE WHEN kind = 'design' THEN 1 END) AS with_scenario
FROM digest LEFT JOIN (SELECT o_orderkey AS sample_id, user_count FROM chains) USING (sample_id) WHERE length(last_content) >= 100 GROUP BY 1"""
ORACLE["a16_generation_stats"] = f"""WITH {_KINDS} SELECT kind, CASE WHEN o_orderkey % 13 = 0 THEN 'error' ELSE 'ok' END AS status, count(*) AS n FROM kinds GROUP BY 1, 2"""


# --- requests -----------------------------------------------------------------------------------

_RAW = """raw0 AS (SELECT req_id, users, CASE WHEN req_id % 4 <> 0 THEN sites ELSE 1 END AS sites,
  CASE WHEN req_id % 5 <> 0 THEN compliance ELSE []::VARCHAR[] END AS compliance, CASE WHEN req_id % 6 <> 0 THEN uptime ELSE 99.9 END AS uptime,
  CASE WHEN req_id % 3 <> 0 THEN 128 + req_id % 5000 ELSE 2048 END AS max_tokens, (req_id % 13) / 10.0::DOUBLE AS temperature,
  CASE WHEN req_id % 7 <> 0 THEN substr(concat('status ', status, ' seen'), 1, (5 + req_id % 10)::INT) END AS symptom,
  CASE WHEN req_id % 2 = 0 THEN 'USD' WHEN req_id % 9 = 0 THEN 'eur' ELSE 'USD' END AS currency FROM requests)"""
ORACLE["p5_validate_requests"] = f"""WITH {REQUESTS}, {_RAW}
SELECT req_id, users, sites, {joined('compliance')} AS compliance, uptime, max_tokens::BIGINT AS max_tokens, round(temperature, 6) AS temperature, currency,
  concat_ws('|', CASE WHEN symptom IS NULL THEN 'symptom: required' END, CASE WHEN uptime < 90 OR uptime > 100 THEN 'uptime: not in 90.0..100.0' END,
    CASE WHEN max_tokens < 256 OR max_tokens > 4096 THEN 'max_tokens: not in 256..4096' END, CASE WHEN temperature > 1 THEN 'temperature: not in 0.0..1.0' END,
    CASE WHEN length(symptom) < 10 THEN 'symptom: shorter than 10' END, CASE WHEN NOT regexp_full_match(currency, '[A-Z]{{3}}') THEN 'currency: not three capital letters' END) AS violations
FROM raw0"""

_REVIEW = f"""{REQUESTS}, rv AS (SELECT *, (req_id % 41) / 40.0::DOUBLE AS confidence, CASE priority_code WHEN '1' THEN 'high' WHEN '5' THEN 'low' ELSE 'medium' END AS priority FROM requests)"""
ORACLE["p6_review_rules"] = f"""WITH {_REVIEW} SELECT req_id, confidence < 0.8 OR len(compliance) > 0 OR uptime >= 99.99 AS api,
  confidence < 0.8 OR priority = 'high' OR len(compliance) > 0 AS agent,
  list_has_any(compliance, ['PCI-DSS', 'HIPAA']) OR uptime >= 99.99 OR confidence < 0.8 AS policy FROM rv"""
ORACLE["p7_approval_routing"] = f"""WITH {_REVIEW}, e AS (SELECT *, status = 'P' AS failed FROM rv)
SELECT CASE WHEN failed OR confidence < 0.8 OR priority = 'high' OR len(compliance) > 0 THEN 'approval' ELSE 'done' END AS queue,
  CASE WHEN failed THEN 'error' ELSE 'success' END AS status, count(*) AS n, round(sum(CASE WHEN failed THEN 0 ELSE confidence END), 6) AS confidence
FROM e GROUP BY 1, 2"""

_LISTED = "CASE WHEN len(compliance) > 0 THEN concat('[\"', array_to_string(compliance, '\",\"'), '\"]') ELSE '[]' END"
_MSG = f"""{REQUESTS}, msg AS (SELECT *, req_id % 5 AS form, concat('{{"users":', users, ',"sites":', sites, ',"compliance":', {_LISTED}, ',"uptime":', uptime, ',"region":"emea"}}') AS reqs FROM requests),
tasks AS (SELECT *, CASE WHEN form = 3 THEN 'm' ELSE 't' END || req_id AS task_id,
  CASE form WHEN 0 THEN 'design' WHEN 1 THEN 'troubleshoot' WHEN 2 THEN 'estimate' WHEN 3 THEN 'design' ELSE 'review' END AS type,
  CASE form WHEN 0 THEN concat('{{"requirements":', reqs, '}}') WHEN 1 THEN concat('{{"device":"r', sites, '","symptom":"link ', users, ' down"}}')
    WHEN 2 THEN concat('{{"users":', users, ',"compliance":', {_LISTED}, '}}') WHEN 3 THEN concat('{{"users":', users, ',"budget":"tight"}}')
    ELSE concat('{{"note":"', sites, '"}}') END AS context,
  CASE form WHEN 0 THEN 'high' WHEN 2 THEN 'low' ELSE 'medium' END AS priority, CASE WHEN form = 1 THEN 'planner' ELSE 'team_leader' END AS requestor FROM msg)"""
ORACLE["p9_normalize_tasks"] = f"""WITH {_MSG} SELECT req_id, task_id, type, context, priority, requestor, task_id AS correlation_id, NULL::VARCHAR AS error FROM tasks"""


def downtime_sql(u: str) -> str:
    m = f"((100.0::DOUBLE - {u}) / 100 * 525600)"
    return f"CASE WHEN {m} < 60 THEN printf('%.1f min/year', {m}) ELSE printf('%.1f hours/year', {m} / 60) END"


_CLOSE = """
Provide topology selection rationale, redundancy design, routing protocol selection,
security architecture, and implementation roadmap. Include configuration examples."""
_AGENT_DESIGN = f"""concat('Design a complete enterprise network architecture for:', chr(10), '- Users/endpoints: ', users, chr(10), '- Sites/locations: ',
  CASE WHEN form = 0 THEN sites ELSE 1 END, chr(10), '- Required compliance: ', CASE WHEN form = 0 AND len(compliance) > 0 THEN array_to_string(compliance, ', ') ELSE 'none specified' END,
  chr(10), '- Uptime requirement: ', up, '% (', {downtime_sql('up')}, ')', chr(10), '- Budget: ', CASE WHEN form = 0 THEN 'flexible' ELSE 'tight' END, chr(10), {q(_CLOSE)},
  CASE WHEN form = 0 THEN concat(chr(10), 'Additional requirement — region: emea') ELSE '' END)"""
_INDENTED = """concat('{', chr(10), '  "users": ', users, ',', chr(10), '  "compliance": ', CASE WHEN len(compliance) = 0 THEN '[]' ELSE
  concat('[', chr(10), '    "', array_to_string(compliance, concat('",', chr(10), '    "')), '"', chr(10), '  ]') END, chr(10), '}')"""
ORACLE["r30_task_prompts"] = f"""WITH {_MSG}, t AS (SELECT *, CASE WHEN form = 0 THEN uptime ELSE 99.9::DOUBLE END AS up FROM tasks)
SELECT req_id, type, md5(CASE type WHEN 'design' THEN {_AGENT_DESIGN}
  WHEN 'troubleshoot' THEN concat('Troubleshoot this network issue:', chr(10), chr(10), 'Device: r', sites, chr(10), 'Symptom: link ', users, ' down', chr(10), 'Protocol: unknown', chr(10), 'Impact: unknown', chr(10))
  WHEN 'estimate' THEN concat('Provide a detailed cost estimate for:', chr(10), chr(10), {_INDENTED}, chr(10), chr(10), 'Break down CAPEX and annual OPEX. Include hardware, licensing, and implementation.')
  ELSE replace(replace(replace(context, '"', chr(39)), ':', ': '), ',', ', ') END) AS prompt_md5, CASE WHEN form IN (0, 2) THEN {joined('compliance')} ELSE '' END AS compliance FROM t"""

_NL = "chr(10)"
_TF = lambda c: f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
_U = "CASE WHEN req_id % 8 <> 0 THEN users::VARCHAR ELSE {} END"
_COMP = "CASE WHEN len(compliance) > 0 THEN array_to_string(compliance, ', ') ELSE 'none' END"
_TOOL_CLOSE = """
Provide: topology selection, routing design, redundancy, security segmentation,
hardware recommendations, and phased implementation plan."""
_LOGS = "CASE WHEN req_id % 2 = 0 THEN concat(chr(10), '{}:', chr(10), repeat(status, 500)) ELSE '' END"
_BGP = "CASE WHEN req_id % 3 = 0 THEN 'BGP' ELSE 'unknown' END"
ORACLE["r30_w9_request_prompts"] = f"""WITH {REQUESTS} SELECT req_id,
  md5(concat('Design a complete enterprise network architecture:', {_NL}, '- Users/endpoints: ', {_U.format("'not specified'")}, {_NL}, '- Sites: ', sites, {_NL}, '- Compliance: ', {_COMP}, {_NL},
    '- Uptime SLA: ', uptime, '%', {_NL}, '- Budget: moderate', {_NL}, '- Data center: ', {_TF('req_id % 2 = 0')}, {_NL}, '- WAN type: ', CASE WHEN req_id % 5 = 0 THEN 'MPLS' ELSE 'not specified' END, {_NL},
    '- Cloud connectivity: ', {_TF('req_id % 4 = 0')}, {_NL}, '- Redundancy level: N+2', {_NL}, '- racks: ', req_id % 10, {_NL}, '- order: ', status, {_NL})) AS design_api,
  md5(concat('Design a complete enterprise network architecture:', {_NL}, 'Users: ', {_U.format("'not specified'")}, {_NL}, 'Sites: ', sites, {_NL}, 'Compliance: ', {_COMP}, {_NL}, 'Uptime SLA: ', uptime, '%', {_NL},
    'Budget: moderate', {_NL}, 'Data center needed: ', {_TF('req_id % 2 = 0')}, {_NL}, 'Wireless coverage: ', {_TF('req_id % 3 = 0')}, {_NL}, {q(_TOOL_CLOSE)})) AS design_tool,
  md5(concat('Troubleshoot: status ', status, {_NL}, 'Device: r', sites, {_NL}, 'Protocol: ', {_BGP}, {_LOGS.format('Logs')})) AS troubleshoot_api,
  md5(concat('Troubleshoot network design issue:', {_NL}, 'Device: r', sites, {_NL}, 'Symptom: status ', status, {_NL}, 'Protocol: ', {_BGP}, {_NL}, {_LOGS.format('Relevant logs')})) AS troubleshoot_tool,
  md5(concat('Cost estimate for ', {_U.format("'?'")}, ' users, ', sites, ' sites, compliance=[', coalesce(array_to_string(list_transform(compliance, lambda s: concat('''', s, '''')), ', '), ''), ']')) AS estimate_api,
  md5(concat('Provide detailed cost estimate (EUR):', {_NL}, 'Users: ', {_U.format("'unspecified'")}, ', Sites: ', sites, {_NL}, 'Compliance: ', {_COMP}, {_NL}, 'Include: CAPEX itemization, ',
    CASE WHEN req_id % 2 = 0 THEN 'annual OPEX, ' ELSE '' END, 'hardware, licensing, implementation labor')) AS estimate_tool FROM requests"""
ORACLE["r27_r31_cache_keys"] = """SELECT doc_id, md5(concat('<|system|>', chr(10), 'Answer in ', lang, '<|end|>', chr(10), '<|user|>', chr(10), text, '<|end|>', chr(10), '<|assistant|>', chr(10))) AS prompt_md5,
  substr(sha256(concat('Answer in ', lang, chr(10), text)), 1, 16) AS cache_key FROM documents"""
ORACLE["r29_downtime"] = f"WITH {REQUESTS} SELECT req_id, uptime, {downtime_sql('uptime')} AS downtime FROM requests"


# --- knowledge: the leaves are written down directly, no document is parsed ------------------------

KB = """leaf AS (
  SELECT r_name AS category, NULL::BIGINT AS doc_no, r_name || '.name' AS path, r_name AS v, true AS is_text FROM region
  UNION ALL SELECT r_name, NULL, concat(r_name, '.nations[', i, '].', f), CASE f WHEN 'key' THEN n_nationkey::VARCHAR ELSE n_name END, true
    FROM (SELECT r_name, n_nationkey, n_name, row_number() OVER (PARTITION BY r_name ORDER BY concat('{"key":"', n_nationkey, '","name":"', n_name, '"}')) - 1 AS i
      FROM region JOIN nation ON n_regionkey = r_regionkey), (VALUES ('key'), ('name')) f(f)
  UNION ALL SELECT event_type, event_id, event_type || '.props.k', json_extract_string(props, '$.k'), false FROM events
  UNION ALL SELECT event_type, event_id, event_type || '.who[0]', 'user', true FROM events
  UNION ALL SELECT event_type, event_id, event_type || '.who[1]', user_id::VARCHAR, false FROM events
  UNION ALL SELECT source, doc_id, source || '.body.text', text, true FROM documents
  UNION ALL SELECT source, doc_id, source || '.body.lang', lang, true FROM documents),
post AS (SELECT category, doc_no, path, term FROM (SELECT category, doc_no, path, trim(unnest(string_split_regex(lower(v), '\\s+')), '.,;:()[]{}"''') AS term FROM leaf WHERE is_text)
  WHERE length(term) > 3)"""
_TERMS = "['the', 'nation', 'user', 'africa', 'estion', 'one']"
ORACLE["k1_flatten"] = f"WITH {KB} SELECT category, doc_no, path, md5(v) AS value_md5, is_text FROM leaf"
ORACLE["k2_index_terms"] = f"""WITH {KB} SELECT term, count(*) AS postings, count(DISTINCT (category, doc_no, path)) AS paths FROM post GROUP BY 1"""
ORACLE["k3_j9_topic_matches"] = f"""WITH {KB} SELECT category, count(DISTINCT (doc_no, path)) AS match_count FROM post WHERE list_contains({_TERMS}, term) GROUP BY 1"""
ORACLE["k3_topic_sections"] = f"""WITH {KB} SELECT DISTINCT category, string_split(path, '.')[2] AS section FROM post
WHERE list_contains({_TERMS}, term) AND string_split(path, '.')[2] IN ('name', 'props', 'who', 'body', 'nations', 'empty')"""
ORACLE["k4_slices"] = f"""SELECT name AS slice, category, 3 * count(*) AS leaves FROM part
JOIN (VALUES {", ".join(f"({i}, {q(name)}, {q(c)})" for i, (name, c, _) in enumerate(SLICES))}) s(i, name, category) ON i = p_partkey % {len(SLICES)}
WHERE p_partkey % 6 <> 0 GROUP BY 1, 2"""
ORACLE["k1_deep_documents"] = """SELECT p_brand AS category, p_partkey AS part, length(p_brand) + 2 * (p_size % 39 + 2) + 3 AS path_chars,
  unnest([p_name, p_size::VARCHAR]) AS leaf, unnest([true, false]) AS is_text FROM part"""
_COVER = """cover AS (SELECT r_name AS category, 3::BIGINT AS section_count, 1 + count(n_name) AS total_entries, false AS has_metadata FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1
  UNION ALL SELECT event_type, 2, count(*) * 3, false FROM events GROUP BY 1 UNION ALL SELECT source, 1, count(*) * 2, false FROM documents GROUP BY 1)"""
ORACLE["a15_k5_coverage"] = f"WITH {_COVER} SELECT category, section_count, total_entries::BIGINT AS total_entries, has_metadata FROM cover"
ORACLE["a15_coverage_score"] = f"""WITH {KB}, {_COVER}, n AS (SELECT (SELECT count(*) FROM cover WHERE category IN ('AFRICA', 'ASIA', 'EUROPE', 'click', 'src0', 'src999')) AS present,
  (SELECT count(DISTINCT term) FROM post) AS total_terms)
SELECT present, total_terms, round(present::DOUBLE / 6 * 60 + least(40.0, total_terms::DOUBLE / 100), 1) AS coverage_score FROM n"""

_NAMES = "['design_patterns', 'troubleshooting_trees', 'compliance_requirements', 'vendor_specifics', 'cost_benchmarks', 'unlisted']"
_ENTRIES = f"""base AS (SELECT ({_NAMES})[n_regionkey % 6 + 1] AS category, n_name AS key, n_name AS entry, 'file' AS source, 0::BIGINT AS added, n_nationkey::BIGINT AS seq FROM nation),
fresh AS (SELECT ({_NAMES})[(n_regionkey + c_custkey % 6) % 6 + 1] AS category, n_name AS key, c_name AS entry, 'update' AS source, c_custkey % 100 AS added, c_custkey AS seq
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
ORACLE["k6_upsert"] = f"""WITH {_ENTRIES}, u AS (SELECT * FROM base UNION ALL SELECT * FROM fresh WHERE category <> 'unlisted')
SELECT category, 'base' AS section, key, entry, source, added, versions FROM (SELECT *, count(*) OVER (PARTITION BY category, key) AS versions,
  row_number() OVER (PARTITION BY category, key ORDER BY added DESC, seq DESC) AS rn FROM u) WHERE rn = 1"""
ORACLE["k6_snapshots"] = ORACLE["k6_upsert"].replace("SELECT * FROM base", "SELECT * FROM base WHERE category <> 'unlisted'")
ORACLE["k6_manual_entries"] = """SELECT c_custkey, c_mktsegment AS source, c_custkey::VARCHAR AS added, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name,
  CASE WHEN c_custkey % 3 <> 0 THEN concat('["', c_name, '"]') END AS value FROM customer"""
ORACLE["k6_place_entries"] = f"""WITH {_ENTRIES} SELECT category, CASE WHEN category = 'design_patterns' THEN 'topology_patterns' ELSE '' END AS section, count(*) AS n
FROM fresh GROUP BY 1, 2"""
ORACLE["k6_rejected"] = f"WITH {_ENTRIES} SELECT category, count(*) AS n FROM fresh WHERE category = 'unlisted' GROUP BY 1"
ORACLE["k7_extraction_entries"] = """SELECT source AS category, lang AS key, versions, added, least(2000, length(text))::BIGINT AS description_chars, md5(text) AS content_md5
FROM (SELECT *, doc_id % 97 AS added, count(*) OVER (PARTITION BY source, lang) AS versions,
  row_number() OVER (PARTITION BY source, lang ORDER BY doc_id % 97 DESC, doc_id DESC) AS rn FROM documents) WHERE rn = 1"""
ORACLE["k7_refresh_metadata"] = f"""WITH {_ENTRIES}, b AS (SELECT category, max(added) AS last_updated, count(*) AS n FROM base GROUP BY 1),
f AS (SELECT category, max(added) AS updated, count(*) AS m FROM fresh GROUP BY 1)
SELECT category, greatest(last_updated, updated) AS last_updated, n + coalesce(m, 0) AS live_extractions FROM b LEFT JOIN f USING (category)"""
ORACLE["k8_extraction_counts"] = """SELECT source AS category, count(*) FILTER (doc_id % 9 <> 0 AND text <> '') AS success,
  count(*) FILTER (doc_id % 9 = 0 OR text = '') AS failed FROM documents GROUP BY 1"""


# --- monitoring ---------------------------------------------------------------------------------

SERVED = """served AS (SELECT event_id, ts, user_id, event_type AS task_type, value * 100 AS latency_ms, least(1.0::DOUBLE, 0.5 + value / 300) AS confidence,
  event_id % 5 <> 0 AS has_think, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code FROM events)"""
METRICS = f"""{SERVED}, metrics AS (SELECT ts, task_type AS endpoint, 'InferenceLatency' AS metric, latency_ms AS value FROM served
  UNION ALL SELECT ts, task_type, 'ConfidenceScore', confidence FROM served UNION ALL SELECT ts, task_type, 'ThinkBlockPresent', has_think::INT FROM served
  UNION ALL SELECT ts, task_type, 'RequestCount', 1 FROM served UNION ALL SELECT ts, task_type, 'ErrorCount', 1 FROM served WHERE status_code >= 400)"""


def win(seconds: int) -> str:
    return f"(epoch_us(ts) // {seconds * 1000000} * {seconds})"


#: The exact sum of doubles as a whole number of 2^-70, cut to 61 bits with a mark for what was cut, then rounded once.
_WHOLE = "sum((value * 1180591620717411303424.0::DOUBLE)::HUGEINT)"
_CUT = f"pow(2::DOUBLE, greatest(0, floor(log2(greatest(abs({_WHOLE}), 1)::DOUBLE))::INT - 60))"
_TOP = f"({_WHOLE} // {_CUT}::HUGEINT)"
EXACT_SUM = f"(({_TOP} + CASE WHEN {_TOP} % 2 = 0 AND {_WHOLE} % {_CUT}::HUGEINT <> 0 THEN 1 ELSE 0 END)::BIGINT::DOUBLE * ({_CUT} / 1180591620717411303424.0::DOUBLE))"
EXACT_AVG = f"{EXACT_SUM} / count(value)"
ORACLE["t2_metric_counts"] = f"WITH {METRICS} SELECT metric, endpoint, count(*) AS n, round(sum(value), 6) AS total FROM metrics GROUP BY 1, 2"
ORACLE["t1_metric_windows"] = f"""WITH {METRICS} SELECT metric, {win(300)} AS window_start, count(*) AS n, round(sum(value), 6) AS sum, {EXACT_AVG} AS average,
  round(min(value), 6) AS least, round(max(value), 6) AS greatest FROM metrics GROUP BY 1, 2"""
_P = "round(quantile_cont({v}, 0.5), 6) AS p50, round(quantile_cont({v}, 0.95), 6) AS p95, round(quantile_cont({v}, 0.99), 6) AS p99"
ORACLE["t1_percentiles"] = f"WITH {METRICS} SELECT metric, {win(3600)} AS window_start, {_P.format(v='value')} FROM metrics GROUP BY 1, 2"
ORACLE["t1_percentiles_overall"] = f"WITH {SERVED} SELECT task_type, {_P.format(v='latency_ms')} FROM served GROUP BY 1"
ORACLE["t3_labelled_counts"] = f"WITH {SERVED} SELECT task_type, status_code, has_think, confidence < 0.8 AS approval, count(*) AS n FROM served GROUP BY 1, 2, 3, 4"


def hist(name: str, value: str, bounds) -> str:
    rows = ", ".join(f"({q(str(b))}, {b}::DOUBLE)" for b in bounds) + ", ('+Inf', 'inf'::DOUBLE)"
    return f"SELECT {q(name)} AS name, task_type, le, count(*) FILTER ({value} <= b) AS n FROM served, (VALUES {rows}) t(le, b) GROUP BY 2, 3"


ORACLE["t4_histograms"] = f"""WITH {SERVED} {hist('request', 'latency_ms / 1000', al.REQUEST_SECONDS_BOUNDS)} UNION ALL
{hist('inference', 'latency_ms / 1000', al.INFERENCE_SECONDS_BOUNDS)} UNION ALL {hist('confidence', 'confidence', al.CONFIDENCE_BOUNDS)}"""


def quantile_rows(source: str, keys: str, value: str, bounds, qs) -> str:
    """Interpolated quantile of bucket counts: the first bucket whose count reaches the rank."""
    lows = ", ".join(f"({i}, {0.0 if i == 0 else bounds[i - 1]}::DOUBLE, {b}::DOUBLE)" for i, b in enumerate(bounds))
    parts = []
    for p in qs:
        parts.append(f"""SELECT {keys}, {p}::DOUBLE AS q, coalesce(arg_min(lo + (hi - lo) * (({p}::DOUBLE * n - below) / (c - below)), i) FILTER (c >= {p}::DOUBLE * n), {float(bounds[-1])}) AS value
FROM (SELECT {keys}, i, lo, hi, count(*) FILTER ({value} <= hi) AS c, count(*) FILTER ({value} <= lo AND i > 0) AS below, count(*) AS n
  FROM {source}, (VALUES {lows}) b(i, lo, hi) GROUP BY {keys}, i, lo, hi) GROUP BY {keys}""")
    return " UNION ALL ".join(parts)


ORACLE["t5_histogram_quantiles"] = f"""WITH {SERVED}, w AS (SELECT *, {win(600)} AS window_start FROM served),
x AS ({quantile_rows('w', 'task_type, window_start', 'latency_ms / 1000', al.INFERENCE_SECONDS_BOUNDS, [0.5, 0.95])})
SELECT task_type, window_start, round(max(value) FILTER (q = 0.5), 6) AS q50, round(max(value) FILTER (q = 0.95), 6) AS q95 FROM x GROUP BY 1, 2"""


def slide(source: str, seconds: int) -> str:
    return f"(SELECT *, unnest(range({win(60)} + 60, {win(60)} + {seconds} + 1, 60)) AS window_end FROM {source})"


_ERR = f"SELECT window_end, count(*) FILTER (status_code >= 500) / 300.0::DOUBLE AS value FROM {slide('served', 300)} GROUP BY 1"
_RATIO = f"""SELECT window_end, (count(*) FILTER (has_think) / 900.0::DOUBLE) / (count(*) / 900.0::DOUBLE + 1e-9) AS value FROM {slide('served', 900)} GROUP BY 1"""
ORACLE["t6_error_rate"] = f"WITH {SERVED} SELECT window_end, round(value, 6) AS value, value > 0.1 AS high FROM ({_ERR})"
ORACLE["t6_think_ratio"] = f"WITH {SERVED} SELECT window_end, round(value, 6) AS value FROM ({_RATIO})"

_CMP = "CASE WHEN comparison IN ('GreaterThanThreshold', '>') THEN value > threshold WHEN comparison IN ('LessThanThreshold', '<') THEN value < threshold ELSE value = threshold END"


def alarm_sql(base: str) -> str:
    rules = ", ".join(f"({q(a)}, {q(m)}, {q(s)}, {p}, {k}, {t}::DOUBLE, {q(c)}, {q(v)})" for a, m, s, p, k, t, c, v in al.THRESHOLD_ALARMS)
    stats = " UNION ALL ".join(
        f"SELECT {q(a)} AS alarm, {win(p)} AS window_start, "
        + {"Average": EXACT_AVG, "Sum": EXACT_SUM}.get(s, f"quantile_cont(value, {int(s[1:]) / 100 if s[0] == 'p' else 0})")
        + f" AS value FROM metrics WHERE metric = {q(m)} GROUP BY 2"
        for a, m, s, p, *_ in al.THRESHOLD_ALARMS
    )
    return f"""{base}, rules(alarm, metric, stat, period, periods, threshold, comparison, severity) AS (VALUES {rules}), stats AS ({stats}),
bad AS (SELECT *, window_start // period AS slot FROM stats JOIN rules USING (alarm) WHERE {_CMP}),
isl AS (SELECT *, slot - row_number() OVER (PARTITION BY alarm ORDER BY slot) AS island FROM bad),
fired AS (SELECT alarm, severity, window_start, value, row_number() OVER (PARTITION BY alarm, island ORDER BY slot) AS run,
  row_number() OVER (PARTITION BY alarm, island ORDER BY slot) >= periods AS firing FROM isl)"""


ORACLE["w5_j11_threshold_alarms"] = f"WITH {alarm_sql(METRICS)} SELECT alarm, severity, window_start, round(value, 6) AS value, run, firing FROM fired"
_CHAN = ", ".join(f"({q(s)}, {q(c)})" for s, names in al.CHANNELS.items() for c in names)
ORACLE["t7_notifications"] = f"""WITH {alarm_sql(METRICS)} SELECT alarm, severity, channel, count(*) AS n FROM fired JOIN (VALUES {_CHAN}) c(severity, channel) USING (severity)
WHERE firing GROUP BY 1, 2, 3"""
_MACHINE = """metrics AS (SELECT ts, 'disk_used_percent' AS metric, 60 + value % 40 AS value FROM events UNION ALL SELECT ts, 'CPUUtilization', value % 8 FROM events)"""
ORACLE["t12_machine_alarms"] = f"WITH {alarm_sql(_MACHINE)} SELECT alarm, window_start, value, run, firing FROM fired"

_ACTIVE = """moves AS (SELECT epoch_us(ts) // 60000000 * 60 AS minute, 1 AS change FROM served
  UNION ALL SELECT (epoch_us(ts) + trunc(latency_ms * 1000)::BIGINT) // 60000000 * 60, -1 FROM served),
net AS (SELECT minute, sum(change)::BIGINT AS change FROM moves GROUP BY 1),
active AS (SELECT minute, change, sum(change) OVER (ORDER BY minute)::BIGINT AS active FROM net)"""
ORACLE["t11_active_requests"] = f"WITH {SERVED}, {_ACTIVE} SELECT * FROM active"
_DUR = ", ".join(
    f"({q(a)}, {q(s)}, {w}, {t}::DOUBLE, {q(c)}, {h}, {q(v)})" for a, s, _, w, t, c, h, v in al.DURATION_ALARMS
)
_SLIDE_Q = f"""qi AS ({quantile_rows(slide('served', 300), 'window_end', 'latency_ms / 1000', al.INFERENCE_SECONDS_BOUNDS, [0.95])}),
qc AS ({quantile_rows(slide('served', 600), 'window_end', 'confidence', al.CONFIDENCE_BOUNDS, [0.5])})"""
ORACLE["w6_duration_alarms"] = f"""WITH {SERVED}, {_ACTIVE}, {_SLIDE_Q},
sig AS (SELECT 'inference_seconds' AS signal, window_end, value FROM qi UNION ALL SELECT 'confidence', window_end, value FROM qc
  UNION ALL SELECT 'errors_per_second', window_end, value FROM ({_ERR}) UNION ALL SELECT 'think_ratio', window_end, value FROM ({_RATIO})
  UNION ALL SELECT 'up', {win(60)} + 60, max((status_code < 500)::INT)::DOUBLE FROM served GROUP BY 2
  UNION ALL SELECT 'active_requests', minute + 60, active::DOUBLE FROM active),
rules(alarm, signal, seconds, threshold, comparison, hold, severity) AS (VALUES {_DUR}),
bad AS (SELECT *, window_end // 60 AS slot FROM sig JOIN rules USING (signal) WHERE {_CMP}),
isl AS (SELECT *, slot - row_number() OVER (PARTITION BY alarm ORDER BY slot) AS island FROM bad),
since AS (SELECT *, min(window_end) OVER (PARTITION BY alarm, island) AS since FROM isl)
SELECT alarm, severity, window_end, round(value, 6) AS value, since, CASE WHEN window_end - since >= hold THEN 'firing' ELSE 'pending' END AS state FROM since"""


# --- files, task intake, streams ------------------------------------------------------------------

ORACLE["u4_merge_checks"] = f"WITH {DIGEST}, {check_rows(True)} SELECT * FROM checks"
ORACLE["s1_s2_sample_files"] = """SELECT doc_id, lang, md5(text) AS text_md5, 'sample' AS kind FROM documents
UNION ALL SELECT count(*), NULL, md5('{' || source), 'rejected' FROM documents GROUP BY source"""
_SCORE = lambda c: f"round({c}, 6) AS {c}"
ORACLE["s7_result_files"] = f"""WITH {SCORED} SELECT concat(conv_id, '-', turn) AS test_id, case_category AS category, overall_score, pass_fail,
  has_think_block AS has_think, reasoning_steps::BIGINT AS reasoning_steps, {_SCORE('keyword_score')}, {_SCORE('source_score')}, {_SCORE('confidence')},
  {_SCORE('latency_ms')}, {joined('kmissing')} AS missing FROM scored"""
ORACLE["s7_report_file"] = ORACLE["curate_statistics"]
ORACLE["s2_split_folders"] = """SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, count(*) AS n,
  sum(length(text))::BIGINT AS chars, min(md5(text)) AS least_md5 FROM documents GROUP BY 1"""
ORACLE["s6_knowledge_files"] = """WITH c(category) AS (VALUES ('design_patterns'), ('troubleshooting_trees'), ('compliance_requirements'), ('vendor_specifics'), ('configuration_templates'), ('cost_benchmarks')),
f AS (SELECT ['design_patterns', 'vendor_specifics', 'notes'][n_regionkey % 3 + 1] AS category, 2 * count(*) AS leaves, max(n_name) AS last FROM nation GROUP BY 1)
SELECT category, coalesce(leaves, 0) AS leaves, last FROM c LEFT JOIN f USING (category)"""
ORACLE["s11_scenario_cases"] = """SELECT concat('case-', n_nationkey) AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'troubleshooting' ELSE 'design' END AS type,
  n_nationkey::VARCHAR AS users, lower(n_name) AS industry, concat(n_name, '|OSPF') AS keywords, n_nationkey / 32.0::DOUBLE AS min_confidence, n_nationkey % 3 = 0 AS requires_human_review FROM nation"""
ORACLE["s9_enough_rows"] = "SELECT least(count(*), 9000) AS rows_seen, count(*) >= 9000 AS enough FROM documents"
ORACLE["s3_prompt_files"] = """SELECT concat(conv_id, '-', turn) AS id, CASE WHEN role = 'user' THEN 'asked' ELSE 'general' END AS category, md5(text) AS prompt_md5
FROM conversations"""
ORACLE["s5_test_case_files"] = f"""WITH {SCORED} SELECT case_id::VARCHAR AS id, case_category AS category, array_to_string(expected, '|') AS keywords,
  array_to_string(required, '|') AS sources FROM cases WHERE case_category = 'bgp'"""

_TASK_RAW = f"""{_MSG}, t AS (SELECT *, CASE WHEN form = 0 THEN uptime ELSE 99.9::DOUBLE END AS up FROM tasks),
prompted AS (SELECT *, CASE type WHEN 'design' THEN {_AGENT_DESIGN}
  WHEN 'estimate' THEN concat('Provide a detailed cost estimate for:', chr(10), chr(10), {_INDENTED}, chr(10), chr(10), 'Break down CAPEX and annual OPEX. Include hardware, licensing, and implementation.')
  END AS prompt FROM t),
responses AS (SELECT *, coalesce(concat('<think>Step 1: read.</think>', '<|system|>', chr(10), {case_map('type', {'estimate': TASK_SYSTEM['estimate']}, TASK_SYSTEM['design'])},
  '<|end|>', chr(10), '<|user|>', chr(10), nullif(prompt, ''), '<|end|>', chr(10), '<|assistant|>', chr(10)), '') AS raw FROM prompted WHERE type NOT IN ('troubleshoot', 'review')
  UNION ALL SELECT *, '' FROM prompted WHERE type IN ('troubleshoot', 'review'))"""
ORACLE["t10_x2_task_intake"] = f"""WITH {PARSED_STRICT.replace(RESP, _TASK_RAW)}, f AS (SELECT *, type IN ('troubleshoot', 'review') AS failed, type = 'review' AS waits,
  CASE WHEN type IN ('troubleshoot', 'review') THEN 0 ELSE least(0.5::DOUBLE + 0.15 + CASE WHEN len(sources) > 0 THEN 0.1 ELSE 0 END + CASE WHEN len(sources) > 2 THEN 0.05 ELSE 0 END
    + CASE WHEN length(answer) > 200 THEN 0.05 ELSE 0 END + least(({_HITS}) * 0.02::DOUBLE, 0.1), 1.0) END AS confidence FROM strict),
g AS (SELECT *, failed OR confidence < 0.8 OR priority = 'high' OR (form IN (0, 2) AND len(compliance) > 0) AS approval FROM f)
SELECT task_id, type, requestor, CASE WHEN waits THEN 'waiting' WHEN failed THEN 'error' ELSE 'success' END AS status,
  CASE WHEN waits THEN 'retry' WHEN approval THEN 'approval' ELSE 'done' END AS queue, CASE WHEN waits THEN 'no recorded answer' WHEN failed THEN 'device lost' END AS error, md5(answer) AS answer_md5, {joined('sources')} AS sources, round(confidence, 6) AS confidence, approval AS requires_approval FROM g"""
ORACLE["t10_stream_intake"] = ORACLE["t10_x2_task_intake"]
ORACLE["t1_stream_windows"] = f"""WITH {METRICS} SELECT metric, {win(3600)} AS window_start, count(*) AS n, round(sum(value), 6) AS sum, {EXACT_AVG} AS average,
  round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99
FROM metrics GROUP BY 1, 2"""
ORACLE["t3_stream_counters"] = f"WITH {SERVED} SELECT task_type, status_code, has_think, count(*) AS n FROM served GROUP BY 1, 2, 3"
ORACLE["t6_stream_error_rate"] = ORACLE["t6_error_rate"]
ORACLE["s4_prompt_tables"] = """SELECT doc_id::VARCHAR AS id, 'general' AS category, md5(concat('say "', text, '", please')) AS prompt_md5 FROM documents"""
ORACLE["r24_remediation_steps"] = f"""WITH {RESP}, s AS (SELECT conv_id, turn, raw, list_filter(list_transform(
  string_split(regexp_replace(raw, '\\n(Step\\s+\\d)', chr(1) || '\\1', 'g'), chr(1)), lambda p: regexp_extract(p, '(?s)Step\\s+\\d+.*')), lambda p: p <> '') AS steps FROM responses),
parts AS (SELECT conv_id, turn, CASE WHEN len(steps) > 0 THEN steps ELSE [raw] END AS parts FROM s)
SELECT conv_id, turn, unnest(range(len(parts))) AS step, md5(unnest(parts)) AS text_md5 FROM parts"""

"""Rule checks of one sample. A check that does not apply is not emitted.

Names and messages of the checks, and the numbers they compare with, are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.fixed.rules import (
    COLLAPSED_CORE_MAX_USERS, CONTROL_PREFIX, CONTROLS, EIGRP_WORDS, NON_PUBLIC_BLOCKS,
    OTHER_VENDORS, OVERLAY_CONTEXT, OVERLAY_WORDS, PUBLIC_EXCEPTIONS, SPINE_LEAF_CONTEXT,
    SPINE_LEAF_REQUIRED, THREE_TIER_MIN_USERS,
)
from answerloom.fixed.sources import CITABLE_NAMES, STANDARD_VERSIONS
from answerloom.functions.parse import THINK
from answerloom.functions.text import (
    all_matches, contains_any, count_matches, count_present, strip, text_or_empty,
)

# Patterns.
STEP_ANY_CASE = r"(?iuU)Step\s+\d+:"
EXPLICIT_CITATION = r"(?iuU)(?:Source|Reference|Ref|Per|From|Chapter|Section)[:.]?\s*[^\n]+"
TLS_VERSION = r"(?U)tls\s*1\.[2-3]"
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
IPV4 = rf"(?U)\b(?:{OCTET}\.){{3}}{OCTET}\b"


def _check(name: str, passed: Column, message: Column | str) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        passed.alias("passed"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
    )


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _emitted(checks: list[Column]) -> Column:
    return F.filter(F.array(*checks), lambda c: c.isNotNull())


def _texts(df: DataFrame, text: str) -> DataFrame:
    """The forms of an answer that the rules read, derived once."""
    body = text_or_empty(F.col(text))
    return df.select("*", body.alias("_body"), F.lower(body).alias("_low"), F.regexp_extract(body, THINK, 1).alias("_think"))


def _sample_facts(body: Column, low: Column, think: Column) -> Column:
    return F.struct(
        (body != "").alias("answered"),
        (F.contains(body, F.lit("<think>")) & F.contains(body, F.lit("</think>"))).alias("tags"),
        F.length(strip(F.substring_index(body, "</think>", -1))).alias("tail"),
        count_matches(think, STEP_ANY_CASE).alias("steps"),
        count_present(F.lower(think), [n.lower() for n in CITABLE_NAMES]).alias("refs"),
        count_matches(think, EXPLICIT_CITATION).alias("cites"),
        contains_any(low, ["spine-leaf", "spine leaf"]).alias("spine_leaf"),
        contains_any(low, SPINE_LEAF_CONTEXT).alias("spine_leaf_context"),
        F.array(*[contains_any(low, [name]) for name in STANDARD_VERSIONS]).alias("standards"),
        F.array(*[contains_any(low, versions) for versions in STANDARD_VERSIONS.values()]).alias("versions"),
        contains_any(low, ["tls", "ssl"]).alias("tls"),
        low.rlike(TLS_VERSION).alias("tls_version"),
        F.contains(low, F.lit("ebgp")).alias("ebgp"),
    )


def _accuracy_facts(body: Column, low: Column) -> Column:
    return F.struct(
        contains_any(low, OVERLAY_WORDS).alias("overlay"),
        contains_any(low, OVERLAY_CONTEXT).alias("overlay_context"),
        (contains_any(low, EIGRP_WORDS) & contains_any(low, OTHER_VENDORS)).alias("eigrp_mixed"),
        public_addresses(body).alias("addresses"),
        contains_any(low, ["spine-leaf", "spine leaf"]).alias("spine_leaf"),
        contains_any(low, SPINE_LEAF_REQUIRED).alias("in_dc"),
        contains_any(low, ["three-tier", "three tier"]).alias("three_tier"),
        contains_any(low, ["collapsed core"]).alias("collapsed_core"),
        F.array(*[contains_any(low, words) for _, _, words in CONTROLS]).alias("controls"),
    )


def with_answer_facts(df: DataFrame, text: str) -> DataFrame:
    """Adds ``sample_facts`` and ``accuracy_facts``, the few values that R14 to R22 read of the answer in ``text``.

    They are taken where the answer is, so that no answer has to travel to its sample's other values.
    A query that reads one of the two computes only that one.
    """
    body, low, think = F.col("_body"), F.col("_low"), F.col("_think")
    return _texts(df, text).select(
        *df.columns, _sample_facts(body, low, think).alias("sample_facts"), _accuracy_facts(body, low).alias("accuracy_facts")
    )


def sample_checks(df: DataFrame, strict: bool = False) -> DataFrame:
    """R14, R15, R16 on a sample digest (see ``operators.curate``).

    Adds ``checks`` array<struct<name, passed, message>> and ``warnings``. A sample without an
    answer is judged as one with an empty answer.
    """
    min_sources, min_answer, min_steps = (3, 500, 5) if strict else (2, 200, 5)
    nothing = F.lit("")
    facts = df.withColumn("_facts", F.coalesce("sample_facts", _sample_facts(nothing, nothing, nothing)))
    f = F.col("_facts")
    steps, refs, cites, tail = f["steps"], f["refs"], f["cites"], f["tail"]
    enough, answered = F.col("n_messages") >= 2, f["answered"]
    in_chain = enough & answered
    chain = [
        F.when(~enough, _check("has_messages", F.lit(False), "Sample must have at least 2 messages")),
        F.when(
            enough & ~answered,
            _check("has_assistant_message", F.lit(False), "No assistant message found"),
        ),
        F.when(in_chain, _check("has_think_tags", f["tags"],
                                "Missing <think>...</think> tags in assistant response")),
        F.when(in_chain, _check("min_reasoning_steps", steps >= min_steps,
                                _text("Only ", steps, f" steps found (minimum {min_steps})"))),
        F.when(in_chain, _check("has_source_references", refs >= min_sources,
                                _text("Only ", refs, f" source references found (minimum {min_sources})"))),
        F.when(in_chain, _check("has_answer_content", tail >= min_answer,
                                _text("Answer section too short: ", tail, f" chars (min {min_answer})"))),
    ]
    technical = [
        F.when(f["spine_leaf"], _check("spine_leaf_context", f["spine_leaf_context"],
                                       "Spine-leaf topology mentioned without data center context")),
        *[
            F.when(f["standards"][i],
                   _check(f"compliance_version_{standard}", f["versions"][i],
                          f"{standard} mentioned without version number"))
            for i, standard in enumerate(STANDARD_VERSIONS)
        ],
        F.when(f["tls"],
               _check("tls_version_specified", f["tls_version"],
                      "TLS mentioned without version (should specify TLS 1.2 or 1.3)")),
        _check("has_user_question", F.coalesce(F.col("has_user"), F.lit(False)), "No user question found"),
    ]
    used = F.greatest(F.coalesce(F.size("sources_used"), F.lit(0)), F.lit(0))
    declared = F.coalesce(F.col("reasoning_steps"), F.lit(0))
    attribution = [
        _check("explicit_source_citations", cites >= 2,
               _text("Only ", cites, " explicit source citations in think block")),
        _check("metadata_sources_populated", used >= 2, "metadata.sources_used has fewer than 2 entries"),
        _check("metadata_reasoning_steps", declared >= min_steps,
               _text("metadata.reasoning_steps = ", declared, f" (min {min_steps})")),
    ]
    users = F.col("user_count")
    small_ebgp = f["ebgp"] & (users > 0) & (users < 500)
    warned = F.when(
        small_ebgp, F.lit("eBGP used for small network (<500 users) - verify this is intentional")
    )
    return facts.select(
        *df.columns,
        _emitted(chain + technical + attribution).alias("checks"),
        F.array_compact(F.array(warned)).alias("warnings"),
    )


def score_checks(df: DataFrame, pass_mark: float = 70.0) -> DataFrame:
    """R17. Share of emitted checks that hold, the verdict, and the error texts."""
    failed = F.filter("checks", lambda c: ~c.passed)
    passed = F.size("checks") - F.size(failed)
    scored = df.select(
        "*",
        F.when(F.size("checks") == 0, 0.0).otherwise(passed / F.size("checks") * 100).alias("score"),
        F.transform(failed, lambda c: F.concat(c["name"], F.lit(": "), c["message"])).alias("errors"),
    )
    return scored.withColumn("passed", F.col("score") >= pass_mark)


def _graded(name: Column | str, passed: Column, failed_as: str, bad, good, evidence=None) -> Column:
    """A check whose severity is ``failed_as`` when it fails and info when it holds."""
    bad = bad if isinstance(bad, Column) else F.lit(bad)
    good = good if isinstance(good, Column) else F.lit(good)
    return F.struct(
        (name if isinstance(name, Column) else F.lit(name)).alias("name"),
        passed.alias("passed"),
        F.when(passed, "info").otherwise(failed_as).alias("severity"),
        F.when(passed, good).otherwise(bad).alias("message"),
        (evidence if evidence is not None else F.lit("")).alias("evidence"),
    )


def protocol_checks(facts: Column) -> list[Column]:
    """R18."""
    return [
        F.when(facts["overlay"],
               _graded("vxlan_context", facts["overlay_context"], "warning",
                       "VXLAN/EVPN mentioned without clear data center context",
                       "VXLAN/EVPN used appropriately in DC context")),
        F.when(facts["eigrp_mixed"],
               _graded("eigrp_multi_vendor", F.lit(False), "warning",
                       "EIGRP mentioned alongside non-Cisco vendors (EIGRP is Cisco proprietary)", "")),
    ]


def _as_number(quad: Column) -> Column:
    part = F.split(quad, r"\.")
    return sum(part[i].cast("bigint") * (256 ** (3 - i)) for i in range(4))


def _number(quad: str) -> int:
    a, b, c, d = (int(x) for x in quad.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_public_ipv4(quad: Column) -> Column:
    """R19. False for private, loopback and reserved blocks and for octets like ``01``."""
    value = _as_number(quad)
    inside = F.lit(False)
    for first, bits in NON_PUBLIC_BLOCKS:
        low = _number(first)
        inside = inside | value.between(low, low + 2 ** (32 - bits) - 1)
    listed = inside & ~quad.isin(PUBLIC_EXCEPTIONS)
    return ~quad.rlike(r"(?:^|\.)0\d") & ~listed


def public_addresses(text: Column) -> Column:
    """R19. Every occurrence of a public address, in order."""
    return F.filter(all_matches(text, IPV4), is_public_ipv4)


def address_checks(addresses: Column) -> Column:
    """R19. One failed warning per occurrence of ``public_addresses``."""
    return F.transform(
        addresses,
        lambda ip: _graded(
            F.concat(F.lit("public_ip_in_design_"), ip), F.lit(False), "warning",
            F.concat(F.lit("Public IP "), ip, F.lit(" used - verify if intentional (internet-facing)")),
            "", ip,
        ),
    )


def topology_checks(facts: Column, users: Column) -> list[Column]:
    """R20. The two size rules need a user count."""
    big = users >= THREE_TIER_MIN_USERS
    small = users <= COLLAPSED_CORE_MAX_USERS
    evidence = users.cast("string")
    return [
        F.when(facts["spine_leaf"],
               _graded("spine_leaf_appropriate", facts["in_dc"], "error",
                       "Spine-leaf is a DC topology, not campus/branch",
                       "Spine-leaf correctly used in DC context")),
        F.when(facts["three_tier"] & users.isNotNull(),
               _graded("three_tier_scale", big, "warning",
                       _text("Three-tier for ", users,
                             f" users is oversized (recommended: {THREE_TIER_MIN_USERS}+ users)"),
                       _text("Three-tier correctly sized for ", users, " users"), evidence)),
        F.when(facts["collapsed_core"] & users.isNotNull(),
               _graded("collapsed_core_scale", small, "warning",
                       _text("Collapsed core for ", users,
                             f" users exceeds recommended max ({COLLAPSED_CORE_MAX_USERS} users)"),
                       _text("Collapsed core appropriate for ", users, " users"), evidence)),
    ]


def control_checks(facts: Column, compliance: Column) -> list[Column]:
    """R21 with J7: the control list is compiled to columns, no join."""
    checks = []
    for i, (standard, control, _) in enumerate(CONTROLS):
        spoken = control.replace("_", " ")
        checks.append(
            F.when(F.array_contains(compliance, standard),
                   _graded(f"{CONTROL_PREFIX[standard]}_{control}", facts["controls"][i], "error",
                           f"{standard} {spoken} not addressed", f"{standard} {spoken} addressed"))
        )
    return checks


def accuracy_checks(df: DataFrame) -> DataFrame:
    """R18 to R22 on a sample digest: ``accuracy_checks``, score and critical failures."""
    given = df.select(
        "*",
        F.coalesce("accuracy_facts", _accuracy_facts(F.lit(""), F.lit(""))).alias("_facts"),
        F.coalesce(F.col("compliance"), F.array().cast("array<string>")).alias("_std"),
    )
    facts = F.col("_facts")
    found = F.concat(
        _emitted(protocol_checks(facts)),
        address_checks(facts["addresses"]),
        _emitted(topology_checks(facts, F.col("user_count")) + control_checks(facts, F.col("_std"))),
    )
    checked = given.select(*df.columns, found.alias("accuracy_checks"))
    total = F.size("accuracy_checks")
    passed = F.size(F.filter("accuracy_checks", lambda c: c.passed))
    critical = F.filter("accuracy_checks", lambda c: ~c.passed & (c.severity == "error"))
    return checked.select(
        "*",
        F.when(total == 0, 100.0).otherwise(passed / total * 100).alias("accuracy_score"),
        F.size(critical).alias("critical_failures"),
    )

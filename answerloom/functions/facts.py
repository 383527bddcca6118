"""Technical facts as named predicates on a text, and the config syntax check.

A fact that the text does not touch holds. Add facts by passing your own ``Fact`` list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.text import all_matches, contains_any, count_present, strip


@dataclass(frozen=True)
class Fact:
    """X1. ``holds`` gets the text and its lower-cased form and returns a boolean Column."""

    name: str
    category: str
    source: str
    holds: Callable[[Column, Column], Column]


def names_number(topic: list[str], number: int) -> Callable[[Column, Column], Column]:
    """R12. When the topic comes up, ``number`` stands in the text as a whole number."""
    return lambda t, low: ~contains_any(low, topic) | t.rlike(rf"(?U)\b0*{number}\b")


def names_number_between(topic: list[str], least: int, most: int) -> Callable[[Column, Column], Column]:
    """R12. When the topic comes up, a number of three to five digits between both limits is given."""

    def holds(t: Column, low: Column) -> Column:
        numbers = F.regexp_extract_all(t, F.lit(r"(?U)\b([0-9]{3,5})\b"), F.lit(1))
        return ~contains_any(low, topic) | F.exists(numbers, lambda n: n.cast("int").between(least, most))

    return holds


def only_if(word: str, holds: Callable) -> Callable[[Column, Column], Column]:
    return lambda t, low: ~contains_any(low, [word]) | holds(t, low)


def mentions(terms: list[str]) -> Callable[[Column, Column], Column]:
    return lambda t, low: contains_any(low, terms)


def unless(topic: list[str], holds: Callable) -> Callable[[Column, Column], Column]:
    """Holds when the topic is absent."""
    return lambda t, low: ~contains_any(low, topic) | holds(t, low)


def always(t: Column, low: Column) -> Column:
    return F.lit(True)


def _llq(t: Column, low: Column) -> Column:
    stated = names_number(["llq", "priority queue", "strict priority"], 33)
    return ~contains_any(low, ["llq", "priority queue"]) | stated(t, low)


# Names, categories, sources, words and numbers of the facts.
FACTS = [
    Fact("collapsed_core_max_users", "topology", "Campus Network HA Design Guide",
         names_number_between(["collapsed core", "two-tier"], 1800, 2200)),
    Fact("spine_leaf_64port_max_servers", "topology", "CCNP DCCOR - Data Center Core",
         names_number(["spine", "leaf", "spine-leaf"], 2048)),
    Fact("three_tier_max_endpoints", "topology", "CCNP Enterprise Design ENSLD",
         names_number(["three-tier", "three tier"], 50000)),
    Fact("n_plus_1_optimal", "ha", "Campus Network HA Design Guide - Redundancy Levels",
         mentions(["n+1", "n plus 1", "two parallel paths"])),
    Fact("hsrp_default_preemption", "ha", "CCNP ENCOR - HSRP vs VRRP vs GLBP",
         unless(["hsrp"], unless(["preempt"], mentions(["disabled", "not enabled"])))),
    Fact("vrrp_preemption_enabled_default", "ha", "CCNP ENCOR - HSRP vs VRRP vs GLBP",
         unless(["vrrp"], unless(["preempt"], mentions(["enabled"])))),
    Fact("active_active_capacity_planning", "ha", "Campus Network HA Design - Active-Active Constraints",
         names_number(["active-active", "capacity"], 50)),
    Fact("bgp_tcp_port", "bgp", "Routing TCP/IP Volume II",
         only_if("bgp", names_number(["bgp", "tcp"], 179))),
    Fact("ebgp_default_ttl", "bgp", "BGP Design and Implementation",
         unless(["ebgp", "external bgp"], unless(["ttl"], mentions(["1", "ebgp-multihop"])))),
    Fact("bgp_next_hop_iBGP", "bgp", "BGP Design and Implementation",
         only_if("ibgp", mentions(["next-hop unchanged", "next-hop-self"]))),
    Fact("ospf_lsa_refresh_interval", "ospf", "OSPF Anatomy of an Internet Routing Protocol",
         only_if("lsa", names_number(["lsa", "refresh", "30 minute"], 30))),
    Fact("ospf_lsa_max_age", "ospf", "OSPF Anatomy", always),
    Fact("voice_dscp", "qos", "End-to-End QoS Network Design / RFC 4594",
         unless(["voice", "voip"], mentions(["ef", "expedited forwarding", "46"]))),
    Fact("llq_max_bandwidth_percent", "qos", "End-to-End QoS Network Design - LLQ Design Rules", _llq),
    Fact("scavenger_dscp", "qos", "RFC 4594 QoS Guidelines", always),
    Fact("inter_as_option_a_most_secure", "mpls", "Definitive MPLS Network Designs - Inter-AS Options",
         unless(["option a", "back-to-back vrf"],
                lambda t, low: low.rlike(r"(?d)option.{0,30}a.{0,50}secure|secure.{0,50}option.{0,30}a"))),
    Fact("inter_as_option_c_most_scalable", "mpls", "Definitive MPLS Network Designs - Inter-AS Options",
         unless(["option c", "multihop mp-ebgp"],
                lambda t, low: low.rlike(r"(?d)option.{0,30}c.{0,50}scalab|scalab.{0,50}option.{0,30}c"))),
    Fact("sdwan_planes", "sdwan", "Cisco Software-Defined Wide Area Networks",
         unless(["sd-wan", "sdwan"],
                lambda t, low: count_present(low, ["vbond", "vmanage", "vsmart", "vedge", "cedge"]) >= 3)),
    Fact("symmetric_irb_no_all_vteps", "vxlan", "Building Data Centers with VXLAN BGP EVPN", always),
]


def check_facts(
    df: DataFrame, text: str, category: str | None = None, facts: list[Fact] = FACTS
) -> DataFrame:
    """R11 with J2: score and failed facts. The rule list is compiled to columns, no join.

    A row whose ``category`` is blank is held against every fact, another row only against
    facts of its category and general ones.
    """
    prepared = df.withColumn("_low", F.lower(F.col(text)))
    wanted = F.coalesce(F.col(category), F.lit("")) if category else F.lit("")
    verdicts = []
    for fact in facts:
        verdict = F.struct(
            F.lit(fact.name).alias("fact"),
            F.coalesce(fact.holds(F.col(text), F.col("_low")), F.lit(True)).alias("passed"),
        )
        if category and fact.category != "general":
            verdict = F.when((wanted == "") | (wanted == fact.category), verdict)
        verdicts.append(verdict)
    checked = prepared.withColumn(
        "_v", F.filter(F.array(*verdicts), lambda v: v.isNotNull())
    ).drop("_low")
    with_lists = checked.select(
        "*",
        F.size("_v").alias("num_checked"),
        F.transform(F.filter("_v", lambda v: ~v.passed), lambda v: v.fact).alias("failed_facts"),
    ).drop("_v")
    return with_lists.withColumn(
        "fact_score",
        F.when(F.col("num_checked") == 0, 1.0).otherwise(
            (F.col("num_checked") - F.size("failed_facts")) / F.col("num_checked")
        ),
    )


# Fence labels and line ends.
FENCE = r"(?s)```(?:cisco|ios|nxos|juniper|text)?\n(.*?)```"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def config_syntax_ok(text: Column) -> Column:
    """R13. Parentheses balance on every line; BGP and OSPF blocks name what they connect."""

    def times(line: Column, char: str) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit(char), F.lit("")))

    def has(block: Column, word: str) -> Column:
        return F.contains(block, F.lit(word))

    def block_ok(block: Column) -> Column:
        lines = F.split(block, LINE_END)
        balanced = F.forall(lines, lambda line: times(line, "(") == times(line, ")"))
        bgp = ~has(block, "router bgp") | has(block, "neighbor") | has(block, "network")
        ospf = ~has(block, "router ospf") | has(block, "network") | has(block, "area")
        # A block of blank lines is skipped before any rule applies.
        return (strip(block) == "") | (balanced & bgp & ospf)

    return F.forall(all_matches(text, FENCE, 1), block_ok)

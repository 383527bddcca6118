"""Scenarios, reasoning chains and chat samples, computed row by row from an id and a seed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.fixed import chain_text as text
from answerloom.fixed import scenarios as fixed
from answerloom.operators.curate import split_random

STEP_TYPE = "array<struct<title:string,source_ref:string,content:string,sub_steps:array<string>>>"


# --- draws --------------------------------------------------------------------------------------


def draw(key: Column, field: str, n: int, seed: int) -> Column:
    """A number in [0, n) that depends on seed, field and id alone, never on partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}|{field}|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n


def share(key: Column, field: str, seed: int) -> Column:
    return draw(key, field, 2 ** 32, seed) / float(2 ** 32)


def pick(values: list, key: Column, field: str, seed: int) -> Column:
    literals = [
        F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)
        for v in values
    ]
    return F.array(*literals)[draw(key, field, len(values), seed).cast("int")]


#: Columns of a sample's scenario by kind, in the order of a sample file.
DESIGN_FIELDS = ("user_count", "site_count", "industry", "compliance", "uptime_requirement", "budget", "is_datacenter", "cloud_heavy", "scale")
FAULT_FIELDS = ("protocol", "issue_type", "symptoms")


def design_scenarios(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """G1."""
    k = F.col(key)
    scales = F.array(
        *[F.struct(F.lit(s).alias("scale"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for s, lo, hi in fixed.SCALES]
    )
    drawn = df.withColumn("_scale", scales[draw(k, "scale", len(fixed.SCALES), seed).cast("int")])
    spread = draw(k, "users", 2 ** 32, seed) % (F.col("_scale.hi") - F.col("_scale.lo") + 1)
    drawn = drawn.select(
        *df.columns,
        F.col("_scale.scale").alias("scale"),
        (F.col("_scale.lo") + spread).cast("bigint").alias("user_count"),
        pick(fixed.SITE_COUNTS, k, "sites", seed).cast("bigint").alias("site_count"),
        pick(fixed.INDUSTRIES, k, "industry", seed).alias("industry"),
        pick(fixed.COMPLIANCE_SETS, k, "compliance", seed).alias("_compliance"),
        pick(fixed.UPTIMES, k, "uptime", seed).alias("uptime_requirement"),
        pick(fixed.BUDGETS, k, "budget", seed).alias("budget"),
        (share(k, "datacenter", seed) < fixed.DATACENTER_SHARE).alias("is_datacenter"),
        (share(k, "cloud", seed) < fixed.CLOUD_SHARE).alias("cloud_heavy"),
    )
    none = F.size("_compliance") == 0
    corrected = (
        F.when(none & (F.col("industry") == "financial_services"), F.array(F.lit("PCI-DSS"), F.lit("SOX")))
        .when(none & (F.col("industry") == "healthcare"), F.array(F.lit("HIPAA")))
        .otherwise(F.col("_compliance"))
    )
    return drawn.withColumn("compliance", corrected).drop("_compliance")


def fault_scenarios(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """G2."""
    faults = F.array(
        *[
            F.struct(
                F.lit(p).alias("protocol"), F.lit(i).alias("issue_type"),
                F.array(*[F.lit(s) for s in symptoms]).alias("symptoms"),
            )
            for p, i, symptoms in fixed.FAULTS
        ]
    )
    chosen = df.withColumn("_fault", faults[draw(F.col(key), "fault", len(fixed.FAULTS), seed).cast("int")])
    return chosen.select(*df.columns, "_fault.*")


def plan_kinds(df: DataFrame, key: str, design_ratio: float = 0.70, seed: int = 42) -> DataFrame:
    """G3. Exactly floor(n * ratio) design rows, the others troubleshooting."""
    placed = split_random(df, key, design_ratio, 0.0, seed)
    return placed.withColumn("kind", F.when(F.col("split") == "train", "design").otherwise("troubleshooting")).drop("split")


# --- questions ----------------------------------------------------------------------------------


def _spoken(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def _thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def _say(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _drawn(forms: tuple[Column, ...], number: Column) -> Column:
    """The form of that number; the others are not made."""
    return reduce(lambda chosen, form: chosen.when(number == form[0], form[1]), enumerate(forms[1:], 1), F.when(number == 0, forms[0]))


def design_question(key: Column, seed: int = 42) -> Column:
    """G4. The sentences."""
    comply = F.when(
        F.size("compliance") > 0,
        _say(" We must comply with ", F.array_join("compliance", " and "), "."),
    ).otherwise("")
    phrases = [x for pair in fixed.BUDGET_PHRASES.items() for x in pair]
    budget = F.coalesce(
        F.create_map(*[F.lit(x) for x in phrases])[F.col("budget")], F.lit(fixed.BUDGET_PHRASES["moderate"])
    )
    industry, users = _spoken(F.col("industry")), _thousands(F.col("user_count"))
    sites, uptime = F.col("site_count"), F.col("uptime_requirement")
    many = sites > 1
    forms = (
        _say("Design a network for a ", industry, " company with ", users, " users across ", sites, " ",
             F.when(many, "sites").otherwise("site"), ".", comply, " We need ", uptime,
             " uptime and have a ", budget, "."),
        _say("I'm building network infrastructure for a ", industry, " organization. We have ", users,
             " employees ",
             F.when(many, _say("distributed across ", sites, " locations")).otherwise("at a single location"),
             ".", comply, " Reliability target: ", uptime, ". Budget: ", budget,
             ". What architecture do you recommend?"),
        _say("Recommend a complete network architecture for a ", industry, " enterprise: ", users, " users, ",
             sites, " sites.", comply, " Required uptime: ", uptime, ". Budget constraints: ", budget,
             ". Include topology, WAN design, security, hardware recommendations, and cost estimates."),
    )
    return _drawn(forms, draw(key, "question", 3, seed))


def fault_question(key: Column, seed: int = 42) -> Column:
    """G4. The sentences."""
    symptoms = F.array_join("symptoms", "; ")
    protocol, issue = F.upper("protocol"), _spoken(F.col("issue_type"))
    forms = (
        _say("We're experiencing ", issue, " on our ", protocol, " network. Symptoms: ", symptoms,
             ". Walk me through the troubleshooting methodology."),
        _say("Our network team is seeing: ", symptoms, ". This appears to be a ", protocol, " ", issue,
             " issue. What is the systematic approach to diagnose and resolve this?"),
        _say("Help me troubleshoot a ", protocol, " problem. We're observing: ", symptoms,
             ". Provide step-by-step diagnostic commands and expected outputs."),
    )
    return _drawn(forms, draw(key, "question", 3, seed))


# --- choices ------------------------------------------------------------------------------------


def scale_label(users: Column) -> Column:
    """G5."""
    return F.when(users < 500, "small").when(users < 5000, "medium").when(users < 50000, "large").otherwise("enterprise")


def select_topology(users: Column, is_datacenter: Column) -> Column:
    """G6."""
    return F.when(is_datacenter, "spine_leaf").when(users < 2000, "collapsed_core").otherwise("three_tier")


def select_wan(sites: Column, cloud_heavy: Column, compliance: Column) -> Column:
    """G7."""
    private = F.arrays_overlap(compliance, F.array(F.lit("PCI-DSS"), F.lit("HIPAA")))
    return (
        F.when((sites > 10) | cloud_heavy, "sd_wan")
        .when(private, "mpls")
        .when(sites > 3, "hybrid_wan")
        .otherwise("mpls")
    )


def wan_sizing(users: Column, sites: Column) -> Column:
    """G8. struct<users_per_site, mbps, recommended>."""
    per_site = F.floor(users / F.greatest(sites, F.lit(1)))
    mbps = per_site * 2
    return F.struct(
        per_site.alias("users_per_site"), mbps.alias("mbps"),
        F.bround(F.least(mbps * F.lit(1.2), mbps + F.lit(100.0)), 0).cast("bigint").alias("recommended"),
    )


def cost_model(users: Column, compliance: Column, typical: Column | None = None) -> Column:
    """G9 with J6. ``typical`` is a benchmark text such as ``$1,000``; by default the fixed table."""
    label = scale_label(users)
    if typical is None:
        pairs = [x for pair in fixed.CAPEX_PER_USER.items() for x in pair]
        typical = F.create_map(*[F.lit(x) for x in pairs])[label]
    shown = F.coalesce(typical, F.lit(fixed.CAPEX_DEFAULT))
    per_user = F.coalesce(
        F.regexp_replace(shown, "[$,]", "").try_cast("double").cast("bigint"), F.lit(600).cast("bigint")
    )
    premium = F.lit(1.0) + F.when(F.array_contains(compliance, "PCI-DSS"), 0.30).otherwise(0.0)
    premium = premium + F.when(F.array_contains(compliance, "HIPAA"), 0.25).otherwise(0.0)
    base = per_user * users
    capex = F.floor(base * premium)
    opex = F.floor(capex * F.lit(0.15))
    return F.struct(
        label.alias("scale"), per_user.alias("per_user"), base.alias("base_capex"),
        premium.alias("multiplier"), capex.alias("capex"), opex.alias("opex"), (capex + 3 * opex).alias("tco"),
    )


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _step(title, source: Column | str, content, sub_steps: Column | None = None) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        lit(title).alias("title"), lit(source).alias("source_ref"), lit(content).alias("content"),
        (sub_steps if sub_steps is not None else _texts([])).alias("sub_steps"),
    )


def _tier(users: Column, position: int) -> Column:
    """G10: hardware by size."""
    chosen = F.lit(text.HARDWARE[-1][position])
    for row in reversed(text.HARDWARE[:-1]):
        chosen = F.when(users > row[0], row[position]).otherwise(chosen)
    return chosen


# --- chains -------------------------------------------------------------------------------------


def with_design_chain(df: DataFrame, only: Column | None = None, into: str = "chain") -> DataFrame:
    """G10, G11. Adds ``chain``: six fixed steps, plus PCI, HIPAA and WAN where they apply; null where ``only`` doesn't hold.

    Choices and figures are columns first, so that each is worked out once per row.
    """
    users, sites, compliance = F.col("user_count"), F.col("site_count"), F.col("compliance")
    chosen = df.select(
        "*",
        F.array_contains(compliance, "PCI-DSS").alias("_pci"),
        F.array_contains(compliance, "HIPAA").alias("_hipaa"),
        scale_label(users).alias("_label"),
        select_topology(users, F.col("is_datacenter")).alias("_topology"),
        select_wan(sites, F.col("cloud_heavy"), compliance).alias("_wan"),
        wan_sizing(users, sites).alias("_size"),
        cost_model(users, compliance).alias("_cost"),
    )
    return chosen.select(*df.columns, (_design_steps() if only is None else F.when(only, _design_steps())).alias(into))


def _if(condition: Column, step: Column) -> Column:
    return F.when(condition, F.array(step)).otherwise(F.array().cast(STEP_TYPE))


def _design_steps() -> Column:
    users, sites, uptime = F.col("user_count"), F.col("site_count"), F.col("uptime_requirement")
    datacenter, topology, wan = F.col("is_datacenter"), F.col("_topology"), F.col("_wan")
    pci, hipaa, size, cost = F.col("_pci"), F.col("_hipaa"), F.col("_size"), F.col("_cost")
    ranges = [x for pair in fixed.TOPOLOGY_USERS.items() for x in pair]
    user_range = F.coalesce(F.create_map(*[F.lit(x) for x in ranges])[topology], F.lit("N/A"))
    notes = [x for pair in text.UPTIME_NOTES.items() for x in pair]
    note = F.coalesce(F.create_map(*[F.lit(x) for x in notes])[uptime], F.lit(text.UPTIME_DEFAULT_NOTE))
    large = (users > 10000) | (sites > 10)
    scale = _step(
        text.SCALE_TITLE, text.SCALE_SOURCE,
        _say("- User count: ", users, " → '", F.col("_label"), "' category\n- Recommended topology: ",
             F.initcap(_spoken(topology)), "\n- Decision basis: ", user_range, " user range"),
        F.array(
            _say("Alternative 1 considered: collapsed core - ",
                 F.when(users > 2000, "Rejected: exceeds 2000-user threshold").otherwise("Viable option")),
            _say("Alternative 2 considered: spine-leaf - ",
                 F.when(datacenter, "Applicable").otherwise("Rejected: data center topology only")),
        ),
    )
    availability = _step(
        _say("High Availability Design for ", uptime, " Uptime"), text.HA_SOURCE,
        _say("- Uptime target: ", uptime, " = ", note, "\n" + text.UPTIME_TAIL),
        F.when(F.contains(uptime, F.lit("99.99")), _texts(text.HA_SUB + text.HA_SUB_STRICT)).otherwise(_texts(text.HA_SUB)),
    )
    transport = _step(
        text.WAN_TITLE, text.WAN_SOURCE,
        _say("- Site count: ", sites, " → ", F.upper(_spoken(wan)), "\n- Average users per site: ",
             size["users_per_site"], "\n- Bandwidth calculation: ", size["users_per_site"],
             " users × 2 Mbps = ", size["mbps"], " Mbps minimum\n- Recommended: ", size["recommended"],
             " Mbps with 20% headroom"),
        F.when(wan == "sd_wan", _texts(text.WAN_SUB["sd_wan"])).when(wan == "mpls", _texts(text.WAN_SUB["mpls"])).otherwise(_texts([])),
    )
    security = _step(
        text.SECURITY_TITLE, text.SECURITY_SOURCE,
        _say(text.SECURITY_HEAD + "\n- Compliance-driven segmentation: ",
             F.when(pci, "CDE isolation required").otherwise("Standard VLAN segmentation"),
             "\n- PHI data isolation: ",
             F.when(hipaa, "HIPAA-compliant separate VLAN required").otherwise("Not required"),
             "\n" + text.SECURITY_TAIL),
        F.concat(
            _texts(text.SECURITY_SUB),
            F.when(pci, _texts([text.SECURITY_PCI])).otherwise(_texts([])),
            F.when(hipaa, _texts([text.SECURITY_HIPAA])).otherwise(_texts([])),
        ),
    )
    hardware = _step(
        text.VENDOR_TITLE, text.VENDOR_SOURCE,
        _say("- Core: ", _tier(users, 1), "\n- Distribution: ", _tier(users, 2), "\n- Access: ", _tier(users, 3),
             "\n" + text.HARDWARE_TAIL),
    )
    money = _step(
        text.COST_TITLE, text.COST_SOURCE,
        _say("- Scale: ", cost["scale"], " (", users, " users) → $", _thousands(cost["per_user"]),
             "/user benchmark\n- Base CapEx: $", _thousands(cost["base_capex"]),
             "\n- Compliance premium: ", F.bround((cost["multiplier"] - 1) * 100, 0).cast("int"),
             "%\n- Estimated total CapEx: $", _thousands(cost["capex"]), "\n- Annual OpEx estimate: $",
             _thousands(cost["opex"]), " (15% of CapEx)\n- 3-Year TCO: $", _thousands(cost["tco"])),
    )
    phases = _step(
        text.PHASE_TITLE, text.PHASE_SOURCE,
        F.when(large, text.PHASES_LARGE).when(users > 1000, text.PHASES_MEDIUM).otherwise(text.PHASES_SMALL),
    )
    return F.concat(
        F.array(scale),
        _if(pci, _step(text.PCI_TITLE, text.PCI_SOURCE, text.PCI_BODY, _texts(text.PCI_SUB))),
        _if(hipaa, _step(text.HIPAA_TITLE, text.HIPAA_SOURCE, text.HIPAA_BODY, _texts(text.HIPAA_SUB))),
        F.array(availability), _if(sites > 1, transport), F.array(security, hardware, money, phases),
    )


def diagnostic_routes(spark: SparkSession) -> DataFrame:
    """J8. The fixed diagnostic steps as (route, diagnostics); five rows."""
    routes: dict[str, list] = {}
    for route, _, check, commands, expected, on_failure in text.DIAGNOSTICS:
        prefix, source = text.ROUTE_WORDING[route.split("_")[0]]
        content = f"Command: {', '.join(commands)}\nExpected: {expected}"
        content += f"\nIf fail: {on_failure}" if route.startswith("bgp") else ""
        routes.setdefault(route, []).append((prefix + check, source, content, []))
    prefix, source = text.ROUTE_WORDING["layers"]
    for number, name, checks, commands in text.LAYERS:
        content = f"Checks: {', '.join(checks)}\nCommands: {', '.join(commands)}"
        routes.setdefault("layers", []).append((f"{prefix}{number} ({name}) Verification", source, content, []))
    return spark.createDataFrame(list(routes.items()), f"route string, diagnostics {STEP_TYPE}")


def diagnostic_route() -> Column:
    """J8: which diagnostic tree a fault takes."""
    protocol, issue = F.lower("protocol"), F.col("issue_type")
    stuck = F.contains(issue, F.lit("exstart")) | F.contains(issue, F.lit("exchange"))
    return (
        F.when((protocol == "bgp") & F.contains(issue, F.lit("neighbor")), "bgp_neighbor_down")
        .when(protocol == "bgp", "bgp_route_missing")
        .when((protocol == "ospf") & stuck, "ospf_exstart")
        .when(protocol == "ospf", "ospf_neighbor_down")
        .when(protocol.isin("interface", "connectivity"), "layers")
        .otherwise("generic")
    )


def with_fault_chain(df: DataFrame, routes: DataFrame, only: Column | None = None, into: str = "chain") -> DataFrame:
    """G12. Adds ``chain``: triage, link check, up to four diagnostics, resolution; null where ``only`` doesn't hold.

    ``routes(route, diagnostics)`` is a small lookup table; Spark broadcasts it by its size.
    """
    protocol, issue = F.upper("protocol"), F.col("issue_type")
    joined = df.withColumn("route", diagnostic_route()).join(routes, "route", "left")
    generic = F.array(
        *[
            _step(f"Diagnostic Step {i}: Systematic Verification", text.GENERIC_SOURCE,
                  _say("Verify ", protocol, " ", issue, " from multiple angles:\n" + text.GENERIC_TAIL))
            for i in range(1, 5)
        ]
    )
    known = F.slice(F.coalesce(F.col("diagnostics"), F.array().cast(STEP_TYPE)), 1, 4)
    causes = [x for pair in text.CAUSES.items() for x in pair]
    cause = F.coalesce(F.create_map(*[F.lit(x) for x in causes])[F.lower("protocol")], F.lit(text.CAUSE_DEFAULT))
    verify = F.when(F.lit(False), _texts([]))
    for name, commands in text.VERIFY.items():
        verify = verify.when(F.lower("protocol") == name, _texts(commands))
    chain = F.concat(
        F.array(
            _step(text.TRIAGE_TITLE, text.TRIAGE_SOURCE,
                  _say("- Protocol affected: ", protocol, "\n- Issue category: ", issue, "\n- Symptoms: ",
                       F.array_join("symptoms", ", "), "\n" + text.TRIAGE_TAIL)),
            _step(text.LINK_TITLE, text.LINK_SOURCE, text.LINK_BODY),
        ).cast(STEP_TYPE),
        F.when(F.col("route") == "generic", generic.cast(STEP_TYPE)).otherwise(known),
        F.array(
            _step(text.RESOLUTION_TITLE, _say(protocol, text.RESOLUTION_SOURCE_TAIL),
                  _say("- Root cause category: ", issue, "\n- Common causes for ", protocol, ": ", cause,
                       "\n" + text.RESOLUTION_TAIL),
                  verify.otherwise(_texts(text.VERIFY_DEFAULT)))
        ).cast(STEP_TYPE),
    )
    return joined.select(*df.columns, (chain if only is None else F.when(only, chain)).alias(into))


def render_chain(chain: Column) -> Column:
    """G13."""
    blocks = F.transform(
        chain,
        lambda s, i: F.concat(
            F.lit("\n\nStep "), (i + 1).cast("string"), F.lit(": "), s["title"],
            F.lit("\n- Source: "), s["source_ref"], F.lit("\n"), s["content"],
            F.array_join(F.transform(s["sub_steps"], lambda t: F.concat(F.lit("\n  * "), t)), ""),
        ),
    )
    return F.concat(F.lit("<think>"), F.array_join(blocks, ""), F.lit("\n</think>"))


def generated_rows(kinds: DataFrame, key: str, routes: DataFrame, seed: int = 42) -> DataFrame:
    """G1, G2, G4, G11, G12 for rows of both kinds in one branch: the scenario's columns, ``question`` and ``chain`` of each row's own ``kind``."""
    k, design = F.col(key), F.col("kind") == "design"
    drawn = fault_scenarios(design_scenarios(kinds, key, seed), key, seed)
    asked = drawn.withColumn("question", F.when(design, design_question(k, seed)).otherwise(fault_question(k, seed)))
    chained = with_fault_chain(with_design_chain(asked, design, "_design"), routes, ~design, "_fault")
    return chained.withColumn("chain", F.coalesce("_design", "_fault")).drop("_design", "_fault")


def assemble_samples(rows: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """G14, U1. Samples of both kinds from ``generated_rows`` and supplied ``answers(key, answer)``, joined once.

    Messages and metadata have the types of a sample file, so curation takes them as they are; a
    scenario's columns are null where the kind has none. Rows without an answer keep a null ``messages``
    and status ``error`` (A16 counts them).
    """
    joined = rows.join(answers, key, "left")
    design, answered = F.col("kind") == "design", F.coalesce(F.col("answer"), F.lit("")) != ""
    messages = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(
            F.lit("assistant").alias("role"),
            F.concat(render_chain(F.col("chain")), F.lit("\n\n"), F.col("answer")).alias("content"),
        ),
    )
    own = {name: F.when(design, F.col(name)) for name in DESIGN_FIELDS} | {name: F.when(~design, F.col(name)) for name in FAULT_FIELDS}
    first = F.concat(F.upper("protocol"), F.lit(" Troubleshooting Decision Tree"))
    metadata = F.struct(
        F.col("kind").alias("type"), F.lit(None).cast("string").alias("category"), F.struct(*[c.alias(name) for name, c in own.items()]).alias("scenario"),
        F.when(design, _texts(fixed.DESIGN_SOURCES)).otherwise(F.concat(F.array(first), _texts(fixed.FAULT_SOURCES))).alias("sources_used"),
        F.when(design, F.array(_spoken(select_topology(F.col("user_count"), F.col("is_datacenter"))))).otherwise(_texts([])).alias("design_patterns"),
        F.when(design, F.col("compliance")).otherwise(_texts([])).alias("compliance_requirements"),
        F.size("chain").alias("reasoning_steps"),
    )
    return joined.select(
        key, "kind", F.when(answered, "ok").otherwise("error").alias("status"),
        F.when(answered, messages).alias("messages"), F.when(answered, metadata).alias("metadata"),
    )


def generation_stats(samples: DataFrame) -> DataFrame:
    """A16."""
    return samples.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))

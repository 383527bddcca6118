"""Chat rendering, prompts, cache keys and loss weights. The prompts' wording is in ``fixed.templates``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.fixed import templates as text
from answerloom.functions.text import WHITESPACE, cut, one_decimal

# Chat marks.
SYSTEM, USER, ASSISTANT, END = "<|system|>", "<|user|>", "<|assistant|>", "<|end|>"


def render_turn(role: Column, content: Column) -> Column:
    """One message of the chat template; every role but system and user speaks as assistant."""
    mark = F.when(role == "system", SYSTEM).when(role == "user", USER).otherwise(ASSISTANT)
    return F.concat(mark, F.lit("\n"), content, F.lit(END))


def chat_template(messages: Column) -> Column:
    """R26. First system message, then the other roles; an open user turn invites an answer."""
    system = F.filter(messages, lambda m: m["role"] == "system")
    others = F.filter(messages, lambda m: m["role"] != "system")
    spoken = F.transform(
        F.concat(F.slice(system, 1, 1), others), lambda m: render_turn(m["role"], m["content"])
    )
    invited = F.when(
        F.try_element_at(messages, F.lit(-1))["role"] == "user", F.array(F.lit(ASSISTANT))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(spoken, invited), "\n")


def chat_pieces(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """R26 for samples stored one message per row: the lines of the template in ``position`` order.

    Every turn renders where it is. Only system texts and, per sample, the last role meet in an
    aggregate, so no text of the conversation itself is shuffled.
    """
    is_system = F.col(role) == "system"
    spoken = turns.filter(~is_system | F.col(role).isNull()).select(
        F.col(key), F.col(order).cast("bigint").alias("position"), render_turn(F.col(role), F.col(text)).alias("piece")
    )
    system = turns.filter(is_system).groupBy(key).agg(F.min_by(text, order).alias("_t")).select(
        F.col(key), F.lit(-1).cast("bigint").alias("position"), render_turn(F.lit("system"), F.col("_t")).alias("piece")
    )
    ends = turns.groupBy(key).agg(F.max(order).alias("_last"), F.max_by(role, order).alias("_role"))
    invite = ends.filter("_role = 'user'").select(
        F.col(key), (F.col("_last") + 1).cast("bigint").alias("position"), F.lit(ASSISTANT).alias("piece")
    )
    return spoken.unionByName(system).unionByName(invite)


def single_turn_prompt(system: Column, user: Column) -> Column:
    """R27."""
    return F.concat(
        F.lit(SYSTEM + "\n"), system, F.lit(END + "\n" + USER + "\n"), user,
        F.lit(END + "\n" + ASSISTANT + "\n"),
    )


def cache_key(system: Column, prompt: Column) -> Column:
    """R31."""
    return F.substring(F.sha2(F.concat(system, F.lit("\n"), prompt), 256), 1, 16)


def span_weights(text: Column, weight: float = 2.0) -> Column:
    """R28. struct<tokens, weight> over whitespace tokens; tags and what they enclose weigh more.

    Tags are tokens of their own. A block that is never closed weighs to the end.
    """
    marked = F.regexp_replace(text, "(</?think>)", " $1 ")
    tokens = F.split(F.btrim(marked, F.lit(WHITESPACE)), r"(?U)\s+")
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("bigint").alias("tokens"),
                     F.lit(0.0).alias("weight"))

    def step(acc: Column, token: Column) -> Column:
        opening, closing = token == "<think>", token == "</think>"
        heavy = acc["inside"] | opening | closing
        return F.struct(
            (opening | (acc["inside"] & ~closing)).alias("inside"),
            (acc["tokens"] + F.when(token == "", 0).otherwise(1)).alias("tokens"),
            (acc["weight"] + F.when(token == "", 0.0).when(heavy, weight).otherwise(1.0)).alias("weight"),
        )

    return F.aggregate(
        tokens, start, step,
        lambda acc: F.struct(acc["tokens"].alias("tokens"), acc["weight"].alias("weight")),
    )


def downtime(uptime: Column) -> Column:
    """R29."""
    minutes = (F.lit(100.0) - uptime) / 100 * 525600
    return F.when(minutes < 60, F.concat(one_decimal(minutes), F.lit(" min/year"))).otherwise(
        F.concat(one_decimal(minutes / 60), F.lit(" hours/year"))
    )


def _or(c: Column, default: str) -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def _users_or(c: Column, default: str) -> Column:
    """Zero users counts as not given."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c.cast("string"))


def _listed(values: Column, empty: str) -> Column:
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.array_join(values, ", ")).otherwise(empty)


def _flag(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def _number(c: Column) -> Column:
    """A double the way Python prints it: 100.0, 99.9."""
    return F.coalesce(c, F.lit(99.9)).cast("double").cast("string")


def filled(template: str, **values: Column) -> Column:
    """A template with a column at each ``${name}``."""
    parts = re.split(r"\$\{(\w+)\}", template)
    return F.concat(*[values[part] if k % 2 else F.lit(part) for k, part in enumerate(parts)])


def _extra_lines(extras: Column, template: str) -> Column:
    """Additional fields, one line each; map order is the order of writing."""
    entries = F.map_entries(F.coalesce(extras, F.create_map().cast("map<string,string>")))
    return F.array_join(F.transform(entries, lambda e: filled(template, key=e["key"], value=e["value"])), "")


def design_prompt(r: dict[str, Column], flavor: str = "agent") -> Column:
    """R30. ``r`` maps requirement names to columns; ``uptime_shown`` is the uptime as it was sent."""
    common = {"sites": _or(r["sites"], "1"), "budget": _or(r["budget"], "flexible")}
    if flavor == "agent":
        return filled(
            text.DESIGN_AGENT, **common, users=_or(r["users"], "unspecified"), compliance=_listed(r["compliance"], "none specified"),
            uptime=F.coalesce(r.get("uptime_shown", F.lit(None)), _number(r["uptime"])), downtime=downtime(F.coalesce(r["uptime"], F.lit(99.9))),
            extras=_extra_lines(r["extras"], text.DESIGN_AGENT_EXTRA),
        )
    common |= {
        "users": _users_or(r["users"], "not specified"), "compliance": _listed(r["compliance"], "none"), "uptime": _number(r["uptime"]),
        "data_center": _flag(r["data_center"]),
    }
    if flavor == "api":
        return filled(
            text.DESIGN_API, **common, wan_type=_or(r["wan_type"], "not specified"), cloud_connectivity=_flag(r["cloud_connectivity"]),
            redundancy_level=_or(r["redundancy_level"], "N+1"), extras=_extra_lines(r["extras"], text.DESIGN_API_EXTRA),
        )
    return filled(text.DESIGN_TOOL, **common, wireless=_flag(r["wireless"]))


def troubleshoot_prompt(r: dict[str, Column], flavor: str = "agent", logs_chars: int = 500) -> Column:
    """R30, W9. Logs are shown to ``logs_chars`` characters."""
    common = {"device": _or(r["device"], "unknown")}
    if flavor == "agent":
        symptom = F.coalesce(r["symptom"], r["message"], F.lit("No description provided"))
        return filled(text.TROUBLESHOOT_AGENT, **common, symptom=symptom, protocol=_or(r["protocol"], "unknown"), impact=_or(r["impact"], "unknown"))
    template, tail = (text.TROUBLESHOOT_API, text.TROUBLESHOOT_API_LOGS) if flavor == "api" else (text.TROUBLESHOOT_TOOL, text.TROUBLESHOOT_TOOL_LOGS)
    has_logs = F.coalesce(r["logs"], F.lit("")) != ""
    return filled(
        template, **common, symptom=r["symptom"], protocol=_or(F.when(r["protocol"] != "", r["protocol"]), "unknown"),
        logs=F.when(has_logs, filled(tail, logs=cut(r["logs"], logs_chars))).otherwise(""),
    )


def estimate_prompt(r: dict[str, Column], flavor: str = "tool") -> Column:
    """R30."""
    if flavor == "agent":
        return filled(text.ESTIMATE_AGENT, context=r["context_json"])
    sites = _or(r["sites"], "1")
    if flavor == "api":
        quoted = F.transform(F.coalesce(r["compliance"], F.array().cast("array<string>")), lambda s: F.concat(F.lit("'"), s, F.lit("'")))
        return filled(text.ESTIMATE_API, users=_users_or(r["users"], "?"), sites=sites, compliance=F.array_join(quoted, ", "))
    return filled(
        text.ESTIMATE_TOOL, currency=_or(r["currency"], "USD"), users=_users_or(r["users"], "unspecified"), sites=sites,
        compliance=_listed(r["compliance"], "none"), opex=F.when(F.coalesce(r["include_opex"], F.lit(True)), text.ESTIMATE_TOOL_OPEX).otherwise(""),
    )

"""JSON texts written anew from their tokens: indented, or the way Python shows its value. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r'"(?:[^"\\]++|\\.)*+"|[\[\]{}:,]|[^\s\[\]{}:,"]++'
_DECIMAL = r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?\z"


def json_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _is_text(token: Column) -> Column:
    return F.startswith(token, F.lit('"'))


def _value(token: Column) -> Column:
    """The characters a JSON string stands for."""
    return F.get_json_object(F.concat(F.lit('{"a":'), token, F.lit("}")), "$.a")


def _number(token: Column) -> Column:
    """Decimals as the shortest text of their double, whole numbers as they stand, and so very large and small ones."""
    x = token.try_cast("double")
    plain = token.rlike(_DECIMAL) & token.rlike(r"[.eE]") & ((F.abs(x) >= 1e-3) | (x == 0)) & (F.abs(x) < 1e7)
    return F.when(plain, x.cast("string")).otherwise(token)


def _escaped(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _ascii(text: Column) -> Column:
    """Characters beyond ASCII as \\u escapes, two for those beyond 16 bits."""
    def shown(c: Column) -> Column:
        code = F.ascii(c)
        above = code - 0x10000
        pair = F.concat(_escaped(F.shiftright(above, 10) + 0xD800), _escaped(above.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        return F.when(code < 127, c).when(code < 0x10000, _escaped(code)).otherwise(pair)

    spread = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), shown), "")
    return F.when(text.rlike("[^\\x00-\\x7E]"), spread).otherwise(text)


def _json_string(token: Column) -> Column:
    """A string token with the escapes that JSON needs, and no others."""
    unescaped = F.contains(token, F.lit("\\"))
    again = F.regexp_extract(F.to_json(F.struct(_value(token).alias("a"))), r'(?s)^\{"a":(.*)\}\z', 1)
    return _ascii(F.when(unescaped, again).otherwise(token))


def _blanks(depth: Column) -> Column:
    return F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))


def indented_json(text: Column) -> Column:
    """A JSON text with its fields on lines of their own, two blanks a level; other texts stay. Made for contexts of a few hundred tokens."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit("").alias("last"))

    def add(a: Column, t: Column) -> Column:
        opens, closes, empty = t.isin("{", "["), t.isin("}", "]"), a["last"].isin("{", "[")
        line = F.when(empty & ~closes, _blanks(a["depth"])).otherwise("")
        shown = (
            F.when(closes, F.when(empty, t).otherwise(F.concat(_blanks(a["depth"] - 1), t)))
            .when(t == ",", F.concat(t, _blanks(a["depth"]))).when(t == ":", ": ").when(_is_text(t), _json_string(t)).otherwise(_number(t))
        )
        depth = a["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.struct(F.concat(a["out"], line, shown).alias("out"), depth.alias("depth"), t.alias("last"))

    return F.when(F.try_parse_json(text).isNull(), text).otherwise(F.aggregate(json_tokens(text), start, add, lambda a: a["out"]))


def _quoted(value: Column) -> Column:
    """A text as Python shows it: single quotes, or double ones around single ones."""
    back = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    lines = F.replace(F.replace(F.replace(back, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    single, double = F.contains(value, F.lit("'")), F.contains(value, F.lit('"'))
    escaped = F.concat(F.lit("'"), F.replace(lines, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(single & ~double, F.concat(F.lit('"'), lines, F.lit('"'))).otherwise(escaped)


def python_text(text: Column) -> Column:
    """A JSON object or list as Python's ``str`` shows it; other texts stay."""

    def shown(t: Column) -> Column:
        word = F.when(t == "true", "True").when(t == "false", "False").when(t == "null", "None")
        return F.when(t == ",", ", ").when(t == ":", ": ").when(_is_text(t), _quoted(_value(t))).otherwise(F.coalesce(word, _number(t)))

    nested = F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*[\[{]")
    return F.when(nested, F.array_join(F.transform(json_tokens(text), shown), "")).otherwise(text)

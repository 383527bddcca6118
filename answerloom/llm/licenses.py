"""Licence mentions in whole texts: ordered signature rules behind keywords. DataFrame and SQL functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.license_rules import STEMS, Rule, rules
from answerloom.llm.lines import lower_ascii
from answerloom.llm.tables import text_or_empty

#: Everything that isn't part of a word once A-Z are lower-cased.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Plain phrases that are counted wherever their words stand together.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
PHRASE_CONFIDENCE = 0.5


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bounded(pattern: str) -> str:
    """Whole words only; the spaces around a match aren't part of it, so neighbours can both match."""
    return f"(?<= )(?:{pattern})(?= )"


def phrase_starts(phrase: str) -> str:
    """SQL: numbers of the words of ``words`` at which the phrase begins."""
    parts = phrase.split(" ")
    same = " and ".join(f"get(words, i + {k}) = {quoted(p)}" for k, p in enumerate(parts))
    return f"if(contains(padded, {quoted(f' {phrase} ')}), filter(sequence(0L, n_words - 1), i -> {same}), cast(array() as array<bigint>))"


def detections(signatures: Sequence[Rule]) -> str:
    """SQL: every match of every rule whose keyword is in ``padded``, as intervals of characters, in the order they are judged.

    Matches and the pieces between them alternate, so a match begins where the lengths before it end.
    """
    listed = ", ".join(
        f"named_struct('label', {quoted(r.label)}, 'keyword', {quoted(r.keyword)}, 'pattern', {quoted(bounded(r.pattern))}, 'p', {r.priority}, 'o', {k}, 'c', {r.confidence}D)"
        for k, r in enumerate(signatures)
    )
    intervals = """
        aggregate(
            zip_with(regexp_extract_all(padded, r.pattern, 0), slice(split(padded, r.pattern, -1), 1, greatest(1, size(regexp_extract_all(padded, r.pattern, 0)))),
                     (m, gap) -> named_struct('m', char_length(m), 'gap', char_length(gap))),
            named_struct('at', 0, 'found', cast(array() as array<struct<s:int,e:int,p:int,o:int,label:string,c:double>>)),
            (a, x) -> if(x.m is null, a, named_struct(
                'at', a.at + x.gap + x.m,
                'found', concat(a.found, array(named_struct('s', a.at + x.gap, 'e', -(a.at + x.gap + x.m), 'p', r.p, 'o', r.o, 'label', r.label, 'c', r.c))))),
            a -> a.found)"""
    return f"sort_array(flatten(transform(filter(array({listed}), r -> contains(padded, r.keyword)), r -> {intervals})))"


def survivors() -> str:
    """SQL: labels and best confidence of ``found`` after suppression.

    A detection goes if it lies inside another of the same or a better priority. As they come by
    start, longest and best first, it is enough to know how far each priority has reached.
    """
    return """
        aggregate(found, named_struct('r1', -1, 'r2', -1, 'r3', -1, 'labels', cast(array() as array<string>), 'c', 0D),
            (a, x) -> named_struct(
                'r1', if(x.p = 1, greatest(a.r1, -x.e), a.r1), 'r2', if(x.p = 2, greatest(a.r2, -x.e), a.r2), 'r3', if(x.p = 3, greatest(a.r3, -x.e), a.r3),
                'labels', if(a.r1 >= -x.e or (x.p >= 2 and a.r2 >= -x.e) or (x.p >= 3 and a.r3 >= -x.e), a.labels, array_union(a.labels, array(x.label))),
                'c', if(a.r1 >= -x.e or (x.p >= 2 and a.r2 >= -x.e) or (x.p >= 3 and a.r3 >= -x.e), a.c, greatest(a.c, x.c))))"""


def joined_labels(labels: str) -> Column:
    return F.expr(f"array_join(array_sort(array_distinct({labels})), ',')")


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: Mapping[str, str] = PHRASES, signatures: Sequence[Rule] | None = None) -> DataFrame:
    """One row per document: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Words are runs of digits, a-z and non-ASCII characters after A-Z are lower-cased. The base
    counts the places of ``phrases`` and the numbers of the first and last word one begins at (null
    without any). Signature rules add labels: a text that holds none of ``STEMS`` is passed over, a
    rule is tried only where its keyword is, and detections inside another of the same or a better priority
    are dropped. score is the best confidence among what is left, a phrase's being 0.5, else 0.

    Null text counts as empty: no words, empty label lists. Repeated rows give repeated results and a
    null id is returned as it is. Other columns are ignored; an empty table gives an empty result.
    """
    signatures = rules() if signatures is None else signatures
    spaced = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text_or_empty(text)), NOT_WORD, " ")), F.lit(" ")).alias("padded"),
    )
    hit = F.lit(False)
    for stem in STEMS:
        hit = hit | F.contains("padded", F.lit(stem))
    any_phrase = F.lit(False)
    for phrase in phrases:
        any_phrase = any_phrase | F.contains("padded", F.lit(f" {phrase} "))
    measured = spaced.select(
        "doc_id", "padded", hit.alias("hit"), any_phrase.alias("base_hit"),
        F.when(F.col("padded") == "  ", F.lit(0)).otherwise(F.octet_length("padded") - F.octet_length(F.replace("padded", F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"),
    )
    starts = ", ".join(f"'{name}', {phrase_starts(phrase)}" for name, phrase in ((f"b{k}", p) for k, p in enumerate(phrases)))
    none = ", ".join(f"'b{k}', cast(array() as array<bigint>)" for k in range(len(phrases)))
    located = measured.select(
        "doc_id", "padded", "hit", "base_hit", "n_words", F.expr("if(base_hit, split(trim(padded), ' ', -1), cast(array() as array<string>))").alias("words")
    ).select(
        "doc_id", "n_words", F.expr(f"if(base_hit, named_struct({starts}), named_struct({none}))").alias("base"),
        F.expr(f"if(hit, {detections(signatures)}, cast(array() as array<struct<s:int,e:int,p:int,o:int,label:string,c:double>>))").alias("found"),
    )
    places = f"flatten(array({', '.join(f'base.b{k}' for k in range(len(phrases)))}))"
    named = ", ".join(f"if(size(base.b{k}) > 0, array({quoted(label)}), cast(array() as array<string>))" for k, label in enumerate(phrases.values()))
    judged = located.select("doc_id", "n_words", F.expr(places).alias("places"), F.expr(f"concat({named})").alias("base_names"), F.expr(survivors()).alias("left"))
    return judged.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        joined_labels("base_names").alias("base_labels"), joined_labels("concat(base_names, left.labels)").alias("labels"),
        F.greatest(F.expr("left.c"), F.when(F.size("places") > 0, F.lit(PHRASE_CONFIDENCE)).otherwise(F.lit(0.0))).alias("score"),
    )

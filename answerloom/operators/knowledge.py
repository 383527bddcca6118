"""A knowledge base of nested documents as tables: leaves, index, lookup, coverage, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.text import cut

# Characters cut from index words and from search words.
INDEX_TRIM = ".,;:()[]{}\"'"
SEARCH_TRIM = ".,;:()"

# Document categories and the section new entries go to.
CATEGORY_SECTIONS = {
    "design_patterns": "topology_patterns", "troubleshooting_trees": "bgp_issues",
    "compliance_requirements": "pci_dss", "vendor_specifics": "cisco",
    "configuration_templates": "bgp_templates", "cost_benchmarks": "capex_by_scale",
}

# The slices of K4 (name, category, section).
SLICES = [
    ("topology_patterns", "design_patterns", "topology_patterns"),
    ("wan_patterns", "design_patterns", "wan_patterns"),
    ("security_patterns", "design_patterns", "security_patterns"),
    ("ha_patterns", "design_patterns", "ha_patterns"),
    ("data_center_patterns", "design_patterns", "data_center_patterns"),
    ("bgp_issues", "troubleshooting_trees", "bgp_issues"),
    ("ospf_issues", "troubleshooting_trees", "ospf_issues"),
    ("interface_issues", "troubleshooting_trees", "interface_issues"),
    ("qos_issues", "troubleshooting_trees", "qos_issues"),
    ("connectivity_sequence", "troubleshooting_trees", "connectivity_issues"),
    ("routing_loops", "troubleshooting_trees", "routing_loops"),
    ("pci_dss_v4", "compliance_requirements", "pci_dss"),
    ("hipaa", "compliance_requirements", "hipaa"),
    ("sox", "compliance_requirements", "sox"),
    ("nist_csf_v2", "compliance_requirements", "nist_csf"),
    ("iso_27001_2022", "compliance_requirements", "iso_27001"),
    ("cisco", "vendor_specifics", "cisco"), ("juniper", "vendor_specifics", "juniper"),
    ("arista", "vendor_specifics", "arista"), ("palo_alto", "vendor_specifics", "palo_alto"),
    ("f5", "vendor_specifics", "f5"),
    ("capex_by_scale", "cost_benchmarks", "capex_by_scale"),
    ("opex_models", "cost_benchmarks", "opex_models"),
    ("tco_models", "cost_benchmarks", "tco_models"),
    ("roi_considerations", "cost_benchmarks", "roi_considerations"),
]


def _children(df: DataFrame) -> DataFrame:
    """One row per child of ``node``; a node without children stays (its child is null)."""
    spark = df.sparkSession
    return df.lateralJoin(spark.tvf.variant_explode_outer(F.col("node").outer()))


def parse_documents(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """S6: JSON text to VARIANT; text that is no JSON and missing files count as empty documents."""
    return docs.withColumn("node", F.coalesce(F.try_parse_json(doc), F.parse_json(F.lit("{}")))).drop(doc)


def _step(key: Column, pos: Column) -> Column:
    return F.when(key.isNull(), F.concat(F.lit("["), pos.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), key))


def deeper(doc: Column, levels: int) -> Column:
    """Whether a JSON text nests more than ``levels`` objects and lists: some brackets are left when innermost pairs are removed so often."""
    brackets = F.regexp_replace(F.regexp_replace(doc, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]+", "")
    for _ in range(levels):
        brackets = F.regexp_replace(brackets, r"\{\}|\[\]", "")
    return F.coalesce(brackets != "", F.lit(False))


def _shallow_nodes(rows: DataFrame, keep: list[str], levels: int) -> DataFrame:
    """Every level is one lateral explode; rows that are leaves already pass through."""
    for _ in range(levels):
        rows = _children(rows).select(
            *keep,
            F.when(F.col("value").isNull(), F.col("path")).otherwise(F.concat("path", _step(F.col("key"), F.col("pos")))).alias("path"),
            F.coalesce("value", "node").alias("node"),
        )
    return rows


def _deep_nodes(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rounds of explodes until no object or list is left, as a recursive query; its depth is that of the documents, its rows have no limit."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    names = "".join(f"`{c}`, " for c in keep)
    own = "".join(f"t.`{c}`, " for c in keep)
    return spark.sql(
        f"""WITH RECURSIVE tree({names} path, node) MAX RECURSION LEVEL 1001 AS (
          SELECT {names} path, node FROM {{rows}}
          UNION ALL
          SELECT {own} concat(t.path, if(c.key IS NULL, concat('[', c.pos, ']'), concat('.', c.key))), c.value FROM tree t, LATERAL variant_explode(t.node) c
        ) SELECT {names} path, node FROM tree""",  # JSON nested more than 1000 deep is no document for the parser
        rows=rows,
    )


def flatten(docs: DataFrame, category: str = "category", doc: str = "doc", levels: int = 8) -> DataFrame:
    """K1, X4. Leaves as (..., path, node): ``category.key[3].key``, at any depth. No shuffle.

    All documents take one pass of ``levels`` explodes. The few objects and lists that are left below it are opened by
    rounds until none is left.
    """
    keep = [c for c in docs.columns if c != doc]

    def shaped(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_shape", F.schema_of_variant("node"))

    def nodes(some: DataFrame) -> DataFrame:
        return shaped(_shallow_nodes(parse_documents(some, doc).select(*keep, F.col(category).cast("string").alias("path"), "node"), keep, levels))

    closed = F.col("_shape").rlike("^(OBJECT|ARRAY)<")
    opened = nodes(docs)
    # More levels than ``levels`` take more opening brackets, which few texts hold.
    below = nodes(docs.filter(F.col(doc).rlike(rf"(?s)^(?:[^\[{{]*+[\[{{]){{{levels + 1}}}"))).filter(closed)
    deep = shaped(_deep_nodes(below.drop("_shape"), keep))
    leaves = opened.filter(~closed).unionByName(deep.filter(~closed))
    return leaves.select(*keep, "path", "node", (F.col("_shape") == "STRING").alias("is_text"))


def leaf_text(node: Column) -> Column:
    return F.try_variant_get(node, "$", "string")


def leaf_terms(node: Column, min_chars: int = 4) -> Column:
    """The index words of a text leaf, in order: ``min_chars`` characters or more without the punctuation around them."""
    return F.sort_array(_trimmed(_words(node), min_chars))


def _words(node: Column) -> Column:
    return F.split(F.lower(leaf_text(node)), r"(?U)\s+")


def _trimmed(words: Column, min_chars: int) -> Column:
    return F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(INDEX_TRIM))), lambda t: F.length(t) >= min_chars)


def build_index(leaves: DataFrame, min_chars: int = 4, repeats: bool = True) -> DataFrame:
    """K2. Postings (..., term, path, first), one row per occurrence of ``min_chars`` characters or more; string leaves only.

    The original indexes words of more than three characters. Pass 1 to find shorter ones, such as protocol names.

    Postings stay rows. A term in every document is many rows, never one long list. ``first`` marks one occurrence of each
    term in a leaf, so paths are counted without bringing a leaf's words together again. Without ``repeats``
    only those occurrences are made.
    """
    keep = [c for c in leaves.columns if c not in ("node", "is_text")]
    if not repeats:
        distinct = F.array_distinct(_trimmed(F.array_distinct(_words(F.col("node"))), min_chars))
        return leaves.filter("is_text").select(*keep, F.explode(distinct).alias("term")).withColumn("first", F.lit(True))
    terms = leaves.filter("is_text").withColumn("_terms", leaf_terms(F.col("node"), min_chars))
    marked = F.transform("_terms", lambda t, i: F.struct(t.alias("term"), ((i == 0) | (t != F.col("_terms")[F.greatest(i - 1, F.lit(0))])).alias("first")))
    return terms.select(*keep, F.inline(marked))


def index_terms(postings: DataFrame) -> DataFrame:
    """K2, A19. Postings and distinct paths per term, in one shuffle by term."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("postings"), F.count_if("first").alias("paths"))


def store_index(postings: DataFrame, folder: str, terms: int = 1 << 20, row_group_bytes: int = 8 << 20) -> None:
    """K3. One row per leaf and term, laid out by ranges of (term, category, path, ...).

    A search reads the row groups whose least and greatest term, and whose Bloom filter, allow one of its words.
    A term of very many leaves spreads over several ranges, even if they have one path. The postings are written as they come
    first (``folder``-unsorted), so that finding the ranges reads them instead of making them once more.
    """
    found = f"{folder}-unsorted"
    postings.filter("first").drop("first").write.mode("errorifexists").parquet(found)
    rows = postings.sparkSession.read.parquet(found)
    order = ["term", "category", "path"]
    (
        rows.repartitionByRange(*order, *[c for c in rows.columns if c not in order]).sortWithinPartitions(*order[:2]).write.mode("errorifexists")
        .option("parquet.bloom.filter.enabled#term", "true").option("parquet.bloom.filter.expected.ndv#term", terms)
        .option("parquet.block.size", row_group_bytes).parquet(folder)
    )


def search_terms(topic: str) -> list[str]:
    """K3. Words longer than two characters, lower-cased, punctuation trimmed."""
    return sorted({w.lower().strip(SEARCH_TRIM) for w in topic.split() if len(w) > 2})


def find(postings: DataFrame, topic: str) -> DataFrame:
    """J9. Postings of the topic's words: a filter that reaches the stored index."""
    return postings.filter(F.col("term").isin(search_terms(topic)))


def topic_matches(postings: DataFrame, topic: str, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """K3, A19. Distinct matching paths per category."""
    distinct = find(postings, topic).select("category", *keys).distinct()
    return distinct.groupBy("category").agg(F.count(F.lit(1)).alias("match_count"))


def sections(docs: DataFrame, category: str = "category", doc: str = "doc") -> DataFrame:
    """Top-level keys (category, section)."""
    top = _children(parse_documents(docs, doc)).filter("key IS NOT NULL")
    return top.select(F.col(category).alias("category"), F.col("key").alias("section")).distinct()


def topic_sections(postings: DataFrame, topic: str, known: DataFrame) -> DataFrame:
    """K3. Second path element of the matches, where it is a real section name."""
    named = find(postings, topic).select("category", F.try_element_at(F.split("path", r"\."), F.lit(2)).alias("section"))
    return named.distinct().join(known, ["category", "section"], "left_semi")


def slice_leaves(leaves: DataFrame, slices: list[tuple[str, str, str]] = SLICES) -> DataFrame:
    """K4. Leaves under the listed (name, category, section), renamed; one filter on the path."""
    names = [x for name, category, section in slices for x in (f"{category}.{section}", name)]
    below = F.substr("path", F.length("category") + 2)
    prefix = F.concat_ws(".", "category", F.regexp_extract(below, r"^[^.\[]*", 0))
    named = leaves.withColumn("slice", F.create_map(*[F.lit(x) for x in names])[prefix])
    return named.filter("slice IS NOT NULL")


def count_entries(docs: DataFrame, category: str = "category", doc: str = "doc", depth_cap: int = 5) -> DataFrame:
    """A15. Rows of (..., section, entries), where a list counts its length and depth is capped; ``section`` is the top-level key."""
    rows = parse_documents(docs, doc).withColumns({"level": F.lit(0), "section": F.lit(None).cast("string")})
    keep = [c for c in rows.columns if c not in ("node", "level", "section")]
    for _ in range(depth_cap + 1):
        # Lists are counted, not entered: only objects go on to their children.
        shaped = rows.withColumn("_list", F.try_variant_get("node", "$", "array<variant>").isNotNull())
        opened = shaped.withColumn("_node", F.col("node")).withColumn(
            "node", F.when(~F.col("_list"), F.col("_node"))
        )
        rows = _children(opened).select(
            *keep,
            F.coalesce("value", "_node").alias("node"),
            (F.col("level") + F.col("value").isNotNull().cast("int")).alias("level"),
            F.when(F.col("level") == 0, F.col("key")).otherwise(F.col("section")).alias("section"),
        )
    size = F.size(F.try_variant_get("node", "$", "array<variant>"))
    entries = (
        F.when(F.col("level") > depth_cap, 1)
        .when(size >= 0, size)
        .when(F.schema_of_variant("node") == "OBJECT<>", 0)
        .otherwise(1)
    )
    return rows.withColumn("entries", entries).drop("node", "level")


def coverage(docs: DataFrame, category: str = "category", doc: str = "doc") -> DataFrame:
    """A15, K5. Sections (keys not starting with ``_``), entries, metadata flag per category; the documents are opened once."""
    per_section = count_entries(docs, category, doc).groupBy(F.col(category).alias("category"), "section").agg(F.sum("entries").alias("entries"))
    return per_section.groupBy("category").agg(
        F.count_if(~F.startswith("section", F.lit("_"))).alias("section_count"), F.sum("entries").alias("total_entries"),
        F.coalesce(F.bool_or(F.col("section") == "metadata"), F.lit(False)).alias("has_metadata"),
    )


def coverage_score(leaves: DataFrame, required: list[str], min_chars: int = 4) -> DataFrame:
    """A15. 60 points for categories with any leaf in a section, up to 40 for index terms; A19 counts the terms. One pass over the leaves."""
    in_section = F.col("category").isin(required) & F.startswith("path", F.concat(F.col("category"), F.lit(".")))
    filled = F.when(in_section, F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("name"))))
    terms = F.when(F.col("is_text"), F.transform(F.array_distinct(leaf_terms(F.col("node"), min_chars)), lambda t: F.struct(F.lit("term").alias("kind"), t.alias("name"))))
    empty = F.array().cast("array<struct<kind:string,name:string>>")
    found = leaves.select(F.inline(F.concat(F.coalesce(filled, empty), F.coalesce(terms, empty)))).distinct()
    both = found.agg(F.count_if(F.col("kind") == "category").alias("present"), F.count_if(F.col("kind") == "term").alias("total_terms"))
    score = F.col("present") / len(required) * 60 + F.least(F.lit(40.0), F.col("total_terms") / 100)
    return both.select("present", "total_terms", F.round(score, 1).alias("coverage_score"))


def place_entries(new: DataFrame, known: DataFrame) -> DataFrame:
    """K6. The section a new entry goes to: its category's default, or the top level without it.

    ``known`` is the output of ``sections``; the top level is an empty section name.
    """
    pairs = [F.lit(x) for pair in CATEGORY_SECTIONS.items() for x in pair]
    wanted = new.withColumn("section", F.create_map(*pairs)[F.col("category")])
    found = known.select("category", "section", F.lit(True).alias("_found")).distinct()
    return wanted.join(found, ["category", "section"], "left").withColumn(
        "section", F.when(F.col("_found"), F.col("section")).otherwise("")
    ).drop("_found")


def of_categories(rows: DataFrame, known: list[str] | DataFrame | None, how: str) -> DataFrame:
    """Rows of known categories (left_semi) or of others (left_anti); ``known`` is a list, a table with the column category, or the six of the knowledge base."""
    if isinstance(known, DataFrame):
        return rows.join(known.select("category").distinct(), "category", how)
    listed = F.coalesce(F.col("category").isin(known or list(CATEGORY_SECTIONS)), F.lit(False))
    return rows.filter(listed if how == "left_semi" else ~listed)


def upsert(base: DataFrame, new: DataFrame, known: list[str] | DataFrame | None = None, keep_seq: bool = False) -> DataFrame:
    """K6, K7. Latest entry per (category, section, key) of base and new rows, by ``added``.

    Both have (category, section, key, entry, source, added, seq); ``seq`` breaks ties. Entries
    of unknown categories are rejected. Copies of one key combine on the map side. ``versions`` counts rows, or those that
    a row of ``base`` stands for. ``sources.snapshots`` writes the result.
    """
    counted = [df if "versions" in df.columns else df.withColumn("versions", F.lit(1).cast("bigint")) for df in (base, of_categories(new, known, "left_semi"))]
    last = F.max_by(F.struct("entry", "source", "added", "seq"), F.struct("added", "seq"))
    merged = counted[0].unionByName(counted[1]).groupBy("category", "section", "key").agg(last.alias("e"), F.sum("versions").alias("versions"))
    return merged.select("category", "section", "key", "e.entry", "e.source", "e.added", *(["e.seq"] if keep_seq else []), "versions")


def rejected(new: DataFrame, known: list[str] | DataFrame | None = None) -> DataFrame:
    """K6. Rows of categories that do not exist."""
    return of_categories(new, known, "left_anti")


def manual_entry(value: Column, source: Column, added: Column) -> Column:
    """K6. Entry text: an object keeps its fields, another value is put under ``value``."""
    meta = F.to_json(F.struct(F.struct(source.alias("source"), added.cast("string").alias("added")).alias("_metadata")))
    head = F.substring_index(meta, "}", 1)
    is_object = F.startswith(F.ltrim(value), F.lit("{"))
    inner = F.when(is_object, F.regexp_replace(value, r"^\s*\{(.*)\}\s*$", "$1")).otherwise(
        F.concat(F.lit('"value":'), F.coalesce(value, F.lit("null")))
    )
    return F.concat(head, F.lit("}"), F.when(inner == "", "").otherwise(F.concat(F.lit(","), inner)), F.lit("}"))


def extraction_entry(answer: Column, query: Column, extracted: Column, shown: int = 2000) -> Column:
    """K7, W9. The description shows the first ``shown`` characters, the content is whole."""
    return F.to_json(
        F.struct(
            query.alias("_query"), extracted.cast("string").alias("_extracted_at"),
            cut(answer, shown).alias("description"), answer.alias("full_content"),
        )
    )


def refresh_metadata(base: DataFrame, new: DataFrame) -> DataFrame:
    """K6, K7. Per category: newest update and how many extractions came with it."""
    updates = new.groupBy("category").agg(F.max("added").alias("updated"), F.count(F.lit(1)).alias("n"))
    return base.join(updates, "category", "left").select(
        "category", F.greatest("last_updated", "updated").alias("last_updated"),
        (F.coalesce("live_extractions", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("live_extractions"),
    )


def extraction_counts(answers: DataFrame) -> DataFrame:
    """K8. Success and failure per category; a blank answer failed."""
    ok = F.coalesce(F.col("answer"), F.lit("")) != ""
    return answers.groupBy("category").agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))

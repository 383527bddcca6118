"""The registered queries: each reads whole tables under ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerloom.fixed import alarms, scenarios
from answerloom.fixed.rules import TOPIC_TARGETS
from answerloom.functions import checks, facts, parse, prompts, scores
from answerloom.operators import (
    curate, evaluate, generate, knowledge, monitor, requests, respond, validate,
)
from answerloom.operators.reports import score_summary, top_counts
from answerloom.plans import datasets, inputs
from answerloom.session import work_folder
from answerloom.sources import files, schemas, snapshots
from answerloom.streaming import service

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def listed(c: Column) -> Column:
    return F.array_join(c, "|")


def real(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def whole(c: Column) -> Column:
    return c.cast("bigint")


def sample_digest(spark: SparkSession, d: str) -> DataFrame:
    return inputs.with_metadata(curate.digest_turns(inputs.turns(spark, d)))


# --- curation ---------------------------------------------------------------------------------


@query
def curate_statistics(spark, d):
    """W1, P2, A1 end to end: conversations to the statistics of the cleaned set."""
    digest = curate.digest_turns(inputs.turns(spark, d))
    unique = curate.deduplicate(digest, F.col("first_print"), "sample_id")
    stats = curate.dataset_stats(curate.validate_samples(unique))
    return stats.select(
        whole(F.col("total")).alias("total"),
        *[real(F.col(c)).alias(c) for c in ("think_block_rate", "avg_response_chars", "avg_reasoning_steps")],
    )


@query
def p1_message_pickers(spark, d):
    picked = curate.pick_turns(inputs.turns(spark, d))
    return picked.select(
        "sample_id", F.md5("first_content").alias("first_md5"), F.md5("last_content").alias("last_md5"),
        F.md5("assistant_content").alias("assistant_md5"), "has_user",
    )


@query
def p1_sample_digest(spark, d):
    """What the curation rules read of a sample; its texts stay where they are."""
    digest = curate.digest_turns(inputs.turns(spark, d))
    return digest.select(
        "sample_id", whole(F.col("n_messages")).alias("n_messages"), "has_user", F.md5("first_print").alias("print_md5"),
        "first_given", *[whole(F.col(c)).alias(c) for c in ("last_chars", "steps", "citations", "total_chars")], "thinks",
    )


@query
def p2_valid_samples(spark, d):
    return curate.count_valid(curate.digest_turns(inputs.turns(spark, d)))


@query
def p3_first_rows(spark, d):
    docs = inputs.table(spark, d, "documents").select("doc_id", "source", "lang")
    return curate.first_rows(docs, 20, "doc_id")


@query
def a1_dataset_stats(spark, d):
    stats = curate.dataset_stats(sample_digest(spark, d))
    return stats.select(
        whole(F.col("total")).alias("total"),
        *[real(F.col(c)).alias(c) for c in ("think_block_rate", "avg_response_chars", "avg_reasoning_steps")],
    )


@query
def a2_types(spark, d):
    return curate.count_by_type(sample_digest(spark, d))


@query
def w1_deduplicate(spark, d):
    docs = inputs.table(spark, d, "documents").select("doc_id", "source", "text")
    return curate.deduplicate(docs, F.col("text"), "doc_id").select("doc_id", "source")


@query
def w1_duplicate_groups(spark, d):
    docs = inputs.table(spark, d, "documents")
    groups = curate.duplicate_groups(docs, F.col("text"), "doc_id")
    return groups.select(F.col("_fp").alias("fingerprint"), F.col("_keep").alias("kept"), F.col("_n").alias("copies"))


@query
def w2_split_stratified(spark, d):
    docs = inputs.table(spark, d, "documents").select("doc_id", "source")
    return curate.split_stratified(docs, "doc_id", F.col("source")).select("doc_id", "source", "split")


@query
def w2_split_samples(spark, d):
    split = curate.split_stratified(sample_digest(spark, d), "sample_id", curate.stratum_of(), seed=7)
    return split.groupBy(curate.stratum_of().alias("stratum"), "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id")
    )


@query
def w3_split_random(spark, d):
    docs = inputs.table(spark, d, "documents").select("doc_id")
    return curate.split_random(docs, "doc_id", seed=11).select("doc_id", "split")


@query
def w4_seeded_sample(spark, d):
    docs = inputs.table(spark, d, "documents").select("doc_id", "source")
    return curate.seeded_sample(docs, "doc_id", 128)


@query
def w8_seeded_shuffle(spark, d):
    orders = inputs.table(spark, d, "orders").select("o_orderkey")
    return curate.shuffled(orders, "o_orderkey").select(
        "o_orderkey", curate.seeded_order(42, F.col("o_orderkey")).alias("order_key")
    )


@query
def a17_dataset_gates(spark, d):
    gates = curate.dataset_gates(sample_digest(spark, d))
    return gates.withColumn("duplicate_ratio", real(F.col("duplicate_ratio")))


@query
def a20_plan_vs_actual(spark, d):
    names = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("topic")) for k, t, _ in TOPIC_TARGETS])
    topic = names[(F.col("doc_id") % 9).cast("int")]
    docs = inputs.table(spark, d, "documents").select(topic["kind"].alias("kind"), topic["topic"].alias("topic"))
    return curate.plan_vs_actual(docs, curate.topic_targets(spark))


# --- response parsing and scores ----------------------------------------------------------------


def parsed(spark: SparkSession, d: str, flavor: str) -> DataFrame:
    return parse.parse_responses(inputs.responses(spark, d), flavor)


def parse_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "conv_id", "turn", F.md5("reasoning").alias("reasoning_md5"), F.md5("answer").alias("answer_md5"),
        listed(F.col("sources")).alias("sources"), "has_think_block",
        whole(F.col("reasoning_steps")).alias("reasoning_steps"),
    )


@query
def r1_parse_basic(spark, d):
    return parse_columns(parsed(spark, d, "basic"))


@query
def r2_parse_strict(spark, d):
    return parse_columns(parsed(spark, d, "strict"))


@query
def r3_parse_suite(spark, d):
    return parse_columns(parsed(spark, d, "suite"))


@query
def r4_confidence_strict(spark, d):
    scored = scores.with_confidence_strict(parsed(spark, d, "strict"))
    return scored.select("conv_id", "turn", real(F.col("confidence")).alias("confidence"))


@query
def r5_confidence_suite(spark, d):
    scored = scores.with_confidence_suite(parsed(spark, d, "suite"))
    return scored.select("conv_id", "turn", real(F.col("confidence")).alias("confidence"))


@query
def r6_reasoning_score(spark, d):
    scored = scores.with_reasoning_score(inputs.responses(spark, d), F.col("raw"))
    return scored.select("conv_id", "turn", real(F.col("reasoning_score")).alias("score"))


@query
def r8_source_attribution(spark, d):
    found = scores.source_attribution(inputs.responses(spark, d), "raw")
    return found.select(
        "conv_id", "turn", listed(F.col("domains_cited")).alias("domains"),
        whole(F.col("citation_count")).alias("citations"), listed(F.col("compliance_versions")).alias("versions"),
    )


@query
def r9_claim_alignment(spark, d):
    found = scores.claim_alignment(inputs.responses(spark, d), "raw")
    return found.select(
        "conv_id", "turn", whole(F.col("applicable")).alias("applicable"),
        whole(F.col("aligned")).alias("aligned"), listed(F.col("failed_claims")).alias("failed"),
        real(F.col("claim_score")).alias("score"),
    )


@query
def r10_alignment_score(spark, d):
    scored = scores.alignment_score(inputs.responses(spark, d), "raw")
    return scored.select("conv_id", "turn", real(F.col("alignment_score")).alias("score"))


@query
def r11_technical_facts(spark, d):
    checked = facts.check_facts(inputs.responses(spark, d), "raw", "category")
    return checked.select(
        "conv_id", "turn", "category", whole(F.col("num_checked")).alias("num_checked"),
        listed(F.col("failed_facts")).alias("failed"), real(F.col("fact_score")).alias("score"),
    )


@query
def r11_facts_on_documents(spark, d):
    """Facts over whole documents, no category."""
    checked = facts.check_facts(inputs.table(spark, d, "documents").select("doc_id", "text"), "text")
    return checked.select(
        "doc_id", listed(F.col("failed_facts")).alias("failed"), real(F.col("fact_score")).alias("score")
    )


@query
def r13_config_syntax(spark, d):
    rows = inputs.responses(spark, d)
    return rows.select("conv_id", "turn", facts.config_syntax_ok(F.col("raw")).alias("ok"))


@query
def r23_extract_cost(spark, d):
    c = F.col("raw")
    rows = inputs.responses(spark, d).select(
        "conv_id", "turn", parse.extract_cost(c, "api").alias("api"), parse.extract_cost(c, "agent").alias("agent")
    )
    return rows.select(
        "conv_id", "turn", F.col("api.capex").alias("api_capex"), F.col("api.annual_opex").alias("api_opex"),
        F.col("agent.capex").alias("agent_capex"), F.col("agent.annual_opex").alias("agent_opex"),
        F.col("agent").isNotNull().alias("agent_found"),
    )


@query
def r24_remediation_steps(spark, d):
    rows = inputs.responses(spark, d)
    steps = parse.remediation_steps(F.col("raw"))
    return rows.select("conv_id", "turn", F.posexplode(steps).alias("step", "text")).select(
        "conv_id", "turn", whole(F.col("step")).alias("step"), F.md5("text").alias("text_md5")
    )


def judge_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Judge texts of six shapes, one per event."""
    value, k = F.col("value").cast("string"), F.col("event_id") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit('{"score": '), value, F.lit(', "rationale": "fine"}')))
        .when(k == 1, F.concat(F.lit('Verdict: {"score" : '), (F.col("event_id") % 5 + 1).cast("string"), F.lit(".5, broken")))
        .when(k == 2, F.lit("no score at all"))
        .when(k == 3, F.lit('{"rationale": "score left out"}'))
        .when(k == 4, F.lit('{"score": "high"}'))
        .otherwise(F.concat(F.lit('{"score": "'), (F.col("event_id") % 7).cast("string"), F.lit('"}')))
    )
    return inputs.table(spark, d, "events").select("event_id", raw.alias("raw"))


@query
def r25_parse_judgement(spark, d):
    rows = judge_outputs(spark, d).select("event_id", parse.parse_judgement(F.col("raw")).alias("j"))
    return rows.select("event_id", real(F.col("j.score")).alias("score"), F.col("j.rationale").alias("rationale"))


@query
def a9_judge_report(spark, d):
    rows = judge_outputs(spark, d).select(parse.parse_judgement(F.col("raw"))["score"].alias("score"))
    report = evaluate.judge_report(rows)
    return report.withColumn("avg_score", real(F.col("avg_score")))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Parsed responses with the turn before them as their question."""
    turns = inputs.table(spark, d, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = turns.select("conv_id", "turn", F.coalesce(before, F.lit("")).alias("question"))
    return parsed(spark, d, "basic").join(asked, ["conv_id", "turn"], "left")


@query
def x3_w9_judge_forms(spark, d):
    """What a judge would read of every response, in the lengths its form shows."""
    form = respond.judge_form(F.col("question"), F.col("reasoning"), F.col("answer"))
    return questions(spark, d).select("conv_id", "turn", F.md5(form).alias("form_md5"), whole(F.length(form)).alias("chars"))


@query
def x3_judged_responses(spark, d):
    """Responses with their recorded judgements; of every fourth form length none is recorded, of every other fourth the judge failed."""
    rows = questions(spark, d)
    form = respond.judge_form(F.col("question"), F.col("reasoning"), F.col("answer"))
    n = F.length("form")
    said = F.concat(F.lit('{"score": '), (1 + n % 9 / 2).cast("string"), F.lit(', "rationale": "form of '), n.cast("string"), F.lit('"}'))
    recorded = rows.select(form.alias("form")).distinct().filter(n % 4 != 0).select(
        respond.prompt_key(F.col("form")).alias("prompt_key"), F.when(n % 4 != 1, said).alias("raw"), F.lit(None).cast("double").alias("latency_ms"),
        F.when(n % 4 == 1, "judge was away").alias("error"),
    )
    judged = respond.judge(rows, recorded=recorded, question="question")
    return judged.select("conv_id", "turn", "score", "rationale", "judge_error")


@query
def r26_chat_template(spark, d):
    pieces = prompts.chat_pieces(inputs.table(spark, d, "conversations"))
    return pieces.select("conv_id", "position", F.md5("piece").alias("piece_md5"))


def chat_samples(spark: SparkSession, d: str) -> DataFrame:
    """One sample per document: its source asks, its text answers; every third has a system message, every fifth is open."""
    docs, k = inputs.table(spark, d, "documents"), F.col("doc_id")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    system = F.when(k % 3 == 0, F.array(turn("system", F.col("lang")))).otherwise(none)
    said = F.when(k % 5 == 0, none).otherwise(F.array(turn("assistant", F.coalesce("text", F.lit("")))))
    return docs.select("doc_id", F.concat(F.array(turn("user", F.col("source"))), said, system).alias("messages"))


@query
def r26_rendered_samples(spark, d):
    """Whole samples as the text a model is trained on."""
    rows = chat_samples(spark, d).select("doc_id", prompts.chat_template(F.col("messages")).alias("rendered"))
    return rows.select("doc_id", F.md5("rendered").alias("rendered_md5"), whole(F.length("rendered")).alias("chars"))


@query
def w4_calibration_texts(spark, d):
    """The seeded calibration sample as rendered texts; samples are drawn before they are rendered."""
    drawn = curate.seeded_sample(chat_samples(spark, d), "doc_id", 128)
    return drawn.select("doc_id", prompts.chat_template(F.col("messages")).alias("rendered"))


@query
def r28_span_weights(spark, d):
    rows = inputs.responses(spark, d).select("conv_id", "turn", prompts.span_weights(F.col("raw")).alias("w"))
    return rows.select("conv_id", "turn", F.col("w.tokens").alias("tokens"), real(F.col("w.weight")).alias("weight"))


# --- sample validation --------------------------------------------------------------------------


@query
def r14_r16_sample_checks(spark, d):
    checked = validate.validate(sample_digest(spark, d))
    return checked.select("sample_id", F.inline("checks")).select("sample_id", "name", "passed", "message")


@query
def r14_r16_strict_checks(spark, d):
    checked = validate.validate(sample_digest(spark, d), strict=True)
    return checked.select("sample_id", F.inline("checks")).select("sample_id", "name", "passed")


@query
def r17_validate_samples(spark, d):
    checked = validate.validate(sample_digest(spark, d))
    return checked.select(
        "sample_id", real(F.col("score")).alias("score"), "passed",
        whole(F.size("errors")).alias("errors"), whole(F.size("warnings")).alias("warnings"),
    )


@query
def a3_validation_report(spark, d):
    report = validate.validation_report(validate.validate(sample_digest(spark, d)))
    return report.withColumn("average_score", real(F.col("average_score")))


@query
def a18_pass_rate_gate(spark, d):
    gate = validate.passes_rate_gate(validate.validation_report(validate.validate(sample_digest(spark, d))))
    return gate.withColumn("pass_rate", real(F.col("pass_rate")))


@query
def a4_check_rates(spark, d):
    rates = validate.check_rates(validate.validate(sample_digest(spark, d)))
    return rates.withColumn("pass_rate", real(F.col("pass_rate")))


@query
def p8_recommendations(spark, d):
    return validate.recommendations(validate.check_rates(validate.validate(sample_digest(spark, d))))


@query
def a5_frequent_errors(spark, d):
    return validate.frequent_errors(validate.validate(sample_digest(spark, d)))


@query
def r18_r21_accuracy_checks(spark, d):
    checked = validate.check_accuracy(sample_digest(spark, d))
    return checked.select("sample_id", F.posexplode("accuracy_checks").alias("pos", "c")).select(
        "sample_id", F.col("c.name").alias("name"), F.col("c.passed").alias("passed"),
        F.col("c.severity").alias("severity"), F.col("c.message").alias("message"),
        F.col("c.evidence").alias("evidence"),
    )


@query
def r19_public_addresses(spark, d):
    """Every public IPv4 occurrence in the documents."""
    docs = inputs.table(spark, d, "documents")
    return docs.select("doc_id", F.inline(checks.address_checks(checks.public_addresses(F.col("text"))))).select("doc_id", "name", "evidence")


@query
def r22_accuracy_scores(spark, d):
    checked = validate.check_accuracy(sample_digest(spark, d))
    return checked.select(
        "sample_id", real(F.col("accuracy_score")).alias("score"), whole(F.col("critical_failures")).alias("critical")
    )


@query
def a6_accuracy_report(spark, d):
    report = validate.accuracy_report(validate.check_accuracy(sample_digest(spark, d)))
    return report.withColumn("average_accuracy_score", real(F.col("average_accuracy_score")))


# --- evaluation ---------------------------------------------------------------------------------


def scored_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every response is an answer to the case its conversation number falls on."""
    n_cases = inputs.table(spark, d, "benchmark").agg(F.count(F.lit(1)).alias("n")).scalar()
    numbered = inputs.responses(spark, d).withColumn("case_id", F.col("conv_id") % n_cases)
    return datasets.score_suite(numbered, inputs.test_cases(spark, d))


@query
def j1_r7_keyword_scores(spark, d):
    return scored_cases(spark, d).select(
        "conv_id", "turn", "case_id", listed(F.col("keywords_found")).alias("found"),
        listed(F.col("keywords_missing")).alias("missing"), listed(F.col("sources_found")).alias("sources"),
        real(F.col("keyword_score")).alias("keyword_score"), real(F.col("source_score")).alias("source_score"),
        F.col("overall_score"), "pass_fail",
    )


@query
def a12_quality_report(spark, d):
    report = evaluate.quality_report(scored_cases(spark, d), "case_category")
    names = ("avg_score", "avg_keyword", "avg_confidence", "avg_latency_ms", "think_rate")
    return report.select(
        "category", "is_total", "cases", *[real(F.col(n)).alias(n) for n in names], "passes", "warns", "fails"
    )


@query
def a13_missing_keywords(spark, d):
    return evaluate.missing_keywords(scored_cases(spark, d))


def judged_responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses with a recorded judgement each."""
    verdict = F.concat(F.lit('{"score": '), (F.col("turn") % 6).cast("string"), F.lit("}"))
    return inputs.responses(spark, d).withColumn("judge_score", parse.parse_judgement(verdict)["score"])


@query
def a7_fact_report(spark, d):
    report = score_summary(facts.check_facts(inputs.responses(spark, d), "raw", "category"), "fact_score")
    return report.select(F.col("num_samples"), *[real(F.col(c)).alias(c) for c in ("avg_score", "min_score", "max_score")])


@query
def a7_failed_facts(spark, d):
    return top_counts(facts.check_facts(inputs.responses(spark, d), "raw", "category"), "failed_facts", 10, "fact")


@query
def a8_alignment_report(spark, d):
    report = score_summary(scores.alignment_score(inputs.responses(spark, d), "raw"), "alignment_score")
    return report.select(F.col("num_samples"), *[real(F.col(c)).alias(c) for c in ("avg_score", "min_score", "max_score")])


@query
def a8_failed_claims(spark, d):
    return top_counts(scores.claim_alignment(inputs.responses(spark, d), "raw"), "failed_claims", 5, "claim")


@query
def a10_reasoning_report(spark, d):
    rows = scores.with_reasoning_score(inputs.responses(spark, d), F.col("raw"))
    report = score_summary(rows, "reasoning_score")
    return report.select(F.col("num_samples"), *[real(F.col(c)).alias(c) for c in ("avg_score", "min_score", "max_score")])


def batch_answers(spark: SparkSession, d: str) -> DataFrame:
    """User turns as prompts; the recorded answer is the next assistant turn, a few prompts are blank."""
    asked = inputs.table(spark, d, "conversations").filter("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("general").alias("category"),
        F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "").otherwise(F.col("text")).alias("prompt"),
        "conv_id", (F.col("turn") + 1).alias("turn"),
    )
    answers = inputs.responses(spark, d).select("conv_id", "turn", "raw", "latency_ms")
    joined = asked.join(answers, ["conv_id", "turn"], "left")
    return joined.withColumn("error", F.when(F.col("raw").isNull(), "no recorded answer"))


@query
def s8_u2_batch_records(spark, d):
    """Records written as lines, absent fields left out, and read back."""
    path = work_folder(spark)
    records = respond.batch_records(batch_answers(spark, d))
    files.write_batch(records, path)
    return spark.read.schema(records.schema).json(path).select(
        "id", F.md5("prompt").alias("prompt_md5"), F.md5("answer").alias("answer_md5"), "error",
        real(F.col("latency_ms")).alias("latency_ms"), "has_think_block",
        whole(F.col("reasoning_steps")).alias("reasoning_steps"),
    )


@query
def a11_batch_stats(spark, d):
    answered = batch_answers(spark, d)
    rows = answered.withColumn("has_think_block", F.col("raw").rlike(parse.THINK))
    stats = evaluate.batch_stats(rows)
    names = ("avg_latency_ms", "min_latency_ms", "max_latency_ms", "think_block_rate")
    return stats.select("total", "completed", "failed", *[real(F.col(n)).alias(n) for n in names])


@query
def a14_evaluation_metrics(spark, d):
    scored = datasets.evaluate_responses(judged_responses(spark, d))
    long = evaluate.metrics_long(evaluate.evaluation_metrics(scored))
    return long.select("metric", real(F.col("value")).alias("value"))


@query
def q1_gates(spark, d):
    gates = datasets.gate_report(judged_responses(spark, d))
    return gates.withColumn("value", real(F.col("value")))


@query
def q1_overall(spark, d):
    return evaluate.overall_pass(datasets.gate_report(judged_responses(spark, d)))


# --- generation ---------------------------------------------------------------------------------


def order_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys that scenarios are made of, dealt evenly: much work follows from a small row."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return inputs.table(spark, d, "orders").select("o_orderkey").repartition(width, "o_orderkey")


def design_rows(spark: SparkSession, d: str) -> DataFrame:
    return generate.design_scenarios(order_keys(spark, d), "o_orderkey")


def fault_rows(spark: SparkSession, d: str) -> DataFrame:
    return generate.fault_scenarios(order_keys(spark, d), "o_orderkey")


@query
def g1_design_scenarios(spark, d):
    return design_rows(spark, d).withColumn("compliance", listed(F.col("compliance")))


@query
def g2_fault_scenarios(spark, d):
    return fault_rows(spark, d).withColumn("symptoms", listed(F.col("symptoms")))


@query
def g3_plan_kinds(spark, d):
    return generate.plan_kinds(inputs.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query
def g4_design_questions(spark, d):
    return design_rows(spark, d).select("o_orderkey", generate.design_question(F.col("o_orderkey")).alias("question"))


@query
def g4_fault_questions(spark, d):
    return fault_rows(spark, d).select("o_orderkey", generate.fault_question(F.col("o_orderkey")).alias("question"))


@query
def g5_g9_choices(spark, d):
    """Scale, topology, WAN type, WAN size and cost of every service request."""
    r = inputs.requests(spark, d).withColumn("users", F.col("users").cast("bigint"))
    users, sites = F.col("users"), F.col("sites").cast("bigint")
    rows = r.select(
        "req_id", generate.scale_label(users).alias("scale"),
        generate.select_topology(users, F.col("req_id") % 7 == 0).alias("topology"),
        generate.select_wan(sites, F.col("req_id") % 3 == 0, F.col("compliance")).alias("wan"),
        generate.wan_sizing(users, sites).alias("w"), generate.cost_model(users, F.col("compliance")).alias("c"),
    )
    return rows.select(
        "req_id", "scale", "topology", "wan", "w.users_per_site", "w.mbps", "w.recommended",
        "c.per_user", "c.base_capex", real(F.col("c.multiplier")).alias("multiplier"), "c.capex", "c.opex", "c.tco",
    )


@query
def j6_cost_benchmark(spark, d):
    """Benchmark looked up by join, default where the label is missing."""
    r = inputs.requests(spark, d).select("req_id", F.col("users").cast("bigint").alias("users"), "compliance")
    known = [(k, v) for k, v in scenarios.CAPEX_PER_USER.items() if k != "enterprise"]
    table = spark.createDataFrame(known, "scale string, typical string")
    joined = r.withColumn("scale", generate.scale_label(F.col("users"))).join(table, "scale", "left")
    cost = generate.cost_model(F.col("users"), F.col("compliance"), F.col("typical"))
    return joined.select("req_id", "scale", "typical", cost["capex"].alias("capex"))


@query
def g11_design_chains(spark, d):
    rows = generate.with_design_chain(design_rows(spark, d))
    return rows.select(
        "o_orderkey", whole(F.size("chain")).alias("steps"),
        F.md5(generate.render_chain(F.col("chain"))).alias("think_md5"),
    )


@query
def g12_fault_chains(spark, d):
    rows = generate.with_fault_chain(fault_rows(spark, d), generate.diagnostic_routes(spark))
    return rows.select(
        "o_orderkey", whole(F.size("chain")).alias("steps"),
        F.md5(generate.render_chain(F.col("chain"))).alias("think_md5"),
    )


def assembled(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of samples; the supplied answer is a short note on the order, some are blank."""
    kinds = generate.plan_kinds(order_keys(spark, d), "o_orderkey")
    note = F.when(F.col("o_orderkey") % 13 != 0, F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).otherwise("")
    answers = inputs.table(spark, d, "orders").select("o_orderkey", note.alias("answer"))
    rows = generate.generated_rows(kinds, "o_orderkey", generate.diagnostic_routes(spark))
    return generate.assemble_samples(rows, answers, "o_orderkey")


@query
def g14_u1_assembled_samples(spark, d):
    return assembled(spark, d).select(
        "o_orderkey", "kind", "status", F.md5(F.col("messages")[0]["content"]).alias("question_md5"),
        F.md5(F.col("messages")[1]["content"]).alias("answer_md5"),
        F.col("metadata.reasoning_steps").cast("bigint").alias("reasoning_steps"),
        F.col("metadata.sources_used")[0].alias("first_source"),
    )


#: What curation and the counts read of a digest.
CURATED = (
    "sample_id", "first_print", "first_given", "n_messages", "last_chars", "steps", "total_chars", "type", "user_count", "compliance", "reasoning_steps",
)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, for rows that cost much to make and are read more than once."""
    folder = work_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


@query
def g14_curated_samples(spark, d):
    """Generated samples go through curation as they are: deduplicated, filtered, counted by type."""
    samples = assembled(spark, d).filter("status = 'ok'")
    digest = stored(curate.digest_messages(samples, "o_orderkey").select(*CURATED))
    kept = curate.validate_samples(curate.deduplicate(digest, F.col("first_print"), "sample_id"))
    return kept.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_chars").alias("chars"), F.sum(whole(F.col("steps"))).alias("steps"),
        F.sum("reasoning_steps").alias("reasoning_steps"), F.sum("user_count").alias("users"), F.count("compliance").alias("with_scenario"),
    )


@query
def a16_generation_stats(spark, d):
    return generate.generation_stats(assembled(spark, d))


# --- requests -----------------------------------------------------------------------------------


@query
def p5_validate_requests(spark, d):
    checked = requests.validate_requests(inputs.raw_requests(spark, d), required=("symptom",))
    return checked.select(
        "req_id", whole(F.col("users")).alias("users"), whole(F.col("sites")).alias("sites"), listed(F.col("compliance")).alias("compliance"),
        "uptime", whole(F.col("max_tokens")).alias("max_tokens"), real(F.col("temperature")).alias("temperature"),
        "currency", listed(F.col("violations")).alias("violations"),
    )


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    r = inputs.requests(spark, d)
    confidence = (F.col("req_id") % 41) / 40
    priority = F.when(F.col("priority_code") == "1", "high").when(F.col("priority_code") == "5", "low")
    return r.select("*", confidence.alias("confidence"), priority.alias("priority"))


@query
def p6_review_rules(spark, d):
    c, s, u = F.col("confidence"), F.col("compliance"), F.col("uptime")
    return reviewed(spark, d).select(
        "req_id", requests.api_requires_review(c, s, u).alias("api"),
        requests.agent_requires_review(c, F.col("priority"), s).alias("agent"),
        requests.policy_requires_review(c, s, u).alias("policy"),
    )


@query
def p7_approval_routing(spark, d):
    rows = reviewed(spark, d).select(
        "req_id", "confidence",
        requests.agent_requires_review(F.col("confidence"), F.col("priority"), F.col("compliance")).alias("requires_approval"),
        F.when(F.col("status") == "P", "device lost").alias("error"),
    )
    routed = requests.route(requests.with_error_policy(rows))
    return routed.groupBy("queue", "status").agg(
        F.count(F.lit(1)).alias("n"), real(F.sum("confidence")).alias("confidence")
    )


@query
def p9_normalize_tasks(spark, d):
    tasks = requests.normalize_tasks(inputs.task_messages(spark, d))
    return tasks.select("req_id", "task_id", "type", "context", "priority", "requestor", "correlation_id", "error")


@query
def r30_task_prompts(spark, d):
    tasks = requests.task_prompt(requests.normalize_tasks(inputs.task_messages(spark, d)))
    named = requests.task_compliance(F.col("context"))
    return tasks.select("req_id", "type", F.md5("prompt").alias("prompt_md5"), listed(named).alias("compliance"))


def prompt_fields(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    r, k = inputs.requests(spark, d), F.col("req_id")
    fields = {
        "users": F.when(k % 8 != 0, F.col("users")), "sites": F.col("sites"), "compliance": F.col("compliance"),
        "uptime": F.col("uptime"), "budget": F.lit("moderate"), "data_center": k % 2 == 0, "wireless": k % 3 == 0,
        "wan_type": F.when(k % 5 == 0, "MPLS"), "cloud_connectivity": k % 4 == 0, "redundancy_level": F.lit("N+2"),
        "extras": F.create_map(F.lit("racks"), (k % 10).cast("string"), F.lit("order"), F.col("status")),
        "device": F.concat(F.lit("r"), F.col("sites").cast("string")), "symptom": F.concat(F.lit("status "), F.col("status")),
        "protocol": F.when(k % 3 == 0, "BGP"), "logs": F.when(k % 2 == 0, F.repeat(F.col("status"), 700)),
        "currency": F.lit("EUR"), "include_opex": k % 2 == 0,
    }
    return r, fields


@query
def r30_w9_request_prompts(spark, d):
    r, f = prompt_fields(spark, d)
    return r.select(
        "req_id",
        F.md5(prompts.design_prompt(f, "api")).alias("design_api"),
        F.md5(prompts.design_prompt(f, "tool")).alias("design_tool"),
        F.md5(prompts.troubleshoot_prompt(f, "api")).alias("troubleshoot_api"),
        F.md5(prompts.troubleshoot_prompt(f, "tool")).alias("troubleshoot_tool"),
        F.md5(prompts.estimate_prompt(f, "api")).alias("estimate_api"),
        F.md5(prompts.estimate_prompt(f, "tool")).alias("estimate_tool"),
    )


@query
def r27_r31_cache_keys(spark, d):
    docs = inputs.table(spark, d, "documents")
    system = F.concat(F.lit("Answer in "), F.col("lang"))
    return docs.select(
        "doc_id", F.md5(prompts.single_turn_prompt(system, F.col("text"))).alias("prompt_md5"),
        prompts.cache_key(system, F.col("text")).alias("cache_key"),
    )


@query
def r29_downtime(spark, d):
    return inputs.requests(spark, d).select("req_id", "uptime", prompts.downtime(F.col("uptime")).alias("downtime"))


# --- knowledge ----------------------------------------------------------------------------------


def leaves(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.flatten(inputs.knowledge_documents(spark, d))


def postings(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.build_index(leaves(spark, d))


TOPIC = "The nation, (user) AFRICA; estion or one"


@query
def k1_flatten(spark, d):
    rows = leaves(spark, d)
    return rows.select("category", "doc_no", "path", F.md5(knowledge.leaf_text(F.col("node"))).alias("value_md5"), "is_text")


_INDEXES: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of the documents under ``d``, written at the first search of an application and read by all."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        folder = work_folder(spark)
        knowledge.store_index(knowledge.build_index(leaves(spark, d), repeats=False), folder)
        _INDEXES[key] = folder
    return spark.read.parquet(_INDEXES[key])


@query
def k2_index_terms(spark, d):
    """A19: postings and distinct paths per term."""
    return knowledge.index_terms(postings(spark, d))


@query
def k3_j9_topic_matches(spark, d):
    return knowledge.topic_matches(stored_index(spark, d), TOPIC, ("doc_no", "path"))


@query
def k3_topic_sections(spark, d):
    known = knowledge.sections(inputs.knowledge_documents(spark, d))
    return knowledge.topic_sections(stored_index(spark, d), TOPIC, known)


@query
def k1_deep_documents(spark, d):
    """Documents nested 3 to 40 levels deep, flattened to the last one."""
    docs = inputs.nested_documents(spark, d)
    rows = knowledge.flatten(docs)
    return rows.select("category", "part", F.length("path").cast("bigint").alias("path_chars"), knowledge.leaf_text(F.col("node")).alias("leaf"), "is_text")


@query
def k4_slices(spark, d):
    """The slices of the knowledge base, from documents that hold their sections and others."""
    rows = knowledge.slice_leaves(knowledge.flatten(inputs.section_documents(spark, d)))
    return rows.groupBy("slice", "category").agg(F.count(F.lit(1)).alias("leaves"))


@query
def a15_k5_coverage(spark, d):
    return knowledge.coverage(inputs.knowledge_documents(spark, d))


@query
def a15_coverage_score(spark, d):
    required = ["AFRICA", "ASIA", "EUROPE", "click", "src0", "src999"]
    return knowledge.coverage_score(leaves(spark, d), required)


@query
def k6_upsert(spark, d):
    return knowledge.upsert(inputs.base_entries(spark, d), inputs.new_entries(spark, d))


@query
def k6_place_entries(spark, d):
    """Sections of new entries where the knowledge base has some of the default sections."""
    held = spark.createDataFrame([("design_patterns", "topology_patterns"), ("cost_benchmarks", "tco_models")], "category string, section string")
    placed = knowledge.place_entries(inputs.new_entries(spark, d), held)
    return placed.groupBy("category", "section").agg(F.count(F.lit(1)).alias("n"))


@query
def k6_rejected(spark, d):
    return knowledge.rejected(inputs.new_entries(spark, d)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query
def k7_extraction_entries(spark, d):
    """Documents as extraction answers: the latest per source and language stays."""
    docs = inputs.table(spark, d, "documents")
    entry = knowledge.extraction_entry(F.col("text"), F.col("lang"), F.col("doc_id"))
    new = docs.select(
        F.col("source").alias("category"), F.lit("live").alias("section"), F.col("lang").alias("key"),
        entry.alias("entry"), F.lit("extraction").alias("source"), (F.col("doc_id") % 97).alias("added"),
        F.col("doc_id").alias("seq"),
    )
    merged = knowledge.upsert(new.limit(0), new, docs.select(F.col("source").alias("category")))
    return merged.select(
        "category", "key", "versions", "added",
        F.length(F.get_json_object("entry", "$.description")).cast("bigint").alias("description_chars"),
        F.md5(F.get_json_object("entry", "$.full_content")).alias("content_md5"),
    )


@query
def k7_refresh_metadata(spark, d):
    base = inputs.base_entries(spark, d).groupBy("category").agg(
        F.max("added").alias("last_updated"), F.count(F.lit(1)).alias("live_extractions")
    )
    return knowledge.refresh_metadata(base, inputs.new_entries(spark, d))


@query
def k8_extraction_counts(spark, d):
    docs = inputs.table(spark, d, "documents")
    return knowledge.extraction_counts(
        docs.select(F.col("source").alias("category"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("answer"))
    )


# --- monitoring ---------------------------------------------------------------------------------


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return monitor.derive_metrics(inputs.service_events(spark, d))


def machine_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Disk and processor readings, one pair per event."""
    e = inputs.table(spark, d, "events").select(inputs.utc("ts").alias("ts"), "value")
    pair = F.array(
        F.struct(F.lit("disk_used_percent").alias("metric"), (60 + F.col("value") % 40).alias("value")),
        F.struct(F.lit("CPUUtilization").alias("metric"), (F.col("value") % 8).alias("value")),
    )
    return e.select("ts", F.inline(pair))


@query
def t2_metric_counts(spark, d):
    rows = metrics(spark, d)
    return rows.groupBy("metric", "endpoint").agg(F.count(F.lit(1)).alias("n"), real(F.sum("value")).alias("total"))


@query
def t1_metric_windows(spark, d):
    windows = monitor.metric_windows(metrics(spark, d), 300)
    return windows.select(
        "metric", "window_start", "n", "average",
        *[real(F.col(c)).alias(c) for c in ("sum", "least", "greatest")],
    )


@query
def t1_percentiles(spark, d):
    rows = monitor.metric_percentiles(metrics(spark, d), 3600, [0.5, 0.95, 0.99])
    return rows.select("metric", "window_start", *[real(F.col(c)).alias(c) for c in ("p50", "p95", "p99")])


@query
def t1_percentiles_overall(spark, d):
    """One large group per task type."""
    events = inputs.service_events(spark, d)
    rows = monitor.exact_percentiles(events, ["task_type"], "latency_ms", [0.5, 0.95, 0.99])
    return rows.select("task_type", *[real(F.col(c)).alias(c) for c in ("p50", "p95", "p99")])


@query
def t3_labelled_counts(spark, d):
    events = inputs.service_events(spark, d).withColumn("approval", F.col("confidence") < 0.8)
    return monitor.labelled_counts(events, ["task_type", "status_code", "has_think", "approval"])


@query
def t4_histograms(spark, d):
    events = inputs.service_events(spark, d)
    seconds = F.col("latency_ms") / 1000
    measured = {
        "request": (seconds, alarms.REQUEST_SECONDS_BOUNDS), "inference": (seconds, alarms.INFERENCE_SECONDS_BOUNDS),
        "confidence": (F.col("confidence"), alarms.CONFIDENCE_BOUNDS),
    }
    return monitor.histograms(events, measured, ["task_type"])


@query
def t5_histogram_quantiles(spark, d):
    rows = monitor.histogram_wide(
        inputs.service_events(spark, d), F.col("latency_ms") / 1000, alarms.INFERENCE_SECONDS_BOUNDS,
        ["task_type", monitor.window_start(F.col("ts"), 600).alias("window_start")],
    )
    return rows.select(
        "task_type", "window_start",
        *[
            real(monitor.histogram_quantile(F.col("cumulative"), alarms.INFERENCE_SECONDS_BOUNDS, q)).alias(f"q{round(q * 100)}")
            for q in (0.5, 0.95)
        ],
    )


def profile(spark: SparkSession, d: str) -> DataFrame:
    return monitor.minute_profile(
        inputs.service_events(spark, d), alarms.INFERENCE_SECONDS_BOUNDS, alarms.CONFIDENCE_BOUNDS
    )


@query
def t6_error_rate(spark, d):
    rates = monitor.error_rate(profile(spark, d))
    return rates.select("window_end", real(F.col("value")).alias("value"), (F.col("value") > 0.1).alias("high"))


@query
def t6_think_ratio(spark, d):
    return monitor.think_ratio(profile(spark, d)).select("window_end", real(F.col("value")).alias("value"))


def fired(spark: SparkSession, d: str) -> DataFrame:
    return monitor.threshold_alarms(monitor.window_statistics(metrics(spark, d)), monitor.threshold_rules(spark))


@query
def w5_j11_threshold_alarms(spark, d):
    return fired(spark, d).select(
        "alarm", "severity", "window_start", real(F.col("value")).alias("value"), whole(F.col("run")).alias("run"), "firing"
    )


@query
def t7_notifications(spark, d):
    sent = monitor.notifications(fired(spark, d).filter("firing"))
    return sent.groupBy("alarm", "severity", "channel").agg(F.count(F.lit(1)).alias("n"))


@query
def t12_machine_alarms(spark, d):
    statistics = monitor.window_statistics(machine_metrics(spark, d))
    rows = monitor.threshold_alarms(statistics, monitor.threshold_rules(spark))
    return rows.select(
        "alarm", "window_start", "value", whole(F.col("run")).alias("run"), "firing"
    )


@query
def w6_duration_alarms(spark, d):
    signals = monitor.service_signals(
        inputs.service_events(spark, d), alarms.INFERENCE_SECONDS_BOUNDS, alarms.CONFIDENCE_BOUNDS
    )
    rows = monitor.duration_alarms(signals, monitor.duration_rules(spark))
    return rows.select("alarm", "severity", "window_end", real(F.col("value")).alias("value"), "since", "state")


@query
def t11_active_requests(spark, d):
    return monitor.active_requests(inputs.service_events(spark, d)).select(
        "minute", whole(F.col("change")).alias("change"), whole(F.col("active")).alias("active")
    )


# --- files, task intake, streams ------------------------------------------------------------------


@query
def u4_merge_checks(spark, d):
    """Check rows of two passes; where both have a check, the strict pass wins."""
    digest = sample_digest(spark, d)

    def rows(strict: bool) -> DataFrame:
        return validate.validate(digest, strict).select("sample_id", F.inline("checks"))

    return validate.merge_checks(rows(False), rows(True))


@query
def s1_s2_sample_files(spark, d):
    """Documents written as sample lines among lines that are no JSON, read back by the reader."""
    docs = inputs.table(spark, d, "documents")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    line = F.to_json(
        F.struct(
            F.array(turn("user", F.col("source")), turn("assistant", F.col("text"))).alias("messages"),
            F.struct(F.col("lang").alias("type"), F.col("doc_id").cast("int").alias("reasoning_steps")).alias("metadata"),
        )
    )
    path = work_folder(spark)
    docs.select(F.explode(F.array(line, F.concat(F.lit("{"), F.col("source")), F.lit("  "))).alias("value")).write.text(path)
    good, bad = files.read_samples(spark, path)
    good = good.select(
        F.col("metadata.reasoning_steps").cast("bigint").alias("doc_id"), F.col("metadata.type").alias("lang"),
        F.md5(F.col("messages")[1]["content"]).alias("text_md5"), F.lit("sample").alias("kind"),
    )
    bad = bad.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("n").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.md5("value").alias("text_md5"),
        F.lit("rejected").alias("kind"),
    )
    return good.unionByName(bad)


@query
def s3_prompt_files(spark, d):
    """Prompts as JSON lines of two forms, one of them without an id."""
    turns = inputs.table(spark, d, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    message = F.struct(F.col("role"), F.col("text").alias("content"))
    line = F.when(F.col("role") == "user", F.to_json(F.struct(key.alias("id"), F.lit("asked").alias("category"), F.col("text").alias("prompt")))).otherwise(
        F.to_json(F.struct(key.alias("id"), F.array(message).alias("messages")))
    )
    path = work_folder(spark)
    turns.select(line.alias("value")).write.text(path)
    return files.read_prompts_json(spark, path).select("id", "category", F.md5("prompt").alias("prompt_md5"))


@query
def s4_prompt_tables(spark, d):
    """Prompts as CSV under one of the other column names, with line ends and quotes inside."""
    docs = inputs.table(spark, d, "documents")
    path = work_folder(spark)
    shown = F.concat(F.lit('say "'), F.col("text"), F.lit('", please'))
    docs.select(F.col("doc_id").alias("id"), shown.alias("question")).write.option("header", True).option("escape", '"').csv(path)
    return files.read_prompts_csv(spark, path).select("id", "category", F.md5("prompt").alias("prompt_md5"))


@query
def s5_test_case_files(spark, d):
    """Test cases written as lines and read back for one category, whatever its case."""
    cases = inputs.test_cases(spark, d)
    path = work_folder(spark)
    files.write_samples(
        cases.select(
            F.col("case_id").cast("string").alias("id"), F.col("case_category").alias("category"),
            "expected_key_facts", "sources_required",
        ),
        path,
    )
    rows = files.read_test_cases(spark, path, category="BGP")
    return rows.select("id", "category", listed(F.col("expected_key_facts")).alias("keywords"), listed(F.col("sources_required")).alias("sources"))


@query
def s7_result_files(spark, d):
    """Scored answers written as the stored report keeps them, and read again."""
    path = work_folder(spark)
    scored = scored_cases(spark, d).withColumn("test_id", F.concat_ws("-", "conv_id", "turn"))
    files.write_results(scored.withColumns({"category": F.col("case_category"), "has_think": F.col("has_think_block")}), path)
    rows = spark.read.schema(schemas.RESULT).json(path)
    return rows.select(
        "test_id", "category", "overall_score", "pass_fail", "has_think", whole(F.col("reasoning_steps")).alias("reasoning_steps"),
        *[real(F.col(c)).alias(c) for c in ("keyword_score", "source_score", "confidence", "latency_ms")],
        listed(F.col("keywords_missing")).alias("missing"),
    )


@query
def s7_report_file(spark, d):
    """A report written as one document and read back."""
    path = work_folder(spark)
    files.write_report(curate_statistics(spark, d), path)
    return spark.read.schema("total bigint, think_block_rate double, avg_response_chars double, avg_reasoning_steps double").json(path)


@query
def s2_split_folders(spark, d):
    """Samples written to a folder per split and read back from them."""
    path, k = work_folder(spark), F.col("doc_id")
    split = F.when(k % 10 < 8, "train").when(k % 10 == 8, "val").otherwise("test")
    said = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    files.write_samples(inputs.table(spark, d, "documents").select(F.array(said).alias("messages"), split.alias("split")), path, split="split")
    rows = spark.read.schema("messages array<struct<role:string,content:string>>, split string").json(path)
    texts = F.col("messages")[0]["content"]
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(texts)).alias("chars"), F.min(F.md5(texts)).alias("least_md5"))


@query
def s6_knowledge_files(spark, d):
    """One JSON file per category, those of other names left alone and missing ones empty, read and flattened."""
    nation, folder = inputs.table(spark, d, "nation"), work_folder(spark)
    names = ["design_patterns", "vendor_specifics", "notes"]
    category = F.array(*[F.lit(n) for n in names])[(F.col("n_regionkey") % 3).cast("int")]
    docs = nation.groupBy(category.alias("category")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))  # 25 nations
    docs.select("category", F.to_json(F.struct("nations")).alias("value")).repartition("category").write.partitionBy("category").text(f"{folder}/parts")
    store, of = snapshots.file_store(spark, folder)
    store.mkdirs(of(f"{folder}/files"))
    for name in names:
        part = store.globStatus(of(f"{folder}/parts/category={name}/part-*"))[0].getPath()
        store.rename(part, of(f"{folder}/files/{name}.json"))
    read = files.read_knowledge(spark, f"{folder}/files")
    per_file = knowledge.flatten(read).groupBy("category").agg(F.count(F.lit(1)).alias("leaves"), F.max(knowledge.leaf_text(F.col("node"))).alias("last"))
    return read.select("category").join(per_file, "category", "left").select("category", F.coalesce("leaves", F.lit(0)).alias("leaves"), "last")


@query
def s11_scenario_cases(spark, d):
    """A scenario file of one case per nation, written and read back."""
    n, path = F.col("n_nationkey"), work_folder(spark)
    given = F.struct(n.alias("users"), F.lower("n_name").alias("industry"))
    case = F.struct(
        F.concat(F.lit("case-"), n.cast("string")).alias("id"), F.col("n_name").alias("name"), F.when(n % 2 == 0, "troubleshooting").alias("type"), given.alias("input"),
        F.array(F.col("n_name"), F.lit("OSPF")).alias("expected_keywords"), (n / 32).alias("min_confidence"), (n % 3 == 0).alias("requires_human_review"),
    )
    doc = inputs.table(spark, d, "nation").agg(F.struct(F.sort_array(F.collect_list(case)).alias("scenarios")).alias("d"))  # 25 nations
    doc.select(F.to_json("d").alias("value")).coalesce(1).write.text(path)
    rows = files.read_scenarios(spark, path)
    return rows.select("id", "name", "type", F.col("input")["users"].alias("users"), F.col("input")["industry"].alias("industry"), listed(F.col("expected_keywords")).alias("keywords"), "min_confidence", "requires_human_review")


@query
def k6_snapshots(spark, d):
    """Base entries and then updates in three parts, each a snapshot of its own; the last one is read."""
    path, new = work_folder(spark), inputs.new_entries(spark, d)
    snapshots.update_snapshot(inputs.base_entries(spark, d), path)
    for part in range(3):
        snapshots.update_snapshot(new.filter(F.col("seq") % 3 == part), path)
    return snapshots.read_snapshot(spark, path).filter("category <> 'unlisted'").drop("seq")


@query
def k6_manual_entries(spark, d):
    """Entries made by hand: objects keep their fields, other values go under a key."""
    c = inputs.table(spark, d, "customer")
    value = F.when(F.col("c_custkey") % 3 == 0, F.to_json(F.struct("c_name", "c_custkey"))).otherwise(F.to_json(F.array("c_name")))
    entry = knowledge.manual_entry(value, F.col("c_mktsegment"), F.col("c_custkey"))
    shown = {"source": "$._metadata.source", "added": "$._metadata.added", "name": "$.c_name", "value": "$.value"}
    return c.select("c_custkey", *[F.get_json_object(entry, p).alias(k) for k, p in shown.items()])


@query
def s9_enough_rows(spark, d):
    return files.enough(inputs.table(spark, d, "documents"))


def queue_messages(spark: SparkSession, d: str) -> DataFrame:
    """Queue messages written once and read back in even parts: much work follows from a small one."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stored(inputs.task_messages(spark, d).select("value").repartition(width, "value"))


def recorded_answers(messages: DataFrame) -> DataFrame:
    """A table of answers recorded for the prompts of messages: an echo, an error for link faults, none for reviews."""
    spark = messages.sparkSession
    asked, kept = work_folder(spark), work_folder(spark)
    service.asked_tasks(messages).filter("type <> 'review'").select("model_prompt").write.parquet(asked)
    distinct = spark.read.parquet(asked).filter("model_prompt is not null").distinct()
    lost = F.contains("model_prompt", F.lit("Symptom: link"))
    distinct.select(
        respond.prompt_key(F.col("model_prompt")).alias("prompt_key"), F.when(~lost, F.concat(F.lit("<think>Step 1: read.</think>"), "model_prompt")).alias("raw"),
        F.lit(1.0).alias("latency_ms"), F.when(lost, "device lost").alias("error"),
    ).write.parquet(kept)
    return spark.read.parquet(kept)


def routed_columns(answers: DataFrame) -> DataFrame:
    return answers.select(
        "task_id", "type", "requestor", "status", "queue", "error", F.md5("answer").alias("answer_md5"),
        listed(F.col("sources")).alias("sources"), real(F.col("confidence")).alias("confidence"), "requires_approval",
    )


@query
def t10_x2_task_intake(spark, d):
    """Queue messages through prompt, recorded answers, parsing, review and routing."""
    messages = queue_messages(spark, d)
    return routed_columns(service.answer_tasks(messages, recorded_answers(messages)))


@query
def t10_stream_intake(spark, d):
    """The same as a stream over files of messages, joined with a table of recorded answers and written by queue."""
    messages = queue_messages(spark, d)
    inbox, out = work_folder(spark), work_folder(spark)
    messages.write.text(inbox)
    answers = service.answer_tasks(service.read_tasks(spark, inbox), recorded_answers(messages))
    service.write_routed(answers, out, work_folder(spark)).awaitTermination()
    return routed_columns(service.read_routed(spark, out))


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = inputs.table(spark, d, "events").schema
    return inputs.as_served(spark.readStream.schema(schema).parquet(f"{d}/events*.parquet"))


def whole_result(df: DataFrame) -> DataFrame:
    """Run a stream over the files there are; its complete result is written anew per trigger."""
    spark = df.sparkSession
    out, marks = work_folder(spark), work_folder(spark)
    running = (
        df.writeStream.outputMode("complete").option("checkpointLocation", marks).trigger(availableNow=True)
        .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(out)).start()
    )
    running.awaitTermination()
    return spark.read.parquet(out)


@query
def t1_stream_windows(spark, d):
    """Minutes written by a stream, read back as hours."""
    path = work_folder(spark)
    service.write_windows(monitor.derive_metrics(event_stream(spark, d)), path, work_folder(spark)).awaitTermination()
    rows = service.read_windows(spark, path, 3600, [0.5, 0.95, 0.99])
    return rows.select("metric", "window_start", "n", "average", *[real(F.col(c)).alias(c) for c in ("sum", "p50", "p95", "p99")])


@query
def t3_stream_counters(spark, d):
    return whole_result(service.counters(event_stream(spark, d), ["task_type", "status_code", "has_think"]))


@query
def t6_stream_error_rate(spark, d):
    rates = whole_result(service.sliding_error_rate(event_stream(spark, d)))
    return rates.select("window_end", real(F.col("value")).alias("value"), (F.col("value") > 0.1).alias("high"))

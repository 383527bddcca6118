"""Scenario and chain generation."""

from pyspark.sql import functions as F

from answerloom.operators import curate, generate
from answerloom.plans.catalog import QUERIES
from answerloom.sources import files


def test_same_rows_for_any_partitioning(spark):
    a = generate.design_scenarios(spark.range(300).repartition(1), "id").collect()
    b = generate.design_scenarios(spark.range(300).repartition(7), "id").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    c = generate.design_scenarios(spark.range(300), "id", seed=1).collect()
    assert sorted(map(str, a)) != sorted(map(str, c))
    for r in a:
        lo, hi = {"small": (50, 500), "medium": (500, 5000), "large": (5000, 50000), "enterprise": (50000, 200000)}[r.scale]
        assert lo <= r.user_count <= hi
        if r.industry in ("financial_services", "healthcare"):
            assert r.compliance


def test_chains_have_the_stated_length(spark):
    rows = generate.with_design_chain(generate.design_scenarios(spark.range(400), "id"))
    for r in rows.collect():
        want = 6 + ("PCI-DSS" in r.compliance) + ("HIPAA" in r.compliance) + (r.site_count > 1)
        assert len(r.chain) == want
    faults = generate.with_fault_chain(generate.fault_scenarios(spark.range(200), "id"), generate.diagnostic_routes(spark))
    assert {len(r.chain) for r in faults.collect()} == {7}


def test_rendering(spark):
    df = spark.createDataFrame([([("T", "S", "C", ["x", "y"]), ("U", "S", "D", [])],)], "c " + generate.STEP_TYPE)
    text = df.select(generate.render_chain(F.col("c"))).first()[0]
    assert text == "<think>\n\nStep 1: T\n- Source: S\nC\n  * x\n  * y\n\nStep 2: U\n- Source: S\nD\n</think>"


def test_cost_and_wan(spark):
    df = spark.createDataFrame([(1000, ["PCI-DSS", "HIPAA"]), (100, [])], "u bigint, c array<string>")
    got = [r[0] for r in df.select(generate.cost_model(F.col("u"), F.col("c"))).collect()]
    assert (got[0].base_capex, got[0].capex, got[0].opex, got[0].tco) == (600000, 930000, 139500, 1348500)
    assert (got[1].per_user, got[1].capex) == (350, 35000)
    odd = df.select(generate.cost_model(F.col("u"), F.col("c"), F.lit("n/a")))
    assert odd.first()[0].per_user == 600
    wan = spark.createDataFrame([(101, 2), (5, 10)], "u bigint, s bigint").select(generate.wan_sizing(F.col("u"), F.col("s")))
    assert [tuple(r[0]) for r in wan.collect()] == [(50, 100, 120), (0, 0, 0)]


def made(spark, n):
    kinds = generate.plan_kinds(spark.range(n), "id")
    answers = spark.range(n).select("id", F.when(F.col("id") % 5 > 0, "done " * 30).otherwise("").alias("answer")).filter("id % 7 > 0")
    return generate.assemble_samples(generate.generated_rows(kinds, "id", generate.diagnostic_routes(spark)), answers, "id")


def test_missing_answers_are_counted(spark):
    stats = generate.generation_stats(made(spark, 70)).collect()
    ok = sum(1 for i in range(70) if i % 5 and i % 7)
    assert sum(r.n for r in stats if r.status == "ok") == ok and sum(r.n for r in stats) == 70
    assert sum(r.n for r in stats if r.kind == "design") == 49


def test_both_kinds_in_one_branch(spark):
    rows = made(spark, 60).filter("status = 'ok'")
    for r in rows.collect():
        s = r.metadata.scenario
        assert r.metadata.type == r.kind and r.metadata.reasoning_steps == r.messages[1].content.count("\nStep ")
        assert (s.user_count is None) == (r.kind != "design") == (s.protocol is not None)
    # Each row's chain is that of its kind alone.
    key = [r.id for r in rows.filter("kind = 'design'").select("id").collect()]
    alone = generate.with_design_chain(generate.design_scenarios(spark.range(60), "id")).filter(F.col("id").isin(key))
    want = {r.id: r.t for r in alone.select("id", generate.render_chain(F.col("chain")).alias("t")).collect()}
    got = {r.id: r.messages[1].content.split("</think>")[0] + "</think>" for r in rows.filter("kind = 'design'").collect()}
    assert got == want


def test_generated_samples_are_curated_and_written(spark, tmp_path):
    samples = made(spark, 60).filter("status = 'ok'")
    digest = curate.digest_messages(samples, "id")
    kept = curate.validate_samples(curate.deduplicate(digest, F.col("first_print"), "sample_id"))
    n = kept.count()
    assert 0 < n <= samples.count() and kept.filter("steps > 0").count() == n
    files.write_samples(samples.select("messages", "metadata"), str(tmp_path / "s"))
    again, bad = files.read_samples(spark, str(tmp_path / "s"), line_numbers=False)
    assert bad.count() == 0
    back = curate.digest_messages(again)
    strip = lambda df: sorted(tuple(r)[1:] for r in df.select("sample_id", "first_print", "total_chars", "steps", "type", "user_count", "reasoning_steps").collect())
    assert strip(back) == strip(digest)


def test_curated_samples_are_made_once(spark, tmp_path):
    """Curation reads the digests twice, once to find copies; the samples behind them are not made twice."""
    key = F.col("id")
    spark.range(300).select(key.alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("F").alias("o_orderstatus")).write.parquet(str(tmp_path / "orders.parquet"))
    counts = QUERIES["g14_curated_samples"](spark, str(tmp_path))
    assert "<think>" not in counts._jdf.queryExecution().optimizedPlan().toString()
    whole = sum(r.n for r in counts.collect())
    assert 0 < whole <= 276


def test_question_forms_are_made_one_at_a_time(spark):
    rows = generate.fault_scenarios(spark.range(60).union(spark.sql("SELECT CAST(NULL AS BIGINT) AS id")), "id").select("id", generate.fault_question(F.col("id")).alias("q"))
    begins = {(r.q or "").split(" ")[0] for r in rows.filter("id is not null").collect()}
    assert begins == {"We're", "Our", "Help"}
    assert rows.filter("id is null").first().q is None

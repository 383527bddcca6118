"""Curation on small fixtures against plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from answerloom.operators import curate
from answerloom.sources import schemas


def test_split_matches_model(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b"])) for i in range(900)] + [(1000, "one"), (1001, "two"), (1002, "two")]
    rows += [(2000 + i, "three") for i in range(3)]

    def model(stratified):
        groups = {}
        for i, s in rows:
            groups.setdefault(s if stratified else "", []).append(i)
        out = {}
        for ids in groups.values():
            ids.sort(key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i))
            n, a, b = len(ids), int(len(ids) * 0.8), int(len(ids) * (0.8 + 0.1))
            if stratified:
                a = max(1, a)
                b = max(a + 1, b)
            for place, i in enumerate(ids):
                out[i] = "train" if place < a else "val" if place < b else "test"
        return out

    for parts in (1, 7):
        for digits in (1, 4):
            df = spark.createDataFrame(rows, "id bigint, s string").repartition(parts)
            got = curate.split_stratified(df, "id", F.col("s"), hex_digits=digits)
            assert {r.id: r.split for r in got.collect()} == model(True)
            assert {r.id: r.split for r in curate.split_random(df, "id", hex_digits=digits).collect()} == model(False)


def test_split_edges(spark):
    empty = spark.createDataFrame([], "id bigint")
    assert curate.split_random(empty, "id").count() == 0
    few = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert {r.split for r in curate.split_random(few, "id", 0.1, 0.1).collect()} == {"test"}


def test_split_depends_on_seed_only(spark):
    df = spark.range(500)
    a = {r.id for r in curate.split_random(df, "id", seed=1).filter("split = 'train'").collect()}
    b = {r.id for r in curate.split_random(df, "id", seed=2).filter("split = 'train'").collect()}
    assert len(a) == len(b) == 400 and a != b


def test_deduplicate_hot_group(spark):
    same = "A" * 199 + "b"
    rows = [(i, " " + same[1:] + str(i)) for i in range(300)] + [(1000 + i, f"own {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, t string").repartition(5)
    assert sorted(r.id for r in curate.deduplicate(df, F.col("t"), "id", prefix_chars=200).collect()) == [0] + list(range(1000, 1050))


def test_fingerprint_cuts_before_it_strips(spark):
    df = spark.createDataFrame([(" " * 200 + "x",)], "t string")
    whole, cut, empty = df.select(curate.fingerprint(F.col("t")), curate.fingerprint(F.col("t"), 200), curate.fingerprint(F.lit(None))).first()
    assert whole != cut == empty


def test_deduplicate_compares_whole_texts_and_nulls(spark):
    rows = [(1, "p" * 200 + "one"), (2, "p" * 200 + "two"), (3, None), (4, None), (5, " P" + "p" * 199 + "ONE ")]
    df = spark.createDataFrame(rows, "id long, t string")
    assert sorted(r.id for r in curate.deduplicate(df, F.col("t"), "id").collect()) == [1, 2, 3]
    assert sorted(r.id for r in curate.deduplicate(df, F.col("t"), "id", prefix_chars=200).collect()) == [1, 3, 5]


def test_random_split_has_no_nested_loop(spark):
    df = curate.split_random(spark.range(100).withColumnRenamed("id", "k"), "k")
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["split"]: r["count"] for r in df.groupBy("split").count().collect()} == {"train": 80, "val": 10, "test": 10}


def samples(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, " + schemas.SAMPLE)


def meta(kind=None, category=None):
    return (kind, category, None, None, None, None, None)


def test_digest_and_rules(spark):
    long = "x" * 100
    rows = [
        (1, [("user", "q"), ("assistant", long)], meta("design")),
        (2, [("user", "q")], meta(None, "mixed")),
        (3, [], None),
        (4, [("user", None), ("assistant", long)], meta()),
        (5, [("user", "q"), ("assistant", "<think>\nStep 1: a\nStep 22: b</think>" + long)], meta()),
        (6, None, None),
    ]
    digest = curate.digest_messages(samples(spark, rows))
    got = {r.sample_id: r for r in digest.collect()}
    assert [got[i].n_messages for i in range(1, 7)] == [2, 1, 0, 2, 2, 0]
    assert got[1].sample_facts.tail == 100 and got[5].sample_facts.tags and got[1].has_user and not got[3].has_user
    assert got[1].last_chars == 100 and got[1].first_print == hashlib.sha256(b"q").hexdigest() and not got[4].first_given
    assert sorted(r.sample_id for r in curate.validate_samples(digest).collect()) == [1, 5]
    assert tuple(curate.count_valid(digest).first()) == (2, 4)
    stats = curate.dataset_stats(digest).first()
    assert stats.total == 6 and stats.think_block_rate == pytest.approx(1 / 6) and stats.avg_reasoning_steps == 2.0
    types = {r.type: r.n for r in curate.count_by_type(digest).collect()}
    assert types == {"design": 1, "unknown": 5}
    strata = {r[0] for r in digest.select(curate.stratum_of()).collect()}
    assert strata == {"design", "mixed", "unknown"}


def test_turn_digest_equals_message_digest(spark):
    chats = {1: [("system", "s"), ("user", "u"), ("assistant", "a")], 2: [("assistant", "x"), ("assistant", "y")]}
    turns = [(k, i, r, t) for k, m in chats.items() for i, (r, t) in enumerate(m)]
    long = curate.digest_turns(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(3))
    wide = curate.digest_messages(samples(spark, [(k, m, None) for k, m in chats.items()])).select(long.columns)
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, wide.collect()))


def test_stats_of_nothing(spark):
    stats = curate.dataset_stats(curate.digest_messages(samples(spark, []))).first()
    assert tuple(stats) == (0, 0.0, 0.0, 0.0)


def test_gates_and_order(spark):
    ids = [r.id for r in curate.shuffled(spark.range(50), "id").collect()]
    assert sorted(ids) == list(range(50)) and ids != sorted(ids)
    assert [r.id for r in curate.seeded_sample(spark.range(50), "id", 5).collect()] == ids[:5]
    assert math.isclose(curate.dataset_gates(curate.digest_messages(samples(spark, []))).first().duplicate_ratio, 0.0)

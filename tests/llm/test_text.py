"""Quality, licences, archives, tokenizers and packing against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from answerloom.llm import trees
from answerloom.llm.bytebpe import LOOK_AHEAD, cut_points, encode_documents, encoder
from answerloom.llm.features import FEATURES
from answerloom.llm.license_rules import STEMS, rules
from answerloom.llm.licenses import PHRASES, bounded, scan_licenses
from answerloom.llm.packing import pack, pack_documents, word_ids
from answerloom.llm.quality import quality_scores
from answerloom.llm.rules import FALLING, quality_rules
from answerloom.llm.warc import read_archives, write_archives

SF = "/root/testdata/sf0.01"
WORD = "[^\x20\x09-\x0d]+"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def brute_counts(text):
    words = re.findall(WORD, text or "")
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(triples)
    repeated = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    lines, again = set(), 0
    for line in (text or "").split("\n"):
        again += bool(re.search(WORD, line)) and line in lines
        lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(repeated)


def test_rules(spark, documents, rows, nothing, labels):
    got = quality_rules(documents, labels).collect()
    counts = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    assert sorted(((r.doc_id, *counts(r)) for r in got), key=repr) == sorted(((i, *brute_counts(t)) for i, t in rows), key=repr)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality_rules(nothing, labels).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = quality_rules(docs, labels).join(labels, "doc_id").filter("not base_failed")
    assert judged.filter((F.col("quality") == 1) & ~F.col("kept")).count() <= 0.02 * judged.count()


def test_trees_are_monotone():
    draw = np.random.default_rng(2)
    x = draw.random((3000, 3))
    y = (x[:, 0] + 0.4 * np.sin(9 * x[:, 1]) + 0.3 * draw.random(3000) < 0.7).astype(float)
    forest = trees.fit(x, y, np.array([-1, 0, 1]))
    grid = draw.random((200, 3))
    for j, sign in ((0, -1), (2, 1)):
        steps = [forest.score(np.column_stack([np.full(200, v) if c == j else grid[:, c] for c in range(3)])) for v in np.linspace(0, 1, 30)]
        assert (sign * np.diff(steps, axis=0) >= -1e-12).all()
    assert ((forest.score(x) > 0.5) == y).mean() > 0.8 and set(FALLING) <= set(FEATURES)
    assert trees.fit(np.empty((0, 3)), np.empty(0), np.zeros(3, int)).score(grid).std() == 0


def test_quality(spark, documents, nothing, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.95
    assert quality_scores(documents, labels).count() == documents.count() and quality_scores(nothing, labels).count() == 0
    assert {r.score for r in quality_scores(documents, labels.limit(0)).collect()} == {0.5}


def brute_license(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))
    padded = f" {' '.join(words)} "
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found = [(m.start(), m.end(), r.priority, o, r) for o, r in enumerate(rules()) for m in re.finditer(bounded(r.pattern), padded)]
    found.sort(key=lambda x: (x[0], -x[1], x[2], x[3]))
    left = [f for k, f in enumerate(found) if not any(g[1] >= f[1] and g[2] <= f[2] for g in found[:k])]
    base = {label for _, label in places}
    labels = base | {f[4].label for f in left}
    starts = [i for i, _ in places]
    score = max([f[4].confidence for f in left] + [0.5] * bool(places), default=0.0)
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_licenses(spark, documents, rows, nothing):
    texts = [
        "SPDX-License-Identifier: MIT-0 mit licence CC-BY cc by cc by-sa 4.0", "This work is licensed under the GNU General Public License, version 3. GPLv3 gpl v2 lgpl 2.1",
        "Released under the terms of the Mozilla Public License 2.0; see LICENSE file. Copyright (c) 2020 All Rights Reserved all rights reserved",
        "é general public license Ü general public licenses", "the software is provided as is without warranty of any kind", "3-clause BSD",
    ]
    extra = [(90_000 + k, t) for k, t in enumerate(texts)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sorted((tuple(r) for r in scan_licenses(docs).collect()), key=repr)
    assert got == sorted(((i, *brute_license(t)) for i, t in rows + extra), key=repr)
    plan = scan_licenses(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and scan_licenses(nothing).count() == 0


@pytest.mark.parametrize("rule", rules(), ids=lambda r: f"{r.priority}-{r.label}")
def test_every_rule_is_behind_its_keyword_and_a_stem(rule):
    @settings(max_examples=8, database=None, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(rule.pattern.replace(".{", "[a-z ]{"), fullmatch=True))
    def check(text):
        assert rule.keyword in f" {text} " and any(s in f" {text} " for s in STEMS)

    check()


def test_archives(spark, nothing):
    draw = random.Random(4)
    html = [None, "", "", "<p>é</p>", "x" * 3_000_000] + ["".join(draw.choices("ab<>\x1f\x8b\x08é\r\n ", k=draw.randrange(3000))) for _ in range(60)]
    rows = [(k, None if k % 7 == 0 else f"http://h/{k}?q=\r\n é", html[k * 5 % len(html)], "s") for k in range(150)] + [(149, "u", html[0], "s"), (None, "u", "only", "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    newest = {}
    for i, _, h, _ in rows:
        newest[h or ""] = max(newest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in rows:
        body = (h or "").encode()
        own = i is None or i == newest[h or ""] or len(body) < 2
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else newest[h or ""], body if own else None))
    files = write_archives(pages, min_bytes=2, file_bytes=40_000)
    for split in (700, 1 << 20):
        got = read_archives(files, split_bytes=split).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()
        assert sorted(((*r[:5], None if r[5] is None else bytes(r[5])) for r in got), key=repr) == sorted(want, key=repr)
    assert read_archives(write_archives(nothing.select(F.col("doc_id").alias("page_id"), F.col("rest").alias("url"), F.col("text").alias("html")))).count() == 0


def test_damaged_record_is_skipped(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}</p>" * 50) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    file = write_archives(pages.repartition(1)).collect()
    for f in file:
        path = f.path.removeprefix("file:")
        data = bytearray(open(path, "rb").read())
        data[len(data) // 2 + 40] ^= 255
        open(path, "wb").write(data)
    got = {r.page_id for r in read_archives(spark.createDataFrame(file), split_bytes=500).collect()}
    assert 40 - 2 * len(file) <= len(got) < 40


def test_byte_bpe(documents, rows, nothing):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = encoder(path, P.PATTERN).encoding
    want = sorted(((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows if t is None or len(t) < 69_000), key=repr)
    for chunk, overlap in ((32_768, 512), (700, 40)):
        got = encode_documents(documents.filter("text is null or length(text) < 69000"), path, P.PATTERN, chunk_chars=chunk, overlap_chars=overlap).collect()
        assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got), key=repr) == want
        assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    long = documents.filter("doc_id = 20006")
    assert bytes(encode_documents(long, path, P.PATTERN).first().decoded) == b"y" * 70_000
    assert encode_documents(nothing, path, P.PATTERN).count() == 0


@settings(max_examples=150, database=None, deadline=None)
@given(st.text(alphabet=" \n\t'abstrevmld1é!?.中", min_size=60, max_size=400), st.integers(20, 60), st.integers(8, 20))
def test_cuts_are_boundaries(text, chunk, overlap):
    coder = encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    starts = list(range(0, len(text), chunk))
    cuts = cut_points([text[s : s + chunk + overlap] for s in starts], starts, coder.boundaries)
    assert set(cuts) <= set(coder.boundaries(text).tolist()) and cuts == sorted(cuts) and LOOK_AHEAD > 3


def test_pack():
    draw = np.random.default_rng(0)
    for lengths in (np.array([1]), np.array([4096, 4097, 8191]), draw.integers(1, 9000, 400), np.ones(5000, int), np.empty(0, int)):
        doc, start, length, sequence, offset, step = pack(lengths)
        assert (length > 0).all() and length.sum() == lengths.sum()
        for d in range(len(lengths)):
            own = np.argsort(start[doc == d])
            begin = start[doc == d][own]
            assert (begin == np.cumsum(length[doc == d][own]) - length[doc == d][own]).all()
        for s in range(len(step)):
            own = np.argsort(offset[sequence == s])
            size = length[sequence == s][own]
            assert (offset[sequence == s][own] == np.cumsum(size) - size).all() and size.sum() <= 4096 and size.sum() & (size.sum() - 1) == 0
    assert sum(pack(draw.integers(1, 3000, 2000))[5] == 0) > 0


def test_packed_documents(documents, rows, nothing):
    path = P.path("word_bpe_49k.json")
    coder = word_ids(path, 2)
    got = pack_documents(documents, path, block_tokens=20_000).collect()
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        whole[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(coder.whole(t or "") + np.array([2], "<u4").tobytes())
    for i, own in texts.items():
        assert sum(len(x) for _, x, _ in whole[i]) == sum(map(len, own))
        if len(own) == 1:
            assert b"".join(x for _, x, _ in sorted(whole[i])) == own[0] and {n for *_, n in whole[i]} == {len(own[0]) // 4}
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
    assert pack_documents(nothing, path).count() == 0


def test_packing_ids_equal_the_tokenizer_by_default():
    path = P.path("word_bpe_49k.json")
    fresh = Tokenizer.from_file(path)
    texts = ["a document <|endoftext|> then more", "x<|startoftext|>y.<|endoftext|>", "<|ENDOFTEXT|> <|end oftext|>", "don't<|endoftext|>'s stop!! <|endoftext|>."]
    ids, lengths = word_ids(path, 2).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [[*fresh.encode(x, add_special_tokens=False).ids, 2] for x in texts]


@pytest.mark.parametrize("end", [" ", "", "\n"])
def test_long_spans_are_hashed_in_linear_time(end):
    """A line or word of 20 MB costs about what the same bytes cost in short ones; equal spans have equal hashes wherever they stand."""
    import time

    from answerloom.llm.arrays import BLOCK_BYTES, Words, span_hashes

    piece = ("x" * 9 + end) * (2 << 20)
    begun = time.perf_counter()
    words = Words.of(pa.array([piece, "a " + piece]))
    hashes = words.hashes()
    assert time.perf_counter() - begun < 5
    if not end:
        assert len(hashes) == 3 and hashes[0] == hashes[2] != hashes[1]
    data = np.frombuffer(bytes(np.random.default_rng(1).integers(0, 256, 5 * BLOCK_BYTES, np.uint8)) * 2 + b"\0" * 8, np.uint8)
    for n in (0, 1, BLOCK_BYTES - 1, BLOCK_BYTES, BLOCK_BYTES + 1, 3 * BLOCK_BYTES, 5 * BLOCK_BYTES):
        one, two, other = span_hashes(data, np.array([0, 5 * BLOCK_BYTES, 1]), np.array([n, n, n]))
        assert one == two and (n == 0 or one != other)
    swapped = np.concatenate([data[BLOCK_BYTES : 2 * BLOCK_BYTES], data[:BLOCK_BYTES], data[-8:]])
    assert span_hashes(swapped, np.array([0]), np.array([2 * BLOCK_BYTES]))[0] != span_hashes(data, np.array([0]), np.array([2 * BLOCK_BYTES]))[0]


def test_long_texts_in_linear_time(spark):
    """Statistics, passages and tokens of one text without a line end or blank."""
    import time

    from answerloom.llm.bytebpe import encode_documents
    from answerloom.llm.substring import remove_repeated_passages
    from answerloom.llm.tokengroups import jaccard_components

    def seconds(n, df_of):
        text = spark.createDataFrame([(1, "ab1 " * 10)], "doc_id long, text string").selectExpr("doc_id", f"repeat('ab1xyz', {n}) as text")
        begun = time.perf_counter()
        df_of(text).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    path = P.path("byte_bpe_multi_50k.tiktoken")
    spaced = lambda df: df.withColumn("text", F.replace("text", F.lit("1"), F.lit("1 ")))
    coded = lambda df: encode_documents(spaced(df), path, P.PATTERN)
    seconds(1000, coded)
    one, two = seconds(1 << 19, coded), seconds(1 << 20, coded)
    assert two < 3 * one + 2
    for op in (remove_repeated_passages, jaccard_components):
        assert seconds(3 << 20, op) < 20


def test_archives_are_read_by_many_tasks(spark):
    from answerloom.llm.warc import read_archives, write_archives

    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("html"))
    records = read_archives(write_archives(pages.repartition(4), file_bytes=64 << 10), split_bytes=8 << 10)
    tasks = records.withColumn("task", F.spark_partition_id()).groupBy("task").count().count()
    assert records.count() == 3000 and tasks >= 8


def walked(forest, x):
    """One row through every tree, node by node."""
    total = forest.bias
    for at in forest.root.tolist():
        while forest.left[at] != at:
            at = int(forest.left[at] if x[forest.feature[at]] <= forest.threshold[at] else forest.right[at])
        total += forest.value[at]
    return 1 / (1 + np.exp(-total))


def statistics_of(text):
    from answerloom.llm.features import matrix, with_statistics

    (_, stats), = with_statistics(iter([pa.record_batch([pa.array([text])], ["text"])]), "text")
    return matrix(stats)[0]


def test_verdicts_are_those_of_the_trees(spark, documents, rows, labels):
    """Scores against single walks through the nodes, on each document's own statistics; accuracy on labels that weren't learned."""
    from answerloom.llm.features import FEATURES as NAMES
    from answerloom.llm.quality import held_out, labelled_matrix

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = labels.filter(~held_out(F.col("doc_id")))
    x, y = labelled_matrix(docs, known, "doc_id", "text", "quality", 20_000)
    forest = trees.fit(x, y, np.array([-1 if name in FALLING else 0 for name in NAMES]))
    judged = quality_rules(docs, known).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in judged:
        want = walked(forest, statistics_of(texts[r.doc_id] or ""))
        assert abs(r.score - want) < 1e-9 and r.kept == (not r.base_failed and want >= 0.5)
    truth = {r.doc_id: r.quality for r in labels.filter(held_out(F.col("doc_id"))).collect()}
    asked = [r for r in judged if r.doc_id in truth and not r.base_failed]
    assert len(asked) > 10 and np.mean([r.kept == bool(truth[r.doc_id]) for r in asked]) >= 0.9


def test_scores_are_those_of_dense_covariances(spark, labels):
    """Log-densities row by row from the covariances themselves, without Cholesky factors."""
    from answerloom.llm import discriminant
    from answerloom.llm.quality import fitted, held_out, labelled_matrix

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    x, y = labelled_matrix(docs, labels.filter(~held_out(F.col("doc_id"))), "doc_id", "text", "quality", 20_000)
    model = fitted(docs, labels, "doc_id", "text", "quality", 20_000)
    z = discriminant.transformed(x)
    centre, scale = z.mean(0), np.maximum(z.std(0), 1e-3)
    z = (z - centre) / scale
    own = [z[y == k] for k in (0, 1)]
    spread = [np.cov(o.T, bias=True) for o in own]
    pooled = sum(s * len(o) / len(z) for s, o in zip(spread, own, strict=True))
    shrunk = [0.7 * s + 0.3 * pooled for s in spread]
    shrunk = [0.9 * s + 0.1 * np.trace(s) / len(s) * np.eye(len(s)) for s in shrunk]
    texts = {r.doc_id: r.text for r in docs.limit(60).collect()}
    scores = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    for i, text in texts.items():
        v = (discriminant.transformed(statistics_of(text or "")) - centre) / scale
        density = [-0.5 * np.linalg.slogdet(s)[1] - 0.5 * (v - o.mean(0)) @ np.linalg.solve(s, v - o.mean(0)) for s, o in zip(shrunk, own, strict=True)]
        d = density[1] - density[0]
        want = 1 / (1 + np.exp(-np.clip(model.slope * np.sign(d) * np.log1p(abs(d)) + model.shift, -40, 40)))
        assert abs(scores[i] - want) < 1e-6

"""Exact, line, passage and near-duplicate operators against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from answerloom.llm import substring
from answerloom.llm.exact import QuotientFilter, exact_groups
from answerloom.llm.lines import drop_shared_lines
from answerloom.llm.neardup import ALL_PAIRS, IDF_SHARE, block_links, near_duplicates, rare_prefix, weighted_samples
from answerloom.llm.substring import _as_text, remove_repeated_passages

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quotient_filters_merge_losslessly():
    draw = np.random.default_rng(3)
    parts = [draw.integers(0, 2**64, 3000, dtype=np.uint64) for _ in range(3)] + [np.array([0, 2**64 - 1, 7], np.uint64).repeat(300)]
    parts[1][:500] = parts[0][:500]
    filters = []
    for part in parts:
        keys, counts = np.unique(part, return_counts=True)
        made = QuotientFilter.from_bytes(QuotientFilter.of(keys, counts).to_bytes())
        assert (made.items()[0] == keys).all() and (made.items()[1] == counts).all()
        filters.append(made)
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    got = QuotientFilter.merged(filters)
    assert (got[0] == keys).all() and (got[1] == counts).all()


def test_exact_groups(documents, rows, nothing):
    normal = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    size = Counter(t for _, t in normal)
    least = {}
    for i, t in normal:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    want = [(i, least.get(t) if size[t] > 1 else i, size[t], size[t] == 1 or i == least.get(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in normal]
    assert sorted_rows(exact_groups(documents)) == sorted(want, key=repr)
    assert exact_groups(nothing).count() == 0


def brute_lines(rows, min_docs):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOW)
    seen = {}
    for i, lines in split:
        if i is not None:
            for x in lines:
                seen.setdefault(key(x), set()).add(i)
    shared = {k for k, v in seen.items() if k and len(v) >= min_docs}
    return sorted(((i, len(x), sum(key(y) in shared for y in x), "\n".join(y for y in x if key(y) not in shared)) for i, x in split), key=repr)


@pytest.mark.parametrize("min_docs", [2, 10])
def test_lines(documents, rows, nothing, min_docs):
    got = drop_shared_lines(documents, min_docs=min_docs).select("doc_id", "n_lines", "n_dropped", "kept_text")
    assert sorted_rows(got) == brute_lines(rows, min_docs)
    assert drop_shared_lines(nothing).count() == 0


def test_lines_run_no_python(documents):
    plan = drop_shared_lines(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_passages(rows, window=20):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    in_order = sorted(((i, t or "", w) for (i, t), (_, w) in zip(rows, words, strict=True) if i is not None), key=lambda x: x[:2])
    for i, _, w in in_order:
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i, p))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[p : p + window])] != (i, p):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_passages(documents, rows, nothing):
    assert sorted_rows(remove_repeated_passages(documents)) == brute_passages(rows)
    assert remove_repeated_passages(nothing).count() == 0


def test_passages_keep_separators(documents, rows):
    got = {(r.doc_id, r.kept_text) for r in remove_repeated_passages(documents, separators="original", carry=["shard"]).collect()}
    want = {(r[0], r[2], r[3]) for r in brute_passages(rows)}
    assert {(i, " ".join(WORD.findall(t))) for i, t in got} == {(i, t) for i, _, t in want}
    unchanged = {i for i, n, _ in want if not n}
    assert {(i, t or "") for i, t in rows if i in unchanged} == {(i, t) for i, t in got if i in unchanged}


def test_two_characters_a_word(monkeypatch):
    monkeypatch.setattr("answerloom.llm.substring.ALPHABET", 3)
    text, width = _as_text(np.array([1, 2, 1, 4, 3]), 4)
    assert width == 2 and text[0:2] == text[4:6] != text[2:4] and len(text) == 10


def template_rows(draw, n):
    """Documents of few words and one period, so that passages overlap, nest, repeat in themselves and end in the middle of others."""
    base = [str(draw.randrange(50)) for _ in range(120)]
    out = []
    for k in range(n):
        a = draw.randrange(len(base))
        piece = base[a : a + draw.randrange(100)] + draw.choice([[], ["x"] * draw.randrange(30), ["p", "q"] * draw.randrange(20), base[: draw.randrange(60)]])
        if piece and draw.random() < 0.3:
            piece[draw.randrange(len(piece))] = f"edit{draw.randrange(3)}"
        out.append((k, " ".join(piece)))
    return out + out[:3]


@pytest.mark.parametrize("same_ids", [False, True])
@pytest.mark.parametrize("limit", [None, 30])
def test_automata_locate_every_occurrence(monkeypatch, limit, same_ids):
    """The steps of the operator by hand, over shards that share passages; with small automata, strings and alphabets too."""
    if limit:
        for name in ("ALPHABET", "AUTOMATON_WORDS", "STREAM_WORDS"):
            monkeypatch.setattr(substring, name, limit)
    for seed in range(6):
        rows = template_rows(random.Random(seed), 60)
        rows = [(i // 3 if same_ids and i % 7 == 1 else i, t) for i, t in rows]
        shards = [pa.table({"doc_id": pa.array([i for i, _ in rows if i % 3 == k], pa.int64()), "text": [t for i, t in rows if i % 3 == k]}) for k in range(3)]

        def grouped(tables, column):
            whole = pa.concat_tables(tables)
            return {k: whole.filter(pc.equal(whole.column(column), k)) for k in pc.unique(whole.column(column)).to_pylist()}

        keys = [(pa.scalar(k),) for k in range(3)]
        sent = grouped([substring._anchor_rows(20, 8, 2)(k, t) for k, t in zip(keys, shards, strict=True)], "bucket")
        anchors = grouped([substring._recurring_anchors((pa.scalar(b),), t) for b, t in sent.items()], "shard")
        windows = grouped([substring._window_rows(20, 8, 2)(keys[k], shards[k], anchors[k]) for k in range(3)], "bucket")
        known = grouped([substring._first_places((pa.scalar(b),), t) for b, t in windows.items()], "shard")
        clean = substring._cleaned(20, "space", ["doc_id", "n_words", "n_removed", "kept_text"])
        got = pa.concat_tables([clean(keys[k], shards[k], known[k]) for k in range(3)])
        assert sorted((tuple(r.values()) for r in got.to_pylist()), key=repr) == brute_passages(rows)


def test_samples_estimate_weighted_similarity():
    draw = np.random.default_rng(1)
    key = np.sort(draw.integers(0, 2**64, 500, dtype=np.uint64))
    a = draw.choice([1.0, 2.0, 3.5], 500)
    b = a.copy()
    b[:120] *= 3
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    x, y = (weighted_samples(np.zeros(500, int), key, w, 1, 600) for w in (a, b))
    assert abs((x == y).mean() - true) < 0.07
    both = weighted_samples(np.repeat([0, 2], 500), np.concatenate([key, key]), np.concatenate([a, b]), 3, 600)
    assert (both[0] == x[0]).all() and (both[2] == y[0]).all()


def shingle_counts(rows, k=5):
    rows = {i: WORD.findall((t or "").translate(LOW)) for i, t in rows if i is not None}
    sets = {i: Counter(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) for i, w in rows.items()}
    return rows, sets


def test_near_duplicates(documents, rows, nothing):
    ids = [i for i, _ in rows if i is not None]
    words, sets = shingle_counts(rows)
    n_docs = len(ids)
    df = Counter()
    for i, _ in rows:
        if i is not None:
            df.update(sets[i].keys())
    weight = {i: {s: n * (1 + IDF_SHARE * math.log((1 + n_docs) / (1 + df[s])) / math.log(1 + n_docs)) for s, n in c.items()} for i, c in sets.items()}
    label = {i: i for i in words}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sorted(words):
        for b in sorted(words):
            if a < b:
                common = sum(min(w, weight[b][s]) for s, w in weight[a].items() if s in weight[b])
                union = sum(weight[a].values()) + sum(weight[b].values()) - common
                if words[a] == words[b] or (union and common / union >= 0.8):
                    x, y = root(a), root(b)
                    label[max(x, y)] = min(x, y)
    got = near_duplicates(documents).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(ids)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == {i: root(i) for i in words}
    size = Counter(root(i) for i in ids)
    assert all(r.class_size == size[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got if r.doc_id is not None)
    assert [r.kept for r in got if r.doc_id is None] == [True, True]
    assert near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("n", [200, 2400])
def test_near_pairs_in_a_large_bucket(spark, n):
    """Texts of one template, about 0.75 alike, with planted pairs of up to 0.9: all share buckets, and only the pairs are copies."""
    draw = random.Random(11)
    template = [f"t{k}" for k in range(200)]
    texts = {i: " ".join(template + [f"o{i}x{k}" for k in range(draw.randrange(29, 35))]) for i in range(n)}
    for i in range(0, 120, 2):
        own = texts[i].split(" ")[200:]
        same = draw.randrange(4, 27)
        texts[i + 1] = " ".join([*template, *own[:same], *[f"p{i}x{k}" for k in range(len(own) - same)]])
    _, sets = shingle_counts(list(texts.items()))
    df = Counter(s for c in sets.values() for s in c)
    weigh = lambda s: 1 + IDF_SHARE * math.log((1 + n) / (1 + df[s])) / math.log(1 + n)
    total = {i: sum(map(weigh, c)) for i, c in sets.items()}
    holders, common = defaultdict(list), Counter()
    for i, c in sets.items():
        for s in c:
            if df[s] < n:
                holders[s].append(i)
    for s, ids in holders.items():
        for pair in combinations(sorted(ids), 2):
            common[pair] += weigh(s)
    base = sum(weigh(s) for s, f in df.items() if f == n)
    similar = lambda a, b, c: c / (total[a] + total[b] - c)
    light = sorted(total.values())[:2]
    assert 0.7 < base / (sum(light) - base) < 0.79
    want = {pair for pair, c in common.items() if similar(*pair, base + c) >= 0.8}
    assert len(want) > 30
    got = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    least = {b: a for a, b in want}
    assert {r.doc_id: r.class_id for r in got} == {i: least.get(i, i) for i in texts}


def test_rare_prefixes_leave_out_no_link():
    draw = np.random.default_rng(4)
    df = draw.integers(1, 50, 400)
    for _ in range(300):
        a = np.sort(draw.choice(400, 120, replace=False))
        b = np.sort(np.unique(np.concatenate([draw.choice(a, draw.integers(90, 120), replace=False), draw.choice(400, draw.integers(0, 25), replace=False)])))
        wa, wb = (draw.choice([1.0, 1.2, 2.0], 400, p=[0.8, 0.15, 0.05])[x] for x in (a, b))
        both, ia, ib = np.intersect1d(a, b, return_indices=True)
        least = np.minimum(wa[ia], wb[ib]).sum()
        if least / (wa.sum() + wb.sum() - least) >= 0.8:
            (pa, ra), (pb, rb) = rare_prefix(a, wa, df[a], 0.8), rare_prefix(b, wb, df[b], 0.8)
            _, ia, ib = np.intersect1d(pa, pb, return_indices=True)
            assert ((ra[ia] >= wb.sum()) & (rb[ib] >= wa.sum())).any()


def test_all_likely_pairs_of_a_small_block():
    links = block_links(np.arange(ALL_PAIRS), np.zeros((ALL_PAIRS, 56), np.uint8), 0.64)
    assert {tuple(x) for x in links.tolist()} == set(combinations(range(ALL_PAIRS), 2))


@pytest.mark.parametrize("share", [0.2, 1.0])
def test_recall_at_other_inverse_frequencies(spark, share):
    """All pairs against brute force where inverse frequency counts a fifth, as by default, and in full."""
    draw = random.Random(8)
    words = [f"w{k}" for k in range(600)]
    texts = {}
    for i in range(0, 240, 2):
        text = [draw.choice(words) for _ in range(120)]
        texts[i] = " ".join(text)
        for _ in range(draw.choice([0, 1, 2, 3, 4])):
            text[draw.randrange(120)] = draw.choice(words)
        texts[i + 1] = " ".join(text)
    _, sets = shingle_counts(list(texts.items()))
    n, df = len(texts), Counter(s for c in sets.values() for s in c)
    weight = {i: {s: k * (1 + share * math.log((1 + n) / (1 + df[s])) / math.log(1 + n)) for s, k in c.items()} for i, c in sets.items()}
    want = {i: i for i in texts}
    for i in range(0, 240, 2):
        a, b = weight[i], weight[i + 1]
        common = sum(min(w, b[s]) for s, w in a.items() if s in b)
        if common / (sum(a.values()) + sum(b.values()) - common) >= 0.8:
            want[i + 1] = i
    got = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), idf_share=share).collect()
    assert {r.doc_id: r.class_id for r in got} == want and 20 < sum(i != k for i, k in want.items()) < 120

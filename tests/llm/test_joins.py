"""The n-gram Jaccard join, centroid clustering and the prefix trie against brute force."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from answerloom.llm import tokengroups
from answerloom.llm.centroids import cluster_vectors, lookup_table, nearest
from answerloom.llm.oracle import TRIE
from answerloom.llm.prefixes import left_extents, neighbour_prefixes, prefix_trie, range_minima, right_extents, sparse_table
from answerloom.llm.tables import pieces
from answerloom.llm.tokengroups import jaccard_components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def jaccard_brute(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append((i, frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])))
    least = {}
    for i, s in sets:
        if i is not None and s:
            least[s] = min(least.get(s, i), i)
    root = {i: i for i in least.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    both = list(least.items())
    for k, (s, i) in enumerate(both):
        for o, j in both[:k]:
            if 100 * len(s & o) >= 85 * len(s | o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(least[s]) if s else i) for i, s in sets), key=repr)


@pytest.fixture(scope="module")
def template(spark):
    """A family of near copies that holds half of all rows, some of them just below the threshold of each other."""
    draw = random.Random(1)
    words = [f"w{k}" for k in range(200)]
    base = [[draw.choice(words) for _ in range(n)] for n in (150, 150, 40, 20, 9, 5, 2)]
    rows = []
    for i in range(420):
        text = list(base[0] if i % 2 else draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 3, 4])):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((i * 11 % 420, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("group,chunk", [(256, 256), (12, 5)])
def test_jaccard_family(template, monkeypatch, group, chunk):
    monkeypatch.setattr(tokengroups, "GROUP_DOCS", group)
    monkeypatch.setattr(tokengroups, "CHUNK_DOCS", chunk)
    df, rows = template
    assert rows_of(jaccard_components(df), "doc_id", "n_shingles", "component_id") == jaccard_brute(rows)


def test_jaccard_edges(documents, rows, nothing):
    got = rows_of(jaccard_components(documents), "doc_id", "n_shingles", "component_id")
    assert got == jaccard_brute(rows)
    assert jaccard_components(nothing).count() == 0


def test_bound_opens_only_near_groups():
    import pyarrow as pa

    def made(ids, sets):
        keys = [np.sort(np.array(s, np.uint64)) for s in sets]
        return pa.table({"doc_id": ids, "n_shingles": [len(s) for s in sets], "members": [k.tobytes() for k in keys]})

    members = made([1, 2], [range(100), range(50, 150)])
    queries = made([7, 8, 9], [[*range(95), *range(500, 505)], [*range(80), *range(500, 520)], range(25, 125)])
    a, b, opens = tokengroups.open_group(members, queries, 85)
    assert opens == 2 and a.tolist() == [7] and b.tolist() == [1]  # 8 stays shut, 9 opens and finds none


def test_reach_is_exact():
    for n in range(1, 40):
        for at in range(n):
            most = int(tokengroups.reach(np.array([n]), np.array([at]), 85)[0])
            want = [m for m in range(n - at, 3 * n + 2) if 100 * (n - at) >= 85 * (n + m - (n - at))]
            assert max(want, default=0) <= max(most, 0)
            assert not want or most == max(want)


def test_pieces_follow_the_input(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "uuid() as text").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.answerloom.pieceBytes", "1m")
    try:
        assert pieces(df, 2) > 5 and pieces(df.limit(0), 3) >= 3 and pieces(df, 1000) == 1000
    finally:
        spark.conf.unset("spark.answerloom.pieceBytes")


def clusters_brute(rows, k, rounds, dims, seed=2):
    keep = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for i, v in sorted(((i, v) for i, v in keep if i is not None), key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in keep]
        groups = [[v for (_, v), a in zip(keep, at, strict=True) if a == j] for j in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    end, total = [near(v) for _, v in keep], {}
    for d, j in end:
        total[j] = total.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, total[j], sum(total.values()), digest[j]) for (i, _), (d, j) in zip(keep, end, strict=True)), key=repr)


def test_clusters(spark):
    draw = random.Random(4)
    rows = [(i, [draw.gauss(i % 3, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [rows[1], (rows[2][0], rows[3][1]), (None, rows[4][1])]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 7), (304, [None] + [1.0] * 5), (305, [float("nan")] * 6), (306, [float("inf")] * 6), (307, [1e5, -1e5, 0.0, 0.0, 0.0, -0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int")
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    for k, rounds in ((7, 3), (1, 0), (1000, 2)):
        assert rows_of(cluster_vectors(df, dims=6, k=k, rounds=rounds), *names) == clusters_brute(rows, k, rounds, 6)
    assert cluster_vectors(df.limit(0), dims=6).count() == 0 and cluster_vectors(df.filter("vec_id > 299 and vec_id < 307"), dims=6).count() == 0
    with pytest.raises(Exception, match="beyond"):
        cluster_vectors(spark.createDataFrame([(1, [1e9] * 6)], "vec_id long, embedding array<double>"), dims=6).count()


def test_tables_are_distances():
    draw = np.random.default_rng(0)
    for spread in (5, 10**6):
        v, c = draw.integers(-spread, spread, (9000, 5)), draw.integers(-spread, spread, (11, 5))
        place, table = lookup_table(v[:, 0], c[:, 0])
        assert (table[place] == (v[:, :1] - c[None, :, 0]) ** 2).all() and len(table) <= len(np.unique(v[:, 0]))
        full = ((v[:, None, :] - c[None]) ** 2).sum(2)
        cluster, distance = nearest(v, c)
        assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()


def trie_brute(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            role, text = r or "", x or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((t is not None, t or 0, digest, role, text))
    own = {c: [v[3:] for v in sorted(t)] for c, t in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    turns = {c: tuple(own.get(c - c % 20, [])[: heads[c]] + own[c][heads[c] :]) for c in own}
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, s in turns.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        words = (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] = saved.get(p[:d], 0) + words
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
    ends = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if turns[c] == p))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], ends(p, m)) for p, m in members.items()), key=repr)


TRIE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("ranges", [1, 16])
def test_trie(spark, ranges):
    draw = random.Random(ranges)
    rows = []
    for c in draw.sample(range(600), 300):
        if draw.random() < 0.3:  # one conversation that many repeat
            rows += [(c, t, "user", "same words here") for t in range(6)]
        else:
            rows += [(c, t if t else draw.choice([0, None]), draw.choice(["u", None]), draw.choice(["a b", "a  b", "", None, "x"])) for t in range(draw.choice([1, 2, 3, 8]))]
    rows += [(None, 1, "u", "x"), rows[0], rows[0], (10**12, 5, "u", "word " * 30_000), (10**12 + 1, 1, None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, n int, depth int")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        assert rows_of(prefix_trie(df), *TRIE_COLUMNS) == trie_brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert prefix_trie(df.limit(0)).count() == 0 and prefix_trie(df.filter("conv_id is null")).count() == 0
    con = duckdb.connect()
    con.register("conversations", df.toPandas().convert_dtypes())
    cur = con.execute(TRIE)
    at = [[c[0] for c in cur.description].index(name) for name in TRIE_COLUMNS]
    assert sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr) == trie_brute(rows)


def test_extents():
    draw = np.random.default_rng(2)
    rows = sorted({tuple(draw.integers(0, 3, draw.integers(0, 7)).tolist()) for _ in range(200)})
    offset = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    flat = np.array([x for r in rows for x in r], np.uint64)
    shared = neighbour_prefixes(np.column_stack([flat, flat]), offset)
    table = sparse_table(shared)
    for i, r in enumerate(rows):
        for d in range(len(r) + 1):
            same = [j for j, o in enumerate(rows) if o[:d] == r[:d] and len(o) >= d]
            assert left_extents(table, np.array([i]), np.array([d]))[0] == same[0] and right_extents(table, np.array([i]), np.array([d]))[0] == same[-1]
    first, last = np.array([0, 3, 5]), np.array([0, 9, len(rows) - 1])
    assert range_minima(table, first, last).tolist() == [shared[a : b + 1].min() for a, b in zip(first, last, strict=True)]

"""Near copies: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.arrays import Words, bucket_cuts, joined, mix, pack_sorted, row_slices, run_hashes, unpack_sorted
from answerloom.llm.components import connected_components
from answerloom.llm.tables import in_shards, partitions, pieces, stored

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: How much more a shingle of one document weighs than one of all. Among copies of a large group the
#: words they share are frequent and their edits are rare, so a full inverse frequency would count every edit double.
IDF_SHARE = 0.2
#: Samples: BANDS bands of ROWS each. Two texts of similarity 0.8 share a band with probability 0.9994.
BANDS, ROWS = 14, 4
#: Documents of a block of a bucket, and the documents every block of a large bucket has in common.
BLOCK_DOCS, HUBS = 256, 4
#: Documents of a bucket up to which all its pairs are verified; those of larger ones are also compared by their rare shingles.
ALL_PAIRS = 16
#: Documents of either side that a task compares by one rare shingle.
SIDE_DOCS = 1024
#: Share of equal samples from which a pair is verified: the threshold less three standard deviations of the share.
SLACK = 3 * (THRESHOLD * (1 - THRESHOLD) / (BANDS * ROWS)) ** 0.5
#: Shingles that are sampled together, so that the arrays stay in a core's cache.
SAMPLE_ROWS = 1 << 15
_LIMIT = np.uint64(0xFFFFFFFF)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Distinct shingles of each text, by text and hash: (row, hash, how often), and the words. Case of A-Z doesn't matter."""
    words = Words.of(texts)
    upper = (words.data >= 65) & (words.data <= 90)
    words.data[upper] += 32
    hashes = words.hashes()
    runs = run_hashes(hashes, k)
    inside = words.row[: len(runs)] == words.row[len(words.row) - len(runs) :]
    row, key = words.row[: len(runs)][inside], runs[inside]
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))) if len(key) else np.empty(0, np.int64)
    words.hash = hashes
    return row[begin], key[begin], np.diff(np.append(begin, len(key))), words


def text_digests(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's sequence of words."""
    n, hashes = len(words.offsets) - 1, words.hash
    place = (np.arange(len(hashes)) - words.first[words.row]).astype(np.uint64)
    out = []
    for seed in (0x51, 0xA7):
        each = mix(joined(hashes, mix(place + np.uint64(seed))))
        total = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
        out.append(mix(total[words.first[1:]] - total[words.first[:-1]] + np.diff(words.first).astype(np.uint64)).view(np.int64))
    assert len(out[0]) == n
    return out[0], out[1]


def inverse_frequency(df: np.ndarray, n_docs: int, share: float = IDF_SHARE) -> np.ndarray:
    """1 for a shingle of all documents, nearly 1 + ``share`` for one of a single document, by the logarithm between."""
    return 1 + share * np.log((1 + n_docs) / (1 + np.minimum(df, n_docs))) / np.log(1 + max(n_docs, 1))


def _units(x: np.ndarray) -> np.ndarray:
    """Two numbers of the open unit interval from each 64-bit hash."""
    return (x.view(np.uint32).reshape(-1, 2) >> np.uint32(8)).astype(np.int32).astype(np.float32) * np.float32(2**-24) + np.float32(2**-26)


def weighted_samples(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n_rows: int, n_samples: int) -> np.ndarray:
    """Improved consistent weighted sampling: for each row and sample 32 bits of the (shingle, level) drawn.

    For every shingle and sample r and c are drawn from Gamma(2, 1) and b from the unit interval, by
    hashes of both; with t = floor(ln w / r + b) the shingle of least ln c - r (t - b) - r is drawn
    together with t. Two rows draw the same with the probability of their weighted Jaccard similarity.
    """
    out = np.zeros((n_rows, n_samples), np.uint32)
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
    cut = 0
    while cut < len(starts):
        stop = int(np.searchsorted(starts, starts[cut] + SAMPLE_ROWS, side="left"))
        stop = max(stop, cut + 1)
        a, z = int(starts[cut]), int(starts[stop]) if stop < len(starts) else len(row)
        k, log_w, begin = key[a:z], np.log(weight[a:z]).astype(np.float32), starts[cut:stop] - a
        place = np.arange(z - a, dtype=np.uint64)
        for s in range(n_samples):
            x = mix(k + np.uint64((s + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            u, v = _units(x).T, _units(mix(x)).T
            r = -np.log(u[0] * u[1])
            # The low 8 bits of each half are in no unit number; 16 of them make b.
            c = np.maximum(-np.log(v[0] * v[1]), np.float32(1e-9))
            b = (((x >> np.uint64(24)) & np.uint64(0xFF00)) | (x & np.uint64(0xFF))).astype(np.int32).astype(np.float32) * np.float32(2**-16)
            t = np.floor(log_w / r + b)
            score = np.log(c) - r * (t - b + 1)
            bits = score.astype(np.float32).view(np.uint32)
            ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
            chosen = (np.minimum.reduceat((ordered << np.uint64(32)) | place, begin) & _LIMIT).astype(np.int64)
            out[row[a + begin], s] = (joined(k[chosen], t[chosen].astype(np.int64).view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        cut = stop
    return out


def _distinct_in_shard(docs: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a shard and how many of its documents hold each. Differences of 56-bit hashes keep what is sent small."""
    parts = [shingles(part.column("text"), k)[1] >> np.uint64(8) << np.uint64(8) for part in row_slices(docs.to_batches(), "text")]
    return np.unique(np.concatenate(parts), return_counts=True)


def _frequency_rows(k: int, buckets: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        keys, counts = _distinct_in_shard(docs, k)
        cuts = bucket_cuts(keys, buckets)
        rows = [(b, slice(i, j)) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
        return pa.table({
            "bucket": pa.array([b for b, _ in rows], pa.int32()), "shard": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "keys": pa.array([pack_sorted(keys[s] >> np.uint64(8)) for _, s in rows], pa.binary()), "counts": pa.array([_pack_counts(counts[s]) for _, s in rows], pa.binary()),
        })

    return run


def _pack_counts(counts: np.ndarray) -> bytes:
    """Which counts are above one, then those, in four bytes each."""
    return np.packbits(counts > 1).tobytes() + counts[counts > 1].astype("<u4").tobytes()


def _unpack_counts(packed: bytes, n: int) -> np.ndarray:
    many = np.unpackbits(np.frombuffer(packed, np.uint8, (n + 7) // 8), count=n).astype(bool)
    counts = np.ones(n, np.int64)
    counts[many] = np.frombuffer(packed, "<u4", offset=(n + 7) // 8)
    return counts


def _document_frequencies(key: tuple, group: pa.Table) -> pa.Table:
    """All shards' shingles of one range to each shard's counts over all documents, in the shard's own order."""
    parts = [unpack_sorted(x) for x in group.column("keys").to_pylist()]
    counts = np.concatenate([_unpack_counts(c, len(x)) for c, x in zip(group.column("counts").to_pylist(), parts, strict=True)])
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    fresh = np.append(True, keys[order][1:] != keys[order][:-1])
    total = np.empty(len(keys), np.int64)
    total[order] = np.add.reduceat(counts[order], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    ends = np.cumsum([len(x) for x in parts])
    return pa.table({
        "shard": group.column("shard"), "bucket": pa.array([key[0].as_py()] * len(parts), pa.int32()),
        "counts": pa.array([_pack_counts(np.minimum(total[e - len(x) : e], 2**32 - 1)) for x, e in zip(parts, ends, strict=True)], pa.binary()),
    })


class Frequencies:
    """Document frequencies of a shard's shingles, from what the ranges sent back."""

    def __init__(self, docs: pa.Table, counts: pa.Table, k: int, buckets: int) -> None:
        self.keys, _ = _distinct_in_shard(docs, k)
        cuts = bucket_cuts(self.keys, buckets)
        self.df = np.ones(len(self.keys), np.int64)
        for bucket, packed in zip(counts.column("bucket").to_pylist(), counts.column("counts").to_pylist(), strict=True):
            if bucket >= 0:
                i, j = int(cuts[bucket]), int(cuts[bucket + 1])
                self.df[i:j] = _unpack_counts(packed, j - i)

    def of(self, key: np.ndarray) -> np.ndarray:
        return self.df[np.searchsorted(self.keys, key >> np.uint64(8) << np.uint64(8))]

    def weights(self, key: np.ndarray, tf: np.ndarray, n_docs: int, share: float) -> np.ndarray:
        return tf * inverse_frequency(self.of(key), n_docs, share)


def _signature_rows(k: int, buckets: int, n_docs: int, share: float):
    def run(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
        frequencies, out = Frequencies(docs, counts, k, buckets), []
        for part in row_slices(docs.to_batches(), "text"):
            row, shingle, tf, words = shingles(part.column("text"), k)
            samples = weighted_samples(row, shingle, frequencies.weights(shingle, tf, n_docs, share), part.num_rows, BANDS * ROWS)
            d1, d2 = text_digests(words)
            bands = np.empty((part.num_rows, BANDS), np.uint64)
            for b in range(BANDS):
                band = mix(np.full(part.num_rows, b, np.uint64))
                for s in range(b * ROWS, (b + 1) * ROWS):
                    band = joined(band, samples[:, s].astype(np.uint64))
                bands[:, b] = band
            some = np.bincount(row, minlength=part.num_rows) > 0
            offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            sketch = np.ascontiguousarray(samples.astype(np.uint8))
            out.append(pa.table({
                "doc_id": part.column("doc_id"), "d1": pa.array(d1), "d2": pa.array(d2),
                "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[some].ravel().view(np.int64))),
                "sketch": pa.array([x.tobytes() for x in sketch], pa.binary()),
            }))
        return pa.concat_tables(out)

    return run


def rare_prefix(short: np.ndarray, weight: np.ndarray, df: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of a document, one of which any text as similar as ``threshold`` shares, and how heavy such a text can be.

    All documents order shingles alike, by frequency and hash. If the first one that two have in common
    stands behind a weight of x in a document of weight w, both share w - x at most. At the threshold they
    share threshold / (1 + threshold) of the sum of their weights, so the other weighs (w - x) (1 + threshold)
    / threshold - w at most; and it weighs threshold * w at least.
    """
    order = np.lexsort((short, df))
    w, total = weight[order], weight.sum()
    reach = (total - np.cumsum(w) + w) * (1 + threshold) / threshold * (1 + 1e-6) - total
    some = reach >= threshold * total
    return short[order][some], reach[some]


def _vector_rows(k: int, buckets: int, n_docs: int, threshold: float, share: float):
    """Wanted documents' shingles: 32 bits of each hash, sorted, and the weight as a logarithm in 16 bits; with bucket -2 also the rare prefix."""
    schema = pa.schema([("doc_id", pa.int64()), ("vector", pa.binary()), ("weight", pa.float64()), ("prefix", pa.list_(pa.int32())), ("reach", pa.list_(pa.float64()))])

    def run(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        wanted = pc.unique(counts.column("doc_id").combine_chunks().drop_null())
        if not len(wanted):
            return schema.empty_table()
        in_large = pc.unique(counts.filter(pc.equal(counts.column("bucket"), -2)).column("doc_id").combine_chunks())
        frequencies, out = Frequencies(docs, counts, k, buckets), []
        chosen = docs.filter(pc.is_in(docs.column("doc_id"), value_set=wanted))
        for part in row_slices(chosen.to_batches(), "text"):
            row, shingle, tf, _ = shingles(part.column("text"), k)
            short = (shingle >> np.uint64(32)).astype("<u4")  # still in order within a row
            weight = np.minimum(np.log2(frequencies.weights(shingle, tf, n_docs, share)) * 2048, 65535).astype("<u2")
            first = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
            spans = list(zip(first, first[1:], strict=False))
            vectors = [short[a:z].tobytes() + weight[a:z].tobytes() for a, z in spans]
            exact, df = np.exp2(weight / 2048.0), frequencies.of(shingle)
            large = pc.is_in(part.column("doc_id"), value_set=in_large).to_pylist()
            rare = [rare_prefix(short[a:z], exact[a:z], df[a:z], threshold) if yes else (None, None) for (a, z), yes in zip(spans, large, strict=True)]
            out.append(pa.table({
                "doc_id": part.column("doc_id"), "vector": pa.array(vectors, pa.binary()), "weight": pa.array([float(exact[a:z].sum()) for a, z in spans], pa.float64()),
                "prefix": pa.array([None if x is None else x.view("<i4") for x, _ in rare], pa.list_(pa.int32())), "reach": pa.array([x for _, x in rare], pa.list_(pa.float64())),
            }, schema=schema))
        return pa.concat_tables(out)

    return run


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Sum of lesser weights by sum of greater ones over the shingles of both."""
    (ka, wa), (kb, wb) = ((np.frombuffer(v, "<u4", len(v) // 6), np.exp2(np.frombuffer(v, "<u2", offset=len(v) // 6 * 4) / 2048.0)) for v in (a, b))
    if not len(ka) or not len(kb):
        return 0.0
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = kb[at] == ka
    common = np.minimum(wa[both], wb[at[both]]).sum()
    return float(common / (wa.sum() + wb.sum() - common))


def block_links(doc: np.ndarray, sketch: np.ndarray, least: float) -> np.ndarray:
    """Pairs of a block to verify first: all that may be links if it is small, else a spanning forest of the strongest estimates, and each document's two strongest."""
    n = len(doc)
    if n <= ALL_PAIRS:
        a, b = np.triu_indices(n, 1)
        likely = (sketch[a] == sketch[b]).mean(axis=1) >= least
        return np.column_stack([a[likely], b[likely]])
    same = np.zeros((n, n), np.float32)
    for s in range(sketch.shape[1]):
        same += sketch[:, s, None] == sketch[None, :, s]
    same /= sketch.shape[1]
    np.fill_diagonal(same, -1)
    pairs = []
    for nth in (1, 2):
        best = np.argpartition(-same, nth - 1, axis=1)[:, nth - 1]
        strong = same[np.arange(n), best] >= least
        pairs.append(np.column_stack([np.flatnonzero(strong), best[strong]]))
    near, source, outside = same[0].copy(), np.zeros(n, np.int64), np.ones(n, bool)
    outside[0] = False
    for _ in range(n - 1):
        v = int(np.argmax(np.where(outside, near, -2)))
        outside[v] = False
        if near[v] >= least:
            pairs.append(np.array([[source[v], v]]))
        closer = outside & (same[v] > near)
        near[closer], source[closer] = same[v][closer], v
    return np.concatenate(pairs)


def _candidate_pairs(least: float):
    """Rows (key, block, doc_id, sketch), sorted by key and block, to pairs; a block is looked at in pieces of four times its intended size."""

    def emit(doc: np.ndarray, sketches: list[bytes]) -> np.ndarray:
        doc, at = np.unique(doc, return_index=True)
        if len(doc) < 2:
            return np.empty((0, 2), np.int64)
        pairs = block_links(doc, np.frombuffer(b"".join(sketches[i] for i in at.tolist()), np.uint8).reshape(len(doc), -1), least)
        return np.sort(doc[pairs], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, docs, sketches, found, size = None, [], [], [], 0
        for batch in batches:
            key = np.column_stack([batch.column("key").to_numpy(), batch.column("block").to_numpy()])
            ids, own = batch.column("doc_id").to_numpy(), batch.column("sketch").to_pylist()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if held_key is not None and (tuple(key[a]) != held_key or len(docs) >= 4 * BLOCK_DOCS):
                    found.append(emit(np.array(docs), sketches))
                    docs, sketches = [], []
                held_key = tuple(key[a])
                docs += ids[a:z].tolist()
                sketches += own[a:z]
            size = sum(map(len, found))
            if size >= 1 << 16:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
                found = []
        if docs:
            found.append(emit(np.array(docs), sketches))
        if sum(map(len, found)):
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, i, j, other, doc_id, label, weight, reach), sorted by the first three, to pairs of other and not other whose weights are in each other's reach."""
    names, found, held = ["k", "i", "j", "other", "doc_id", "label", "weight", "reach"], [], None

    def emit(rows: list[np.ndarray]) -> None:
        _, _, _, other, doc, label, weight, reach = rows
        x, y = np.flatnonzero(other), np.flatnonzero(~other)
        a, b = np.nonzero((weight[x, None] <= reach[y]) & (weight[y] <= reach[x, None]) & (label[x, None] != label[y]))
        if len(a):
            found.append(np.unique(np.sort(np.column_stack([doc[x[a]], doc[y[b]]]), axis=1), axis=0))

    def flush() -> Iterator[pa.RecordBatch]:
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            found.clear()
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        rows = [batch.column(name).to_numpy(zero_copy_only=False) for name in names]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])) + 1
        cuts = [0, *new.tolist()]
        for a, z in zip(cuts, cuts[1:], strict=False):
            emit([x[a:z] for x in rows])
            if sum(map(len, found)) >= 1 << 16:
                yield from flush()
        held = [x[cuts[-1] :] for x in rows]
    if held is not None:
        emit(held)
    yield from flush()


def prefix_pairs(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b) of different labels that may be links by their rare prefixes: no pair of documents with a prefix is left out.

    Of two such documents the lighter one has the first shared shingle where its reach is its own weight or more.
    A shingle without such a row, or with one label, needs no look. Of the others, the rows outside the commonest label
    meet all rows, in blocks.
    """
    post = vectors.filter("prefix is not null").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "weight", F.coalesce("label", "doc_id").alias("label"), F.explode(F.arrays_zip("prefix", "reach")).alias("at")
    )
    post = stored(post.select(F.col("at.prefix").alias("k"), "doc_id", "label", "weight", F.col("at.reach").alias("reach")))
    lighter = F.col("reach") >= F.col("weight")
    limits = stored(post.groupBy("k").agg(
        F.min(F.when(lighter, F.col("weight"))).alias("least"), F.max(F.when(lighter, F.col("reach"))).alias("most"), F.min("label").alias("l0"), F.max("label").alias("l1")
    ).filter("least is not null and l0 <> l1").drop("l0", "l1"))
    live = stored(post.join(limits, "k").filter("reach >= least and weight <= most").drop("least", "most"))
    counted = live.groupBy("k", "label").agg(F.count(F.lit(1)).alias("n"))
    tops = stored(counted.groupBy("k").agg(F.max_by("label", "n").alias("top"), F.sum("n").alias("all"), F.max("n").alias("same")).filter("all > same"))
    blocks = lambda n: F.ceil(n / SIDE_DOCS).cast("int")
    met = live.join(tops, "k").withColumns({"across": blocks(F.col("all")), "down": blocks(F.col("all") - F.col("same"))})
    own, dealt = F.array(F.lit(True), F.lit(False)), ["doc_id", "label", "weight", "reach"]
    met = met.withColumn("other", F.explode(F.when(F.col("label") != F.col("top"), own).otherwise(F.array(F.lit(False)))))
    met = met.withColumn("i", F.explode(F.when(F.col("other"), F.array(F.pmod(F.xxhash64("k", "doc_id"), "down").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("down") - 1))))
    met = met.withColumn("j", F.explode(F.when(F.col("other"), F.sequence(F.lit(0), F.col("across") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "k"), "across").cast("int")))))
    met = stored(met.select("k", "i", "j", "other", *dealt))
    return met.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(_crossed, "a long, b long").distinct()


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similarity = np.array([weighted_jaccard(x.as_py(), y.as_py()) for x, y in zip(batch.column("va"), batch.column("vb"), strict=True)], float)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similarity)], ["a", "b", "similarity"])
            yield out.filter(pa.array(similarity >= threshold))

    return run


def near_duplicate_links(docs: DataFrame, doc_id: str, text: str, threshold: float, k: int, idf_share: float = IDF_SHARE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep): each document and the least id with the same words; (a, b, similarity): verified links of such ids."""
    spark = docs.sparkSession
    shards = pieces(docs, 2 * partitions(spark))
    buckets = shards // 2
    n_docs = docs.filter(F.col(doc_id).isNotNull()).count()
    grouped = in_shards(docs, doc_id, text, shards).groupBy("shard")
    sent = grouped.applyInArrow(_frequency_rows(k, buckets), "bucket int, shard int, keys binary, counts binary")
    counts = stored(sent.groupBy("bucket").applyInArrow(_document_frequencies, "shard int, bucket int, counts binary"))
    signed = stored(grouped.cogroup(counts.groupBy("shard")).applyInArrow(
        _signature_rows(k, buckets, n_docs, idf_share), "doc_id long, d1 long, d2 long, bands array<long>, sketch binary"
    ))
    # Equal texts meet once, as the least id of them.
    reps = stored(signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))
    members = stored(signed.select("doc_id", "d1", "d2").join(reps, ["d1", "d2"]).select("doc_id", "rep"))
    own = reps.select(F.col("rep").alias("doc_id"))
    keys = stored(signed.select("doc_id", "bands").join(own, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("key")).distinct())
    first_by = [F.min_by("doc_id", F.xxhash64("doc_id", F.lit(h))).alias(f"hub{h}") for h in range(HUBS)]
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *first_by).filter("n > 1"))
    # A large bucket is dealt into blocks at random, other ones for each key; its hubs are in all of them.
    blocks = F.ceil(F.col("n") / BLOCK_DOCS).cast("int")
    is_hub = F.col("doc_id").isin(*[F.col(f"hub{h}") for h in range(HUBS)])
    dealt = keys.join(shared, "key").select(
        "doc_id", "key", F.explode(F.when(is_hub, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "key"), blocks).cast("int")))).alias("block")
    )
    sketched = stored(dealt).join(signed.select("doc_id", "sketch").dropDuplicates(["doc_id"]), "doc_id")
    pairs = sketched.repartition("key", "block").sortWithinPartitions("key", "block", "doc_id").mapInArrow(_candidate_pairs(threshold - SLACK), "a long, b long")
    pairs = stored(pairs.distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    in_large = keys.join(shared.filter(F.col("n") > ALL_PAIRS).select("key"), "key").select("doc_id").distinct()
    asked = counts.withColumn("doc_id", F.lit(None).cast("long"))
    for mark, ids in ((-1, ends), (-2, in_large)):
        wanted = in_shards(ids.withColumn("text", F.lit("")), "doc_id", "text", shards)
        asked = asked.unionByName(wanted.select("shard", F.lit(mark).alias("bucket"), F.lit(None).cast("binary").alias("counts"), "doc_id"))
    vectors = stored(grouped.cogroup(asked.groupBy("shard")).applyInArrow(
        _vector_rows(k, buckets, n_docs, threshold, idf_share), "doc_id long, vector binary, weight double, prefix array<int>, reach array<double>"
    ).dropDuplicates(["doc_id"]))

    def verified(pairs: DataFrame) -> DataFrame:
        met = pairs.join(vectors.select(F.col("doc_id").alias("b"), F.col("vector").alias("vb")), "b").join(vectors.select(F.col("doc_id").alias("a"), F.col("vector").alias("va")), "a")
        return stored(met.select("a", "b", "va", "vb").mapInArrow(_verified(threshold), "a long, b long, similarity double"))

    links = verified(pairs)
    # What blocks and estimates missed: documents of large buckets meet again by rare shingles unless links connect them already.
    missed = stored(prefix_pairs(vectors, connected_components(links)).join(pairs, ["a", "b"], "left_anti"))
    return members, links.unionByName(verified(missed))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, k: int = SHINGLE_WORDS, idf_share: float = IDF_SHARE) -> DataFrame:
    """One row per document: (doc_id, class_id, class_size, kept).

    Texts are sets of ``k``-word shingles (case of A-Z aside), weighted by how often the text has them and by
    how few documents do. A link is a weighted Jaccard similarity of ``threshold`` or more; classes are what
    links and equal word sequences connect, ``class_id`` the least id in one, and that document is kept.
    A shingle of one document weighs up to 1 + ``idf_share`` times as much as one of all. The number of a document's links is
    not returned: pairs that links connect already are not looked at.

    Document frequencies cover all documents: shards send packed distinct shingles to ranges of the hash
    space and get their counts back. Bands of samples make buckets. All pairs of a bucket of up to ``ALL_PAIRS``
    documents are verified if their samples allow a link. A larger one is compared in blocks of about ``BLOCK_DOCS``
    documents, drawn anew for each band and with ``HUBS`` documents in common, and a spanning forest of the
    block and each document's two nearest by estimates are verified. That connects most copies but is no proof
    for the rest, so all documents of such buckets then meet by their rare shingles (``prefix_pairs``), and every
    pair of different classes that an exact bound allows is verified.

    A text of fewer than ``k`` words has no shingles and is a copy only of the same words; a null text has none
    at all, like an empty one. Repeated rows of one id share a class. Rows without an id are each a class of their
    own, with a null ``class_id``. Other columns are ignored; an empty table gives an empty result.
    """
    members, links = near_duplicate_links(docs, doc_id, text, threshold, k, idf_share)
    labels = connected_components(links).select(F.col("node").alias("rep"), "label")
    classed = stored(members.join(labels, "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id")))
    sizes = stored(classed.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")))
    known = classed.join(sizes, "class_id").select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    none = F.lit(None).cast("long")
    alone = docs.filter(F.col(doc_id).isNull()).select(none.alias("doc_id"), none.alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return known.unionByName(alone)

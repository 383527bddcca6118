"""N-gram Jaccard join: similar documents in groups, a matrix of groups' token unions, and only groups within an overlap bound opened."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.arrays import Words, bucket_cuts, joined, mix, pack_sorted, positions_in, row_slices, run_hashes, unpack_sorted
from answerloom.llm.components import connected_components
from answerloom.llm.tables import partitions, pieces, stored, text_or_empty

SHINGLE_WORDS, PERCENT = 4, 85
#: A group ends at so many documents or shingles; queries of a group are dealt into chunks of about so many documents or shingles.
GROUP_DOCS, GROUP_KEYS = 256, 1 << 20
CHUNK_DOCS, CHUNK_KEYS = 256, 1 << 22
#: (query, member) meetings that are counted together.
MEETINGS = 1 << 22
#: Bits of a shingle's hash by which document frequencies are counted. They only put shingles into one order, so collisions cost time, not links.
ORDER_SHIFT = np.uint64(16)
SIGNATURES = 4


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set as (row, 64-bit hash) in order: distinct runs of ``k`` words, or of all if there are fewer; case of A-Z aside."""
    words = Words.of(texts)
    upper = (words.data >= 65) & (words.data <= 90)
    words.data[upper] += 32
    hashes = words.hashes()
    runs = run_hashes(hashes, k)
    inside = words.row[: len(runs)] == words.row[len(words.row) - len(runs) :]
    rows, keys = [words.row[: len(runs)][inside]], [runs[inside]]
    n_words = np.diff(words.first)
    for n in range(1, k):
        few = np.flatnonzero(n_words == n)
        key = mix(np.full(len(few), n, np.uint64))
        for j in range(n):
            key = joined(key, hashes[words.first[few] + j])
        rows.append(few)
        keys.append(key)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])) if len(key) else np.empty(0, bool)
    return row[fresh], key[fresh]


def pack_counts(counts: np.ndarray) -> bytes:
    """Which counts are above one, then those, in four bytes each."""
    counts = np.minimum(counts, 2**32 - 1)
    return np.packbits(counts > 1).tobytes() + counts[counts > 1].astype("<u4").tobytes()


def unpack_counts(packed: bytes, n: int) -> np.ndarray:
    many = np.unpackbits(np.frombuffer(packed, np.uint8, (n + 7) // 8), count=n).astype(bool)
    counts = np.ones(n, np.int64)
    counts[many] = np.frombuffer(packed, "<u4", offset=(n + 7) // 8)
    return counts


def _shard_sets(docs: pa.Table, k: int) -> list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    return [(part, *shingle_sets(part.column("text"), k)) for part in row_slices(docs.to_batches(), "text")]


def _tokens(sets: list, buckets: int, **what: bool) -> tuple:
    """The distinct tokens of a shard and the ends of their ranges, with what np.unique finds besides."""
    found = np.unique(np.concatenate([key >> ORDER_SHIFT for _, _, key in sets]), **what)
    return *found, bucket_cuts(found[0] << ORDER_SHIFT, buckets)


def _token_counts(k: int, buckets: int):
    """A shard's distinct tokens and how many of its documents hold each, cut at equal ranges."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        tokens, counts, cuts = _tokens(_shard_sets(docs, k), buckets, return_counts=True)
        rows = [(b, slice(i, j)) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
        return pa.table({
            "bucket": pa.array([b for b, _ in rows], pa.int32()), "shard": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "tokens": pa.array([pack_sorted(tokens[s]) for _, s in rows], pa.binary()), "counts": pa.array([pack_counts(counts[s]) for _, s in rows], pa.binary()),
        })

    return run


def _summed_counts(key: tuple, group: pa.Table) -> pa.Table:
    """All shards' tokens of one range to each shard's counts over all documents, in the shard's own order."""
    parts = [unpack_sorted(x) for x in group.column("tokens").to_pylist()]
    counts = np.concatenate([unpack_counts(c, len(x)) for c, x in zip(group.column("counts").to_pylist(), parts, strict=True)])
    _, number = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.zeros(number.max() + 1, np.int64)
    np.add.at(total, number, counts)
    ends = np.cumsum([len(x) for x in parts])
    return pa.table({
        "shard": group.column("shard"), "bucket": pa.array([key[0].as_py()] * len(parts), pa.int32()),
        "counts": pa.array([pack_counts(total[number[e - len(x) : e]]) for x, e in zip(parts, ends, strict=True)], pa.binary()),
    })


def reach(size: np.ndarray, position: np.ndarray, percent: int) -> np.ndarray:
    """How large a set can be that links with one of ``size`` and first shares the token at ``position``, in any one order of all tokens.

    They have size - position tokens in common at most, and (100 + percent) times that must be ``percent`` times both sizes.
    """
    return (size - position) * (100 + percent) // percent - size


SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, places array<long>, tokens array<struct<token:long,reach:long>>, shared boolean, members binary"


def _signed(k: int, buckets: int, percent: int):
    """A shard's documents: size and digest of the set; if a token of its prefix has another document, also its place among
    similar ones, those tokens, and the set."""

    def run(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
        sets = _shard_sets(docs, k)
        tokens, number, cuts = _tokens(sets, buckets, return_inverse=True)
        frequency = np.ones(len(tokens), np.int64)
        for bucket, packed in zip(counts.column("bucket").to_pylist(), counts.column("counts").to_pylist(), strict=True):
            i, j = int(cuts[bucket]), int(cuts[bucket + 1])
            frequency[i:j] = unpack_counts(packed, j - i)
        out, done = [], 0
        for part, row, keys in sets:
            df = frequency[number[done : done + len(keys)]]
            done += len(keys)
            size = np.bincount(row, minlength=part.num_rows)
            first = np.concatenate([[0], np.cumsum(size)])
            digests = []
            for seed in (0x51, 0xA7):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(keys + np.uint64(seed)), dtype=np.uint64)])
                digests.append(mix(total[first[1:]] - total[first[:-1]]).view(np.int64))
            by = np.lexsort((keys, df, row))
            reaches = reach(size[row], np.arange(len(keys)) - first[row], percent)
            prefix = (100 * reaches >= percent * size[row]) & (df[by] > 1)
            has_id = ~pc.is_null(part.column("doc_id")).to_numpy(zero_copy_only=False)
            prefix &= has_id[row]
            owner = row[prefix]
            chosen = pa.StructArray.from_arrays([pa.array(keys[by[prefix]].view(np.int64)), pa.array(reaches[prefix])], ["token", "reach"])
            n_shared = np.bincount(owner, minlength=part.num_rows)
            shared = n_shared > 0
            some = np.flatnonzero(size)
            places = np.zeros((part.num_rows, SIGNATURES), np.uint64)
            for s in range(SIGNATURES):
                if len(some):
                    places[some, s] = np.minimum.reduceat(mix(keys ^ np.uint64(0x9E3779B97F4A7C15 * (s + 1) & 0xFFFFFFFFFFFFFFFF)), first[some])
            ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            out.append(pa.table({
                "doc_id": part.column("doc_id"), "n_shingles": size, "d1": digests[0], "d2": digests[1],
                "places": pa.ListArray.from_arrays(ends(shared * SIGNATURES), pa.array(places[shared].ravel().view(np.int64))),
                "tokens": pa.ListArray.from_arrays(ends(n_shared), chosen), "shared": shared,
                "members": pa.array([keys[a:z].tobytes() if s else None for a, z, s in zip(first[:-1].tolist(), first[1:].tolist(), shared.tolist(), strict=True)], pa.binary()),
            }))
        return pa.concat_tables(out)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers runs of neighbours as groups; a group also ends where the first signature changes, once it is a quarter full."""
    from pyspark import TaskContext

    number, docs, keys, place = TaskContext.get().partitionId() << 32, 0, 0, None
    for batch in batches:
        group = np.empty(batch.num_rows, np.int64)
        for k, (size, at) in enumerate(zip(batch.column("n_shingles").to_pylist(), batch.column("place").to_pylist(), strict=True)):
            if docs >= GROUP_DOCS or docs and keys + size > GROUP_KEYS or docs >= GROUP_DOCS // 4 and at != place:
                number, docs, keys = number + 1, 0, 0
            group[k], docs, keys, place = number, docs + 1, keys + size, at
        yield pa.RecordBatch.from_arrays([pa.array(group), *batch.columns[:-1]], ["group", *batch.schema.names[:-1]])


def _sets(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, set sizes, and all members as (number of the row, hash)."""
    sizes = rows.column("n_shingles").to_numpy()
    keys = np.frombuffer(b"".join(rows.column("members").to_pylist()), np.uint64)
    return rows.column("doc_id").to_numpy(), sizes, np.repeat(np.arange(len(sizes)), sizes), keys


def open_group(members: pa.Table, queries: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Linked (query, member) ids of one group, and how many queries opened it.

    A query's tokens in the group's union bound what it shares with any one member. Only queries that
    share enough of themselves with the union meet the members.
    """
    ids, sizes, owner, keys = _sets(members)
    q_ids, q_sizes, q_owner, q_keys = _sets(queries)
    order = np.argsort(keys, kind="stable")
    union, begin, holders = *np.unique(keys[order], return_index=True), owner[order]
    count = np.diff(np.append(begin, len(keys)))
    at = positions_in(union, q_keys)
    opens = 100 * np.bincount(q_owner[at >= 0], minlength=len(q_ids)) >= percent * q_sizes
    hit = (at >= 0) & opens[q_owner]
    at, q_owner = at[hit], q_owner[hit]
    meetings = np.concatenate([[0], np.cumsum(count[at])])
    by_query = meetings[np.searchsorted(q_owner, np.arange(len(q_ids) + 1))]
    a, b, cut = [], [], 0
    while cut < len(q_ids):
        stop = max(int(np.searchsorted(by_query, by_query[cut] + MEETINGS, side="right")) - 1, cut + 1)
        i, j = np.searchsorted(q_owner, [cut, stop])
        n = count[at[i:j]]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at[i:j]], n)
        pair = np.repeat(q_owner[i:j] - cut, n) * len(ids) + holders[place]
        both = np.bincount(pair, minlength=(stop - cut) * len(ids)).reshape(stop - cut, len(ids))
        x, y = np.nonzero((both > 0) & (100 * both >= percent * (q_sizes[cut:stop, None] + sizes[None, :] - both)))
        a.append(q_ids[x + cut])
        b.append(ids[y])
        cut = stop
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b]), int(opens.sum())


def _forest(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Links to one link from each id to the least one that these links reach, so that a dense group sends a row a document."""
    apart = a != b
    nodes, number = np.unique(np.column_stack([a[apart], b[apart]]), return_inverse=True)
    x, y = number.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[x], root[y]), root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"a": nodes[other].astype(np.int64), "b": nodes[root[other]].astype(np.int64)})


def _inner_links(percent: int):
    def run(key: tuple, members: pa.Table) -> pa.Table:
        return _forest(*open_group(members, members, percent)[:2])

    return run


def _outer_links(percent: int):
    def run(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
        return _forest(*open_group(members, queries, percent)[:2]) if members.num_rows and queries.num_rows else _forest(np.empty(0, np.int64), np.empty(0, np.int64))

    return run


def opened(groups: DataFrame, asked: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that documents find in the groups they ask: (doc_id, group). A group that many ask is opened in chunks of them."""
    names = ["doc_id", "n_shingles", "members"]
    sets = groups.select(names).toDF(*names)
    sizes = asked.join(sets.drop("members"), "doc_id").groupBy("group").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("keys"))
    chunks = stored(sizes.select("group", F.greatest(F.ceil(F.col("docs") / CHUNK_DOCS), F.ceil(F.col("keys") / CHUNK_KEYS)).cast("int").alias("chunks")))
    queries = asked.join(chunks, "group").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), "chunks").cast("int")).join(sets, "doc_id").select("group", "chunk", *names)
    members = groups.join(chunks, "group").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("group", "chunk", *names)
    return stored(members.groupBy("group", "chunk").cogroup(queries.groupBy("group", "chunk")).applyInArrow(_outer_links(percent), "a long, b long"))


def first_asked(matrix: DataFrame) -> DataFrame:
    """Every document asks, for each token of its prefix, the group of the least document with that token, if their sizes allow a link; its own it has met already."""
    hub = F.min_by(F.struct("group", "n_shingles", "reach"), "doc_id").alias("hub")
    hubs = matrix.groupBy("token").agg(hub, F.count(F.lit(1)).alias("n")).filter("n > 1")
    near = (F.col("hub.n_shingles") <= F.col("reach")) & (F.col("n_shingles") <= F.col("hub.reach"))
    return matrix.join(hubs, "token").filter((F.col("group") != F.col("hub.group")) & near).select("doc_id", F.col("hub.group").alias("group")).distinct()


def last_asked(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, group) left to be asked, so that no link between different labels is missed.

    The first token that linked documents have in common stands where either one's reach is the other's size or more.
    Tokens whose documents have one label need no look. Of any other, the documents outside its commonest
    label ask the groups that hold it for documents of another label within reach.
    """
    named = stored(matrix.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
    mixed = named.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("n_shingles").alias("least"), F.max("reach").alias("most")).filter("l0 <> l1")
    live = stored(named.join(mixed, "token").filter("reach >= least and n_shingles <= most").drop("l0", "l1", "least", "most"))
    top = live.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("top"))
    held = live.groupBy("token", "group").agg(
        F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("n_shingles").alias("least"), F.max("reach").alias("most")
    )
    asking = live.join(top, "token").filter("label <> top").select("token", "doc_id", "label", "n_shingles", "reach")
    return asking.join(held, "token").filter("least <= reach and n_shingles <= most and (l0 <> label or l1 <> label)").select("doc_id", "group").distinct()


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id).

    A document's set are its distinct runs of ``k`` words (case of A-Z aside), or all its words as one run if there are fewer. Two link if
    100 * intersection >= ``percent`` * union; ``component_id`` is the least id that links reach.

    (1) Shards of documents count in how many documents each shingle occurs. A set's prefix are its rarest shingles, so
    many that linked sets share one; a document none of whose prefix occurs elsewhere links with nothing. Equal sets go on as one.
    (2) The others are sorted by least hashes of their sets and cut into groups of similar documents; a group holds the union of its members' tokens.
    The matrix has a row for each prefix token and group that holds it. (3) Members of a group meet. Then each document asks the group
    of the least document with each of its tokens. (4) What is connected by then needs no further look: only documents whose token
    also stands in another component ask all groups that hold it (``last_asked``). A group that is asked bounds the query's overlap by its
    union and is opened only if that reaches ``percent`` of the query. All steps are exact, so no pair of different components is a link.
    The number of links of each document is not returned: within a component, pairs that are connected already are not compared.

    Null and empty texts have no shingles and link with nothing. Repeated rows of an id each give a row, by their own text. Rows
    without an id link with nothing and have a null ``component_id``. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shards = pieces(docs, 2 * partitions(spark))
    buckets = max(shards // 2, 1)
    spread = F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id))
    shard = F.pmod(spread, F.lit(shards)).cast("int")
    grouped = docs.select(shard.alias("shard"), F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).groupBy("shard")
    sent = grouped.applyInArrow(_token_counts(k, buckets), "bucket int, shard int, tokens binary, counts binary")
    counts = sent.groupBy("bucket").applyInArrow(_summed_counts, "shard int, bucket int, counts binary")
    signed = stored(grouped.cogroup(counts.groupBy("shard")).applyInArrow(_signed(k, buckets, percent), SIGNED))
    digest = ["n_shingles", "d1", "d2"]
    classes = stored(signed.filter("shared").groupBy(*digest).agg(F.min("doc_id").alias("rep")))
    own = signed.filter("shared").join(classes, digest).filter("doc_id = rep").dropDuplicates(digest)
    place = [F.col("places")[s] for s in range(SIGNATURES)]
    ranged = own.select("doc_id", "n_shingles", "tokens", "members", "places").repartitionByRange(shards, *place, "doc_id").sortWithinPartitions(*place, "doc_id")
    numbered = ranged.withColumn("place", F.col("places")[0]).drop("places")
    groups = stored(numbered.mapInArrow(_grouped, "group long, doc_id long, n_shingles long, tokens array<struct<token:long,reach:long>>, members binary"))
    matrix = stored(groups.select(F.inline("tokens"), "group", "doc_id", "n_shingles"))
    inner = stored(groups.groupBy("group").applyInArrow(_inner_links(percent), "a long, b long"))
    links = inner.union(opened(groups, stored(first_asked(matrix)), percent))
    links = links.union(opened(groups, stored(last_asked(matrix, connected_components(links))), percent))
    labels = connected_components(links).withColumnRenamed("node", "rep")
    known = stored(classes.join(labels, "rep", "left").select(*digest, F.coalesce("label", "rep").alias("component_id")))
    alone = signed.filter("not shared").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return alone.unionByName(signed.filter("shared").select("doc_id", *digest).join(known, digest).select("doc_id", "n_shingles", "component_id"))

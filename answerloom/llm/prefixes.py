"""Conversation prefix trie: sorted conversations, common prefix lengths of neighbours, member intervals by range minima."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.llm.tables import partitions, stored

#: Turns of a range of sorted conversations, which is one task's work; ids of a piece of a node's list.
RANGE_TURNS, PIECE_IDS = 500_000, 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, family: int, heads: int) -> DataFrame:
    """(conv_id, turns): each conversation's own turns by number behind those it shares with the first of its family.

    A turn is 128 bits of its role and text, and its text's number of words.
    """
    said, who = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said)))
    words = F.size(F.filter(F.split(said, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")).cast("long")
    turns = conversations.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), digest.alias("h"), words.alias("w")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = stored(own.select("conv_id", F.transform("t", lambda x: F.struct(x.h.alias("h"), x.w.alias("w"))).alias("own")))
    base = own.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, max(heads - 1, 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    both = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % family, "h": h}).join(base, "base", "left")
    head = F.when(F.col("head").isNull(), F.slice("own", 1, F.lit(0))).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return both.select("conv_id", F.concat(head, F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))).alias("turns"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sid, conv_id) in order to pieces of a sequence's ids, joined by commas."""
    for batch in batches:
        sid, ids = batch.column("sid").to_pylist(), batch.column("conv_id").to_pylist()
        cuts = [0]
        for k in range(1, len(sid) + 1):
            if k == len(sid) or sid[k] != sid[k - 1] or k - cuts[-1] >= PIECE_IDS:
                cuts.append(k)
        rows = [(sid[a], ids[a], ",".join(map(str, ids[a:z]))) for a, z in zip(cuts, cuts[1:], strict=False) if z > a]
        yield pa.RecordBatch.from_pydict({"sid": [r[0] for r in rows], "first": [r[1] for r in rows], "ids": [r[2] for r in rows]}, pa.schema([("sid", pa.string()), ("first", pa.int64()), ("ids", pa.string())]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to the digest of each sequence's whole list, as a stream."""
    held, state = None, None
    for batch in batches:
        done = []
        for sid, ids in zip(batch.column("sid").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if sid != held:
                if held is not None:
                    done.append((held, state.hexdigest()))
                held, state = sid, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.string())], ["sid", "ends"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([state.hexdigest()])], ["sid", "ends"])


def id_digests(members: DataFrame) -> DataFrame:
    """(sid, ends): SHA-256 of each sequence's ids in order. Ranges of the sorted ids become pieces, then a sequence's pieces stream through the hash."""
    ranged = members.select("sid", "conv_id").repartitionByRange(partitions(members.sparkSession), "sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    pieces = ranged.mapInArrow(_pieces, "sid string, first long, ids string")
    return pieces.repartition("sid").sortWithinPartitions("sid", "first").mapInArrow(_digests, "sid string, ends string")


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima over runs of 1, 2, 4, ... neighbours: level k holds at i the least of values[i : i + 2 ** k]."""
    table = [values]
    while 2 ** len(table) <= len(values):
        last, half = table[-1], 2 ** (len(table) - 1)
        table.append(np.minimum(last[:-half], last[half:]))
    return table


def right_extents(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last row up to which all neighbours share ``depth`` turns with ``row``, each found by itself by halving steps."""
    n, at = len(table[0]), row.copy()
    for k in range(len(table) - 1, -1, -1):
        fits = at + 2**k <= n - 1
        fits[fits] = table[k][at[fits] + 1] >= depth[fits]
        at[fits] += 2**k
    return at


def left_extents(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first row from which on all neighbours share ``depth`` turns with ``row``."""
    at = row.copy()
    for k in range(len(table) - 1, -1, -1):
        fits = at - 2**k >= 0
        fits[fits] = table[k][at[fits] - 2**k + 1] >= depth[fits]
        at[fits] -= 2**k
    return at


def range_minima(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least value of each closed range: of the two runs of a power of two that cover it."""
    level = np.floor(np.log2(last - first + 1)).astype(np.int64)
    out = np.empty(len(first), table[0].dtype)
    for k in np.unique(level).tolist():
        of = np.flatnonzero(level == k)
        out[of] = np.minimum(table[k][first[of]], table[k][last[of] - 2**k + 1])
    return out


def neighbour_prefixes(turns: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Number of turns each row shares with the row before; the first row: none."""
    length = np.diff(offset)
    out = np.zeros(len(length), np.int64)
    live, d = np.arange(1, len(length)), 0
    while len(live):
        live = live[(length[live] > d) & (length[live - 1] > d)]
        live = live[(turns[offset[live] + d] == turns[offset[live - 1] + d]).all(1)]
        d += 1
        out[live] = d
    return out


NODES = "key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def _chain(digests: np.ndarray, depth: int) -> list[bytes]:
    """One key for each prefix of a conversation, the empty one first."""
    state = hashlib.md5()
    out = [state.digest()]
    for d in range(depth):
        state.update(digests[d].tobytes())
        out.append(state.digest())
    return out


def _nodes(neighbours: dict[int, tuple[int, int]]):
    """A range of sorted distinct conversations to its nodes. Those that the ranges beside it share have a key and are sums over this range only.

    A prefix is a candidate at the first row that has it, and its members are the rows from there to its right extent. What a
    subtree saves is the words of all members' turns behind the prefix, less each node's once at the row that brings it.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at").combine_chunks()
        before, after = neighbours[key[0].as_py()]
        column = rows.column("turns").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offset = column.offsets.to_numpy().astype(np.int64)
        offset = offset - offset[0]
        flat = column.flatten()
        turns = np.frombuffer(b"".join(flat.field("h").to_pylist()), np.uint64).reshape(-1, 2)
        spent = np.concatenate([[0], np.cumsum(flat.field("w").to_numpy())])  # words of the turns before
        n, length = len(offset) - 1, np.diff(offset)
        count, conv = (rows.column(c).to_numpy() for c in ("n", "conv_id"))
        shared = neighbour_prefixes(turns, offset)
        minima, least = sparse_table(shared), sparse_table(conv)

        fresh = shared + 1  # the first depth at which a row is a candidate
        fresh[0] = 0
        begin = np.concatenate([[0], np.cumsum(length - fresh + 1)])
        row = np.repeat(np.arange(n), np.diff(begin))
        depth = np.arange(begin[-1]) - begin[row] + fresh[row]
        last = right_extents(minima, row, depth)

        up = np.maximum(depth - 1, 0)
        over = left_extents(minima, row, up)
        parent = begin[over] + up - fresh[over]
        words = lambda r, d: spent[offset[r] + d] - spent[offset[r]]
        total = words(np.arange(n), length)
        over_rows = lambda x: np.concatenate([[0], np.cumsum(x)])
        members, spoken = over_rows(count), over_rows(count * total)
        brought = over_rows(total - words(np.arange(n), shared))
        leaf = np.append(shared[1:], max(after, 0)) < length
        if after < 0:
            leaf[-1] = True
        leaves = over_rows(leaf)

        sum_of = lambda x: x[last + 1] - x[row]
        n_convs = sum_of(members)
        known = np.where(row == 0, np.maximum(up, before), up)  # depths of the row itself that an earlier range brings
        own = total[row] - words(row, np.minimum(known, length[row]))
        saved = sum_of(spoken) - n_convs * words(row, up) - own - (brought[last + 1] - brought[row + 1])
        new = (depth > 0) & ((row > 0) | (depth > before))
        children = np.bincount(parent[new], minlength=len(row))
        open_ = ((row == 0) & (depth <= before)) | ((last == n - 1) & (depth <= after))
        conv_id = range_minima(least, row, last)

        first, final = _chain(turns[: length[0]], max(before, 0)), _chain(turns[offset[-2] :], max(after, 0))

        def chained(at: np.ndarray) -> list:
            return [None if not o else first[d] if r == 0 and d < len(first) else final[d] for o, r, d in zip(open_[at].tolist(), row[at].tolist(), depth[at].tolist(), strict=True)]

        keys, parent_keys = chained(np.arange(len(row))), chained(parent)
        parent_conv, top = conv_id[parent], depth == 0
        ends = np.where(depth == length[row], np.array(rows.column("ends").to_pylist(), object)[row], None)
        return pa.table({
            "key": pa.array(keys, pa.binary()), "parent_key": pa.array([None if t else k for t, k in zip(top.tolist(), parent_keys, strict=True)], pa.binary()),
            "depth": depth, "conv_id": conv_id, "parent_conv_id": pa.array(parent_conv, mask=top | open_[parent]), "n_convs": n_convs,
            "n_children": children, "n_leaves": sum_of(leaves), "saved_tokens": saved, "ends": pa.array(ends.tolist(), pa.string()),
        })

    return run


def shared_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that two arrays have in common; null: -1."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(a.isNull() | b.isNull(), F.lit(-1)).when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def prefix_trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = 20, heads: int = 4
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256).

    A conversation c is rebuilt from the first h turns of c - c % ``family`` and its own turns after its first h, with
    h = crc32 of c in decimal % ``heads``. A node is a sequence of turns (role, text) that conversations begin with; it is named by
    the smallest of them and its depth. ``n_leaves`` and ``saved_tokens`` are taken over the subtree, the node included:
    the words of each node's last text, once for each member but one. ``ends_sha256`` is the digest of the ids that end there.

    Equal conversations become one row with a count, so copies of one conversation cost a row a task. The distinct ones
    are sorted over ranges of bounded size. In a range, a sparse table over the prefix lengths that neighbours share gives every
    candidate prefix its right extent and its parent's left extent by a binary search of its own. Only prefixes that cross a
    range's ends leave it as sums, which are added up by key; a first turn that a third of all conversations share is such a prefix.

    Turns are ordered by number, null first; equal numbers by a digest of their content, so repeated rows are repeated turns.
    Null roles and texts are empty ones. Rows without a conv_id belong to no conversation; the sign of c % ``family`` is that of c. A conversation without turns
    after it is rebuilt is a member of the root. An empty table has no nodes. Other columns are ignored. The digests of one
    conversation's turns (24 bytes a turn), not their texts, have to fit a row.
    """
    spark = conversations.sparkSession
    found = rebuilt(conversations, conv_id, turn, role, text, family, heads)
    found = stored(found.withColumn("sid", F.md5(F.array_join(F.transform("turns", lambda t: F.hex(t.h)), ""))))
    distinct = found.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.any_value("turns").alias("turns"))
    distinct = stored(distinct.join(id_digests(found), "sid"))
    n_turns = distinct.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    ranged = distinct.withColumn("path", F.col("turns.h")).repartitionByRange(max(partitions(spark), ceil(n_turns / RANGE_TURNS)), "path").sortWithinPartitions("path")
    ranged = stored(ranged.select(F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at"), "n", "conv_id", "turns", "ends"))
    edges = ranged.groupBy("range").agg(F.min_by("turns.h", "at").alias("first"), F.max_by("turns.h", "at").alias("last"))
    by = Window.orderBy("range")  # one row a range
    edges = edges.select("range", shared_turns(F.col("first"), F.lag("last").over(by)).alias("before"), shared_turns(F.col("last"), F.lead("first").over(by)).alias("after"))
    neighbours = {r.range: (r.before, r.after) for r in edges.collect()}
    nodes = stored(ranged.groupBy("range").applyInArrow(_nodes(neighbours), NODES))
    open_ = stored(nodes.filter("key is not null").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends").alias("ends"),
    ))
    every = nodes.filter("key is null").unionByName(open_)
    below = every.filter("parent_key is not null and parent_conv_id is null").drop("parent_conv_id")
    named = below.join(open_.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")]
    return every.filter("parent_key is null or parent_conv_id is not null").select(*columns).unionByName(named.select(*columns))

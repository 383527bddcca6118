"""Passages that recur across documents: confirmed by digests, located by sharded Aho-Corasick automata, removed after their first place."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.arrays import (
    Words, bucket_cuts, mix, pack_sorted, positions_in, row_slices, run_hashes, sliding, unpack_sorted,
)
from answerloom.llm.tables import in_shards, partitions, pieces, rest, text_or_empty

#: Words of a passage, and of the shorter runs by which recurring passages are first looked for.
PASSAGE_WORDS, ANCHOR_WORDS = 20, 8
#: Distinct words up to which one character stands for a word in an automaton.
ALPHABET = 1_000_000
#: An automaton ends at so many words of passages, and so many words of documents are made a string at a time.
AUTOMATON_WORDS, STREAM_WORDS = 1 << 19, 1 << 18
#: What a shard says of a window: it stands at several places, always behind the same window, always before the same one.
MANY, BEHIND_ONE, BEFORE_ONE = 1, 2, 4


@dataclass
class Windows:
    """All windows of a slice of documents: whether each lies in one document, and the least anchor inside it."""

    words: Words
    hashes: np.ndarray
    anchors: np.ndarray
    inside: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, window: int, anchor: int) -> Windows:
        words = Words.of(texts)
        hashes = words.hashes()
        n = max(len(hashes) - window + 1, 0)
        inside = words.row[:n] == words.row[len(words.row) - n :]
        anchors = run_hashes(hashes, anchor)
        least = sliding(anchors, window - anchor + 1, np.minimum)[:n] if n else np.empty(0, np.uint64)
        return cls(words, hashes, anchors, inside, least)

    def chosen_anchors(self) -> np.ndarray:
        """Anchors that are the least of some window, once for each place; mixed anew, as least hashes crowd at the low end of their range."""
        n, spare = len(self.least), len(self.anchors) - len(self.least)
        if not n:
            return np.empty(0, np.uint64)
        around = np.zeros(n + 2 * spare, np.uint64)
        around[spare : spare + n] = np.where(self.inside, self.least, 0)
        most = sliding(around, spare + 1, np.maximum)
        return mix(self.anchors[(self.anchors == most) & (most > 0)])

    def digests(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits for each window."""
        low = run_hashes(mix(self.hashes ^ np.uint64(0xD6E8FEB86659FD93)), window)
        return run_hashes(self.hashes, window), (low & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def position(self) -> np.ndarray:
        """Number of each window's first word in its document."""
        return np.arange(len(self.least)) - self.words.first[self.words.row[: len(self.least)]]


def _slices(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The shard's documents by id and text, in pieces, so that all passes number its words alike; of repeated rows all."""
    return row_slices(table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).to_batches(), "text")


def _bytes(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _anchor_rows(window: int, anchor: int, buckets: int):
    """A shard's documents to its chosen anchors, cut at equal ranges; ``many``: chosen at more than one place."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        found = [Windows.of(part.column("text"), window, anchor).chosen_anchors() for part in _slices(docs)]
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        cuts = bucket_cuts(keys, buckets)
        rows = [(b, i, j) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
        return pa.table({
            "bucket": pa.array([b for b, _, _ in rows], pa.int32()), "shard": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "keys": pa.array([pack_sorted(keys[i:j]) for _, i, j in rows], pa.binary()),
            "many": pa.array([np.packbits(counts[i:j] > 1).tobytes() for _, i, j in rows], pa.binary()),
        })

    return run


def _recurring_anchors(key: tuple, group: pa.Table) -> pa.Table:
    """All shards' anchors of one range to each shard's anchors that occur at two places or more."""
    shards = group.column("shard").to_numpy()
    parts = [unpack_sorted(k) for k in group.column("keys").to_pylist()]
    many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool) for m, k in zip(group.column("many").to_pylist(), parts, strict=True)]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.concatenate(many)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    ends = np.cumsum([len(k) for k in parts])
    packed = [pack_sorted(k[again[e - len(k) : e]]) for k, e in zip(parts, ends, strict=True)]
    return pa.table({"shard": shards, "bucket": pa.array([key[0].as_py()] * len(shards), pa.int32()), "keys": pa.array(packed, pa.binary())})


def _by_bucket(table: pa.Table) -> pa.Table:
    return table.sort_by("bucket")


def _neighbours(found: Windows, high: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the windows one word before and after those at ``at``; 0 where their document has none."""
    padded = np.zeros(len(high) + 2, np.uint64)
    padded[1:-1] = np.where(found.inside, high, 0)
    row = np.full(len(high) + 2, -1)
    row[1:-1] = found.words.row[: len(high)]
    before, after = padded[at], padded[at + 2]
    return np.where(row[at] == row[at + 1], before, 0), np.where(row[at + 2] == row[at + 1], after, 0)


def _window_rows(window: int, anchor: int, buckets: int):
    """A shard's documents and recurring anchors to its candidate windows: digest, first place and first word in the shard, and what ``flags`` say."""

    def run(key: tuple, docs: pa.Table, anchors: pa.Table) -> pa.Table:
        recurring = [unpack_sorted(k) for k in _by_bucket(anchors).column("keys").to_pylist()]
        recurring = np.concatenate(recurring) if recurring else np.empty(0, np.uint64)
        kinds = (np.uint64, np.uint32, np.int64, np.int32, np.uint32, np.uint64, np.uint64)
        parts: list[tuple[np.ndarray, ...]] = [tuple(np.empty(0, kind) for kind in kinds)]
        behind = 0
        for part in _slices(docs) if len(recurring) else ():
            found = Windows.of(part.column("text"), window, anchor)
            at = np.flatnonzero(found.inside)
            at = at[positions_in(recurring, mix(found.least[at])) >= 0]
            high, low = found.digests(window)
            ids = part.column("doc_id").to_numpy()
            parts.append((high[at], low[at], ids[found.words.row[at]], found.position()[at].astype(np.int32), (at + behind).astype(np.uint32), *_neighbours(found, high, at)))
            behind += len(found.hashes)
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        del parts
        order = np.lexsort((columns[1], columns[0]))  # documents come by id, so the first of equal ones stays first
        high, low, doc, pos, at, before, after = (c[order] for c in columns)
        fresh = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])) if len(high) else np.zeros(0, bool)
        begin = np.flatnonzero(fresh)
        count = np.diff(np.append(begin, len(high)))
        head = np.repeat(begin, count)
        flags = np.where(count > 1, MANY, 0)
        for flag, side in ((BEHIND_ONE, before), (BEFORE_ONE, after)):
            flags |= np.where(np.logical_and.reduceat(side == side[head], begin), flag, 0) if len(begin) else 0
        high, low, doc, pos, at, flags = high[begin], low[begin], doc[begin], pos[begin], at[begin], flags.astype(np.uint8)
        cuts = bucket_cuts(high, buckets)
        rows = [(b, slice(i, j)) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
        binary = lambda f: pa.array([f(s) for _, s in rows], pa.binary())
        return pa.table({
            "bucket": pa.array([b for b, _ in rows], pa.int32()), "shard": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "high": binary(lambda s: pack_sorted(high[s])), "low": binary(lambda s: low[s].tobytes()), "doc": binary(lambda s: doc[s].tobytes()),
            "pos": binary(lambda s: pos[s].tobytes()), "at": binary(lambda s: at[s].tobytes()), "flags": binary(lambda s: flags[s].tobytes()),
        })

    return run


def _first_places(key: tuple, group: pa.Table) -> pa.Table:
    """All shards' candidate windows of one range to, for each shard, those that have an earlier place for some occurrence in it: where in the shard, and the first place."""
    parts = [unpack_sorted(k) for k in group.column("high").to_pylist()]
    sizes = [len(k) for k in parts]
    kinds = {"low": np.uint32, "doc": np.int64, "pos": np.int32, "at": np.uint32, "flags": np.uint8}
    high, (low, doc, pos, at, flags) = np.concatenate(parts), (_bytes(group.column(c), kind) for c, kind in kinds.items())
    owner = np.repeat(np.arange(len(parts)), sizes)
    order = np.lexsort((pos, doc, low, high))
    fresh = np.append(True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1]))
    first = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    first_doc, first_pos = np.empty_like(doc), np.empty_like(pos)
    first_doc[order], first_pos[order] = doc[first], pos[first]
    wanted = (flags & MANY > 0) | (first_doc != doc) | (first_pos != pos)
    rows = [r[np.argsort(at[r])] for r in np.split(np.flatnonzero(wanted), np.searchsorted(owner[wanted], np.arange(1, len(parts))))]
    binary = lambda c: pa.array([c[r].tobytes() for r in rows], pa.binary())
    return pa.table({"shard": group.column("shard"), "at": binary(at), "doc": binary(first_doc), "pos": binary(first_pos), "flags": binary(flags)})


@dataclass
class Passages:
    """What recurs in a shard: first word there, number of words, and the first place of all (document, position)."""

    at: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    pos: np.ndarray

    @classmethod
    def of(cls, windows: pa.Table, window: int) -> Passages:
        """Neighbouring windows whose first places are neighbours too, and which nowhere in the shard stand without each other, make one passage.

        So each window is in one passage, and wherever it stands, the passage stands as a whole.
        """
        at, doc, pos, flags = (_bytes(windows.column(c), kind) for c, kind in (("at", np.uint32), ("doc", np.int64), ("pos", np.int32), ("flags", np.uint8)))
        order = np.argsort(at)
        at, doc, pos, flags = at[order].astype(np.int64), doc[order], pos[order].astype(np.int64), flags[order]
        onward = (np.diff(at) == 1) & (np.diff(doc) == 0) & (np.diff(pos) == 1) & (flags[:-1] & BEFORE_ONE > 0) & (flags[1:] & BEHIND_ONE > 0)
        begin = np.flatnonzero(np.append(True, ~onward)) if len(at) else np.empty(0, np.int64)
        return cls(at[begin], np.diff(np.append(begin, len(at))) + window - 1, doc[begin], pos[begin])


def _as_text(number: np.ndarray, distinct: int) -> tuple[str, int]:
    """Words by number (0 to ``distinct``) as characters; two a word where there are too many words for one."""
    if distinct <= ALPHABET:
        code, width = number + 1, 1
    else:
        code, width = np.column_stack([number >> 19, (number & 0x7FFFF) + (1 << 19)]).ravel() + 1, 2
    code = np.where(code >= 0xD800, code + 0x800, code)  # surrogates aren't characters
    return code.astype("<u4").tobytes().decode("utf-32-le"), width


def _covered(hashes: np.ndarray, first: np.ndarray, ids: np.ndarray, passages: Passages) -> np.ndarray:
    """Which words of a shard lie in a passage that also stands earlier. ``first``: where each document's words begin, and their number.

    The passages are compiled to automata of bounded size, every document of the shard streams through
    each, and each occurrence but the passage's first place covers its words.
    """
    import ahocorasick

    cover = np.zeros(len(hashes) + 1, np.int32)
    part = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(part, passages.at, 1)
    np.add.at(part, passages.at + passages.size, -1)
    alphabet = np.unique(hashes[np.cumsum(part)[:-1] > 0])
    number = (positions_in(alphabet, hashes) + 1).astype(np.int32)  # 0: a word of no passage
    steps = np.flatnonzero(np.diff(first[:-1] // STREAM_WORDS)) + 1
    cuts = [0, *first[steps].tolist(), len(hashes)]
    groups = np.flatnonzero(np.diff(np.cumsum(passages.size) // AUTOMATON_WORDS)) + 1
    for group in np.split(np.arange(len(passages.at)), groups):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        text, width = _as_text(np.concatenate([number[passages.at[k] : passages.at[k] + passages.size[k]] for k in group]), len(alphabet))
        ends = (np.cumsum(passages.size[group]) * width).tolist()
        for k, a, z in zip(group.tolist(), [0, *ends], ends, strict=False):
            automaton.add_word(text[a:z], k)
        automaton.make_automaton()
        for a, z in zip(cuts, cuts[1:], strict=False):
            text, _ = _as_text(number[a:z], len(alphabet))
            end, which = np.fromiter(chain.from_iterable(automaton.iter(text)), np.int64).reshape(-1, 2).T
            end = a + (end + 1) // width
            start = end - passages.size[which]
            row = np.searchsorted(first, end - 1, side="right") - 1
            counts = (start >= first[row]) & ((ids[row] != passages.doc[which]) | (start - first[row] != passages.pos[which]))
            np.add.at(cover, start[counts], 1)
            np.add.at(cover, end[counts], -1)
    return np.cumsum(cover)[:-1] > 0


def _left_text(words: Words, gone: np.ndarray, separators: str) -> pa.Array:
    """Texts without the words that go: one space between words, or the white space that stood behind each."""
    n = len(words.offsets) - 1
    if separators == "space":
        stay = np.flatnonzero(~gone)
        row = words.row[stay]
        final = np.append(row[1:] != row[:-1], True) if len(stay) else np.zeros(0, bool)
        size = words.length[stay] + ~final
        begin = np.cumsum(size) - size
        data = words.data[np.repeat(words.start[stay] - begin, size) + np.arange(int(size.sum()))]
        data[(begin + size - 1)[~final]] = 32
        per_row = np.bincount(row, size, n).astype(np.int64)
    else:
        total = int(words.offsets[-1])
        drop = np.zeros(total + 1, np.int64)
        following = np.append(words.start[1:], total)
        following = np.minimum(following, words.offsets[words.row + 1]) if len(following) == len(words.row) else following
        at = np.flatnonzero(gone)
        np.add.at(drop, words.start[at], 1)
        np.add.at(drop, following[at], -1)
        keep = np.cumsum(drop)[:total] == 0
        data = words.data[:total][keep]
        before = np.concatenate([[0], np.cumsum(keep)])
        per_row = before[words.offsets[1:]] - before[words.offsets[:-1]]
    offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _cleaned(window: int, separators: str, names: Sequence[str]):
    """A shard's documents and its recurring windows to the documents without them."""

    def run(key: tuple, docs: pa.Table, windows: pa.Table) -> pa.Table:
        passages, behind, out = Passages.of(windows, window), 0, []
        if len(passages.at):
            looked = ((Words.of(part.column("text")), part.column("doc_id").to_numpy()) for part in _slices(docs))
            hashes, sizes, ids = (np.concatenate(c) for c in zip(*((w.hashes(), np.diff(w.first), i) for w, i in looked), strict=True))
            repeated = _covered(hashes, np.concatenate([[0], np.cumsum(sizes)]), ids, passages)
            del hashes
        for part in _slices(docs):
            words = Words.of(part.column("text"))
            n = len(words.start)
            gone = repeated[behind : behind + n] if len(passages.at) else np.zeros(n, bool)
            behind += n
            removed = np.bincount(words.row[gone], minlength=part.num_rows)
            kept = _left_text(words, gone, separators)
            carried = [part.column("rest")] if "rest" in names else []
            out.append(pa.record_batch([part.column("doc_id"), pa.array(np.diff(words.first)), pa.array(removed), kept, *carried], list(names)))
        return pa.Table.from_batches(out)

    return run


def remove_repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = PASSAGE_WORDS, anchor: int = ANCHOR_WORDS, separators: str = "space", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: (doc_id, n_words, n_removed, kept_text) and, as the struct ``rest``, the
    columns named in ``carry``.

    A word goes if a run of ``window`` words around it also starts earlier: in a document with a smaller
    id, or before in its own. Runs are judged on the input. Kept words are joined by one space, or
    with ``separators="original"`` by the white space that stood between them.

    Documents lie in shards by a hash of their id, as many as twice the shuffle width or as the input's size asks for. (1) Each shard sends the
    anchors of its windows - of each window's runs of ``anchor`` words the one with the least hash -
    and learns which recur anywhere. (2) Windows around those are confirmed by 96-bit digests, and each
    shard learns the first place of every one that has an earlier place. (3) These windows make the shard's recurring passages,
    which are compiled to automata of up to ``AUTOMATON_WORDS`` words; all documents of the shard stream through each, and that alone
    tells where passages stand. What a shard sends is distinct, so a passage in a third of all documents is one entry a shard.

    Null text has no words. Repeated rows of one id don't count as earlier than each other; if their texts differ, the
    smaller text counts as earlier, but for passages at the same place. Rows without an id are neither searched
    nor changed. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shards = pieces(docs, 2 * partitions(spark))
    buckets = shards // 2
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    kept = F.array_join(words, " ") if separators == "space" else F.col("text")
    whole = docs.filter(F.col(doc_id).isNull()).select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), *rest(carry)).select(
        "doc_id", F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), kept.alias("kept_text"), *(["rest"] if carry else [])
    )
    grouped = in_shards(docs, doc_id, text, shards).groupBy("shard")
    anchors = grouped.applyInArrow(_anchor_rows(window, anchor, buckets), "bucket int, shard int, keys binary, many binary")
    recurring = anchors.groupBy("bucket").applyInArrow(_recurring_anchors, "shard int, bucket int, keys binary")
    candidates = grouped.cogroup(recurring.groupBy("shard")).applyInArrow(
        _window_rows(window, anchor, buckets), "bucket int, shard int, high binary, low binary, doc binary, pos binary, at binary, flags binary"
    )
    confirmed = candidates.groupBy("bucket").applyInArrow(_first_places, "shard int, at binary, doc binary, pos binary, flags binary")
    carried = in_shards(docs, doc_id, text, shards, carry).groupBy("shard") if carry else grouped
    cleaned = carried.cogroup(confirmed.groupBy("shard")).applyInArrow(_cleaned(window, separators, whole.columns), whole.schema)
    return cleaned.unionByName(whole)

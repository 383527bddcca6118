"""Documents packed into token sequences of several lengths, by tiers, without padding."""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.arrays import Words, positions_in, row_slices
from answerloom.llm.tables import text_or_empty

#: Longest sequence, and the context sizes that documents are routed to.
MAX_TOKENS = 4096
TIERS = (512, 1024, 2048, 4096)
#: Tokens that are packed together in a task.
BLOCK_TOKENS = 1 << 21
#: Tokens of one step group.
STEP_TOKENS = 1 << 17
#: Words, and lower-case letter sequences, that a worker remembers.
REMEMBERED, REMEMBERED_CORES = 1_500_000, 200_000
#: Punctuation that the tokenizer keeps apart from letters before it; an apostrophe may begin a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Text bytes that are encoded together.
ENCODE_BYTES = 4 << 20


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordIds:
    """Token ids of whole texts, put together from those of their words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words (runs without ASCII white space). A worker keeps the ids of the words it has met in
    one array, found by a 64-bit hash of the word. A new word of plain letters is lower-cased and
    goes to the merges directly, punctuation after it is a run of its own; any other goes through
    the whole tokenizer.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges, self.letters, self.cores = self.tokenizer.model.tokenize, byte_letters(), {}
        self.runs: dict[str, bytes] = {}
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        self.hashes, self.begin, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.array([self.end_id], np.uint32)  # a document's end is found at 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_letters(self, core: str) -> bytes:
        """Ids of lower-case letters below U+0180, which are composed and lower-cased one by one."""
        ids = self.cores.get(core)
        if ids is None:
            mapped = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.merges(mapped)]).tobytes()
            if len(self.cores) >= REMEMBERED_CORES:
                self.cores.clear()
            self.cores[core] = ids
        return ids

    def of_word(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        run = word[len(core) :]
        # U+0130 becomes two characters in lower case.
        if core and not (core.isalpha() and max(core) < "\u0180" and "\u0130" not in core):
            return self.whole(word)
        if run not in self.runs:
            if len(self.runs) >= REMEMBERED_CORES:
                self.runs.clear()
            self.runs[run] = self.whole(run)
        return (self.of_letters(core.lower()) if core else b"") + self.runs[run]

    def learn(self, words: Words, at: np.ndarray, hashes: np.ndarray) -> None:
        """Add the words at the given places, whose hashes are sorted and new."""
        data = words.data.tobytes()
        found = [self.of_word(data[a : a + n].decode()) for a, n in zip(words.start[at].tolist(), words.length[at].tolist(), strict=True)]
        count = np.array([len(x) // 4 for x in found], np.int64)
        begin = len(self.ids) + np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
        where = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begin, self.count = (np.insert(old, where, new) for old, new in ((self.hashes, hashes), (self.begin, begin), (self.count, count)))
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, each text's end id included, and how many each has."""
        words = Words.of(texts)
        distinct, at, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > REMEMBERED:
            self.forget()
        new = positions_in(self.hashes, distinct) < 0
        if new.any():
            self.learn(words, at[new], distinct[new])
        place = np.searchsorted(self.hashes, distinct)[inverse]
        ends = words.first[1:]
        count, begin = np.insert(self.count[place], ends, 1), np.insert(self.begin[place], ends, 0)
        before = np.cumsum(count) - count
        ids = self.ids[np.repeat(begin - before, count) + np.arange(int(count.sum()))]
        last = (before + count)[ends + np.arange(len(ends))]
        return ids, np.diff(last, prepend=0)


@functools.lru_cache(2)
def word_ids(path: str, end_id: int) -> WordIds:
    return WordIds(path, end_id)


def pack(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> tuple[np.ndarray, ...]:
    """Pieces (document, start, length, sequence, offset) and each sequence's step, for documents of the given lengths.

    A document goes to the smallest tier that holds it; of one longer than the longest tier, full
    windows are cut off first and the rest is routed. From the longest tier to the shortest, windows
    take what was routed to them, longest first; what a window has left is filled from the shorter
    tiers, by a document that fits, else by the beginning of one, whose rest is routed anew. What
    remains at the end is cut at powers of two, so no sequence needs padding. Steps take sequences
    longest first into the group with the fewest tokens so far, so groups are even.
    """
    largest = tiers[-1]
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in tiers]
    out: list[tuple[int, int, int, int, int]] = []
    n_sequences, sizes = 0, []

    def route(doc: int, start: int, length: int) -> None:
        waiting[next(t for t, size in enumerate(tiers) if length <= size)].append((length, doc, start))

    for doc, length in enumerate(lengths.tolist()):
        full = length // largest * largest
        for start in range(0, full, largest):
            out.append((doc, start, largest, n_sequences, 0))
            sizes.append(largest)
            n_sequences += 1
        if length > full:
            route(doc, full, length - full)
    for t in range(len(tiers) - 1, -1, -1):
        size = tiers[t]
        waiting[t].sort()
        left = sum(x[0] for bucket in waiting[: t + 1] for x in bucket)
        while waiting[t] and left >= size:
            gap = size
            while gap:
                # The longest waiting piece of the highest tier that still fits as a whole, else a cut.
                source = next((b for b in range(t, -1, -1) if waiting[b] and waiting[b][0][0] <= gap), None)
                if source is not None:
                    low, high = 0, len(waiting[source])
                    while high - low > 1:
                        middle = (low + high) // 2
                        low, high = (middle, high) if waiting[source][middle][0] <= gap else (low, middle)
                    length, doc, start = waiting[source].pop(low)
                    taken = length
                else:
                    source = next(b for b in range(t + 1) if waiting[b])
                    length, doc, start = waiting[source].pop(0)
                    taken = gap
                out.append((doc, start, taken, n_sequences, size - gap))
                gap -= taken
                if taken < length:
                    rest = (length - taken, doc, start + taken)
                    b = next(b for b, width in enumerate(tiers) if rest[0] <= width)
                    waiting[b].append(rest)
                    waiting[b].sort()
            sizes.append(size)
            n_sequences += 1
            left -= size
        if t:
            # Fewer tokens than a window are left, or none of this tier: they go down, cut to fit.
            for length, doc, start in waiting[t]:
                for a in range(0, length, tiers[t - 1]):
                    waiting[t - 1].append((min(tiers[t - 1], length - a), doc, start + a))
            waiting[t] = []
    rest = sorted(waiting[0], key=lambda x: (x[1], x[2]))
    left = sum(x[0] for x in rest)
    while left:
        size = gap = 1 << (left.bit_length() - 1)
        while gap:
            length, doc, start = rest.pop(0)
            taken = min(length, gap)
            out.append((doc, start, taken, n_sequences, size - gap))
            gap -= taken
            if taken < length:
                rest.insert(0, (length - taken, doc, start + taken))
        sizes.append(size)
        n_sequences += 1
        left -= size
    pieces = np.array(out, np.int64).reshape(-1, 5)
    return (*pieces.T, balanced_steps(np.array(sizes, np.int64), step_tokens))


def balanced_steps(sizes: np.ndarray, step_tokens: int) -> np.ndarray:
    """A step for each sequence: longest first to the group with the fewest tokens."""
    import heapq

    groups = [(0, g) for g in range(max(1, -(-int(sizes.sum()) // step_tokens)))]
    steps = np.zeros(len(sizes), np.int64)
    for s in np.argsort(-sizes, kind="stable").tolist():
        total, g = groups[0]
        heapq.heapreplace(groups, (total + int(sizes[s]), g))
        steps[s] = g
    return steps


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset, sequence_tokens, step).

    A document is the ids of its text by the tokenizer in ``path``, without special tokens, and then
    ``end_id``; a null text is empty, so it is ``end_id`` alone. Tiers are powers of two; sequences
    are full, so none is padded. A task packs its documents in blocks of about ``block_tokens``
    tokens: nothing is shuffled, and its memory is one block's. ``sequence_id`` and ``step`` hold
    the task's number in their high bits. Repeated rows are packed each by itself, a row without an
    id keeps a null one; other columns are ignored, an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[doc_id]
    source = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, base = word_ids(path, end_id), TaskContext.get().partitionId() << 40
        step_base, held, size = base, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, step_base
            names = pa.chunked_array([x for x, _, _ in held]).combine_chunks()
            ids, lengths = np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
            doc, start, length, sequence, offset, steps = pack(lengths, tiers, step_tokens)
            begin = (np.cumsum(lengths) - lengths)[doc] + start
            totals = np.bincount(sequence, length, len(steps)).astype(np.int64)
            for k in range(0, len(doc), 4096):
                c = slice(k, k + 4096)
                parts = [ids[a : a + n].tobytes() for a, n in zip(begin[c].tolist(), length[c].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(doc[c])), pa.array(start[c]), pa.array(length[c]), pa.array(parts, pa.binary()),
                     pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(lengths[doc[c]]), pa.array(sequence[c] + base), pa.array(offset[c]),
                     pa.array(totals[sequence[c]]), pa.array(steps[sequence[c]] + step_base)],
                    ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step"],
                )
            base, step_base = base + len(steps), step_base + int(steps.max(initial=0)) + 1

        for part in row_slices(batches, "text", ENCODE_BYTES):
            ids, lengths = coder.encode(part.column("text"))
            held.append((part.column("doc_id"), ids, lengths))
            size += len(ids)
            if size >= block_tokens:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return source.mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step long"
    )

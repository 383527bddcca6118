"""Vectorised text primitives for code that runs inside tasks: words, hashes, packed key lists.

Words are runs of bytes other than ASCII white space (``[\\x20\\x09-\\x0D]``). All functions work on
a slice of rows, so a task's memory does not depend on how many it reads; a text longer than a slice is one by
itself and takes about 30 bytes a byte of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are looked at together.
SLICE_BYTES = 2 << 20
#: Bytes of a span up to which it is hashed from front to end; longer ones are hashed in blocks of as many.
BLOCK_BYTES = 4096

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_SHIFT_A, _SHIFT_B = np.uint64(32), np.uint64(29)
_FACTOR_A, _FACTOR_B, _FACTOR_C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (multiply and shift rounds)."""
    x = (x ^ (x >> _SHIFT_A)) * _FACTOR_B
    x = (x ^ (x >> _SHIFT_B)) * _FACTOR_C
    return x ^ (x >> _SHIFT_A)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column (null: empty), eight zero bytes after them, and n + 1 offsets."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    out = np.zeros(last - first + 8, np.uint8)
    if last > first:
        out[: last - first] = np.frombuffer(data, np.uint8, last - first, first)
    return out, offsets - first


def row_slices(batches: Iterable[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``size`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


@dataclass
class Words:
    """Words of a slice of texts: first byte and length of each, row it is in, and where each row's words begin."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    length: np.ndarray
    row: np.ndarray
    first: np.ndarray  # n rows + 1
    hash: np.ndarray | None = None

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        data, offsets = column_bytes(column)
        n = int(offsets[-1])
        ink = ~WHITE[data[:n]]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = False, ink[:-1]
            after[-1], after[:-1] = False, ink[1:]
            before[offsets[offsets < n]] = False
            after[offsets[offsets > 0] - 1] = False
        start = np.flatnonzero(ink & ~before)
        end = np.flatnonzero(ink & ~after) + 1
        first = np.searchsorted(start, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        return cls(data, offsets, start, end - start, row, first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of every word's bytes."""
        return span_hashes(self.data, self.start, self.length, seed)


def span_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of ``data[start:start + length]`` for each span, in time that grows with the bytes. ``data`` ends with eight spare bytes.

    The blocks of a long span are hashed side by side and added up with their places mixed in.
    """
    long = np.flatnonzero(length > BLOCK_BYTES)
    if not len(long):
        return _short_hashes(data, start, length, seed)
    out = np.empty(len(start), np.uint64)
    short = np.flatnonzero(length <= BLOCK_BYTES)
    out[short] = _short_hashes(data, start[short], length[short], seed)
    blocks = -(-length[long] // BLOCK_BYTES)
    begin = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(begin, blocks)
    size = np.minimum(np.repeat(length[long], blocks) - place * BLOCK_BYTES, BLOCK_BYTES)
    each = _short_hashes(data, np.repeat(start[long], blocks) + place * BLOCK_BYTES, size, seed)
    total = np.add.reduceat(mix(joined(each, mix(place.astype(np.uint64)))), begin)
    out[long] = mix(total ^ (length[long].astype(np.uint64) * _FACTOR_B))
    return out


def _short_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """Eight bytes of each span a round."""
    words = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    out = mix(length.astype(np.uint64) * _FACTOR_A + np.uint64(seed))
    live, at, left = np.flatnonzero(length > 0), start[length > 0], length[length > 0]
    while len(live):
        chunk = words[at] & _LOW_BYTES[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ chunk) * _FACTOR_A)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring runs from the hashes of both."""
    return mix(a * _FACTOR_A + b)


def run_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive words, by doubling; ``len(word) - k + 1`` entries (none: empty)."""
    n = len(word) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, power, size, rest = None, 0, word, 1, k
    while rest:
        if rest & 1:
            out = power if out is None else joined(out[: len(power) - have], power[have:])
            have += size
        rest >>= 1
        if rest:
            power, size = joined(power[:-size], power[size:]), size * 2
    return out[:n]


def sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """``choose`` (np.minimum or np.maximum) over each ``width`` neighbours, by doubling."""
    out, size = values, 1
    while size * 2 <= width:
        out, size = choose(out[:-size], out[size:]), size * 2
    return choose(out[: len(values) - width + 1], out[width - size :][: len(values) - width + 1]) if size < width else out


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as differences of the fewest whole bytes that hold all of them."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    low = np.ascontiguousarray(steps, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + low.tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    if not packed:
        return np.empty(0, np.uint64)
    width, first = packed[0], int.from_bytes(packed[1:9], "little")
    low = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(low) + 1, 8), np.uint8)
    out[1:, :width] = low
    out = out.view("<u8").reshape(-1).astype(np.uint64)
    out[0] = first
    return np.cumsum(out, dtype=np.uint64)


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of the 64-bit space begins in sorted keys; the last entry is their number."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def positions_in(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in ``sorted_keys``, -1 where it is absent."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, at, -1)

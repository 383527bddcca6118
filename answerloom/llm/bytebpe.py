"""Byte-level BPE: long texts are pre-tokenised in overlapping chunks, stitched, and encoded in pieces."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.tables import text_or_empty

#: Characters of a chunk and of what it shares with the next one.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 512
#: A boundary this far from a chunk's end doesn't depend on what follows: the pattern looks ahead by
#: a contraction's letters or by one character after white space.
LOOK_AHEAD = 4
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 1 << 19


@functools.lru_cache(4)
def encoding(path: str, pattern: str):
    """The library's encoder and the bytes of each id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), tokens


class Encoder:
    """Encodes pre-tokens one by one, as bytes of little-endian unsigned 32-bit ids; remembers the frequent ones."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.pattern = regex.compile(pattern)
        self.encoding, self.tokens = encoding(path, pattern)
        self.known: dict[str, bytes] = {}

    def boundaries(self, text: str) -> np.ndarray:
        """Where the pre-tokens of ``text`` end; characters that no pre-token covers can't occur, as white space is one."""
        return np.fromiter((m.end() for m in self.pattern.finditer(text)), np.int64)

    def ids_of(self, token: str) -> bytes:
        ids = np.array(self.encoding._encode_single_piece(token), "<u4").tobytes()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        known, ids_of = self.known.get, self.ids_of
        return b"".join([known(t) or ids_of(t) for t in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def cut_points(chunks: list[str], starts: list[int], ends_of) -> list[int]:
    """Boundaries that the pre-tokens of the whole text have, one near the start of each chunk but the first.

    ``chunks[i]`` begins at ``starts[i]`` and shares its end with the next chunk's begin. A scan that
    begins inside a pre-token may cut wrongly at first; from the first boundary that both scans
    have on, they agree, for the pattern never looks back. Boundaries near a chunk's end aren't
    trusted. Where an overlap has no common boundary (a pre-token longer than the overlap), the
    scan is carried on from the last one known over as many chunks as it takes.
    """
    cuts, at = [], 0  # ``at``: the last boundary known to be right
    text, begin = chunks[0], 0
    for i in range(1, len(chunks)):
        right = ends_of(text) + begin
        right = right[right <= begin + len(text) - LOOK_AHEAD]
        there = ends_of(chunks[i]) + starts[i]
        common = np.intersect1d(right, there[there <= starts[i] + len(chunks[i]) - LOOK_AHEAD])
        if len(common):
            at = int(common[0])
            cuts.append(at)
            text, begin = chunks[i][at - starts[i] :], at
        else:
            # No cut here: what is left from the last right boundary is joined with the new chunk.
            at = int(right[right <= starts[i]].max()) if (right <= starts[i]).any() else begin
            text, begin = text[at - begin : starts[i] - begin] + chunks[i], at
    return cuts


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row per document: (doc_id, n_tokens, ids, decoded), ids as little-endian unsigned 32-bit integers.

    Ids are those of the vocabulary in ``path`` for each match of ``pattern`` by itself, without
    special tokens; ``decoded`` joins the raw bytes of the ids. A text of more than ``chunk_chars``
    characters is cut into chunks that overlap, and the chunks are pre-tokenised in parallel. Where two
    neighbours' boundaries fall together again the text is cut, and the pieces are encoded in
    parallel and put together by document. Shorter texts are one piece and aren't moved.

    Null text counts as empty (no ids). Repeated rows and rows without an id are given back as often
    as they come. Other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [coder.encode(x) for x in part.column("text").to_pylist()]
                arrays = [part.column(c) for c in part.schema.names[:-1]]
                arrays += [pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names[:-1], "ids", "decoded"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            found = [coder.boundaries(x).astype("<i4").tobytes() for x in batch.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "ends"])

    def stitch(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        copies = sum(r["k"] == 0 for r in rows)
        rows = [r for _, r in sorted({r["k"]: r for r in rows}.items())]
        coder = encoder(path, pattern)
        chunks, starts = [r["chunk"] for r in rows], [r["k"] * chunk_chars for r in rows]
        scanned = {r["chunk"]: np.frombuffer(r["ends"], "<i4").astype(np.int64) for r in rows}
        cuts = [0, *cut_points(chunks, starts, lambda x: scanned[x] if x in scanned else coder.boundaries(x))]
        whole = "".join(c[:chunk_chars] for c in chunks)
        pieces = [whole[a:b] for a, b in zip(cuts, [*cuts[1:], len(whole)], strict=True)]
        n = len(pieces)
        return pa.table({
            "row": pa.array([rows[0]["row"]] * n, pa.string()), "doc_id": pa.array([rows[0]["doc_id"]] * n, group.schema.field("doc_id").type),
            "copies": pa.array([copies] * n, pa.int32()), "k": pa.array(range(n), pa.int32()), "text": pa.array(pieces, pa.string()),
        })

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [*batch.schema.names[:-1], "k", "chunk"]
            for i in range(batch.num_rows):
                whole = batch.column("text")[i].as_py()
                starts = range(0, len(whole), chunk_chars)
                for a in range(0, len(starts), 64):
                    some = starts[a : a + 64]
                    same = [pa.array([batch.column(c)[i].as_py()] * len(some), batch.column(c).type) for c in range(batch.num_columns - 1)]
                    chunks = [whole[x : x + chunk_chars + overlap_chars] for x in some]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(a, a + len(some)), pa.int32()), pa.array(chunks, pa.string())], names)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts, copies = batch.column("parts")[i].as_py(), batch.column("copies")[i].as_py()
                joined = [pa.array([b"".join(p[name] for p in parts)] * copies, pa.binary()) for name in ("ids", "decoded")]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("doc_id")[i].as_py()] * copies, batch.column("doc_id").type), *joined], ["doc_id", "ids", "decoded"])

    kind = dict(source.dtypes)["doc_id"]
    long = F.char_length("text") > chunk_chars
    short = source.filter(~long).mapInArrow(encode, f"doc_id {kind}, ids binary, decoded binary")
    row = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"), 256).alias("row")
    chunks = source.filter(long).select(row, "doc_id", "text").mapInArrow(cut, f"row string, doc_id {kind}, k int, chunk string")
    scanned = chunks.repartition("row", "k").mapInArrow(scan, f"row string, doc_id {kind}, k int, chunk string, ends binary")
    pieces = scanned.groupBy("row").applyInArrow(stitch, f"row string, doc_id {kind}, copies int, k int, text string")
    encoded = pieces.repartition("row", "k").mapInArrow(encode, f"row string, doc_id {kind}, copies int, k int, ids binary, decoded binary")
    joined = encoded.groupBy("row", "doc_id", "copies").agg(F.sort_array(F.collect_list(F.struct("k", "ids", "decoded"))).alias("parts"))
    long_rows = joined.select("doc_id", "copies", "parts").mapInArrow(put, f"doc_id {kind}, ids binary, decoded binary")
    return short.unionByName(long_rows).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")

"""Statistics of whole texts, vectorised over slices of bounded size; what the quality operators score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from answerloom.llm.arrays import Words, row_slices, run_hashes, span_hashes

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?'\"()-")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbols", "upper", "digits", "marks", "wide", "dup_lines", "repeat_words", "distinct_words", "line_words", "sentence_words", "top_word", "bangs",
)


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marked bytes each row has."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """For each text the counts of ``COUNTS`` and the columns of ``FEATURES``.

    n_repeat_words: words in three-word windows that occur twice or more in the text. n_dup_lines: lines
    with a word that equal an earlier line. Windows and lines compare by 64-bit hashes within a text.
    """
    words = Words.of(texts)
    offsets, n = words.offsets, len(words.offsets) - 1
    data = words.data[: int(offsets[-1])]
    rows = np.arange(n)
    n_words = np.diff(words.first)
    start_of_char = (data & 0xC0) != 0x80
    white = (data == 32) | ((data >= 9) & (data <= 13))
    word_chars = per_row(start_of_char & ~white, offsets)
    symbol, hashes = per_row(_SYMBOL[data], offsets), words.hashes()

    def repeats(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of keys within rows: which occur before in the row, and which occur twice or more."""
        own = key * np.uint64(0x9E3779B97F4A7C15) ^ (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        later, many = np.zeros(len(key), bool), np.zeros(len(key), bool)
        later[order[1:]] = same
        many[order[1:]] = same
        many[order[:-1]] |= same
        return later, many

    triples = run_hashes(hashes, 3)
    inside = words.row[: len(triples)] == words.row[2:] if len(triples) else np.zeros(0, bool)
    found = np.zeros(len(triples), bool)
    found[inside] = repeats(triples[inside], words.row[: len(triples)][inside])[1]
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[k : k + len(found)] |= found
    n_repeat = np.bincount(words.row[covered], minlength=n)

    breaks = np.flatnonzero(data == 10)
    line_row = np.concatenate([rows, np.searchsorted(offsets, breaks, side="right") - 1])
    line_begin = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((line_begin, line_row))
    line_start, line_row = line_begin[order], line_row[order]
    last_of_row = np.append(line_row[1:] != line_row[:-1], True) if len(line_row) else np.zeros(0, bool)
    following = np.append(line_start[1:], 0)
    line_end = np.where(last_of_row, offsets[line_row + 1], following - 1)
    ink = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line_start)
    line_start, line_end, line_row = line_start[ink], line_end[ink], line_row[ink]
    later, _ = repeats(span_hashes(words.data, line_start, line_end - line_start), line_row)
    n_dup = np.bincount(line_row[later], minlength=n)

    seen, _ = repeats(hashes, words.row)
    again = np.bincount(words.row[seen], minlength=n)
    lines = np.bincount(line_row, minlength=n)
    ends = np.zeros(len(hashes), bool)
    if len(hashes):
        ends = _STOP[words.data[words.start + words.length - 1]]
    # The largest share of one word: the longest stretch of equal keys when a row's words are sorted.
    top = np.zeros(n, np.int64)
    if len(hashes):
        order = np.lexsort((hashes, words.row))
        h, r = hashes[order], words.row[order]
        begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
        np.maximum.at(top, r[begin], np.diff(np.append(begin, len(h))))

    w, c, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1), per_row(start_of_char, offsets)
    out = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbol, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "log_words": np.log1p(n_words), "word_length": word_chars / w, "symbols": symbol / w, "upper": per_row(_UPPER[data], offsets) / c,
        "digits": per_row(_DIGIT[data], offsets) / c, "marks": per_row(_MARK[data], offsets) / w, "wide": (chars - per_row(data < 128, offsets)) / c,
        "dup_lines": n_dup / np.maximum(lines, 1), "repeat_words": n_repeat / w, "distinct_words": 1 - again / w, "line_words": np.log1p(n_words / np.maximum(lines, 1)),
        "sentence_words": np.log1p(n_words / np.maximum(np.bincount(words.row[ends], minlength=n), 1)), "top_word": top / w, "bangs": per_row(data == 33, offsets) / w,
    }
    return out


def matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.column_stack([stats[name] for name in FEATURES]).astype(np.float64)


def with_statistics(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
    for part in row_slices(batches, text):
        yield part, statistics(part.column(text))

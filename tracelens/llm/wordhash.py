"""Words and runs of words of Arrow string columns as 64-bit hashes, computed in numpy without a Python step per word.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D), which never cuts a UTF-8 character. A hash takes
eight bytes a step, each step through a finaliser that is no polynomial: no arrangement of letters or words makes two
inputs meet other than by chance. Runs of words are hashed by doubling, in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_KEY, _STEP, _JOIN, _SHORT = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95), U(0xAF251AF3B0F025B5), U(0x71D67FFFEDA60000)
#: Spans over so many bytes are hashed one by one.
LONG_SPAN = 512


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)


def blocks(data: np.ndarray) -> np.ndarray:
    """For each byte of data, the eight bytes from it on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size, view = end - start, blocks(data)
    out = mix(size.astype(U) * _STEP + _KEY)
    out = mix(out * _JOIN + (view[start] & _MASKS[np.minimum(size, 8)]))
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), int(_KEY) >> 1)
    rest, at = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
    while len(rest):
        out[rest] = mix(out[rest] * _JOIN + (view[start[rest] + at] & _MASKS[np.minimum(size[rest] - at, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    return out


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Whether each span holds the same bytes as the span whose index is in `like`."""
    out = np.ones(len(like), dtype=bool)
    others = np.flatnonzero(like != np.arange(len(like)))
    out[others] = same_bytes(data, start[others], (end - start)[others], data, start[like[others]], (end - start)[like[others]])
    return out


def same_bytes(a: np.ndarray, at: np.ndarray, size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether spans of a hold the same bytes as spans of b."""
    x, y = blocks(a), blocks(b) if b is not a else None
    y = x if y is None else y
    out = size == b_size
    out &= ((x[at] ^ y[np.minimum(b_at, len(y) - 1)]) & _MASKS[np.minimum(size, 8)]) == 0
    rest, n = np.flatnonzero((size > 8) & out), 8
    while len(rest):
        out[rest] &= ((x[at[rest] + n] ^ y[b_at[rest] + n]) & _MASKS[np.minimum(size[rest] - n, 8)]) == 0
        n += 8
        rest = rest[(size[rest] > n) & out[rest]]
    return out


@dataclass
class Words:
    """start, end: byte offsets in data; hash: of each word; first: index of each document's first word, and their number at the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the column's texts, end to end, and where each begins, with the end of the last (null: empty)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(values, dtype=np.uint8)[at[0] : at[-1]] if values is not None and len(column) else np.zeros(0, np.uint8)
    return data, at - at[0]


def words(column: pa.Array, lower: bool) -> Words:
    """The words of each text in the column (null: none); with lower, A-Z count as a-z."""
    data, at = text_bytes(column)
    n = len(data)
    word = ~_IS_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    before = np.empty(n, dtype=bool)
    before[:1], before[1:] = False, word[:-1]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1:], after[:-1] = False, word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return Words(data, start, end, span_hashes(_LOWER[data] if lower else data, start, end), np.searchsorted(start, at).astype(np.int64))


def runs(hashes: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of the k consecutive words from each word on (as far as there are k), whatever documents they are of."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    span, level, out, done = 1, mix(hashes ^ U((lane + 1) * int(_KEY) % (1 << 64))), None, 0
    while True:
        if k & span:
            part = level[done : done + n]
            out = part if out is None else mix(out * _JOIN + part)
            done += span
        if 2 * span > k:
            return mix(out + U(k * int(_STEP) % (1 << 64)))
        level = mix(level[:-span] * _JOIN + level[span:])
        span *= 2


def short_runs(w: Words, docs: np.ndarray, most: int) -> np.ndarray:
    """Hash of the whole sequence of documents (by index) that have 1 to `most` words."""
    first, n = w.first[docs], w.first[docs + 1] - w.first[docs]
    out = mix(w.hash[first] ^ _SHORT)
    for j in range(1, most):
        more = np.flatnonzero(n > j)
        out[more] = mix(out[more] * _JOIN + w.hash[first[more] + j])
    return mix(out + n.astype(U) * _STEP)


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Indices of the words at which k words of one document start."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    skip = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(int(counts.sum())) + skip


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values; by doubling spans."""
    span, out = 1, x
    while 2 * span <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1])

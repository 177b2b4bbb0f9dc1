"""Pre-splitting of texts into word pieces in numpy, and ids of pieces from a bounded table.

Characters are classed by a table over all code points: letter, number, white space, other. Both patterns used here cut
where the class changes; what else they do (a space joins the piece after it; a number stands alone; English contractions)
is done on the cuts. Pieces are found by 64-bit hashes and compared byte by byte, each different piece of a slice is looked up
once, and ids are gathered with numpy.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import numpy as np

from .wordhash import U, same_bytes, same_spans, span_hashes

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
_tables: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of each code point; UNKNOWN: not assigned in this Python's Unicode tables."""
    if not _tables:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            if kind[0] == "L":
                table[c] = LETTER
            elif kind[0] == "N":
                table[c] = NUMBER
            elif kind == "Cn":
                table[c] = UNKNOWN
        # Unicode's White_Space property (fixed values)
        table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _tables.append(table)
    return _tables[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _contractions(cp: np.ndarray, kind: np.ndarray, cut: np.ndarray, edge: np.ndarray) -> None:
    """'s 't 'm 'd 're 've 'll after a cut that is at the apostrophe itself are pieces."""
    at = np.flatnonzero((cp == 0x27) & cut[:-1])
    if not len(at):
        return
    pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
    fence = np.concatenate([edge, np.ones(3, dtype=bool)])
    one, two = pad[at + 1], pad[at + 2]
    inside = ~fence[at + 1]
    short = inside & np.isin(one, [0x73, 0x74, 0x6D, 0x64])
    long = inside & ~fence[at + 2] & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
    cut[at[short | long] + 1] = False
    cut[at[short] + 2] = True
    cut[at[long] + 3] = True


def split(cp: np.ndarray, ends: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """start and end of the pieces of texts that end at `ends` in cp.

    spaces: a space joins the piece that follows it and other white space is pieces of its own; else white space is dropped
    and each number stands alone.
    """
    n = len(cp)
    kind = classes()[cp]
    edge = np.zeros(n + 1, dtype=bool)
    edge[0] = True
    edge[ends] = True
    cut = edge.copy()
    cut[1:-1] |= kind[1:] != kind[:-1]
    if not spaces:
        cut[:-1] |= kind == NUMBER
        _contractions(cp, kind, cut, edge)
        at = np.flatnonzero(cut)
        start, end = at[:-1], at[1:]
        keep = kind[start] != SPACE
        return start[keep], end[keep]
    white = kind == SPACE
    # the last white space of a run that something follows: a piece of its own, or, if it is a space, part of what follows
    last = np.zeros(n, dtype=bool)
    last[:-1] = white[:-1] & ~white[1:] & ~edge[1:-1]
    cut[:-1] |= last
    joined = np.flatnonzero(last & (cp == 0x20))
    cut[joined + 1] = False
    _contractions(cp, kind, cut, edge)
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


class PieceTable:
    """ids (little-endian, 32 bits) of pieces of text, found by hash and held with the piece's bytes, which are compared; `make`
    gives the ids of a list of pieces. The table is a set of arrays in the order of the hashes.

    Above `most` entries, those that none of the last slices had are dropped; pieces over 64 characters aren't kept.
    """

    def __init__(self, make: Callable[[list[str]], Sequence], most: int, slices: int = 6):
        self.make, self.most, self.slices, self.now = make, most, slices, 0
        self.names = np.zeros(0, U)
        #: Of each entry: where its bytes and its ids are and how many, and the slice that had it last.
        self.rows = np.zeros((0, 5), np.int64)
        self.bytes, self.flat = np.zeros(0, np.uint8), np.zeros(0, "<i4")

    def ids(self, text: str, data: np.ndarray, bytes_at: np.ndarray | None, start: np.ndarray, end: np.ndarray, starts_of: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, given its pieces in all texts joined, as characters start to end; data: their UTF-8 bytes, bytes_at:
        where each character begins in them (None: in ASCII, at its own place); starts_of: index of each text's first piece, and
        the number of pieces."""
        if not len(start):
            return [np.zeros(0, "<i4")] * (len(starts_of) - 1)
        low, high = (start, end) if bytes_at is None else (bytes_at[start], bytes_at[end])
        names, first, which = np.unique(span_hashes(data, low, high), return_index=True, return_inverse=True)
        odd = np.flatnonzero(~same_spans(data, low, high, first[which]))
        self.now += 1
        at = np.searchsorted(self.names, names)
        taken = np.flatnonzero(at < len(self.names))
        taken = taken[self.names[at[taken]] == names[taken]]
        row = self.rows[at[taken]]
        known = taken[same_bytes(data, low[first[taken]], (high - low)[first[taken]], self.bytes, row[:, 0], row[:, 1])]
        self.rows[at[known], 4] = self.now
        new = np.ones(len(names), dtype=bool)
        new[known] = False
        new = np.flatnonzero(new)
        # pieces that have another one's hash in this slice are made on their own
        asked = np.concatenate([first[new], odd])
        made = [np.asarray(ids, "<i4") for ids in self.make([text[a:b] for a, b in zip(start[asked].tolist(), end[asked].tolist(), strict=True)])]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.concatenate([self.flat, *made])
        where, size = np.zeros(len(names) + len(odd), np.int64), np.zeros(len(names) + len(odd), np.int64)
        where[known], size[known] = self.rows[at[known], 2], self.rows[at[known], 3]
        own = np.concatenate([new, len(names) + np.arange(len(odd))])
        where[own], size[own] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        which[odd] = len(names) + np.arange(len(odd))
        fresh = np.setdiff1d(new, taken, assume_unique=True)
        fresh = fresh[(end - start)[first[fresh]] <= 64]
        self._add(names[fresh], data, low[first[fresh]], (high - low)[first[fresh]], where[fresh], size[fresh], flat)
        each = size[which]
        total = np.concatenate([[0], np.cumsum(each)])
        out = flat[np.repeat(where[which] - total[:-1], each) + np.arange(total[-1])]
        cuts = total[starts_of].tolist()
        return [out[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    def _add(self, names: np.ndarray, data: np.ndarray, low: np.ndarray, n: np.ndarray, where: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        rows = np.stack([len(self.bytes) + np.cumsum(n) - n, n, where, size, np.full(len(n), self.now)], axis=1)
        self.bytes = np.concatenate([self.bytes, data[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]])
        self.flat = flat
        place = np.searchsorted(self.names, names)
        self.names, self.rows = np.insert(self.names, place, names), np.insert(self.rows, place, rows, axis=0)
        if len(self.names) > self.most:
            stay = self.rows[:, 4] > self.now - self.slices
            self.names, rows = self.names[stay], self.rows[stay]
            for of, column in ((self.bytes, 0), (self.flat, 2)):
                n = rows[:, column + 1]
                kept = of[np.repeat(rows[:, column] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                rows[:, column] = np.cumsum(n) - n
                if column:
                    self.flat = kept
                else:
                    self.bytes = kept
            self.rows = rows


def encode(texts: list[str], spaces: bool, table: PieceTable) -> list[np.ndarray]:
    text = "".join(texts)
    cp = code_points(text)
    ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
    if not len(cp):
        return [np.zeros(0, "<i4")] * len(texts)
    start, end = split(cp, ends, spaces)
    data, bytes_at = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), None
    if len(data) != len(cp):
        bytes_at = np.concatenate([[0], np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000).astype(np.int64))])
    at = np.searchsorted(start, np.concatenate([[0], ends]))
    return table.ids(text, data, bytes_at, start, end, at)

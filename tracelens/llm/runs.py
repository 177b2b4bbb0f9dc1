"""Periodic runs in documents, by Lyndon arrays over an ordered alphabet.

A run is a stretch of words with smallest period q, at least MIN_EXPONENT periods and MIN_LENGTH words long, that can't be extended
on either side. Words are numbered in the order of their bytes; nothing is hashed and no suffix structure is built.

`lyndon` finds each suffix's next smaller suffix, from left to right. The longest match seen so far (of positions `left` and
`right`, up to `end`) is kept: inside it, what was decided for the left copy holds for the right one, and comparison goes on at
`end` only. Along one chain of candidates, the match with the next follows from the last one's unless both are equally long. So
each word is matched once and each decision taken once. A run's Lyndon roots are such edges in the alphabet's order or in its
reverse, and the match across the edge is the run's extension to the right; the one to the left is less than a period for the
first root and is compared word by word.

A word that stands fewer than MIN_EXPONENT times in a stretch is in none of its runs, so documents are first cut there, again
and again, until nothing changes; that loses no run and leaves little of plain prose.

Cases: null and empty texts, and texts of white space, have no words, no runs and an empty collapsed text. Equal rows get equal
results. Rows without doc_id are kept. Other columns are ignored, whatever their names. A text is held whole in one task, at about
200 bytes a word for those words that can be in a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

MIN_EXPONENT, MIN_LENGTH = 4, 6
#: Bytes of a word that are compared eight at a time; what is longer is sorted as a whole.
SHORT = 64
SCHEMA = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def lyndon(x: list[int]) -> tuple[list[int], list[int]]:
    """For each position, that of the next smaller suffix and the length of the match with it. x ends with a number that is less
    than all others and stands there only."""
    n = len(x) - 1
    pss, pss_match, nss, nss_match = [-1] * n, [0] * n, [n] * n, [0] * n
    right = end = gap = 0
    for r in range(1, n):
        c, e, known = r - 1, 0, False
        while c >= 0:
            if known and pss_match[last] != e:  # noqa: F821
                if pss_match[last] < e:  # noqa: F821
                    e, smaller = pss_match[last], False  # noqa: F821
                else:
                    smaller = True
            else:
                if right <= c and r < end:
                    q = r - gap
                    e = max(e, min(nss_match[c - gap] if nss[c - gap] == q else pss_match[q], end - r))
                while x[c + e] == x[r + e]:
                    e += 1
                if e and r + e >= end:
                    right, gap, end = r, r - c, r + e
                smaller = x[r + e] < x[c + e]
            if not smaller:
                pss[r], pss_match[r] = c, e
                break
            nss[c], nss_match[c] = r, e
            last, known, c = c, True, pss[c]
    return nss, nss_match


def runs_of(words: list[int], exponent: int = MIN_EXPONENT, length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a sequence of ordered numbers, by start and period. exponent is 2 at least."""
    n, top = len(words), max(words, default=0)
    found = set()
    for order in (words, [top - w for w in words]):
        x = [*order, min(order, default=0) - 1]
        nss, match = lyndon(x)
        for i in range(n):
            j = nss[i]
            p, e = j - i, match[i]
            if j >= n or 2 * p + e - 1 < max(length, exponent * p):  # too short even with the p - 1 words before that can be in it
                continue
            if i >= p and nss[i - p] == i and match[i - p] == e + p:  # not the run's first root
                continue
            b = 0
            while b < p and i > b and x[i - b - 1] == x[j - b - 1]:
                b += 1
            if b < p and (m := b + p + e) >= max(length, exponent * p):
                found.add((i - b, m, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def ranks(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each word data[start : start + size]: equal words, and only they, have equal ones, and the numbers are an order."""
    padded = np.concatenate([data, np.zeros(SHORT + 8, np.uint8)])

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        key = np.zeros(len(at), np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | np.where(left > i, padded[at + i], 0).astype(np.uint64)
        return key

    def number(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        group = np.cumsum(new)
        out = np.empty(len(order), np.int64)
        out[order] = group
        return out, np.bincount(group, minlength=1)[out] if len(order) else out

    out, shared = number(eight(starts, sizes), sizes)
    at = np.flatnonzero((shared > 1) & (sizes > 8))
    done = 8
    while len(at) and done < SHORT:
        ids, shared = number(out[at], eight(starts[at] + done, sizes[at] - done))
        out[at] = out.max() + 1 + ids
        done += 8
        at = at[(shared > 1) & (sizes[at] > done)]
    if len(at):
        whole = sorted((int(out[i]), data[starts[i] : starts[i] + sizes[i]].tobytes(), int(i)) for i in at)
        last, n = None, int(out.max())
        for before, word, i in whole:
            if (before, word) != last:
                last, n = (before, word), n + 1
            out[i] = n
    return out


def stretches(doc: np.ndarray, ids: np.ndarray, times: int = MIN_EXPONENT, length: int = MIN_LENGTH) -> Iterator[tuple[int, int]]:
    """First and last place of the stretches of a document's words in which each word stands `times` times at least: a run of so
    many periods lies in one of them, and its neighbours outside are no part of it."""
    at, part = np.arange(len(ids)), doc.astype(np.int64)
    width = int(ids.max(initial=0)) + 1
    while len(at):
        _, where, count = np.unique(part * width + ids[at], return_inverse=True, return_counts=True)
        often = count[where] >= times
        changed = not often.all()
        at = at[often]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]])
        part = np.cumsum(new) - 1
        long = np.bincount(part, minlength=1)[part] >= length if len(at) else np.zeros(0, bool)
        if not long.all():
            changed, at, part = True, at[long], part[long]
        if not changed:
            break
    if len(at):
        ends = np.flatnonzero(np.append(np.diff(part) != 0, True))
        for a, b in zip(at[np.append(0, ends[:-1] + 1)].tolist(), at[ends].tolist(), strict=True):
            yield a, b + 1


def find(texts: list[str]) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """Number of words, runs and collapsed text of each text. Words are separated by the ASCII white space that bytes.split knows."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    doc = np.searchsorted(first, starts, "right") - 1
    begin = np.searchsorted(starts, first)
    ids = ranks(data, starts, sizes)
    runs: dict[int, list] = {}
    for a, b in stretches(doc, ids):
        d = int(doc[a])
        runs.setdefault(d, []).extend((a - int(begin[d]) + s, m, p) for s, m, p in runs_of(ids[a:b].tolist()))
    out = []
    for i, r in enumerate(raw):
        words, mine = r.split(), sorted(runs.get(i, []), key=lambda x: (x[0], x[2]))
        if mine:
            gone = np.zeros(len(words) + 1, np.int64)
            for s, m, p in mine:
                gone[s + p] += 1
                gone[s + m] -= 1
            collapsed = [w for w, g in zip(words, np.cumsum(gone).tolist()[:-1], strict=True) if not g]
        else:
            collapsed = words
        out.append((len(words), mine, b" ".join(collapsed).decode("utf-8", "surrogatepass")))
    return out


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start and length in words, period; by start, then period), and collapsed: the words left, joined by a
    space, when each run keeps its first period only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                done = find(texts_of(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([n for n, _, _ in done], pa.int64()),
                        pa.array([[{"start": s, "length": m, "period": p} for s, m, p in r] for _, r, _ in done], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                        pa.array([c for _, _, c in done], pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def plant(docs: DataFrame) -> DataFrame:
    """doc_id, text with a periodic tail in a tenth of the documents, as the query op13 fixes it: where h = crc32(doc_id) is a
    multiple of 10, the words from a on repeat the p words at a. Other texts stay as they are."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    bent = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"), bent).otherwise(F.col("text")).alias("text"))


def _better(x: Column, y: Column) -> Column:
    """Of two runs in order of start and period, that of greater length / period; the first of equals."""
    return F.when(x["period"].isNull() | (y["length"] * x["period"] > x["length"] * y["period"]), y).otherwise(x)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run with most periods, runs_sha256, collapsed_sha256."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", none, _better).alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

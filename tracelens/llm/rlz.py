"""Substring dedup by relative Lempel-Ziv parsing against an index of every document's blocks.

Each document is parsed greedily from left to right into factors: (place, words, source document, place there), runs of words
that stand in a document of smaller id, its reference. A factor starts at the first word at which `window` consecutive words also
start in a document of smaller id, and goes on as long as the text goes on as its reference does; where it doesn't but the words
are found in another one, the next factor starts. Factors have `window` words at least and become duplicate spans.

The index holds one entry for each reference block: the least hash of the `gram`-word runs inside a window (a minimizer),
which any two equal windows share. A block that occurs in one document only can hold no duplicate, so only windows over
shared blocks are looked up: two 64-bit hashes of the window's words name it, and the document of least id that has it owns
it. Owners, not copies, are told (one row for each different window), so no key collects what a common passage gathers, and
the result doesn't depend on how documents are dealt out. So each document knows its copied windows, and asks the index for the
references of those that tile their runs: every `window`-th one and the last. What straddles the boundary of two factors is a
window like any other, so a span that two factors cover only together is found or left exactly as its own windows say.

Null or empty text: no words, nothing removed. Texts of under `window` words lose nothing. Equal rows: the row of least
doc_id keeps its words; ties between a reference's places go to its first. Repeats inside one document stay. Rows with equal
doc_id are one document. Rows without doc_id are left out. Very long texts are held one at a time. An empty table gives an empty
one. doc_id may be of any integer type and comes out as long. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .wordhash import U, Words, gram_starts, mix, runs, sliding_min, words


def _windows(batch: pa.RecordBatch, window: int, gram: int):
    """The words, the word index at which each window starts, and the window's minimizer."""
    w = words(batch.column("text"), lower=False)
    at = gram_starts(w.first, window)
    return w, at, sliding_min(runs(w.hash, gram), window - gram + 1)[at] if len(at) else np.zeros(0, U)


def _blocks(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w, at, block = _windows(part, window, gram)
                doc = w.doc[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(block[new].view(np.int64)), pa.array(ids[doc[new]])], ["block", "doc_id"])

    return run


def _listed(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and each one's row."""
    sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).view(U), np.repeat(np.arange(len(sizes)), sizes)


def _within(values: np.ndarray, row: np.ndarray, column: pa.ListArray) -> np.ndarray:
    """Whether each value is in the list of its row."""
    had, of = _listed(column)
    keyed = lambda x, r: mix(x + mix(r.astype(U) + U(1)))
    return np.isin(keyed(values, row), keyed(had, of))


def _lookups(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w, at, block = _windows(part, window, gram)
                doc = w.doc[at]
                shared = ~_within(block, doc, part.column("alone"))
                at, doc = at[shared], doc[shared]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                place = (at - w.first[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*_names(w, at, window), pa.array(ids[doc]), pa.array(place)], ["h1", "h2", "doc_id", "place"])

    return run


def _names(w: Words, at: np.ndarray, window: int) -> list[pa.Array]:
    return [pa.array(runs(w.hash, window, lane)[at].view(np.int64)) for lane in (0, 1)]


def _tiles(window: int, gram: int):
    """Of each run of copied windows: the run's first word, and the windows that tile it, as h1, h2, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w, at, block = _windows(part, window, gram)
                doc = w.doc[at]
                shared = ~_within(block, doc, part.column("alone"))
                at, doc = at[shared], doc[shared]
                own = [_within(runs(w.hash, window, lane)[at], doc, part.column(f"own{lane}")) for lane in (0, 1)]
                at = at[~(own[0] & own[1])]
                doc = w.doc[at]
                begins = np.ones(len(at), dtype=bool)
                begins[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
                start = at[begins][np.cumsum(begins) - 1] if len(at) else at
                last = np.append(begins[1:], True) if len(at) else begins
                tile = ((at - start) % window == 0) | last
                at, doc, start = at[tile], doc[tile], start[tile]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                places = [pa.array((x - w.first[doc]).astype(np.int32)) for x in (at, start)]
                yield pa.RecordBatch.from_arrays([*_names(w, at, window), pa.array(ids[doc]), *places], ["h1", "h2", "doc_id", "place", "run"])

    return run


def parse(tiles: list[tuple[int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """Factors (place, words, source, source place) of one document, from its tiles (run, place, source, source place) in order:
    a tile that goes on where the factor before it ends or overlaps it, in the same source at the same distance, extends it."""
    out: list[list[int]] = []
    now = None
    for run, place, source, there in tiles:
        if out and run == now and out[-1][2] == source and there - place == out[-1][3] - out[-1][0]:
            out[-1][1] = place + window - out[-1][0]
        else:
            out.append([place, window, source, there])
        now = run
    return [tuple(x) for x in out]


FACTORS = "array<struct<place:int,words:int,source_id:long,source_place:int>>"


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, tiles in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("tiles").to_pylist(), strict=True):
                parts = text.as_buffer().to_pybytes().split() if text.is_valid else []
                factors = parse([(t["run"], t["place"], t["source_id"], t["source_place"]) for t in tiles or ()], window)
                n, spans, kept, done = len(parts), len({t["run"] for t in tiles or ()}), [], 0
                for place, words, _, _ in factors:
                    kept += parts[done:place]
                    done = max(done, place + words)
                kept += parts[done:]
                rows.append((doc_id, n, n - len(kept), spans, b" ".join(kept).decode(), [dict(zip(("place", "words", "source_id", "source_place"), f, strict=True)) for f in factors]))
            names = ["doc_id", "n_words", "n_removed", "n_factors", "kept"]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("place", pa.int32()), ("words", pa.int32()), ("source_id", pa.int64()), ("source_place", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], [*names, "factors"])

    return run


def dedup_substrings(docs: DataFrame, window: int = 50, gram: int = 16) -> DataFrame:
    """doc_id, n_words, n_removed, n_factors, kept, factors. kept: the words that no factor covers, joined by one space;
    n_factors: runs of copied windows, each parsed into one factor or more; factors: the parse, place and words counted in words."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = docs.mapInArrow(_blocks(window, gram), "block long, doc_id long")
    alone = blocks.groupBy("block").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("most")).where("doc_id = most").groupBy("doc_id").agg(F.collect_list("block").alias("alone"))
    with_alone = docs.join(alone, "doc_id", "left").select("doc_id", "text", "alone")
    lookups = with_alone.mapInArrow(_lookups(window, gram), "h1 long, h2 long, doc_id long, place int")
    # the filter changes no row; a later join on h1 and h2 would add it on its side alone, and the two uses could not share a shuffle
    owners = lookups.where("h1 is not null and h2 is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "place")).alias("source"))
    own = owners.groupBy(F.col("source.doc_id").alias("doc_id")).agg(F.collect_list("h1").alias("own0"), F.collect_list("h2").alias("own1"))
    tiles = with_alone.join(own, "doc_id", "left").select("doc_id", "text", "alone", "own0", "own1").mapInArrow(_tiles(window, gram), "h1 long, h2 long, doc_id long, place int, run int")
    found = tiles.join(owners, ["h1", "h2"]).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("run", "place", F.col("source.doc_id").alias("source_id"), F.col("source.place").alias("source_place")))).alias("tiles"))
    return docs.join(found, "doc_id", "left").select("doc_id", "text", "tiles").mapInArrow(_kept(window), f"doc_id long, n_words long, n_removed long, n_factors long, kept string, factors {FACTORS}")


def spans_digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "n_factors")

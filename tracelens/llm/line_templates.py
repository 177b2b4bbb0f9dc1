"""Line dedup with a log-template tree: lines that recur across documents, up to variable fields, are dropped.

Fields with digits, addresses and links are variable and stand as <*>. The tree has a fixed depth: a line goes by its token
count, then by its first `depth` tokens, to a leaf. In a leaf, lines in order of how many documents have them join the
template most like them (equal tokens in equal places, of all tokens, at least `similarity`), whose differing places become
<*>, or start one.

A line recurs if it occurs (its variable fields apart) in at least `min_docs` different documents, however often a document has
it. That two lines are alike but for a word says little: a template that stands for words recurs as a whole only if its lines
are first seen in at least `word_docs` different documents and each such place has at least `word_values` different words; else
its lines go by themselves. Recurring lines go from every document but the first (least doc_id) that has the line, or one of the
recurring template.

Equal lines are counted before anything is dealt by leaf, so a leaf holds different lines only; leaves that can't recur, and
those with one line, are settled without being gathered. In a leaf, templates are found by blocks of their tokens, one of which
a similar line shares, so a line is not compared with every template. A line under `min_tokens` tokens is a template of its own,
as it stands (white space aside); lines without tokens stay. A text whose lines all go becomes empty. Null text: no lines, stays
null. Very long texts are taken one at a time. Ties between templates go to the older one, between lines in as many documents to
the lesser hash. Rows of one doc_id are one document; rows without doc_id keep their lines and don't count. An empty table gives
an empty one. Extra columns are kept whatever their names, but n_lines and n_dropped are replaced. doc_id: any integer type.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, total

MIN_DOCS, MIN_TOKENS, DEPTH, SIMILARITY = 2, 3, 3, 0.8
#: What shows that a place of words in a template is a field.
WORD_DOCS, WORD_VALUES = 8, 4
WILD = "<*>"
#: What makes a token variable: a digit, an @ or ://.
_VARIABLE = re.compile(r"[0-9@]|://")


def masked(line: str) -> list[str]:
    return [WILD if _VARIABLE.search(t) else t for t in line.split()]


def _lines(docs: DataFrame, depth: int, min_tokens: int, with_text: bool = False) -> DataFrame:
    """doc_id, pos, leaf, h of every line with a token, and the masked line if asked for; a line under min_tokens is its own leaf.

    A plain Python pass: as SQL expressions, which the optimizer repeats, the query took 951 CPU seconds a GB; so, 259.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not text:
                        continue
                    varied = _VARIABLE.search(text) is not None
                    for pos, raw in enumerate(text.split("\n")):
                        tokens = raw.split()
                        if not tokens:
                            continue
                        short = len(tokens) < min_tokens
                        if varied and not short and _VARIABLE.search(raw):
                            tokens = masked(raw)
                        line = " ".join(tokens)
                        leaf = f"= {line}" if short else f"{len(tokens)} {' '.join(tokens[:depth])}"
                        rows.append((doc, pos, signed(digest(leaf)), signed(digest(line)), line if with_text else None))
                columns = [*zip(*rows, strict=True)] if rows else [[]] * 5
                kinds = [("doc_id", pa.int64()), ("pos", pa.int32()), ("leaf", pa.int64()), ("h", pa.int64()), ("line", pa.string())][: 5 if with_text else 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=False)], [n for n, _ in kinds])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, pos int, leaf long, h long" + ", line string" * with_text)


class _Index:
    """Templates of one leaf by blocks of positions: at most `apart` positions of a line differ from its template, so of
    apart + 1 blocks one is equal. The positions that all lines of the leaf share are in no block."""

    def __init__(self, tokens: int, depth: int, similarity: float):
        apart = tokens - math.ceil(similarity * tokens - 1e-9)
        free, n = tokens - min(depth, tokens), apart + 1
        self.cuts = [(depth + i * free // n, depth + (i + 1) * free // n) for i in range(n)] if free >= n else [(0, 0)]
        self.held: dict[tuple, list[int]] = {}

    def keys(self, tokens: list[str]) -> Iterator[tuple]:
        return ((i, *tokens[a:b]) for i, (a, b) in enumerate(self.cuts))

    def add(self, number: int, tokens: list[str]) -> None:
        for key in self.keys(tokens):
            known = self.held.setdefault(key, [])
            if not known or known[-1] != number:
                known.append(number)

    def like(self, tokens: list[str]) -> list[int]:
        found = [self.held[key] for key in self.keys(tokens) if key in self.held]
        return found[0] if len(found) == 1 else sorted(set().union(*found))


def grow(leaf_lines: list[tuple[int, str, int, int]], similarity: float, depth: int = 0) -> list[int]:
    """(h, line, docs, first) of one leaf, in order -> the number of each line's template. All lines have the same number of
    tokens, of which the first `depth` are equal."""
    templates: list[list[str]] = []
    member = []
    index = None
    for _, line, _, _ in leaf_lines:
        tokens = line.split(" ")
        index = index or _Index(len(tokens), depth, similarity)
        best, most = None, similarity * len(tokens)
        for number in sorted(set(index.like(tokens))):
            same = sum(map(str.__eq__, templates[number], tokens))
            if same >= most and (best is None or same > most):
                best, most = number, same
        if best is None:
            best = len(templates)
            templates.append(tokens)
            index.add(best, tokens)
        else:
            merged = [x if x == y else WILD for x, y in zip(templates[best], tokens, strict=True)]
            if merged != templates[best]:
                templates[best] = merged
                index.add(best, merged)
        member.append(best)
    names: dict[str, int] = {}
    number_of = [names.setdefault(" ".join(t), i) for i, t in enumerate(templates)]
    return [number_of[m] for m in member]


def _recurring(leaf_lines: list[tuple[int, str, int, int]], similarity: float, depth: int, min_docs: int, word_docs: int, word_values: int) -> list[tuple[int, int]]:
    """(h, first) of one leaf's lines that recur: first is the first document of the line, or of its template if that recurs."""
    templates: dict[int, list[int]] = {}
    for i, number in enumerate(grow(leaf_lines, similarity, depth)):
        templates.setdefault(number, []).append(i)
    out = []
    for lines in templates.values():
        firsts = {leaf_lines[i][3] for i in lines}
        whole = len(lines) > 1 and len(firsts) >= max(word_docs, min_docs)
        if whole:
            places = [set(tokens) for tokens in zip(*(leaf_lines[i][1].split(" ") for i in lines), strict=True)]
            whole = all(len(words) == 1 or len(words - {WILD}) >= word_values for words in places)
        out += [(leaf_lines[i][0], min(firsts) if whole else leaf_lines[i][3]) for i in lines if whole or leaf_lines[i][2] >= min_docs]
    return out


def _leaves(similarity: float, depth: int, *evidence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list) -> pa.RecordBatch:
            found = _recurring(rows, similarity, depth, *evidence)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in (0, 1)], ["h", "first"])

        held, now = [], None
        for batch in batches:
            for leaf, *row in zip(*(batch.column(c).to_pylist() for c in ("leaf", "h", "line", "docs", "first")), strict=True):
                if leaf != now and held:
                    yield made(held)
                    held = []
                now = leaf
                held.append(tuple(row))
        if held:
            yield made(held)

    return run


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, depth: int = DEPTH, similarity: float = SIMILARITY, word_docs: int = WORD_DOCS, word_values: int = WORD_VALUES) -> tuple[DataFrame, int]:
    """h (of a masked line) and first document of every line that recurs; and how many there are at most."""
    lines = _lines(docs, depth, min_tokens)
    counted = cut(lines.groupBy("leaf", "h").agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first")))
    # a leaf's lines together are in at most the sum of their documents
    leaves = counted.groupBy("leaf").agg(F.sum("docs").alias("all"), F.count("*").alias("lines")).where(F.col("all") >= min_docs)
    several = cut(counted.join(leaves.where("lines > 1").select("leaf"), "leaf"), total(counted))
    alone = counted.where(F.col("docs") >= min_docs).join(leaves.where("lines = 1").select("leaf"), "leaf", "left_semi")
    # the words of a line are read once, from its first document; the tables joined here grow with the corpus, so they are
    # dealt out at every size
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(several.select(F.col("first").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    words = _lines(texts, depth, min_tokens, True).join(several.withColumnRenamed("first", "doc_id").hint("merge"), ["doc_id", "leaf", "h"]).dropDuplicates(["h"])
    dealt = words.select("leaf", "h", "line", "docs", F.col("doc_id").alias("first")).repartition("leaf").sortWithinPartitions("leaf", F.desc("docs"), "h")
    grown = dealt.mapInArrow(_leaves(similarity, depth, min_docs, word_docs, word_values), "h long, first long")
    return alone.select("h", "first").union(grown), total(counted)


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, depth: int = DEPTH, similarity: float = SIMILARITY, word_docs: int = WORD_DOCS, word_values: int = WORD_VALUES) -> DataFrame:
    """All columns of docs, text without the dropped lines, and n_lines, n_dropped (names that docs has are replaced)."""
    out = cut(*recurring(docs, min_docs, min_tokens, depth, similarity, word_docs, word_values))
    place = _lines(docs, depth, min_tokens).drop("leaf")
    rest = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    mark = next(c for i in range(len(rest) + 1) if (c := f"gone_{i}") not in {x.lower() for x in rest})
    gone = place.join(out.select("h", "first").hint("merge"), "h").where("doc_id != first").groupBy("doc_id").agg(F.collect_set("pos").alias(mark))
    names = [*rest, "n_lines", "n_dropped"]
    schema = docs.select(*rest).withColumn("n_lines", F.lit(0).cast("long")).withColumn("n_dropped", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, n, dropped = [], [], []
                for text, drop in zip(part.column("text").to_pylist(), part.column(mark).to_pylist(), strict=True):
                    lines = text.split("\n") if text else []
                    n.append(len(lines))
                    drop = set(drop or ())
                    kept = [x for i, x in enumerate(lines) if i not in drop] if drop else lines
                    dropped.append(len(lines) - len(kept))
                    texts.append(text if len(kept) == len(lines) else "\n".join(kept))
                columns = {c: part.column(c) for c in rest} | {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return docs.select(*rest).join(gone.hint("merge"), "doc_id", "left").mapInArrow(run, schema)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"), "text")

"""Ingest: Markdown chunking, corpus version, incremental embedding, concept tables."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, lexicon
from ..functions import text as T

TARGET_TOKENS, MIN_TOKENS, OVERLAP = 800, 30, 120
CHARS_PER_TOKEN = 4
#: What a document is made of: a fence with all up to the line that closes it (or the end), a heading, a blank line, any other line.
_UNIT = re.compile(
    r"^[^\S\n]*(?P<mark>```|~~~)[^\n]*(?:(?:\n.*?)??\n[^\S\n]*(?P=mark)[^\n]*|.*\Z)"
    r"|^(?P<level>\#{1,6})[^\S\n]+(?P<title>[^\n]*?)[^\S\n]*\#*[^\S\n]*$|^(?P<blank>[^\S\n]*)$|^[^\n]+$",
    re.M | re.S,
)


def sections(markdown: str) -> list[tuple[list[str], list[str], int]]:
    """(heading path, blocks, characters) of sections with any text. Blocks are runs of lines without a blank one; headings and
    blank lines inside a fence are text, so a fence is never cut."""
    text = "\n".join(markdown.splitlines())
    units = [*_UNIT.finditer(text)]
    slots: list[str | None] = [None] * 6  # the heading of each level, which clears those under it
    out = []
    bounds = [-1, *(i for i, u in enumerate(units) if u["level"]), len(units)]
    for at, after in itertools.pairwise(bounds):
        if at >= 0:
            level = len(units[at]["level"])
            slots[level - 1 :] = [units[at]["title"].strip(), *[None] * (6 - level)]
        inside = units[at + 1 : after]
        blocks = ["\n".join(u[0] for u in run) for kept, run in itertools.groupby(inside, lambda u: u["blank"] is None) if kept]
        if blocks:
            blocks[0] = blocks[0].lstrip()
            blocks[-1] = blocks[-1].rstrip()
            out.append(([s for s in slots if s is not None], blocks, len(text[inside[0].start() : inside[-1].end()].strip())))
    return out


def _sizable(found: list[tuple[list[str], list[str], int]], least: int) -> Iterator[tuple[list[str], list[str]]]:
    """Runs of sections with `least` tokens together, under the last one's headings; what is left at the end joins the run before."""
    ends = [0, *itertools.accumulate(chars + 2 for _, _, chars in found)]
    chars = least * CHARS_PER_TOKEN + 2 if least > 1 else 0
    cuts = [0]
    while cuts[-1] < len(found) and (after := bisect.bisect_left(ends, ends[cuts[-1]] + chars, cuts[-1] + 1)) <= len(found):
        cuts.append(after)
    if len(cuts) == 1 and found:  # all of it together is short
        cuts.append(len(found))
    rest = found[cuts[-1] :]
    for i, (a, b) in enumerate(itertools.pairwise(cuts)):
        tail = rest if i == len(cuts) - 2 else []
        yield found[b - 1][0], [x for _, blocks, _ in (*found[a:b], *tail) for x in blocks]


def _packed(blocks: list[str], target: int, overlap: int) -> Iterator[str]:
    """As many blocks as fit the target, over again from the last ones that fit the overlap; a block over the target stays whole."""
    total = [0, *itertools.accumulate(max(1, len(b) // CHARS_PER_TOKEN) for b in blocks)]
    start = stop = 0
    while stop < len(blocks):
        start = max(start, bisect.bisect_left(total, total[stop] - overlap)) if stop else 0
        stop = max(stop + 1, bisect.bisect_right(total, total[start] + target) - 1)
        yield "\n\n".join(blocks[start:stop]).strip()


def pieces(markdown: str, target: int = TARGET_TOKENS, least: int = MIN_TOKENS, overlap: int = OVERLAP) -> list[tuple[list[str], str]]:
    """Chunks of a document: short sections join the next one, long ones are packed from blocks with an overlapping tail."""
    return [(path, text) for path, blocks in _sizable(sections(markdown), least) for text in _packed(blocks, target, overlap) if text]


def chunk_markdown(docs: DataFrame) -> DataFrame:
    """chunk_id, tenant_id, doc_id, ordinal, heading_path, text from docs(tenant_id, doc_id, markdown): the one ingest step
    that is a state machine and so runs in Python, document by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
        for batch in batches:
            rows = [(t, d, i, path, text) for t, d, m in zip(*(batch.column(c).to_pylist() for c in ("tenant_id", "doc_id", "markdown")), strict=True) for i, (path, text) in enumerate(pieces(m or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["tenant_id", "doc_id", "ordinal", "heading_path", "text"])

    cut = docs.select("tenant_id", "doc_id", "markdown").mapInArrow(run, "tenant_id string, doc_id string, ordinal int, heading_path array<string>, text string")
    return cut.select(ids.chunk_id(F.col("tenant_id"), F.col("doc_id"), F.col("ordinal"), F.col("text")).alias("chunk_id"), "*")


def corpus_version(docs: DataFrame, label: str = "corpus") -> DataFrame:
    """label@ and 8 hex digits over the sorted document digests, whatever their order.

    Digests are combined in two levels, so no task gathers all of them: by the first three hex digits, then the 4096 results.
    """
    digest = docs.select(F.sha2(F.concat_ws("\x1f", "tenant_id", "doc_id", F.sha2(T.text_of("text"), 256)), 256).alias("d"))
    parts = digest.groupBy(F.substring("d", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("d"))
    return parts.agg(F.array_join(F.sort_array(F.collect_list(F.concat("p", "d"))), "").alias("all")).select(F.concat(F.lit(label + "@"), F.substring(F.sha2("all", 256), 1, 8)).alias("corpus_version"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """token -> concept for each distinct token (see `with_concept`)."""
    return with_concept(tokens.select("token").distinct())


def with_concept(tokens: DataFrame) -> DataFrame:
    """tokens(token) and the concept of each, row by row: identifiers with digit runs as #, else four rounds of synonym, stem, synonym.

    Each round joins the small lexicon, so an expression is never expanded into itself.
    """
    spark = tokens.sparkSession
    lex = F.broadcast(spark.createDataFrame(list(lexicon.SYNONYMS.items()), "word string, instead string"))
    out = tokens.select("token").withColumn("t", F.col("token"))
    for _ in range(4):
        for then_stem in (True, False):
            out = out.join(lex, F.col("t") == F.col("word"), "left").withColumn("t", F.coalesce("instead", "t")).drop("word", "instead")
            if then_stem:
                out = out.withColumn("t", T.stem("t"))
    out = out.join(lex, F.col("token") == F.col("word"), "left")
    return out.select("token", F.when(F.col("word").isNull() & T.is_identifier("token"), _smeared("token")).otherwise(F.col("t")).alias("concept"))


def _smeared(token: str) -> Column:
    return F.concat(F.lit("id:"), F.regexp_replace(token, "[0-9]+", "#"))


def concept(token: str) -> Column:
    """What `with_concept` gives, as an expression: nothing is joined, and where it stands behind a coalesce it costs nothing for the
    other rows. Each step is a transform of an array of one, so it is never expanded into itself either."""
    lex = F.create_map(*[F.lit(w) for pair in lexicon.SYNONYMS.items() for w in pair])
    instead = lambda t: F.coalesce(F.try_element_at(lex, t), t)
    one = F.array(token)
    for _ in range(4):
        one = F.transform(F.transform(F.transform(one, instead), T.stem), instead)
    return F.when(F.try_element_at(lex, F.col(token)).isNull() & T.is_identifier(token), _smeared(token)).otherwise(F.get(one, F.lit(0)))


def incremental(chunks: DataFrame, had: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(reused, todo): chunks whose vector of this model is in had(chunk_id, model_id, ...), and those to embed."""
    known = had.where(F.col("model_id") == model)
    return chunks.join(known, "chunk_id"), chunks.join(known, "chunk_id", "left_anti")


def idf(df: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.25), F.log((n + 1) / (df + 1)) + 0.5)


def guard_duplicates(docs: DataFrame) -> DataFrame:
    """docs, or a run-time error where a tenant has a doc_id twice."""
    twice = docs.groupBy("tenant_id", "doc_id").agg(F.count("*").alias("n"))
    return docs.join(twice, ["tenant_id", "doc_id"]).where(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate document "), "doc_id"))).otherwise(F.lit(True)).isNotNull()).drop("n")

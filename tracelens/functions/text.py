"""Text kernel as Column expressions: tokens, identifiers, stems, discriminators, sentences, markers. No Python runs per row.

Null text counts as empty. Array results that are taken apart should be exploded with explode_outer: a plain explode lets the
optimizer move an inferred filter below the expression and evaluate it twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

EMPTY = "array<string>"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_of(x: str | Column) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def raw_tokens(text: str | Column) -> Column:
    found = F.regexp_extract_all(text_of(text), F.lit(L.TOKEN), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.btrim(F.lower(t), F.lit(".-_"))), lambda t: t != "")


def is_identifier(token: str | Column) -> Column:
    return _c(token).rlike(L.IDENTIFIER)


def stem(token: str | Column) -> Column:
    t = _c(token)
    out = F.when((F.length(t) <= 3) | is_identifier(t), t)
    for suffix, instead in L.SUFFIXES:
        out = out.when(t.endswith(suffix) & (F.length(t) - len(suffix) >= 3), F.concat(F.substring(t, F.lit(1), F.length(t) - len(suffix)), F.lit(instead)))
    return out.otherwise(t)


def content_tokens(text: str | Column) -> Column:
    dropped = [w for w in L.STOPWORDS if w not in L.POLARITY]
    return F.filter(raw_tokens(text), lambda t: ~t.isin(dropped))


def discriminators(text: str | Column) -> Column:
    """Sorted distinct polarity words (as pol:word), identifiers and numbers."""
    marked = F.transform(raw_tokens(text), lambda t: F.when(t.isin(L.POLARITY), F.concat(F.lit("pol:"), t)).when(is_identifier(t) | t.rlike("^[0-9]+$"), t))
    return F.array_sort(F.array_distinct(F.filter(marked, lambda t: t.isNotNull())))


def identifiers(text: str | Column) -> Column:
    return F.array_distinct(F.filter(raw_tokens(text), is_identifier))


def numbers(text: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text_of(text), F.lit(L.NUMBER), F.lit(0)))


def strip_code_fences(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), L.FENCED, " ")


def sentences(text: str | Column) -> Column:
    """Trimmed sentences: paragraphs at blank lines, line ends as spaces, cuts after . ! ? before a capital, ( ` or [."""
    paragraphs = F.split(text_of(text), L.PARAGRAPH_END)
    cut = F.flatten(F.transform(paragraphs, lambda p: F.split(F.replace(p, F.lit("\n"), F.lit(" ")), L.SENTENCE_END)))
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def sentence_spans(text: str | Column) -> Column:
    """array<struct<start,end,sentence>>: offsets into the text, end exclusive; each found after the one before it."""
    flat = F.replace(text_of(text), F.lit("\n"), F.lit(" "))
    none = F.array().cast("array<struct<start:int,end:int,sentence:string>>")
    return F.aggregate(
        sentences(text),
        F.struct(F.lit(1).alias("at"), none.alias("spans")),
        lambda acc, s: F.struct(
            (F.call_function("locate", s, flat, acc["at"]) + F.length(s)).alias("at"),
            F.concat(acc["spans"], F.array(F.struct((F.call_function("locate", s, flat, acc["at"]) - 1).alias("start"), (F.call_function("locate", s, flat, acc["at"]) - 1 + F.length(s)).alias("end"), s.alias("sentence")))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def is_prose(sentence: str | Column) -> Column:
    s = F.trim(text_of(sentence))
    marked = s.startswith("```") | s.startswith("~~~") | s.startswith("|")
    words = F.size(F.regexp_extract_all(s, F.lit(L.PROSE_WORD), F.lit(0)))
    return ~marked & (words >= 5) & ~(s.contains(":") & ~s.rlike(L.TERMINAL))


def clean_sentence(sentence: str | Column) -> Column:
    return F.trim(F.regexp_replace(text_of(sentence), L.LIST_MARK, ""))


def _any(patterns: list[str]) -> str:
    return "(?i)" + "|".join(patterns)


def has_refusal_marker(text: str | Column, extra: Column | None = None) -> Column:
    found = text_of(text).rlike(_any(L.REFUSAL))
    return found if extra is None else found | F.exists(extra, lambda m: F.contains(F.lower(text_of(text)), F.lower(m)))


def is_hedged(text: str | Column) -> Column:
    return text_of(text).rlike(_any(L.HEDGE + L.REFUSAL))


def estimate_tokens(text: str | Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text_of(text)) / 4)).cast("int")


def price_of(model: str | Column, tokens_in: Column, tokens_out: Column) -> Column:
    """USD; unknown models cost nothing."""
    def per(i: int) -> Column:
        return reduce(lambda c, m: c.when(_c(model) == m, F.lit(float(L.PRICES[m][i]))), list(L.PRICES)[1:], F.when(_c(model) == list(L.PRICES)[0], F.lit(float(L.PRICES[list(L.PRICES)[0]][i])))).otherwise(F.lit(0.0))

    return F.bround((tokens_in * per(0) + tokens_out * per(1)) / 1e6, 8)


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / union)


def citations(text: str | Column) -> Column:
    """Source numbers in [1] and [1, 2] groups, in order, distinct."""
    groups = F.regexp_extract_all(text_of(text), F.lit(L.CITED), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda n: n.cast("int")))


def parse_scores(reply: str | Column) -> Column:
    """array<struct<n,score>> of a reranker's reply: JSON with a list of scores, else n: score pairs."""
    kind = "array<struct<n:int,score:double>>"
    whole = F.from_json(text_of(reply), f"scores {kind}")["scores"]
    pair = L.SCORED
    pairs = F.transform(F.regexp_extract_all(text_of(reply), F.lit(pair), F.lit(0)), lambda p: F.struct(F.regexp_extract(p, pair, 1).cast("int").alias("n"), F.regexp_extract(p, pair, 2).cast("double").alias("score")))
    return F.coalesce(whole, pairs.cast(kind))


def unwrap(reply: str | Column, *reasoning: str | Column) -> Column:
    """A model's answer: its content, or where that is blank the first of its reasoning fields that isn't, without thoughts."""
    said = [F.when(F.trim(text_of(c)) != "", F.trim(text_of(c))) for c in (reply, *reasoning)]
    return F.trim(F.regexp_replace(F.coalesce(*said, F.lit("")), L.THOUGHT, ""))


def cosine(a: str | Column, b: str | Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.when(dot(x, x) == 0, F.lit(1.0)).otherwise(F.sqrt(dot(x, x)))
    return F.bround(dot(_c(a), _c(b)) / (norm(_c(a)) * norm(_c(b))), 6)


def missing(asked: str | Column, held: str | Column) -> Column:
    """The distinct members of asked that held lacks, in asked's order."""
    return F.array_except(_c(asked), _c(held))

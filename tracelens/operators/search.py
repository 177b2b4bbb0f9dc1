"""Substring search for many patterns at once, by anchors instead of comparing each text with each pattern.

Text and patterns are split at white space. A text that contains a pattern has each of the pattern's inner pieces as a whole token,
so a pattern is looked for where its rarest inner piece stands (counted over the corpus). A pattern without inner pieces has an
edge piece, which lies inside some token: those tokens are found among the corpus's different tokens, by the rarest of the piece's
grams. Every candidate is then compared as a whole, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import MANY, cut, is_small, small

GRAM = 3
_PIECES = r"\s+"


def _tokens(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, token: a text's different tokens."""
    return texts.select(*keys, F.explode(F.array_distinct(F.split(text, _PIECES))).alias("token")).where("token != ''")


def _grams(word: str, size: Column) -> Column:
    """The different substrings of a size, none of a shorter word."""
    n = F.length(word)
    return F.when(n < size, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(F.col(word), i, size))))


def _rarest(of: DataFrame, key: list[str], part: str, counts: DataFrame) -> DataFrame:
    """of(key, part) with counts(part, n): each key's part that stands least often; keys with a part that stands nowhere go."""
    least = of.join(counts, part, "left").groupBy(*key).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col(part).alias("part"))).alias("least"))
    return least.where("least.n > 0").select(*key, F.col("least.part").alias(part))


def _inside(edges: DataFrame, words: DataFrame) -> DataFrame:
    """pattern_id, pattern, token: the words that hold edges(pattern_id, pattern, piece, place) as their end, beginning or anywhere."""
    pieces = edges.select("piece").distinct()
    sizes = sorted(r[0] for r in edges.select(F.least(F.length("piece"), F.lit(GRAM))).distinct().collect())
    size = F.explode(F.array(*[F.lit(s) for s in sizes]))
    grams = words.select("token", size.alias("size")).select("token", F.explode(_grams("token", F.col("size"))).alias("gram"))
    own = pieces.select("piece", F.explode(_grams("piece", F.least(F.length("piece"), F.lit(GRAM)))).alias("gram"))
    counts = grams.join(small(own.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    anchored = edges.join(_rarest(own, ["piece"], "gram", counts), "piece")
    place = F.when(F.col("place") == "end", F.endswith("token", "piece")).when(F.col("place") == "begin", F.startswith("token", "piece")).otherwise(F.contains("token", "piece"))
    return grams.join(small(anchored), "gram").where(place).select("pattern_id", "pattern", "token").distinct()


def _in_place(texts: DataFrame, cut_up: DataFrame, held: DataFrame, anchors: DataFrame, keys: list[str], text: str) -> DataFrame:
    """What `containing` gives, where the anchors are few and go to the texts: a text is compared where it is read and only what is
    found is shuffled. A pattern with an edge piece can meet a text at several tokens: rows are numbered for the time being, and each
    number counts once. No lambda may stand between the tokens and the join: the text would be copied for each token."""
    rows = texts.select(*keys, F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    each = rows.select(*keys, "__text", "__row", F.explode_outer(F.array_distinct(F.split("__text", _PIECES))).alias("token")).where("token != ''")
    met = each.join(F.broadcast(anchors), "token").where(F.contains("__text", "pattern"))
    found = met.select(*keys, "__row", "pattern_id", "pattern").distinct().drop("__row")
    blank = cut_up.where(F.forall("pieces", lambda p: p == "")).select("pattern_id", "pattern")
    if not blank.isEmpty():
        everywhere = texts.select(*keys, F.col(text).alias("__text"), F.lit("").alias("token"))
        met = everywhere.join(small(blank.withColumn("token", F.lit(""))), "token").where(F.contains("__text", "pattern"))
        found = found.union(met.select(*keys, "pattern_id", "pattern"))
    return found.join(small(held), ["pattern_id", "pattern"]).select(*keys, "pattern_id")


def containing(texts: DataFrame, patterns: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, pattern_id: texts and the patterns that they contain; as the join on contains(text, pattern) has it, row for row.

    Nulls contain nothing and are in nothing; the empty pattern is in every text.
    """
    held = patterns.select("pattern_id", "pattern").where("pattern is not null")
    cut_up = held.distinct().withColumn("pieces", F.split("pattern", _PIECES))
    each = cut_up.select("pattern_id", "pattern", F.size("pieces").alias("n"), F.posexplode("pieces").alias("at", "piece")).where("piece != ''")
    inner = each.where("at > 0 and at < n - 1").select("pattern_id", "pattern", F.col("piece").alias("token"))
    tokens = _tokens(texts, keys, text)
    counts = tokens.join(small(inner.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    anchors = _rarest(inner, ["pattern_id", "pattern"], "token", counts)
    # patterns whose pieces are all at an edge, by the longest of those
    place = F.when(F.col("n") == 1, "any").when(F.col("at") == 0, "end").otherwise("begin")
    longest = Window.partitionBy("pattern_id", "pattern").orderBy(F.desc(F.length("piece")), "at")
    edges = each.where("n <= 2").withColumn("place", place).withColumn("r", F.row_number().over(longest)).where("r = 1").select("pattern_id", "pattern", "piece", "place")
    if not edges.isEmpty():
        anchors = anchors.select("pattern_id", "pattern", "token").union(_inside(edges, cut(tokens.select("token").distinct())))
    anchors = cut(anchors.select("pattern_id", "pattern", "token"))
    if is_small(anchors, MANY):
        return _in_place(texts, cut_up, held, anchors, keys, text)
    met = tokens.join(small(anchors), "token").select(*keys, "pattern_id")
    blank = cut_up.where(F.forall("pieces", lambda p: p == "")).select("pattern_id")
    if not blank.isEmpty():
        everywhere = texts.where(F.col(text).isNotNull()).select(*keys, F.lit("").alias("token"))
        met = met.union(everywhere.join(blank.withColumn("token", F.lit("")), "token").select(*keys, "pattern_id"))
    return met.distinct().join(texts.select(*keys, F.col(text).alias("__text")), keys).join(small(held), "pattern_id").where(F.contains("__text", "pattern")).select(*keys, "pattern_id")

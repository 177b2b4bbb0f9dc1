"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions alone.

A text is the set of its distinct five-word shingles over lower-cased runs of letters and digits. An item contaminates a
document when at least `threshold` of its shingles are in the document. An item of fewer words is one shingle of its own length,
and documents are cut into runs of such a length too where there is such an item; no words: the empty set, which is in nothing.

Items are partitioned by size in powers of two. An item's sketch holds its shingles of least hash: in a partition of sizes up
to s, the floor((1 - t) * s) + 1 least ones (all, where it has no more). A document that contains t of an item lacks fewer
shingles than the sketch holds, so it has one of the sketch at least: the search loses no set that contains it, however
long the document and however short the item. Documents too small for the item (under t of its size) are passed over. Candidates
are verified by exact containment over all shingles of the item.

The benchmark's sketches are broadcast while they are under `broadcast_rows` rows, which is checked; beyond that the same
join is shuffled. Document shingles are only streamed past it. Null or empty texts match nothing; equal items are found
under each of their ids, and equal documents each with them. Rows of one doc_id are one document, those of one item_id one item.
Rows without doc_id match nothing, items without item_id count under none. Empty tables give no rows. Very long texts are one
row's array of shingles at a time. Extra columns are ignored by `contaminated` and kept by `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import compact, cut

WORDS, THRESHOLD, BROADCAST_ROWS = 5, 0.75, 500_000


def _grams(tokens: Column, n: int, *mark: Column) -> Column:
    """Hashes of n consecutive tokens (null where there are fewer)."""
    grams = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.xxhash64(*mark, *[F.get(tokens, i + j) for j in range(n)]))
    return F.when(F.size(tokens) >= n, grams)


def _tokens(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def with_shingles(df: DataFrame, k: int, lengths: list[int]) -> DataFrame:
    """Adds shingles (with repeats) in steps, so that the tokens are computed once: runs of k words, and of each of the lengths
    under k, which are marked by their length.

    What follows should take them apart with explode_outer: a plain explode lets the optimizer infer a filter on the array
    and move it below these steps, where it computes the tokens anew for each shingle.
    """
    none = F.array().cast("array<bigint>")
    out = df.withColumn("tokens", _tokens(F.col("text"))).withColumn("tokens", F.when(F.get("tokens", F.lit(0)) == "", F.array().cast("array<string>")).otherwise(F.col("tokens")))
    tokens = F.col("tokens")
    parts = [F.coalesce(_grams(tokens, k), none), *[F.coalesce(_grams(tokens, n, F.lit(n)), none) for n in lengths]]
    return out.withColumn("shingles", F.concat(*parts) if lengths else parts[0]).drop("tokens")


def sketches(items: DataFrame, threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """item_id, words (null from k on), size, partition, all (array), sketch (array)."""
    words = F.size(F.filter(_tokens(F.col("text")), lambda t: t != ""))
    items = items.select("item_id", "text", words.alias("words"))
    long = with_shingles(items.where(F.col("words") >= k).select("item_id", F.lit(None).cast("int").alias("words"), "text"), k, [])
    short = items.where((F.col("words") > 0) & (F.col("words") < k))
    for n in range(1, k):
        long = long.union(with_shingles(short.where(F.col("words") == n).select("item_id", "words", "text"), k, [n]))
    sets = long.select("item_id", "words", F.explode_outer("shingles").alias("h")).where("h is not null")
    sized = sets.groupBy("item_id").agg(F.max("words").alias("words"), F.sort_array(F.collect_set("h")).alias("all")).withColumn("size", F.size("all"))
    top = F.pow(F.lit(2), F.ceil(F.log2("size"))).cast("int")
    least = F.floor(F.lit(1 - threshold) * F.col("top") + F.lit(1e-9)).cast("int") + 1
    return sized.withColumn("top", top).select("item_id", "words", "size", F.col("top").alias("partition"), "all", F.slice("all", 1, F.least(least, F.col("size"))).alias("sketch"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_found, containment: every pair at or over the threshold."""
    index = cut(sketches(items, threshold, k), items.count())
    lengths = sorted(r["words"] for r in index.where("words is not null").select("words").distinct().collect())  # under k of them
    key = index.select(F.explode("sketch").alias("h"), "item_id", "size")
    hashes = _small(key.select("h").distinct(), broadcast_rows)
    documents = with_shingles(docs.select("doc_id", "text"), k, lengths).select("doc_id", F.size("shingles").alias("n"), "shingles")
    hits = documents.select("doc_id", "n", F.explode_outer("shingles").alias("h")).join(hashes, "h", "left_semi").distinct()
    candidates = hits.join(_small(key, broadcast_rows), "h").where(F.col("n") >= F.lit(threshold) * F.col("size")).select("doc_id", "item_id").distinct()
    candidates = cut(compact(candidates, docs))
    # candidate documents are read again, once each, and met with all the shingles of their items
    again = docs.select("doc_id", "text").join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    seen = with_shingles(again, k, lengths).select("doc_id", F.explode_outer("shingles").alias("h"))
    wanted = index.select("item_id", "size", F.explode("all").alias("h"))
    found = seen.join(_small(wanted, broadcast_rows), "h").groupBy("doc_id", "item_id", "size").agg(F.count_distinct("h").alias("n_found"))
    found = found.join(candidates, ["doc_id", "item_id"], "left_semi")
    return found.where(F.col("n_found") >= F.lit(threshold) * F.col("size")).select("doc_id", "item_id", F.col("size").cast("long").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("size")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """The rows of docs, all columns, that no item contaminates."""
    bad = cut(compact(contaminated(docs, items, threshold, k).select("doc_id").distinct(), docs))
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)

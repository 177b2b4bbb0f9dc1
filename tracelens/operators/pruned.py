"""Exact top-k from parts of the posting lists.

A question's rarest terms give a first set of chunks; their exact scores give a score that the k-th best reaches at least. Terms
in order of the most that each can add to a score: those that can't reach it together (the common ones, with the long lists) can't
bring a new chunk among the best, so only the other terms' lists give candidates. Few candidates get their exact scores from the blocks
of the other lists that their chunks fall into, many where their chunks are. Scores are compared with a margin above their rounding;
ties stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import MANY, cut, small
from . import retrieve
from .scope import scope_map

#: Postings of a block on average; chunks of the first set, in multiples of k; what sums of rounded scores may be off by.
BLOCK, FIRST, MARGIN = 128, 2, 1e-5
#: Entries of the lists that candidates come from up to which these are few: they are broadcast then.
FEW = 100_000


def first_terms(wanted: DataFrame, k: int) -> DataFrame:
    """query_id, term: of wanted(query_id, term, df), the rarest, until their lists have FIRST * k entries."""
    before = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    return wanted.withColumn("had", F.coalesce(F.sum("df").over(before), F.lit(0))).where(F.col("had") < FIRST * k).select("query_id", "term")


def reached(scored: DataFrame, k: int) -> DataFrame:
    """query_id, least: the k-th best score of those with so many."""
    best = retrieve.top_k(scored, k, "score")
    return best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("query_id", "least")


def needed_terms(wanted: DataFrame, least: DataFrame) -> DataFrame:
    """query_id, term: of wanted(query_id, term, most), the terms without which no chunk reaches the score; all where none is known."""
    upto = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = wanted.withColumn("sum", F.sum("most").over(upto)).join(least, "query_id", "left")
    return summed.where(F.col("least").isNull() | (F.col("sum") + MARGIN >= F.col("least"))).select("query_id", "term")


def top_k(wanted: DataFrame, scored: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """query_id, chunk_id, score, rank. wanted(query_id, term, df, most); scored(query_id, term) gives query_id, chunk_id and the
    exact score, where it is above 0, of all chunks that have one of these terms. Chunks without a needed term are below the best k."""
    least = reached(scored(first_terms(wanted, k)), k)
    return retrieve.top_k(scored(needed_terms(wanted, least)), k, "score")


# BM25 over blocks


def blocks(posted: DataFrame, rows: int = BLOCK) -> DataFrame:
    """tenant_id, term, parts, part, n, tf, dl, posted: each list of postings in blocks of `rows` entries on average, a chunk's
    entry in that of its id's hash, with the greatest tf and the least dl of each. A common term's list is many rows, none large."""
    sized = posted.groupBy("tenant_id", "term").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts")).where("parts > 1")
    put = posted.join(small(cut(sized), MANY), ["tenant_id", "term"], "left").na.fill(1, ["parts"]).withColumn("part", part_of(F.col("chunk_id"), F.col("parts")))
    entry = F.collect_list(F.struct("chunk_id", "dl", "tf")).alias("posted")
    return put.groupBy("tenant_id", "term", "parts", "part").agg(F.count("*").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"), entry)


def part_of(chunk_id: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(chunk_id), parts).cast("int")


def _scope_stats(stored: DataFrame, chunks: DataFrame, questions: DataFrame, posted: DataFrame | None = None) -> DataFrame:
    """tenant_id, n, avgdl of each asking tenant's scope, from the postings or else the blocks' entries of one number each."""
    if posted is not None:
        return retrieve.scope_stats(chunks, questions, posted).withColumnRenamed("n", "n_docs")
    length = stored.groupBy("tenant_id").agg(F.sum(F.aggregate("posted", F.lit(0).cast("long"), lambda s, p: s + p["tf"])).alias("total"))
    own = chunks.groupBy("tenant_id").agg(F.count("*").alias("n")).join(length, "tenant_id", "left").na.fill(0, ["total"])
    return own.withColumnRenamed("tenant_id", "chunk_tenant").join(scope_map(questions), "chunk_tenant").groupBy("tenant_id").agg(F.sum("n").alias("n_docs"), (F.sum("total") / F.sum("n")).alias("avgdl"))


def wanted_terms(stored: DataFrame, chunks: DataFrame, questions: DataFrame, k1: float = 1.2, b: float = 0.75, posted: DataFrame | None = None) -> DataFrame:
    """query_id, tenant_id, term, df, weight (idf times the term's count in the question), avgdl, most: what the term adds to a
    chunk's score at most; from the blocks' own columns."""
    asked = retrieve.query_terms(questions)
    heads = stored.select(F.col("tenant_id").alias("chunk_tenant"), "term", "n", "tf", "dl").join(small(asked.select("term").distinct(), MANY), "term", "left_semi")
    spread = heads.join(small(scope_map(questions).join(_scope_stats(stored, chunks, questions, posted), "tenant_id"), MANY), "chunk_tenant")
    most = F.max(_part(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("top")
    listed = spread.groupBy("tenant_id", "term", "n_docs", "avgdl").agg(F.sum("n").alias("df"), most)
    rarity = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(listed, ["tenant_id", "term"]).withColumn("weight", F.col("qtf") * rarity).select("query_id", "tenant_id", "term", "df", "weight", "avgdl", (F.col("weight") * F.col("top")).alias("most"))


def _part(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25(stored: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75, posted: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank as retrieve.bm25 has them, from `blocks` of all lists. With the postings, those of the lists that
    questions ask for are enough."""
    wanted = cut(wanted_terms(stored, chunks, questions, k1, b, posted))
    return top_k(wanted, scorer(stored, questions, wanted, k1, b, posted), k)


def scorer(stored: DataFrame, questions: DataFrame, wanted: DataFrame, k1: float = 1.2, b: float = 0.75, posted: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """What top_k asks for. While the terms' lists are short (FEW entries, counted), only the blocks are opened that their chunks can
    stand in. Else those would be nearly all: scores are then summed where the chunk is, over the postings if they are given."""
    asked = wanted.select("query_id", "tenant_id", "term", "weight", "avgdl").join(scope_map(questions), "tenant_id").drop("tenant_id")
    kept = stored.withColumnRenamed("tenant_id", "chunk_tenant")
    key = ["chunk_tenant", "term"]

    def scored(terms: DataFrame) -> DataFrame:
        asks = cut(asked.join(terms.withColumn("leads", F.lit(True)), ["query_id", "term"], "left").na.fill(False, ["leads"]))
        ours = kept.join(small(asks.select(*key).distinct(), MANY), key, "left_semi")
        leading = ours.join(small(asks.where("leads").select(*key).distinct(), MANY), key, "left_semi")
        few = (leading.agg(F.sum("n")).first()[0] or 0) <= FEW
        if few:
            pairs = cut(leading.select(*key, F.explode("posted.chunk_id").alias("chunk_id")).join(small(asks.where("leads"), MANY), key).select("query_id", "chunk_id").distinct())
            parts = cut(ours.select(*key, "parts").distinct()).join(small(asks.select(*key, "query_id"), MANY), key)
            touched = pairs.join(small(parts, MANY), "query_id").select(*key, part_of(F.col("chunk_id"), F.col("parts")).alias("part")).distinct()
            ours = ours.join(small(cut(touched), MANY), [*key, "part"], "left_semi")
        if few or posted is None:
            entries = ours.select(*key, F.explode("posted").alias("p")).select(*key, "p.*")
            if few:
                entries = entries.join(F.broadcast(pairs.select("chunk_id").distinct()), "chunk_id", "left_semi")
            entries = entries.repartition("chunk_id")
        else:
            entries = posted.withColumnRenamed("tenant_id", "chunk_tenant")
        part = F.col("weight") * _part(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
        summed = entries.join(small(asks, MANY), key).groupBy("query_id", "chunk_id").agg(F.bround(F.sum(part), 6).alias("score"), F.max("leads").alias("leads"))
        return summed.where("leads and score > 0").select("query_id", "chunk_id", "score")

    return scored


def rows_read(stored: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """query_id, listed, candidates_from: entries in all lists of a question's terms, and in those that candidates are read from."""
    wanted = cut(wanted_terms(stored, chunks, questions))
    first = first_terms(wanted, k)
    read = first.union(needed_terms(wanted, reached(scorer(stored, questions, wanted)(first), k))).distinct().withColumn("read", F.lit(True))
    both = wanted.join(read, ["query_id", "term"], "left")
    return both.groupBy("query_id").agg(F.sum("df").alias("listed"), F.coalesce(F.sum(F.when(F.col("read"), F.col("df"))), F.lit(0)).alias("candidates_from"))


# Concepts


def concept_knn(chunks: DataFrame, questions: DataFrame, own: DataFrame, asked: DataFrame, weight: DataFrame, k: int = 20) -> DataFrame:
    """query_id, chunk_id, score, rank: as retrieve.concept_knn over all pairs, from the concepts that can reach the k-th score."""
    weighted, whole = retrieve._weighted(chunks, asked, weight)
    scope = scope_map(questions)
    owned = own.withColumnRenamed("tenant_id", "chunk_tenant")
    share = (F.col("qn") * F.col("idf") / F.col("whole")).alias("most")
    wanted = cut(weighted.join(whole, "query_id").join(weight.select("concept", "df"), "concept").select("query_id", "tenant_id", F.col("concept").alias("term"), "df", share))

    def chunks_of(terms: DataFrame) -> DataFrame:
        lists = terms.join(wanted.select("query_id", "term", "tenant_id"), ["query_id", "term"]).join(scope, "tenant_id").withColumnRenamed("term", "concept")
        return lists.join(owned.select("chunk_tenant", "concept", "chunk_id"), ["chunk_tenant", "concept"]).select("query_id", "chunk_id").distinct()

    def score(pairs: DataFrame) -> DataFrame:
        asked_only = owned.join(small(wanted.select(F.col("term").alias("concept")).distinct(), MANY), "concept", "left_semi")
        met = pairs.join(asked_only.select("chunk_id", "n", "concept"), "chunk_id").join(small(weighted, MANY), ["query_id", "concept"])
        part = met.groupBy("query_id", "chunk_id", "n").agg(F.sum(F.col("qn") * F.col("idf")).alias("part")).join(whole, "query_id")
        return part.select("query_id", "chunk_id", F.bround(F.col("part") / F.col("whole") * (1 - 0.30 * F.col("n") / (F.col("n") + 80)), 6).alias("score")).where("score > 0")

    return top_k(wanted, lambda terms: score(chunks_of(terms)), k)

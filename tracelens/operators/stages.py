"""Pipeline stages over many questions and many configurations at once.

A configuration is a row; a stage that it turns off is a null. The two legs are computed once and joined with all
configurations, which are few and broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import MANY, small
from . import retrieve


def legs(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """query_id, chunk_id and rank and score in each leg; null where a leg hasn't the chunk."""
    a = lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    b = semantic.select("query_id", "chunk_id", F.col("rank").alias("semantic_rank"), F.col("score").alias("semantic_score"))
    return a.join(b, ["query_id", "chunk_id"], "full")


def fuse(found: DataFrame, configs: DataFrame) -> DataFrame:
    """config_id, query_id, chunk_id, leg columns, fused_score, fused_rank.

    Both legs: reciprocal ranks, or the plain sum of scores where fusion is off. One leg: 1 / (1 + rank).
    """
    c = found.crossJoin(F.broadcast(configs.select("config_id", "lexical_top_k", "semantic_top_k", "rrf_k")))
    keep = lambda x, leg: F.when(F.col(f"{leg}_rank") <= F.col(f"{leg}_top_k"), F.col(x))
    for leg in ("lexical", "semantic"):
        c = c.withColumn(f"{leg}_score", keep(f"{leg}_score", leg)).withColumn(f"{leg}_rank", keep(f"{leg}_rank", leg))
    c = c.where("lexical_rank is not null or semantic_rank is not null")
    both = F.col("lexical_top_k").isNotNull() & F.col("semantic_top_k").isNotNull()
    part = lambda r: F.coalesce(1 / (F.col("rrf_k") + F.col(r)), F.lit(0.0))
    score = F.when(both & F.col("rrf_k").isNotNull(), F.bround(part("lexical_rank") + part("semantic_rank"), 8))
    score = score.when(both, F.coalesce("lexical_score", F.lit(0.0)) + F.coalesce("semantic_score", F.lit(0.0)))
    score = score.otherwise(1 / (1 + F.coalesce("lexical_rank", "semantic_rank", F.lit(1_000_000))))
    c = c.withColumn("fused_score", score).drop("lexical_top_k", "semantic_top_k", "rrf_k")
    order = Window.partitionBy("config_id", "query_id").orderBy(F.desc("fused_score"), "chunk_id")
    return c.withColumn("fused_rank", F.row_number().over(order))


def gate(candidates: DataFrame, configs: DataFrame) -> DataFrame:
    """config_id, query_id, top1, top2, gate_checked, gate_passed."""
    c = candidates.join(F.broadcast(configs.select("config_id", "gate_signal", "gate_threshold")), "config_id")
    value = F.when(F.col("gate_signal") == "dense_top1", F.col("semantic_score")).when(F.col("gate_signal") == "lexical_top1", F.col("lexical_score")).otherwise(F.col("fused_score"))
    # at most the two legs' top k for a question, so the list is short
    top = c.groupBy("config_id", "query_id", "gate_threshold").agg(F.sort_array(F.collect_list(value), asc=False).alias("v"))
    top = top.select("config_id", "query_id", "gate_threshold", F.get("v", F.lit(0)).alias("top1"), F.get("v", F.lit(1)).alias("top2"))
    checked = F.col("gate_threshold").isNotNull() & F.col("top1").isNotNull()
    return top.select("config_id", "query_id", "top1", "top2", checked.alias("gate_checked"), (~checked | (F.col("top1") >= F.col("gate_threshold"))).alias("gate_passed"))


def rerank_decision(gated: DataFrame, configs: DataFrame) -> DataFrame:
    """gated and rerank_reason: why the reranker is skipped, or run."""
    g = gated.join(F.broadcast(configs.select("config_id", "rerank", "gate_threshold", "gray_ratio", "margin_ratio")), "config_id")
    bound = F.coalesce("gate_threshold", "top1") * F.col("gray_ratio")
    gray = (F.col("top1") < bound) | F.coalesce(F.col("top1") - F.col("top2") < F.abs("top1") * F.col("margin_ratio"), F.lit(False))
    why = F.when(F.col("rerank").isNull(), "ablated").when(~F.col("gate_passed"), "gate refused").when(F.col("rerank") == "always", "run")
    why = why.when(F.col("top1").isNull(), "no signal").when(gray, "run").otherwise("confident")
    return g.select("config_id", "query_id", "top1", "top2", "gate_checked", "gate_passed", why.alias("rerank_reason"))


def rerank_scores(candidates: DataFrame, pairs: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, rerank_score: 100 * (0.6 coverage + 0.4 share of the question's identifiers in the chunk)."""
    asked = questions.select("query_id", T.identifiers("query").alias("asked"))
    held = chunks.join(small(candidates.select("chunk_id").distinct(), MANY), "chunk_id", "left_semi").select("chunk_id", T.identifiers("text").alias("held"))
    c = candidates.select("query_id", "chunk_id").distinct().join(pairs.select("query_id", "chunk_id", "coverage"), ["query_id", "chunk_id"], "left")
    c = c.join(asked, "query_id").join(held, "chunk_id").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    exact = F.when(F.size("asked") > 0, F.size(F.array_intersect("asked", "held")) / F.size("asked")).otherwise(F.col("coverage"))
    return c.select("query_id", "chunk_id", F.bround(100.0 * (0.6 * F.col("coverage") + 0.4 * exact), 2).alias("rerank_score"))


def rerank(candidates: DataFrame, decided: DataFrame, scores: DataFrame, configs: DataFrame) -> DataFrame:
    """candidates, rerank_score (of the shortlist where the reranker runs), position, promoted."""
    c = candidates.join(decided.select("config_id", "query_id", "gate_passed", (F.col("rerank_reason") == "run").alias("runs")), ["config_id", "query_id"])
    c = c.join(F.broadcast(configs.select("config_id", "shortlist")), "config_id").join(scores, ["query_id", "chunk_id"], "left")
    c = c.withColumn("rerank_score", F.when(F.col("runs") & (F.col("fused_rank") <= F.col("shortlist")), F.col("rerank_score")))
    order = Window.partitionBy("config_id", "query_id").orderBy(F.col("rerank_score").isNull(), F.desc("rerank_score"), F.desc("fused_score"), "chunk_id")
    c = c.withColumn("position", F.row_number().over(order))
    return c.withColumn("promoted", F.col("rerank_score").isNotNull() & (F.col("position") < F.col("fused_rank"))).drop("runs", "shortlist")


def context(ranked: DataFrame, chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """config_id, query_id, chunk_id, final_rank, inclusion_reason: winners in order, each followed by its neighbours, the
    first of each chunk, cut at the width. Only winners within the width can matter, so only they are expanded."""
    spans = configs.select("config_id", "width", "neighbours")
    won = ranked.where("gate_passed").join(F.broadcast(spans), "config_id").where(F.col("position") <= F.col("width"))
    most = spans.agg(F.coalesce(F.max("neighbours"), F.lit(0))).first()[0]
    key = won.select("config_id", "query_id", "chunk_id", "position", "width", "neighbours")
    slots = key.select("config_id", "query_id", "chunk_id", "position", F.lit(0).alias("slot"), "width")
    if most:
        near = retrieve.neighbours(key.where("neighbours is not null"), chunks, most).where(F.abs("delta") <= F.col("neighbours"))
        slot = F.when(F.col("delta") < 0, F.col("delta") + most + 1).otherwise(F.col("delta") + most)
        slots = slots.union(near.select("config_id", "query_id", F.col("neighbour_id").alias("chunk_id"), "position", slot.alias("slot"), "width"))
    first = slots.groupBy("config_id", "query_id", "chunk_id", "width").agg(F.min(F.struct("position", "slot")).alias("at"))
    order = Window.partitionBy("config_id", "query_id").orderBy("at")
    cut = first.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= F.col("width"))
    known = ranked.select("config_id", "query_id", "chunk_id", "promoted")
    reason = F.when(F.col("promoted").isNull(), "neighbor_expansion").when(F.col("promoted"), "rerank_promoted").otherwise("fused_top_k")
    return cut.join(known, ["config_id", "query_id", "chunk_id"], "left").select("config_id", "query_id", "chunk_id", "final_rank", reason.alias("inclusion_reason"))


def rewrite(questions: DataFrame, vocabulary: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, query, rewritten: the first pointing word becomes up to two telling words of the last turn before.

    questions(query_id, query, previous); weights(concept, df, idf) of the corpus. A word tells if it is over two letters,
    occurs in the corpus and says nothing the question already says; identifiers first, then by idf, then by spelling.
    """
    from ..functions.lexicon import DEICTIC

    q = questions.withColumn("pointing", F.arrays_overlap(T.raw_tokens("query"), F.array(*[F.lit(w) for w in DEICTIC])))
    said = q.select("query_id", F.explode_outer(T.content_tokens("query")).alias("token")).join(vocabulary, "token").select("query_id", "concept").distinct()
    told = q.where("pointing").select("query_id", F.explode_outer(T.content_tokens("previous")).alias("token")).where(F.length("token") > 2)
    told = told.join(vocabulary, "token").join(said, ["query_id", "concept"], "left_anti").join(weights.where("df > 0"), "concept")
    order = Window.partitionBy("query_id").orderBy(F.when(T.is_identifier("token"), 0).otherwise(1), F.desc(F.bround("idf", 9)), "token")
    two = told.withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("r", "token"))).alias("t"))
    phrase = two.select("query_id", F.array_join(F.array_distinct(F.col("t.token")), " ").alias("phrase"))
    words = F.filter(F.split(F.col("query"), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(".,?!:;")))
    j = q.join(phrase, "query_id", "left").withColumn("words", words).withColumn("bare", bare)
    at = F.transform(F.col("bare"), lambda w, i: F.when(w.isin(DEICTIC), i))
    j = j.withColumn("at", F.array_min(F.filter(at, lambda i: i.isNotNull())))
    changed = F.array_join(F.transform("words", lambda w, i: F.when(i == F.col("at"), F.col("phrase")).otherwise(w)), " ")
    return j.select("query_id", "query", F.when(F.col("pointing") & F.col("phrase").isNotNull() & F.col("at").isNotNull(), changed).otherwise(F.col("query")).alias("rewritten"))

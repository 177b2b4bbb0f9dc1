"""Extractive answers from a context, and traces: what each run kept, rejected, cited and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import MANY, cut, small
from . import ingest

REFUSE_BELOW, CONFIDENT_FROM, LEAST_CHARS = 0.18, 0.55, 25


def weighted_terms(questions: DataFrame, asked: DataFrame, weights: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, concept, weight (idf times count), whole (of all of the question's concepts)."""
    total = chunks.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_docs"))
    known = weights.select("concept", "idf").join(small(asked.select("concept").distinct(), MANY), "concept", "left_semi")
    w = asked.join(known, "concept", "left").crossJoin(F.broadcast(total))
    w = w.select("query_id", "concept", (F.col("qn") * F.coalesce("idf", ingest.idf(F.lit(0), F.col("n_docs")))).alias("weight"))
    return w.join(w.groupBy("query_id").agg(F.sum("weight").alias("whole")), "query_id")


def sentence_coverage(used: DataFrame, chunks: DataFrame, vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, chunk_id, sentence, coverage for used(query_id, chunk_id): prose sentences long enough to quote."""
    s = chunks.select("chunk_id", "text").join(small(used, MANY), "chunk_id")
    s = s.select("query_id", "chunk_id", F.posexplode_outer(T.sentences(T.strip_code_fences("text"))).alias("place", "raw")).where("raw is not null")
    s = cut(s.select("query_id", "chunk_id", "place", T.clean_sentence("raw").alias("sentence")).where((F.length("sentence") >= LEAST_CHARS) & T.is_prose("sentence")))
    told = s.select("query_id", "chunk_id", "place", F.explode_outer(T.content_tokens("sentence")).alias("token"))
    known = vocabulary.join(small(told.select("token").distinct(), MANY), "token", "left_semi")
    said = told.join(known, "token").select("query_id", "chunk_id", "place", "concept").distinct()
    part = said.join(terms, ["query_id", "concept"]).groupBy("query_id", "chunk_id", "place").agg((F.sum("weight") / F.first("whole")).alias("c"))
    return s.join(part, ["query_id", "chunk_id", "place"], "left").select("query_id", "chunk_id", "sentence", F.bround(F.coalesce("c", F.lit(0.0)), 6).alias("coverage"))


def answers(runs: DataFrame, context: DataFrame, decided: DataFrame, configs: DataFrame, questions: DataFrame, chunks: DataFrame, own: DataFrame, vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """config_id, query_id, status, hedged, answer, citations, reason for runs(config_id, query_id)."""
    covered = own.select("chunk_id", "concept").join(small(context, MANY), "chunk_id").select("config_id", "query_id", "concept").distinct().join(terms, ["query_id", "concept"])
    covered = covered.groupBy("config_id", "query_id").agg(F.bround(F.sum("weight") / F.first("whole"), 6).alias("context_coverage"))
    said = sentence_coverage(context.select("query_id", "chunk_id").distinct(), chunks, vocabulary, terms)
    scored = context.select("config_id", "query_id", "chunk_id", "final_rank").join(said, ["query_id", "chunk_id"])
    order = Window.partitionBy("config_id", "query_id").orderBy(F.desc("coverage"), "final_rank", "sentence")
    scored = scored.withColumn("r", F.row_number().over(order)).withColumn("best", F.first("chunk_id").over(order)).withColumn("all", F.count("*").over(Window.partitionBy("config_id", "query_id")))
    quote = F.struct("r", "chunk_id", "coverage", F.concat("sentence", F.lit(" ["), "final_rank", F.lit("]")).alias("quote"))
    picked = scored.groupBy("config_id", "query_id").agg(F.min(quote).alias("one"), F.min(F.when(F.col("chunk_id") != F.col("best"), quote)).alias("two"), F.first("all").alias("all"))
    wanted = questions.select("query_id", T.discriminators("query").alias("wanted"))
    read = chunks.join(small(context.select("chunk_id").distinct(), MANY), "chunk_id", "left_semi").select("chunk_id", T.discriminators("text").alias("d"))
    held = context.join(read, "chunk_id").groupBy("config_id", "query_id").agg(F.array_distinct(F.flatten(F.collect_list("d"))).alias("held"), F.count("*").alias("sources"))
    j = runs.join(decided.select("config_id", "query_id", "gate_passed"), ["config_id", "query_id"], "left").join(held, ["config_id", "query_id"], "left").join(covered, ["config_id", "query_id"], "left").join(picked, ["config_id", "query_id"], "left")
    j = j.join(wanted, "query_id").join(F.broadcast(configs.select("config_id", "discriminator_guard")), "config_id")
    unmet = F.array_except("wanted", F.coalesce("held", F.array().cast("array<string>")))
    reason = F.when(~F.coalesce("gate_passed", F.lit(True)), "gate").when(F.col("sources").isNull(), "no sources").when(F.coalesce("context_coverage", F.lit(0.0)) < REFUSE_BELOW, "unrelated").when(F.col("one").isNull(), "no sentence")
    j = j.withColumn("reason", reason).withColumn("unmet", unmet)
    hedge = F.col("discriminator_guard") & (F.size("unmet") > 0)
    alone = (F.col("one.coverage") >= CONFIDENT_FROM) | (F.col("all") == 1) | F.col("two").isNull()
    text = F.when(F.col("reason").isNotNull(), F.concat(F.lit("No supporting evidence: "), "reason"))
    text = text.when(hedge, F.concat(F.lit("Not in the sources: "), F.array_join(F.slice("unmet", 1, 3), ", "), F.lit(". Closest: "), "one.quote"))
    text = text.when(alone, F.col("one.quote")).otherwise(F.concat("one.quote", F.lit(" "), "two.quote"))
    cited = F.when(F.col("reason").isNotNull(), F.array().cast("array<string>")).when(hedge | alone, F.array("one.chunk_id")).otherwise(F.array("one.chunk_id", "two.chunk_id"))
    status = F.when(F.col("reason").isNotNull(), "refused").when(hedge, "ungrounded").otherwise("grounded")
    j = j.select("config_id", "query_id", status.alias("status"), text.alias("answer"), cited.alias("citations"), "reason", hedge.alias("hedge"))
    return j.select("config_id", "query_id", "status", (F.col("reason").isNotNull() | F.col("hedge") | T.is_hedged("answer")).alias("hedged"), "answer", "citations", "reason")


def traces(ranked: DataFrame, context: DataFrame, answered: DataFrame) -> DataFrame:
    """One nested row for each run: its candidates in final, then fused order, each with its fate, and its answer. Neighbours that
    only the context has are among them."""
    c = ranked.join(context, ["config_id", "query_id", "chunk_id"], "full")
    fate = F.when(~F.col("gate_passed"), "gate").when(F.col("final_rank").isNull(), "top_k")
    one = F.struct(F.coalesce("final_rank", F.lit(1_000_000)).alias("final_rank"), "fused_rank", "chunk_id", "lexical_rank", "semantic_rank", "fused_score", "rerank_score", fate.alias("rejected_by"), "inclusion_reason")
    # a run has the two legs' top k at most
    return answered.join(c.groupBy("config_id", "query_id").agg(F.array_sort(F.collect_list(one)).alias("candidates")), ["config_id", "query_id"], "left")


def run_stages(configs: DataFrame, decided: DataFrame, answered: DataFrame) -> DataFrame:
    """config_id, query_id, stages: for every run, in order, whether each stage ran or why it was skipped."""
    from ..plans.provenance import stage_grid

    runs = answered.select("config_id", "query_id").join(decided.select("config_id", "query_id", "gate_checked", "gate_passed", "rerank_reason"), ["config_id", "query_id"], "left")
    each = runs.join(F.broadcast(stage_grid(configs)), "config_id")
    found = F.col("gate_passed").isNotNull()
    why = F.when(~F.col("enabled"), "ablated").when(F.col("stage").isin("gate", "rerank", "expand") & ~found, "no candidates")
    why = why.when((F.col("stage") == "gate") & ~F.col("gate_checked"), "not checked").when((F.col("stage") == "expand") & ~F.col("gate_passed"), "gate refused")
    why = why.when((F.col("stage") == "rerank") & (F.col("rerank_reason") != "run"), F.col("rerank_reason"))
    record = F.struct("seq", "stage", F.when(why.isNull(), "ran").otherwise("skipped").alias("state"), why.alias("reason"))
    return each.groupBy("config_id", "query_id").agg(F.array_sort(F.collect_list(record)).alias("stages"))


def attribute(replies: DataFrame, sources: DataFrame, vocabulary: DataFrame, support: float = CONFIDENT_FROM) -> DataFrame:
    """reply_id, place, sentence, chunk_ids, supported, of replies(reply_id, text) and their sources(reply_id, n, chunk_id, text).

    A sentence stands on the sources it cites by number, else on the one that holds most of its concepts if that is `support` of
    them at least (of equal ones, the least number), else on none.
    """
    s = replies.select("reply_id", F.posexplode_outer(T.sentences("text")).alias("place", "sentence")).where("sentence is not null")
    cited = s.select("reply_id", "place", F.posexplode(T.citations("sentence")).alias("seq", "n")).join(sources.select("reply_id", "n", "chunk_id"), ["reply_id", "n"])
    cited = cited.groupBy("reply_id", "place").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))).alias("c")).select("reply_id", "place", F.array_distinct(F.col("c.chunk_id")).alias("cited"))
    said = s.select("reply_id", "place", F.explode_outer(T.content_tokens("sentence")).alias("token")).join(vocabulary, "token").groupBy("reply_id", "place", "concept").agg(F.count("*").alias("w"))
    whole = said.groupBy("reply_id", "place").agg(F.sum("w").alias("whole"))
    held = sources.select("reply_id", "n", "chunk_id", F.explode_outer(T.content_tokens("text")).alias("token")).join(vocabulary, "token").select("reply_id", "n", "chunk_id", "concept").distinct()
    part = said.join(held, ["reply_id", "concept"]).groupBy("reply_id", "place", "n", "chunk_id").agg(F.sum("w").alias("part")).join(whole, ["reply_id", "place"])
    best = part.groupBy("reply_id", "place").agg(F.min(F.struct((-F.col("part") / F.col("whole")).alias("c"), "n", "chunk_id")).alias("b"))
    best = best.where(-F.col("b.c") >= support).select("reply_id", "place", F.array("b.chunk_id").alias("best"))
    j = s.join(cited, ["reply_id", "place"], "left").join(best, ["reply_id", "place"], "left")
    ids = F.coalesce("cited", "best", F.array().cast("array<string>"))
    return j.select("reply_id", "place", "sentence", ids.alias("chunk_ids"), (F.size(ids) > 0).alias("supported"))

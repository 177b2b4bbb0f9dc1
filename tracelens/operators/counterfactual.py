"""Counterfactuals: variants joined with the baseline by question; outcomes, tables, movement, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

OUTCOMES = ["identical", "equivalent", "improved", "degraded", "now_refuses", "now_answers", "now_wrong", "now_confident_wrong", "error"]


def with_failures(answered: DataFrame, errors: dict[str, str], questions: DataFrame) -> DataFrame:
    """answered and a row without an answer for every question under each configuration that could not run."""
    if not errors:
        return answered
    failed = answered.sparkSession.createDataFrame(list(errors.items()), "config_id string, reason string")
    rows = questions.select("query_id").crossJoin(F.broadcast(failed))  # as many as there are names in a sweep
    return answered.unionByName(rows, allowMissingColumns=True)


def diffs(answered: DataFrame, cases: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """config_id, query_id, outcome for each variant run; cases(query_id, kind, answer_key).

    A run without an answer failed: neither it nor what is compared with it agrees with anything. judged(config_id, query_id,
    verdict), if given, decides pairs without ground truth of which neither refuses.
    """
    key = cases.select("query_id", "kind", "answer_key")
    flagged = (F.col("status") == "refused") | F.col("hedged")
    right = F.when(F.col("kind") == "out_of_scope", flagged).otherwise(F.contains(F.lower("answer"), F.lower("answer_key")))
    a = answered.join(key, "query_id").select("config_id", "query_id", "answer", (F.col("status") == "refused").alias("refused"), flagged.alias("flagged"), right.alias("ok"))
    b = a.where("config_id = 'baseline'").select("query_id", *[F.col(c).alias(f"b_{c}") for c in ("answer", "refused", "flagged", "ok")])
    v = a.where("config_id != 'baseline'").join(b, "query_id")
    x = lambda c: F.col(c)
    known = x("ok").isNotNull() & x("b_ok").isNotNull()
    out = F.when(x("answer").isNull() | x("b_answer").isNull(), "error").when(x("answer") == x("b_answer"), "identical")
    out = out.when(known & x("b_ok") & x("ok"), "equivalent").when(known & ~x("b_ok") & x("ok"), "improved")
    out = out.when(known & x("b_ok") & ~x("ok") & x("refused"), "now_refuses").when(known & x("b_ok") & ~x("ok") & x("flagged"), "now_wrong").when(known & x("b_ok") & ~x("ok"), "now_confident_wrong")
    out = out.when(known & x("b_flagged") & ~x("flagged"), "now_confident_wrong").when(known & ~x("b_flagged") & x("flagged") & x("refused"), "now_refuses").when(known & ~x("b_flagged") & x("flagged"), "degraded").when(known, "equivalent")
    out = out.when(x("b_refused") & ~x("refused"), "now_answers").when(x("refused") & ~x("b_refused"), "now_refuses")
    if judged is not None:
        v = v.join(judged.select("config_id", "query_id", "verdict"), ["config_id", "query_id"], "left")
        out = out.when(x("verdict") == "equivalent", "equivalent").when(x("verdict") == "contradictory", F.when(x("flagged"), "now_wrong").otherwise("now_confident_wrong"))
    out = out.otherwise("degraded")
    return v.select("config_id", "query_id", out.alias("outcome"))


def tabulate(d: DataFrame) -> DataFrame:
    """A row for each ablation, a column for each outcome."""
    return d.groupBy("config_id").pivot("outcome", OUTCOMES).count().na.fill(0)


def usage(context: DataFrame, chunks: DataFrame, answered: DataFrame, model: str = "small") -> DataFrame:
    """config_id, query_id, tokens_in, tokens_out, cost_usd of each run: the context read and the answer written. A run without
    context calls no model."""
    read = context.join(chunks.select("chunk_id", T.estimate_tokens("text").alias("t")), "chunk_id").groupBy("config_id", "query_id").agg(F.sum("t").alias("tokens_in"))
    j = answered.join(read, ["config_id", "query_id"], "left").withColumn("tokens_in", F.coalesce("tokens_in", F.lit(0)).cast("long"))
    j = j.withColumn("tokens_out", F.when(F.col("answer").isNull(), 0).otherwise(T.estimate_tokens("answer")).cast("long"))
    cost = F.when(F.col("tokens_in") > 0, T.price_of(F.lit(model), F.col("tokens_in"), F.col("tokens_out"))).otherwise(0.0)
    return j.select("config_id", "query_id", "tokens_in", "tokens_out", cost.alias("cost_usd"))


def usage_deltas(used: DataFrame) -> DataFrame:
    """config_id, query_id, and what each variant run read, wrote and cost beyond the baseline's."""
    columns = ("tokens_in", "tokens_out", "cost_usd")
    base = used.where("config_id = 'baseline'").select("query_id", *[F.col(c).alias(f"b_{c}") for c in columns])
    j = used.where("config_id != 'baseline'").join(base, "query_id")
    return j.select("config_id", "query_id", *[F.bround(F.col(c) - F.col(f"b_{c}"), 8).alias(f"d_{c}") if c == "cost_usd" else (F.col(c) - F.col(f"b_{c}")).alias(f"d_{c}") for c in columns])


def costs(d: DataFrame, deltas: DataFrame) -> DataFrame:
    """config_id, runs, confident_wrong, and the sums of the deltas: what an ablation breaks and what it saves."""
    spent = deltas.groupBy("config_id").agg(F.sum("d_tokens_in").alias("d_tokens_in"), F.sum("d_tokens_out").alias("d_tokens_out"), F.bround(F.sum("d_cost_usd"), 8).alias("d_cost_usd"))
    wrong = d.groupBy("config_id").agg(F.count("*").alias("runs"), F.count_if(F.col("outcome") == "now_confident_wrong").alias("confident_wrong"))
    return wrong.join(spent, "config_id", "left")


def interactions(d: DataFrame, slack: int = 2) -> DataFrame:
    """Composites whose confidently wrong answers exceed the sum of their parts' by more than slack."""
    wrong = d.groupBy("config_id").agg(F.count_if(F.col("outcome") == "now_confident_wrong").alias("n"))
    parts = wrong.where(F.contains("config_id", F.lit("+"))).select("config_id", "n", F.explode(F.split("config_id", r"\+")).alias("part"))
    both = parts.join(wrong.select(F.col("config_id").alias("part"), F.col("n").alias("n_part")), "part", "left")
    whole = both.groupBy("config_id", "n").agg(F.sum("n_part").alias("parts"), F.count_if(F.col("n_part").isNull()).alias("missing"))
    return whole.where("missing = 0").select("config_id", "n", "parts", (F.col("n") > F.col("parts") + slack).alias("interacts"))


def verdicts(d: DataFrame) -> DataFrame:
    t = d.groupBy("config_id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "now_confident_wrong").alias("wrong"), F.count_if(F.col("outcome").isin("now_refuses", "now_wrong")).alias("loud"), F.count_if(F.col("outcome").isin("identical", "equivalent")).alias("same"))
    return t.select("config_id", "n", F.when(F.col("wrong") > 0, "confirmed").when(F.col("loud") > 0, "loud").when(F.col("same") >= 0.98 * F.col("n"), "no effect").otherwise("changed").alias("verdict"))


def rank_delta(context: DataFrame, cand: DataFrame) -> DataFrame:
    """For each chunk of the baseline's context and each variant: fused rank there less fused rank here; 999 if it is gone."""
    base = context.where("config_id = 'baseline'").select("query_id", "chunk_id").join(cand.where("config_id = 'baseline'").select("query_id", "chunk_id", F.col("fused_rank").alias("was")), ["query_id", "chunk_id"])
    variants = cand.select("config_id").distinct().where("config_id != 'baseline'")
    grid = base.crossJoin(F.broadcast(variants))
    now = cand.select("config_id", "query_id", "chunk_id", F.col("fused_rank").alias("is"))
    return grid.join(now, ["config_id", "query_id", "chunk_id"], "left").select("config_id", "query_id", "chunk_id", F.coalesce(F.col("is") - F.col("was"), F.lit(999)).alias("rank_delta"))


def context_diagnosis(context: DataFrame, gold: DataFrame) -> DataFrame:
    """config_id, query_id, dropped, diagnosis of each variant's context against the baseline's; gold(query_id, chunk_id)."""
    marked = context.join(gold.select("query_id", "chunk_id", F.lit(1).alias("g")), ["query_id", "chunk_id"], "left")
    listed = marked.groupBy("config_id", "query_id").agg(F.sort_array(F.collect_list(F.struct("final_rank", "chunk_id"))).alias("l"), F.max(F.coalesce("g", F.lit(0))).alias("g"))
    listed = listed.select("config_id", "query_id", F.col("l.chunk_id").alias("ids"), "g")
    keys = context.select("config_id").distinct().where("config_id != 'baseline'").crossJoin(context.select("query_id").distinct())
    none = F.array().cast("array<string>")
    side = lambda df, p: df.select(*[c for c in ("config_id", "query_id") if c in df.columns], F.col("ids").alias(f"{p}_ids"), F.col("g").alias(f"{p}_g"))
    j = keys.join(side(listed.where("config_id = 'baseline'").drop("config_id"), "b"), "query_id", "left").join(side(listed, "v"), ["config_id", "query_id"], "left")
    b, v = F.coalesce("b_ids", none), F.coalesce("v_ids", none)
    bg, vg = F.coalesce("b_g", F.lit(0)), F.coalesce("v_g", F.lit(0))
    why = F.when(b == v, "same").when(F.sort_array(b) == F.sort_array(v), "reordered").when((bg == 1) & (vg == 0), "gold lost").when((bg == 0) & (vg == 1), "gold gained").otherwise("set changed")
    return j.select("config_id", "query_id", F.array_join(F.array_except(b, v), " ").alias("dropped"), why.alias("diagnosis"))


def drift(now: DataFrame, snapshot: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Cells (config_id, outcome) whose share in percent moved by more than tolerance points; both tables are (config_id, outcome, n)."""
    share = lambda df, name: df.withColumn(name, 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("config_id"))).select("config_id", "outcome", name)
    j = share(now, "is").join(share(snapshot, "was"), ["config_id", "outcome"], "full").na.fill(0.0, ["is", "was"])
    return j.withColumn("moved", F.bround(F.col("is") - F.col("was"), 6)).where(F.abs("moved") > tolerance).select("config_id", "outcome", "moved")


def drift_findings(now: DataFrame, snapshot: DataFrame, same_provenance: bool, tolerance: float = 8.0) -> DataFrame:
    """config_id, passed, severity (0 information, 2 medium, 3 high), moved cells: one finding for each ablation of the sweep now.
    What moved is high, or medium where the provenance moved too; an ablation that the snapshot lacks is no failure."""
    cells = drift(now.join(snapshot.select("config_id").distinct(), "config_id", "left_semi"), snapshot, tolerance).groupBy("config_id").agg(F.count("*").alias("moved"))
    every = now.select("config_id").distinct().join(cells, "config_id", "left").withColumn("moved", F.coalesce("moved", F.lit(0)))
    return every.select("config_id", (F.col("moved") == 0).alias("passed"), F.when(F.col("moved") == 0, 0).otherwise(3 if same_provenance else 2).alias("severity"), "moved")


def explain(deltas: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """config_id, query_id, why: in words, what happened to the baseline's context; deltas from rank_delta."""
    per = deltas.groupBy("config_id", "query_id").agg(F.count_if(F.col("rank_delta") == 999).alias("gone"), F.count_if((F.col("rank_delta") > 0) & (F.col("rank_delta") < 999)).alias("fell"), F.count_if(F.col("rank_delta") < 0).alias("rose"), F.count_if(F.col("rank_delta") == 0).alias("held"))
    j = diagnosis.join(per, ["config_id", "query_id"], "left")
    moves = F.concat_ws(", ", *[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {c}"))) for c in ("gone", "fell", "rose", "held")])
    return j.select("config_id", "query_id", F.concat(F.col("diagnosis"), F.lit(": "), F.when(moves == "", "no candidates").otherwise(moves)).alias("why"))


def worked_example(d: DataFrame, deltas: DataFrame) -> DataFrame:
    """The one run to show: of the variant with most confidently wrong answers, the question that lost most of its context."""
    wrong = d.where("outcome = 'now_confident_wrong'")
    top = wrong.groupBy("config_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "config_id").limit(1)
    lost = deltas.groupBy("config_id", "query_id").agg(F.count_if(F.col("rank_delta") != 0).alias("moved"))
    return wrong.join(top.select("config_id"), "config_id").join(lost, ["config_id", "query_id"], "left").orderBy(F.desc_nulls_last("moved"), "query_id").limit(1)


def derived_labels(answered: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, config_id, label for the judge's calibration: from ground truth, for pairs whose texts differ."""
    right = F.coalesce(F.contains(F.lower("answer"), F.lower("answer_key")), F.lit(False))
    a = answered.join(cases.where("kind = 'answerable'").select("query_id", "answer_key"), "query_id").select("config_id", "query_id", "answer", (F.col("status") == "refused").alias("declined"), right.alias("ok"))
    b = a.where("config_id = 'baseline'").select("query_id", *[F.col(c).alias(f"b_{c}") for c in ("answer", "declined", "ok")])
    j = a.where("config_id != 'baseline'").join(b, "query_id").where("answer != b_answer")
    loser = F.when(F.col("ok"), F.col("b_declined")).otherwise(F.col("declined"))
    label = F.when(F.col("ok") & F.col("b_ok"), "equivalent").when(F.col("ok") != F.col("b_ok"), F.when(loser, "degraded").otherwise("contradictory")).otherwise("degraded")
    return j.select("query_id", "config_id", label.alias("label"))

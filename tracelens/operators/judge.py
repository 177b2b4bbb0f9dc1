"""Rule judge, suites' set logic, leak scans and the semantic answer cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from . import search

EQUIVALENT_FROM, DEGRADED_FROM, CACHE_FROM = 0.72, 0.35, 0.93
#: Classes of the answer cache that meet at one point from which on it is split; what bounds give way to rounding of doubles.
HOT, SLACK = 2048, 1e-9


def concept_sets(texts: DataFrame, vocabulary: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """key, out: the sorted distinct concepts of a text column; texts without any are absent."""
    each = texts.select(key, F.explode_outer(T.content_tokens(text)).alias("token")).join(vocabulary, "token")
    return each.groupBy(key).agg(F.sort_array(F.collect_set("concept")).alias(out))


def compare(a: Column, b: Column, concepts_a: Column, concepts_b: Column) -> Column:
    """equivalent, degraded or contradictory."""
    declines = lambda x: T.has_refusal_marker(x) | T.is_hedged(x)
    na, nb = T.numbers(a), T.numbers(b)
    overlap = T.jaccard(concepts_a, concepts_b)
    out = F.when(F.lower(F.trim(a)) == F.lower(F.trim(b)), "equivalent").when(declines(a) & declines(b), "equivalent")
    out = out.when((F.size(na) > 0) & (F.size(nb) > 0) & ~F.arrays_overlap(na, nb), "contradictory").when(declines(a) != declines(b), "degraded")
    return out.when(overlap >= EQUIVALENT_FROM, "equivalent").when(overlap >= DEGRADED_FROM, "degraded").otherwise("contradictory")


def baseline_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """case_id, change: new or fixed; of failing case ids now and in the baseline (filtered to the same suite by the caller)."""
    new, fixed = now.select("case_id").subtract(before.select("case_id")), before.select("case_id").subtract(now.select("case_id"))
    return new.withColumn("change", F.lit("new")).union(fixed.withColumn("change", F.lit("fixed")))


def rollup(findings: DataFrame, acknowledged: DataFrame | None = None) -> DataFrame:
    """suite, total, passed, worst severity, blocking (severity 3 or more among failures). Failures in acknowledged(suite, case_id)
    are known: they count as failed, but neither as worst nor as blocking."""
    failed = ~F.col("passed")
    if acknowledged is not None:
        known = acknowledged.select("suite", "case_id", F.lit(True).alias("known")).distinct()
        findings = findings.join(known, ["suite", "case_id"], "left")
        failed = failed & F.col("known").isNull()
    return findings.groupBy("suite").agg(F.count("*").alias("total"), F.count_if("passed").alias("n_passed"), F.max(F.when(failed, F.col("severity")).otherwise(0)).alias("worst"), F.count_if(failed & (F.col("severity") >= 3)).alias("blocking"))


def canary_scan(surfaces: DataFrame, canaries: DataFrame) -> DataFrame:
    """Surfaces (tenant_id, surface, text) that show another tenant's canary, of canaries(tenant_id, canary)."""
    c = canaries.select(F.struct(F.col("tenant_id").alias("owner"), "canary").alias("pattern_id"), F.col("canary").alias("pattern"))
    found = search.containing(surfaces, c, ["tenant_id", "surface"]).select("tenant_id", "surface", "pattern_id.owner", "pattern_id.canary")
    return found.where("tenant_id != owner")


def _prefixes(classes: DataFrame, threshold: float) -> DataFrame:
    """c, ns, mark, n, k, at: the concepts by which a class meets others, from rare to frequent, and their places. Rarity is counted
    over the classes of the same namespace and discriminators, as only those can meet."""
    each = classes.select("c", "ns", "mark", "n", F.explode("concepts").alias("k"))
    counts = each.groupBy("ns", "mark", "k").agg(F.count("*").alias("df"))
    order = F.sort_array(F.collect_list(F.struct("df", "k")))
    ranked = each.join(counts, ["ns", "mark", "k"]).groupBy("c", "ns", "mark", "n").agg(order.alias("ranked"))
    first = F.slice("ranked", F.lit(1), (F.col("n") - F.ceil(threshold * F.col("n") - SLACK) + 1).cast("int"))
    return ranked.select("c", "ns", "mark", "n", F.posexplode(F.transform(first, lambda r: r["k"])).alias("at", "k"))


def cache_hits(asked: DataFrame, threshold: float = CACHE_FROM, hot: int = HOT) -> DataFrame:
    """entry, hit: each question's earliest earlier one in its namespace with the same discriminators and like concepts.

    asked(entry, ns, concepts array, marks array); entries are unique, threshold is over 0. Questions without namespace, marks
    (null) or concepts hit nothing.

    Questions with equal concepts are one class, whose first stands for all: the earliest like question of any of them is the
    first of some class, so copies are never paired. Sets that reach the threshold share one of their n - ceil(t n) + 1 rarest
    concepts, and are of like size: classes meet by concept and the smaller one's size, where the concepts after the shared one can
    still bring them to the threshold. A meeting point of over `hot` classes is split in parts of about that many. Concept sets are
    read for the pairs left only.
    """
    keep = asked.where("ns is not null and marks is not null and size(concepts) > 0")
    keep = keep.select("entry", "ns", F.array_join(F.array_sort("marks"), " ").alias("mark"), F.array_sort(F.array_distinct("concepts")).alias("concepts"))
    classes = cut(keep.groupBy("ns", "mark", "concepts").agg(F.min("entry").alias("c")).withColumn("n", F.size("concepts")))
    key = ["ns", "mark", "k", "m"]
    place = cut(_prefixes(classes, threshold))
    few = place.select("ns", "mark", "k", F.col("n").alias("m"), F.col("c").alias("b"), F.col("at").alias("at_b"))
    parts = few.groupBy(*key).agg(F.count("*").alias("held")).where(F.col("held") > hot).select(*key, F.ceil(F.col("held") / hot).cast("int").alias("parts"))
    few = few.join(parts, key, "left").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("b"), F.col("parts"))).otherwise(0).cast("int")).drop("parts")
    sizes = F.sequence(F.ceil(threshold * F.col("n") - SLACK).cast("int"), F.col("n"))
    many = place.select("ns", "mark", "k", F.explode(sizes).alias("m"), F.col("c").alias("a"), F.col("at").alias("at_a"), "n")
    many = many.join(parts, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    rest = 1 + F.least(F.col("n") - F.col("at_a") - 1, F.col("m") - F.col("at_b") - 1)
    able = (rest >= threshold / (1 + threshold) * (F.col("n") + F.col("m")) - SLACK) & ((F.col("n") > F.col("m")) | (F.col("a") > F.col("b")))
    pairs = many.join(few, [*key, "part"]).where(able).select("a", "b").distinct()
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("c").alias(x), F.col("concepts").alias(f"c_{x}")), x)
    like = pairs.where(T.jaccard("c_a", "c_b") >= threshold).select("a", "b")
    best = like.union(like.select("b", "a")).groupBy(F.col("a").alias("c")).agg(F.min("b").alias("other"))
    first = classes.join(best, "c", "left").select("ns", "mark", "concepts", F.least("c", "other").alias("hit"))
    return keep.join(first, ["ns", "mark", "concepts"]).where("hit < entry").select("entry", "hit")


def cache_report(asked: DataFrame, threshold: float = CACHE_FROM) -> DataFrame:
    """entry, hit, rejected: as cache_hits, and whether an earlier question of like concepts was turned down for its discriminators."""
    plain = asked.withColumn("marks", F.array().cast("array<string>"))
    like = cache_hits(plain, threshold).select("entry", F.lit(True).alias("like"))
    return like.join(cache_hits(asked, threshold), "entry", "left").select("entry", "hit", F.col("hit").isNull().alias("rejected"))


def wrong_confident(attempted: DataFrame, scored: DataFrame) -> DataFrame:
    """attempted, scored, wrong_confident, rate over what was attempted, reportable (nothing is missing)."""
    j = attempted.select("case_id").join(scored.select("case_id", "verdict"), "case_id", "left")
    t = j.agg(F.count("*").alias("attempted"), F.count("verdict").alias("scored"), F.count_if(F.col("verdict") == "wrong_confident").alias("wrong_confident"))
    return t.withColumn("rate", F.bround(F.col("wrong_confident") / F.greatest(F.col("attempted"), F.lit(1)), 6)).withColumn("reportable", F.col("attempted") == F.col("scored"))


def latest(events: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Last write wins: the row of greatest order for each key."""
    return events.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last")).select(*by, "last.*")


def share_of_slowest(stages: DataFrame, run: str, ms: str) -> DataFrame:
    return stages.withColumn("share", F.bround(F.col(ms) / F.max(ms).over(Window.partitionBy(run)), 6))


VERDICTS = ("equivalent", "degraded", "contradictory")


def two_way(forward: Column, backward: Column, symmetric: bool = False) -> Column:
    """A directional judge asked in both orders: its verdict where both agree, else unstable. A symmetric judge is asked once."""
    return forward if symmetric else F.when(forward == backward, forward).otherwise("unstable")


def parse_verdict(reply: Column) -> Column:
    """A model's verdict: the first word of its first line that is one; unstable where none is."""
    first = F.lower(F.regexp_extract(F.trim(reply), r"^[^\n]*", 0))
    word = F.regexp_extract(first, r"\b(" + "|".join(VERDICTS) + r")\b", 1)
    return F.when(F.coalesce(word, F.lit("")) == "", "unstable").otherwise(word)


def model_judge(pairs: DataFrame, ask, prompt: Column, family: str, answered_by: str) -> DataFrame:
    """pairs with verdict, from a model: ask is a function from batches of prompts (pandas Series) to replies, run as an Arrow
    batch function. A judge of the family that wrote the answers is refused."""
    if family == answered_by:
        raise ValueError(f"{family} can't judge its own answers")
    call = F.pandas_udf(ask, "string")
    return pairs.withColumn("verdict", parse_verdict(call(prompt)))

"""Calibration: nearest-rank percentiles, gate thresholds, agreement, bias, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def nearest_rank(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """group, n, and p<share>: the value at the (half-even rounded) rank share * (n - 1); exact. Values are counted first, so what
    is sorted within a group are its different values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("times"))
    run = counted.withColumn("upto", F.sum("times").over(Window.partitionBy(group).orderBy(value)))
    n = counted.groupBy(group).agg(F.sum("times").alias("n"))
    at = lambda p: F.bround(F.lit(p) * (F.col("n") - 1), 0)
    return run.join(n, group).groupBy(group).agg(F.first("n").alias("n"), *[F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(f"p{round(100 * p)}") for p in shares])


#: Scores are compared in millionths, thresholds tried in ten-thousandths; scores that differ by less than WIDTH millionths may
#: share a range, which so has WIDTH different scores at most.
MICRO, STEP, WIDTH = 1_000_000, 100, 1 << 16


def threshold(scores: DataFrame, name: str = "gate") -> DataFrame:
    """scores(answerable boolean, score) -> threshold, false_refusal, false_admit, name.

    Each midpoint of an answerable and an unanswerable score, to four places, is a candidate; the one with the least of the worse
    of both errors wins, the lowest of equal ones, and is rounded to three places, at which the errors are taken again. Without
    scores of both kinds: nulls. All is rounded as SQL rounds doubles, half-even after a product (`_places`), which can take a
    midpoint that is a tie as a decimal to either side: two pairs of one sum may give two candidates.

    With rising thresholds one error rises and the other falls, so only the candidates next to where they cross matter, and of
    those below it the first with the same error. Different scores are counted, summed up by ranges (which are few: the driver
    holds one row for each), and each step then looks into ranges side by side: no candidate is met with all scores, nor each
    score with each. Scores count to six places.
    """
    value = F.bround(F.col("score") * MICRO, 0).cast("long")
    counted = scores.where("score is not null and answerable is not null").groupBy(value.alias("v")).agg(F.count_if("answerable").alias("a"), F.count_if(~F.col("answerable")).alias("o"))
    marks = cut(counted.withColumn("range", F.floor(F.col("v") / WIDTH)))
    first = lambda kind, f: f(F.when(F.col(kind) > 0, F.col("v")))
    ranges = marks.groupBy("range").agg(F.sum("a").alias("a"), F.sum("o").alias("o"), first("a", F.min).alias("a_min"), first("o", F.min).alias("o_min"), first("o", F.max).alias("o_max")).orderBy("range").collect()
    na, no = sum(r.a for r in ranges), sum(r.o for r in ranges)
    spark, shape = scores.sparkSession, "threshold double, false_refusal double, false_admit double, name string"
    if not na or not no:
        return spark.createDataFrame([(None, None, None, name)], shape)

    def errors(at: int) -> tuple[float, float]:
        """False refusals and admissions at a threshold in millionths."""
        below = marks.where(F.col("v") < at).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("o"), F.lit(0)).alias("o")).first()
        return below.a / na, (no - below.o) / no

    def beside(most: int) -> tuple[int | None, int | None]:
        """The greatest sum of an answerable and an unanswerable score up to `most` and the least above it."""
        held = [(r.range, r.o_min, r.o_max) for r in ranges if r.o]
        lowest = (most - max(r.range for r in ranges if r.a) * WIDTH - WIDTH) // WIDTH
        highest = (most - min(r.range for r in ranges if r.a) * WIDTH) // WIDTH
        around = []
        for k in range(lowest, highest + 1):  # the nearest scores outside a range, for those that have none inside on a side
            around.append((k, max((top for at, _, top in held if at < k), default=None), min((low for at, low, _ in held if at > k), default=None)))
        edges = spark.createDataFrame(around, "range long, before long, after long")
        asks = marks.where("a > 0").select(F.lit(most).cast("long").alias("most"), F.col("v").alias("own")).select((F.col("most") - F.col("own")).alias("at"), "own")
        rows = asks.select("at", "own", F.lit(None).cast("long").alias("o")).union(marks.where("o > 0").select(F.col("v").alias("at"), F.lit(None).cast("long"), F.col("v")))
        rows = rows.withColumn("range", F.floor(F.col("at") / WIDTH)).join(F.broadcast(edges), "range")
        line = Window.partitionBy("range").orderBy("at")
        upto = F.coalesce(F.max("o").over(line.rangeBetween(Window.unboundedPreceding, 0)), F.col("before"))
        above = F.coalesce(F.min("o").over(line.rangeBetween(1, Window.unboundedFollowing)), F.col("after"))
        pairs = rows.select("own", upto.alias("upto"), above.alias("above")).where("own is not null")
        return tuple(pairs.agg(F.max(F.col("own") + F.col("upto")), F.min(F.col("own") + F.col("above"))).first())

    def ends(total: int) -> tuple[int, int]:
        """The least and the greatest candidate that pairs of this sum give, in steps; they differ for ties only."""
        if total % (2 * STEP) != STEP:
            return ((total + STEP) // (2 * STEP),) * 2
        other = marks.where("o > 0").select((F.lit(total).cast("long") - F.col("v")).alias("v"), F.col("v").alias("other"))
        middle = (F.col("v") / float(MICRO) + F.col("other") / float(MICRO)) / 2
        step = F.rint(middle * float(MICRO // STEP)).cast("long")
        return tuple(marks.where("a > 0").select("v").join(other, "v").agg(F.min(step), F.max(step)).first())

    def near(edge: int) -> tuple[int | None, int | None]:
        """The last candidate up to `edge` and the first above it, in steps."""
        tie = 2 * STEP * edge + STEP
        low, high = beside(tie - 1)
        down, up = ends(tie) if high == tie else (None, None)
        if high == tie and up == edge:  # none of them is above
            high = beside(tie)[1]
        first = edge + 1 if up == edge + 1 else None if high is None else ends(high)[0]
        return edge if down == edge else None if low is None else ends(low)[1], first

    # the last score up to which no more are refused than admitted wrongly
    a = o = 0
    for r in ranges:
        if (no - o) * na < a * no:
            break
        here, a, o = (r.range, a, o), a + r.a, o + r.o
    line = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    inside = marks.where(F.col("range") == here[0]).select("v", *[(F.coalesce(F.sum(c).over(line), F.lit(0)) + before).alias(c) for c, before in (("a", here[1]), ("o", here[2]))])
    cross = inside.where((no - F.col("o")) * na >= F.col("a") * no).agg(F.max("v")).first()[0]
    low, high = near(cross // STEP)
    cost = lambda t: _places(max(errors(t * STEP)), 9)
    if low is not None and (high is None or cost(low) <= cost(high)):
        before = marks.where((F.col("o") > 0) & (F.col("v") < low * STEP)).agg(F.max("v")).first()[0]
        best = ends(min(r.a_min for r in ranges if r.a) + min(r.o_min for r in ranges if r.o))[0] if before is None else near(before // STEP)[1]
    else:
        best = high
    best = _places(best / (MICRO // STEP), 3)
    refused, admitted = errors(round(best * MICRO))
    return spark.createDataFrame([(best, _places(refused, 4), _places(admitted, 4), name)], shape)


def _places(x: float, n: int) -> float:
    """x to n places as SQL has it for doubles: halves to the even one, of a product that is a double itself."""
    return round(x * 10.0**n) / 10.0**n


def confusion(pairs: DataFrame) -> DataFrame:
    """gold, predicted, n."""
    return pairs.groupBy("gold", "predicted").agg(F.count("*").alias("n"))


def kappa(pairs: DataFrame) -> DataFrame:
    """n, agreement, kappa of pairs(gold, predicted); no rows: zeros; certain chance agreement: 1 where all agree, else 0."""
    cells = confusion(pairs)
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("same"))
    g = cells.groupBy(F.col("gold").alias("k")).agg(F.sum("n").alias("g"))
    p = cells.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("p"))
    chance = g.join(p, "k").agg(F.coalesce(F.sum(F.col("g") * F.col("p")), F.lit(0)).alias("gp"))
    t = total.crossJoin(chance).withColumn("po", F.when(F.col("n") > 0, F.col("same") / F.col("n")).otherwise(0.0)).withColumn("pe", F.when(F.col("n") > 0, F.col("gp") / (F.col("n") * F.col("n"))).otherwise(0.0))
    k = F.when(F.col("n") == 0, 0.0).when(F.abs(1 - F.col("pe")) < 1e-12, F.when(F.col("po") >= 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return t.select("n", F.bround("po", 6).alias("agreement"), F.bround(k, 6).alias("kappa"))


def point_biserial(df: DataFrame, flag: Column, value: Column) -> DataFrame:
    """Correlation of a yes/no with a number; 0 under 3 rows or without variance."""
    t = df.select(flag.cast("double").alias("x"), value.cast("double").alias("y")).where("x is not null and y is not null")
    s = t.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    return s.select("n", F.when(F.col("n") < 3, 0.0).otherwise(F.bround(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)), 4)).alias("r"))


def retention(context: DataFrame, gold: DataFrame, widths: list[int]) -> DataFrame:
    """config_id, width, n, kept: questions with a gold chunk, and those with one in their first `width` of context.

    A context's first w chunks are the context at width w, so one context at the greatest width serves all.
    """
    asked = gold.select("query_id").distinct()
    best = context.join(gold, ["query_id", "chunk_id"]).groupBy("config_id", "query_id").agg(F.min("final_rank").alias("at"))
    grid = context.select("config_id").distinct().crossJoin(asked).join(best, ["config_id", "query_id"], "left")
    each = grid.select("config_id", "at", F.explode(F.array(*[F.lit(w) for w in widths])).alias("width"))
    return each.groupBy("config_id", "width").agg(F.count("*").alias("n"), F.count_if(F.col("at") <= F.col("width")).alias("kept"))


def spread(kept: DataFrame) -> DataFrame:
    """width, spread: between the configurations that keep most and least gold at a width, in percent points; from `retention`."""
    share = 100.0 * F.col("kept") / F.col("n")
    return kept.groupBy("width").agg(F.bround(F.max(share) - F.min(share), 6).alias("spread"))


def retention_by_kind(context: DataFrame, gold: DataFrame, kinds: DataFrame) -> DataFrame:
    """config_id, kind, n, kept: questions of a kind with a gold chunk, and those with one in their context; kinds(query_id, kind)."""
    asked = gold.select("query_id").distinct().join(kinds, "query_id")
    found = context.join(gold, ["query_id", "chunk_id"]).select("config_id", "query_id").distinct().withColumn("found", F.lit(1))
    grid = context.select("config_id").distinct().crossJoin(asked).join(found, ["config_id", "query_id"], "left")
    return grid.groupBy("config_id", "kind").agg(F.count("*").alias("n"), F.count("found").alias("kept"))


def worst_confusion(pairs: DataFrame) -> DataFrame:
    """gold, predicted, n of the commonest mistake (of equal ones, the first in order); no rows if there is none."""
    wrong = confusion(pairs).where("gold != predicted")
    return wrong.orderBy(F.desc("n"), "gold", "predicted").limit(1)


def shared_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str = "4242") -> DataFrame:
    """n rows (all, if there are fewer): n divided by the number of strata from each, at least one, then from all that are left;
    those of least md5 of seed and key."""
    strata = df.select(stratum).distinct().count()
    each = max(1, n // max(1, strata))
    draw = F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary"))
    drawn = df.withColumn("draw", draw).withColumn("r", F.row_number().over(Window.partitionBy(stratum).orderBy("draw")))
    return drawn.orderBy((F.col("r") > each).cast("int"), "draw").limit(n).drop("draw", "r")


def stratified(df: DataFrame, stratum: str, key: str, each: int, seed: str = "4242") -> DataFrame:
    """Exactly `each` rows of every stratum (all, if it has fewer), those of least md5 of seed and key."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary")))
    return df.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).drop("r")

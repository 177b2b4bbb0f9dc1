"""SpotSigs document fingerprints, in DataFrame functions alone.

Common words of four languages are anchors. Each anchor starts a signature: the anchor and the chain of the next `CHAIN`
content words after it, whichever anchors stand between. A text's fingerprint is the set of its signatures' hashes, written
in ascending order as 16 hex digits each. Anchors near the end, with fewer content words left, start none; a text without
any signature takes each of its words as an anchor, so that only the text without words has the empty fingerprint.

Fingerprints are partitioned by set length: two sets whose likeness (Jaccard) reaches tau differ in length by that factor at
most, so they are in one or two neighbouring partitions; pairs further apart are never compared, and those compared meet only
over a shared signature of their prefixes.

A document's neighbour (the next doc_id, the first after the last) is found inside id ranges; each range also gets a copy of
the first row of the next one, so texts are dealt out once and no window spans more than a range. Null or empty text: empty
fingerprint, likeness 1 to another empty one and 0 to any other. Equal texts have equal fingerprints. With one document, it
is its own neighbour. Rows with equal doc_id follow each other by text; rows without one are left out. Very long texts are one
row's arrays at a time. Empty tables give no rows. Where a text has no signature its fingerprint is of another kind (words, not
chains), so its likeness to one with chains is 0 or near it. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import with_range

CHAIN = 2
#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in a is that it for was on are as with be by this from at an or not have has but they which you we his her she he their its were been will would can there if"
    " le la les de des du un une et est en que qui dans pour pas sur avec ce par plus au aux se son sa ses il elle ne nous vous ou mais"
    " der die das und zu den von mit ist im ein eine des auf für nicht sich dem auch er sie es als an werden aus bei nach oder wie einer einem einen"
    " el los las que y del se por con una para como su al lo no más o pero sus esta entre cuando muy sin sobre también me hasta hay"
).split()


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Adds the sorted array of distinct signature hashes of a text column, step by step so that each step is computed once."""
    w, c, a, s = (f"__{out}_{x}" for x in "wcas")
    anchors = sorted(set(ANCHORS))
    df = df.withColumn(w, _words(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(c, F.filter(w, lambda x: ~x.isin(anchors)))
    df = df.withColumn(a, F.filter(F.transform(w, lambda x, i: F.when(x.isin(anchors), i).otherwise(F.lit(-1))), lambda i: i >= 0))
    # of the p words before an anchor, k are anchors, so p - k are content words: the chain starts there in their list
    df = df.withColumn(s, F.filter(F.transform(a, lambda p, k: F.when(p - k + chain <= F.size(c), F.xxhash64(F.get(w, p), *[F.get(c, p - k + j) for j in range(chain)]))), lambda h: h.isNotNull()))
    every = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + 1 + j) for j in range(chain)]))
    return df.withColumn(out, F.sort_array(F.array_distinct(F.when(F.size(s) > 0, F.col(s)).otherwise(every)))).drop(w, c, a, s)


def likeness(a: str | Column, b: str | Column) -> Column:
    """Jaccard of two signature sets; two empty ones are alike."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both.cast("double") / union)


def as_text(signatures: str) -> Column:
    return F.array_join(F.transform(signatures, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def length_partition(size: Column, tau: float) -> Column:
    """Lengths within a factor of tau are in one partition or two neighbouring ones."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.log(F.lit(1 / tau)) + F.lit(1e-9)).cast("int")


def with_next(docs: DataFrame, column: str) -> DataFrame:
    """Adds next: this column of the row of next higher doc_id, or of the lowest one after the last."""
    ranged = with_range(docs, "doc_id", name="__range")
    # one row for each range, at most 65536 (see with_range)
    firsts = sorted((r["__range"], r["first"]) for r in ranged.groupBy("__range").agg(F.min("doc_id").alias("first")).collect())
    spark = docs.sparkSession
    copies = spark.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], "doc_id long, __into int")
    marked = ranged.join(F.broadcast(copies), "doc_id", "left")
    places = F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("copy")), F.struct(F.col("__into").alias("r"), F.lit(True).alias("copy")))
    dealt = marked.withColumn("__p", F.explode(F.filter(places, lambda p: p["r"].isNotNull())))
    order = Window.partitionBy("__p.r").orderBy("__p.copy", "doc_id", "text")
    return dealt.withColumn("next", F.lead(column).over(order)).where(~F.col("__p.copy")).drop("__p", "__range", "__into")


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, set_size from docs(doc_id, text)."""
    # only texts are dealt out: signatures are computed again where they are needed
    paired = with_next(docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    paired = paired.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)))
    for column, out in (("text", "sigs"), ("next", "next_sigs"), ("edited", "edited_sigs")):
        paired = with_signatures(paired, column, out, chain)
    return paired.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "edited",
        as_text("sigs").alias("fingerprint"),
        as_text("edited_sigs").alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").alias("near_edited"),
        likeness("sigs", "next_sigs").alias("near_next"),
        F.size("sigs").cast("long").alias("set_size"),
    )


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "set_size")


def near_pairs(docs: DataFrame, tau: float = 0.75, chain: int = CHAIN) -> DataFrame:
    """a, b (a < b), likeness >= tau: pairs of different fingerprints, by the least doc_id that has each; see `representatives`.

    Two such sets share one of the rarest signatures of each, as many as a set may lack and one more, so pairs meet over those.
    Documents without words are paired with nothing.
    """
    own = with_signatures(docs.select("doc_id", "text"), "text", "sigs", chain).select("doc_id", "sigs")
    sets = representatives(own).where(F.size("sigs") > 0).withColumn("size", F.size("sigs")).withColumn("p", length_partition(F.col("size"), tau))
    each = sets.select("doc_id", "size", "p", F.explode_outer("sigs").alias("h"))
    ranked = each.join(each.groupBy("h").agg(F.count("*").alias("df")), "h").groupBy("doc_id", "size", "p").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("r"))
    prefix = F.slice("r", F.lit(1), F.col("size") - F.ceil(F.lit(tau) * F.col("size")).cast("int") + 1)
    # a signature that no other set has brings no pair
    keys = ranked.select("doc_id", "size", "p", F.explode_outer(F.filter(prefix, lambda x: x["df"] > 1)).alias("x")).where("x is not null").select("doc_id", "size", "p", F.col("x.h").alias("h"))
    left = keys.select(F.col("doc_id").alias("a"), F.col("size").alias("n_a"), F.explode(F.array("p", F.col("p") + 1)).alias("p"), "h")
    right = keys.select(F.col("doc_id").alias("b"), F.col("size").alias("n_b"), "p", "h")
    fit = (F.least("n_a", "n_b") >= F.lit(tau) * F.greatest("n_a", "n_b")) & (F.col("a") != F.col("b"))
    pairs = left.join(right, ["p", "h"]).where(fit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("sigs").alias(f"s_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").withColumn("likeness", likeness("s_a", "s_b")).where(F.col("likeness") >= tau).select("a", "b", "likeness")


def representatives(own: DataFrame) -> DataFrame:
    """One row for each different set: the least doc_id that has it."""
    return own.groupBy("sigs").agg(F.min("doc_id").alias("doc_id"))

"""Made-up corpora: product modules with known facts, and tenants that compete over one document name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import GLOBAL

TENANTS = ("tenant_a", "tenant_b", "tenant_c")
FACTS = 10
KINDS = ("identifier", "value", "paraphrase", "followup")
_SUBJECTS = ("queue", "cache", "index", "scheduler", "gateway", "archive", "ledger", "monitor", "router", "worker")
_TRAITS = ("timeout", "limit", "window", "quota", "interval", "budget", "depth", "threshold", "delay", "share")


def _pick(words: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(at, F.lit(len(words))) + 1).cast("int"))


def unique_number(at: Column, seed: int, size: int = 1_000_003) -> Column:
    """A number of its own for each `at` under size (a prime): at times a factor of the seed, in the numbers modulo size."""
    return F.pmod(at * F.lit(seed * 2 + 1) + F.lit(seed % size), F.lit(size))


def unique_marker(at: Column, seed: int) -> Column:
    return F.concat(F.lit("MK-"), F.lpad(F.conv(unique_number(at, seed).cast("string"), 10, 36), 4, "0"))


def facts(spark: SparkSession, seed: int = 1729, modules: int = 18) -> DataFrame:
    """tenant_id, doc_id, n, kind, query, answer_key, sentence: FACTS for each of `modules` documents of each tenant; keys are unique."""
    t = spark.range(len(TENANTS) * modules * FACTS).select("id", F.floor(F.col("id") / FACTS).alias("doc"), (F.col("id") % FACTS).alias("n"))
    subject, trait = _pick(_SUBJECTS, F.col("doc")), _pick(_TRAITS, F.col("n"))
    kind = _pick(KINDS, F.col("n"))
    number, marker = (unique_number(F.col("id"), seed) + 1_000_000).cast("string"), unique_marker(F.col("id"), seed)
    key = F.when(kind.isin("identifier", "followup"), marker).otherwise(number)
    module = F.concat(F.lit("module "), F.lpad(F.col("doc").cast("string"), 3, "0"))
    sentence = F.concat(F.lit("The "), trait, F.lit(" of the "), subject, F.lit(" in "), module, F.lit(" is set to "), key, F.lit(" by its owners."))
    query = F.when(kind == "paraphrase", F.concat(F.lit("how large is the "), subject, F.lit("'s "), trait, F.lit(" for "), module)).otherwise(F.concat(F.lit("what is the "), trait, F.lit(" of the "), subject, F.lit(" in "), module))
    return t.select(_pick(TENANTS, F.floor(F.col("doc") / modules)).alias("tenant_id"), F.concat(F.lit("modules/m"), F.lpad(F.col("doc").cast("string"), 3, "0")).alias("doc_id"), "n", kind.alias("kind"), query.alias("query"), key.alias("answer_key"), sentence.alias("sentence"))


def documents(known: DataFrame) -> DataFrame:
    """tenant_id, doc_id, markdown: a section for each fact."""
    part = F.concat(F.lit("## Setting "), F.col("n").cast("string"), F.lit("\n\n"), F.col("sentence"), F.lit(" It has been so since the module was written, and a change needs a review by two of its owners and a note to all who run it."))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("part")))), lambda x: x["part"]), "\n\n")
    return known.groupBy("tenant_id", "doc_id").agg(F.concat(F.lit("# Module\n\n"), body).alias("markdown"))


def assert_unique(known: DataFrame) -> DataFrame:
    """known as it is; a key of two documents fails the job that reads it (paraphrases may share one)."""
    twice = known.where("kind != 'paraphrase'").groupBy("answer_key").agg(F.count_distinct("tenant_id", "doc_id").alias("places"))
    j = known.join(twice, "answer_key", "left")
    clash = F.when(F.coalesce("places", F.lit(1)) > 1, F.raise_error(F.concat(F.lit("a key of two documents: "), "answer_key"))).otherwise(F.lit(True))
    return j.where(clash.isNotNull()).select(*known.columns)


def canary(tenant: str) -> str:
    return f"CANARY-{tenant.removeprefix('tenant_').upper()}-7F3A"


def competing(spark: SparkSession, sections: int = 24) -> DataFrame:
    """tenant_id, doc_id, markdown: every tenant has a policy and a long handbook under the same names, with a canary of its own in
    each section, and all share one global document."""
    rows = []
    for i, tenant in enumerate(TENANTS):
        days, mark = 30 * (i + 1), canary(tenant)
        rows.append((tenant, "policies/retention", f"# Retention policy\n\n## Window\n\nRecords of closed accounts are kept for {days} days and then removed by a nightly job, without exceptions for single accounts. Quote {mark} in a support request about retention.\n\n## Region\n\nKept records are stored in region {i + 1}{i + 1} and are not copied to another region unless a signed request asks for it, see {mark}."))
        parts = [f"## Chapter {k}\n\nThe procedure for topic {k} is reviewed every quarter by the owners of area {k}, who record what they found under {mark}-{k} and report it to the board of the company in writing." for k in range(sections)]
        rows.append((tenant, "policies/handbook", "# Handbook\n\n" + "\n\n".join(parts)))
    rows.append((GLOBAL, "shared/calendar", "# Calendar\n\nThe shared calendar lists the public holidays of all regions and the days on which no change to a production system is approved by anyone."))
    return spark.createDataFrame(rows, "tenant_id string, doc_id string, markdown string")

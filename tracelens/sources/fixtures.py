"""The engine's relations over the driver's tables: tenants, chunks, questions, dense vectors, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators import search

GLOBAL = "tenant_global"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tenant_of(source: Column) -> Column:
    return F.when(source == "src0", F.lit(GLOBAL)).otherwise(F.concat(F.lit("tenant_"), source))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tenant_id, doc_id (padded), doc_no, text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(tenant_of(F.col("source")).alias("tenant_id"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("doc_id"), F.col("doc_id").alias("doc_no"), "text")


def chunks(docs: DataFrame, lines_each: int = 4) -> DataFrame:
    """chunk_id, tenant_id, doc_id, ordinal, text: runs of non-blank lines, without a shuffle."""
    lines = docs.withColumn("lines", F.filter(F.split(T.text_of("text"), "\n"), lambda x: F.trim(x) != ""))
    count = F.ceil(F.size("lines") / lines_each).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice("lines", (i - 1) * lines_each + 1, F.lit(lines_each)), "\n"))
    cut = lines.select("tenant_id", "doc_id", F.posexplode_outer(pieces).alias("ordinal", "text")).where(F.col("text") != "")
    return cut.select(ids.chunk_id(F.col("tenant_id"), F.col("doc_id"), F.col("ordinal"), F.col("text")).alias("chunk_id"), "tenant_id", "doc_id", "ordinal", "text")


def gold_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_no, tenant_id: documents that hold the whole text of an item."""
    found = search.containing(docs, items.select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern")), ["doc_no", "tenant_id"])
    return found.select(F.col("pattern_id").alias("item_id"), "doc_no", "tenant_id")


def questions(docs: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, tenant_id, query, kind: the content tokens of each whole item, asked by the tenant that holds it."""
    gold = gold_documents(docs, items).groupBy("item_id").agg(F.min_by("tenant_id", "doc_no").alias("tenant_id"))
    q = items.select("item_id", F.array_join(T.content_tokens("text"), " ").alias("query"))
    joined = q.join(gold, "item_id", "left")
    return joined.select(F.col("item_id").alias("query_id"), F.coalesce("tenant_id", F.lit("tenant_src1")).alias("tenant_id"), "query", F.when(F.col("tenant_id").isNull(), "out_of_scope").otherwise("answerable").alias("kind"))

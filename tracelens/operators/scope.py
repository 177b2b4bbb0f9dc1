"""Tenant scope: a question sees its own tenant's chunks and the global tenant's, and the filter sits below all scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fixtures import GLOBAL


def scope_map(questions: DataFrame) -> DataFrame:
    """tenant_id (of questions), chunk_tenant: own and global, once where they are the same."""
    return questions.select("tenant_id").distinct().select("tenant_id", F.explode(F.array_distinct(F.array("tenant_id", F.lit(GLOBAL)))).alias("chunk_tenant"))


def scoped_chunks(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """tenant_id (of questions), chunk_id: the chunks each asking tenant may see."""
    return chunks.select("chunk_id", F.col("tenant_id").alias("chunk_tenant")).join(scope_map(questions), "chunk_tenant").select("tenant_id", "chunk_id")


def leaks(candidates: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates (query_id, chunk_id) outside their question's scope; empty if the filter holds."""
    seen = candidates.select("query_id", "chunk_id").distinct().join(questions.select("query_id", "tenant_id"), "query_id")
    owned = seen.join(chunks.select("chunk_id", F.col("tenant_id").alias("chunk_tenant")), "chunk_id")
    return owned.where((F.col("chunk_tenant") != F.col("tenant_id")) & (F.col("chunk_tenant") != GLOBAL))

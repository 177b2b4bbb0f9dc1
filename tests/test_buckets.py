"""The shared index keeps its tables by chunk: what is summed for a chunk is summed and ranked there, and not shuffled."""

import re
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracelens.engine import Engine
from tracelens.functions.lexicon import SYNONYMS
from tracelens.operators import ingest, retrieve
from tracelens.session import bucketed, buckets, cut

TEXTS = ["the rust of lint and rust", "", "lint", "cargo cargo cargo rust-1.2 rust cargo", "the of", None, "deleting configs", "x86_64 replicas fail"]


@pytest.fixture
def joined_by_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def engine(spark):
    rows = [(f"c{i}", "tenant_0" if i % 2 else "tenant_global", f"d{i}", 0, t) for i, t in enumerate(TEXTS)]
    c = spark.createDataFrame(rows, "chunk_id string, tenant_id string, doc_id string, ordinal int, text string")
    q = spark.createDataFrame([(1, "tenant_0", "rust lint"), (2, "tenant_1", "cargo removed")], "query_id long, tenant_id string, query string")
    return Engine(spark, c, q)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def dealt_by_chunk(df) -> bool:
    return bool(re.search(r"Exchange hashpartitioning\([^)]*chunk_id", plan(df)))


def test_sums_over_a_chunk_need_no_shuffle(spark, joined_by_shuffle):
    """What is left to shuffle of a leg is its ranks, each bucket's best for each question, and what the questions alone give."""
    e = engine(spark)
    assert "Exchange hashpartitioning" not in plan(retrieve.chunk_concepts(e.postings, counted=e.terms))
    own, asked, weights = e.concepts
    for scored in (retrieve.concept_knn(e.pairs()), retrieve.bm25(e.chunks, e.questions, posted=e.postings)):
        assert not dealt_by_chunk(scored)
        assert "WindowGroupLimit" in plan(scored)
    bare = retrieve.postings(e.given_chunks).localCheckpoint()
    assert dealt_by_chunk(retrieve.bm25(e.given_chunks, e.questions, posted=bare))


def test_the_same_as_without_buckets(spark):
    e = engine(spark)
    bare = retrieve.postings(e.given_chunks).localCheckpoint()
    assert sorted(e.postings.collect()) == sorted(bare.collect())
    own = retrieve.chunk_concepts(bare, ingest.vocabulary(bare.select(F.col("term").alias("token"))))
    assert sorted(e.own.collect()) == sorted(own.collect())
    assert sorted(e.lexical.collect()) == sorted(retrieve.bm25(e.given_chunks, e.questions).collect())


def test_concepts_where_terms_stand(spark, monkeypatch):
    """Concepts by expression are those by join: for synonyms, what stems to them, identifiers, and terms that aren't common."""
    words = {w + s for w in [*SYNONYMS, *SYNONYMS.values(), "run", "cach", "x86_64", "rust-1.2", "v2", "a"] for s in ("", "s", "es", "ed", "ing", "ings", "ies", "ly", "ness", "ment", "ation")}
    t = spark.createDataFrame([(w,) for w in sorted(words)], "token string")
    assert sorted(t.select("token", ingest.concept("token").alias("concept")).collect()) == sorted(ingest.with_concept(t).collect())
    e = engine(spark)
    before = sorted(e.own.collect())
    monkeypatch.setattr(retrieve, "COMMON", 1)
    assert sorted(retrieve.chunk_concepts(e.postings).collect()) == before


def test_how_many_buckets(spark):
    assert buckets(spark.range(10)) == 1
    assert buckets(spark.range(1 << 30)) == (8 << 30) // (16 << 20)
    assert buckets(spark.range(1 << 21)) == spark.sparkContext.defaultParallelism


def test_a_task_reads_one_bucket_and_writes_one(spark):
    """Also where nothing in the plan needs buckets and files are small: tasks of several buckets sort all their rows to write them."""
    made = bucketed(spark.range(1000), "id", 12)  # three times the cores
    assert made.select((made.id + 1).alias("x")).rdd.getNumPartitions() == 12
    again = bucketed(made.select("id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("j")), "id", 12, dealt=True)
    assert len(again.inputFiles()) == 12
    assert sorted(again.collect()) == [(i, j) for i in range(1000) for j in range(1, 6)]


def test_kept_tables_are_packed(spark):
    for df in (cut(spark.range(1000)), bucketed(spark.range(1000), "id", 2)):
        for name in df.inputFiles():
            assert pq.ParquetFile(Path(name.removeprefix("file://"))).metadata.row_group(0).column(0).compression == "ZSTD"

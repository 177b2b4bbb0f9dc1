"""What the shared index tables shuffle: questions go to the corpus while they are few, not the corpus to the questions."""

from collections import Counter

import pytest

from tracelens.operators import retrieve

TEXTS = ["the rust of lint and rust", "", "lint", "cargo cargo cargo rust-1.2 rust cargo", "the of"]


@pytest.fixture
def joined_by_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def chunks(spark):
    rows = [(f"c{i}", "tenant_0" if i % 2 else "tenant_global", f"d{i}", 0, t) for i, t in enumerate([*TEXTS, None])]
    return spark.createDataFrame(rows, "chunk_id string, tenant_id string, doc_id string, ordinal int, text string")


def test_postings_are_counted_where_the_chunk_is(spark):
    got = retrieve.postings(chunks(spark))
    assert "Exchange" not in plan(got)
    want = Counter((r.chunk_id, r.term) for r in retrieve.tokens(chunks(spark)).collect())
    length = Counter(c for c, _ in want.elements())
    assert {(r.chunk_id, r.dl, r.term): r.tf for r in got.collect()} == {(c, length[c], t): n for (c, t), n in want.items()}


def test_pairs_are_summed_where_the_chunk_is(spark, joined_by_shuffle):
    c = chunks(spark)
    q = spark.createDataFrame([(1, "tenant_0", "rust lint"), (2, "tenant_1", "cargo")], "query_id long, tenant_id string, query string")
    words = spark.createDataFrame([(w, w) for w in ("rust", "lint", "cargo", "rust-1.2", "and")], "token string, concept string")
    own, asked = retrieve.concept_tables(retrieve.postings(c), q, words)
    pairs = retrieve.concept_pairs(c, q, own.localCheckpoint(), asked.localCheckpoint(), retrieve.concept_idf(own, c).localCheckpoint())
    assert "SortMergeJoin" not in plan(pairs)
    assert {(r.query_id, r.chunk_id) for r in pairs.collect()} == {(1, "c0"), (1, "c2"), (1, "c3")}


def test_an_engine_takes_stored_tables(spark):
    """Questions put to an index that is there don't build its vocabulary, concepts and weights again."""
    from tracelens.engine import Engine

    stored = {name: spark.range(1) for name in ("vocabulary", "concepts", "weights")}
    e = Engine(spark, chunks(spark), None, stored)
    assert (e.chunk_vocabulary, e.own, e.weights) == (stored["vocabulary"], stored["concepts"], stored["weights"])


@pytest.mark.parametrize("few", [0, 10**9])
def test_pruned_scores_are_summed_where_the_chunk_is(spark, joined_by_shuffle, monkeypatch, few):
    """Candidates by the thousand and their terms' blocks are not shuffled: not at all, or only few chunks and their entries once."""
    from tracelens.operators import pruned
    from tracelens.queries import QUERIES

    monkeypatch.setattr(pruned, "FEW", few, raising=False)
    got, want = (QUERIES[name](spark, "/root/testdata/sf0.001") for name in ("bm25_pruned_topk", "bm25_topk"))
    assert plan(got).count("hashpartitioning(chunk_id") <= 2 * (few > 0) and "hashpartitioning(query_id" in plan(got) and "SortMergeJoin" not in plan(got)
    rows = lambda df: sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in df.collect())
    assert rows(got) == rows(want) and rows(want)


def test_spread_keeps_counts_and_no_pairs(spark, joined_by_shuffle, monkeypatch, tmp_path):
    """Scores of every pair, of which none is kept: against the plain sum, with equal, empty, null, uneven and zero vectors."""
    import random

    from tracelens.functions import text as T
    from tracelens.operators import vectors
    from tracelens.queries import QUERIES

    rng = random.Random(7)
    some = lambda n=5: [rng.choice([rng.gauss(0, 1), rng.randrange(3) - 1.0]) for _ in range(n)]
    rows = [(i, 0 if i < 400 else i % 3, some()) for i in range(700)] + [(700 + i, 1, [1.0, 2.0, 0.0, 0.0, -1.0]) for i in range(300)]
    rows += [(1000, 2, [0.0] * 5), (1001, 2, None), (1002, 2, some(4)), (1003, 2, []), (1050, 9, [0.5] * 5), (1100, 8, None), (1150, 2, some(4)), (1004, 2, [None, *some(4)])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    v = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for i, s in v.join(v.where("vec_id % 50 = 0").selectExpr("vec_id AS q", "label", "embedding AS e"), "label").select("q", T.cosine("embedding", "e")).collect():
        want.setdefault(i, []).append(s)
    known = lambda x: [s for s in x if s is not None] or [None]
    want = {i: (max(known(x)), sorted(x, key=lambda s: -9 if s is None else s)[len(x) // 2], min(known(x)), len(x)) for i, x in want.items()}
    monkeypatch.setattr(vectors, "VECTORS", 50, raising=False)
    monkeypatch.setattr(vectors, "QUERIES", 3, raising=False)
    got = QUERIES["embedding_browse"](spark, str(tmp_path))
    assert "Join" not in plan(got)
    assert {r.query_id: (r.most, r.middle, r.least, r.n) for r in got.collect()} == want and len(want) == 24

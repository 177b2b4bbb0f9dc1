import random

import pytest

from tracelens.operators import calibrate, counterfactual, judge, retrieve, scope, stages
from tracelens.plans import config
from tracelens.plans.config import Config, compose, normalise


@pytest.fixture
def small(spark):
    chunks = spark.createDataFrame(
        [("c1", "tenant_a", "d", 0, "retention policy keeps records for thirty days"), ("c2", "tenant_a", "d", 1, "other text entirely about limits"), ("c3", "tenant_b", "d", 0, "retention policy keeps records for ninety days"), ("c4", "tenant_global", "g", 0, "the global policy")],
        "chunk_id string, tenant_id string, doc_id string, ordinal int, text string",
    )
    questions = spark.createDataFrame([(1, "tenant_a", "retention policy"), (2, "nobody", "retention policy"), (3, "tenant_a", "the of")], "query_id long, tenant_id string, query string")
    return chunks, questions


def test_a_tenant_sees_its_own_and_global_chunks_only(small):
    chunks, questions = small
    hits = {(r.query_id, r.chunk_id) for r in retrieve.bm25(chunks, questions).collect()}
    assert hits == {(1, "c1"), (1, "c4"), (2, "c4")}
    assert scope.leaks(retrieve.bm25(chunks, questions), questions, chunks).count() == 0


def test_a_filter_after_ranking_would_leak(small, spark):
    chunks, questions = small
    wide = questions.select("query_id", "tenant_id").crossJoin(chunks.select("chunk_id"))
    assert scope.leaks(wide, questions, chunks).count() > 0


def test_neighbours_stay_in_the_document(small, spark):
    chunks, _ = small
    got = {(r.chunk_id, r.delta, r.neighbour_id) for r in retrieve.neighbours(chunks.select("chunk_id"), chunks, 2).collect()}
    assert got == {("c1", 1, "c2"), ("c2", -1, "c1")}


def test_dense_knn_ties_zero_vectors(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, [0.0, 0.0]), (4, 1, [1.0, 0.0])], "vec_id long, scope int, embedding array<double>")
    q = spark.createDataFrame([(9, 0, [2.0, 0.0])], "query_id long, scope int, embedding array<double>")
    assert [(r.vec_id, r.rank, r.score) for r in retrieve.dense_knn(v, q).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, 1.0)]


def legs(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, lexical_rank int, lexical_score double, semantic_rank int, semantic_score double")


def test_fusion_modes(spark):
    found = legs(spark, [(1, "a", 1, 3.0, 2, 0.5), (1, "b", 2, 2.0, None, None), (1, "c", None, None, 1, 0.9)])
    cfg = config.configs(spark, ["baseline", "no_fusion", "no_lexical"])
    got = {(r.config_id, r.chunk_id): (r.fused_score, r.fused_rank) for r in stages.fuse(found, cfg).collect()}
    assert got[("baseline", "a")] == (round(1 / 61 + 1 / 62, 8), 1)
    assert got[("no_fusion", "c")] == (0.9, 3)
    assert ("no_lexical", "b") not in got and got[("no_lexical", "c")] == (0.5, 1)


def test_gate_at_threshold_passes_and_a_missing_signal_is_not_checked(spark):
    found = legs(spark, [(1, "a", 1, 1.0, 1, 0.42), (2, "a", 1, 1.0, 1, 0.41), (3, "a", 1, 1.0, None, None)])
    cfg = config.configs(spark, ["baseline"])
    got = {r.query_id: (r.gate_passed, r.gate_checked) for r in stages.gate(stages.fuse(found, cfg), cfg).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (True, False)}


def test_context_is_winners_with_neighbours_in_order(spark, small):
    chunks, _ = small
    cfg = config.configs(spark, ["no_gate", "no_expansion"])
    ranked = spark.createDataFrame([(c, 1, x, p, True, False) for c in ("no_gate", "no_expansion") for p, x in enumerate(["c2", "c4", "c1"], 1)], "config_id string, query_id long, chunk_id string, position int, gate_passed boolean, promoted boolean")
    got = {}
    for r in stages.context(ranked, chunks, cfg).orderBy("final_rank").collect():
        got.setdefault(r.config_id, []).append(r.chunk_id)
    assert got == {"no_gate": ["c2", "c1", "c4"], "no_expansion": ["c2", "c4", "c1"]}


def test_config_rules():
    assert normalise("b+a+baseline+a") == "a+b" and normalise("baseline") == "baseline"
    assert len({compose(n).hash() for n in config.ABLATIONS}) == len(config.ABLATIONS)
    with pytest.raises(ValueError):
        Config(lexical_top_k=None, semantic_top_k=None)
    with pytest.raises(ValueError):
        compose("no_gate+gate_on_fused")
    with pytest.raises(KeyError):
        compose("nothing")


def test_outcomes(spark):
    cases = spark.createDataFrame([(1, "answerable", "key"), (2, "out_of_scope", None)], "query_id long, kind string, answer_key string")
    rows = [("baseline", 1, "grounded", False, "the key"), ("v", 1, "grounded", False, "wrong"), ("w", 1, "refused", True, "no"), ("baseline", 2, "refused", True, "no"), ("v", 2, "grounded", False, "sure"), ("w", 2, "refused", True, "no")]
    got = {(r.config_id, r.query_id): r.outcome for r in counterfactual.diffs(spark.createDataFrame(rows, "config_id string, query_id long, status string, hedged boolean, answer string"), cases).collect()}
    assert got == {("v", 1): "now_confident_wrong", ("w", 1): "now_refuses", ("v", 2): "now_confident_wrong", ("w", 2): "identical"}


def test_kappa_of_perfect_and_constant_judges(spark):
    make = lambda rows: spark.createDataFrame(rows, "gold string, predicted string")
    assert calibrate.kappa(make([("a", "a"), ("b", "b")])).first()["kappa"] == 1.0
    assert calibrate.kappa(make([("a", "a"), ("b", "a")])).first()["kappa"] == 0.0
    assert calibrate.kappa(make([])).first()["kappa"] == 0.0


def test_threshold_matches_trying_each(spark):
    rng = random.Random(3)
    rows = [(rng.random() < 0.6, round(rng.random(), 2)) for _ in range(60)]
    got = calibrate.threshold(spark.createDataFrame(rows, "answerable boolean, score double")).first()
    a, o = [s for k, s in rows if k], [s for k, s in rows if not k]
    tries = sorted({round((x + y) / 2, 4) for x in a for y in o})
    cost = lambda t: round(max(sum(s < t for s in a) / len(a), sum(s >= t for s in o) / len(o)), 9)
    assert got["threshold"] == min(tries, key=lambda t: (cost(t), t))


def test_cache_hits_need_equal_discriminators(spark):
    rows = [(1, "n", ["a", "b"], []), (2, "n", ["a", "b"], []), (3, "n", ["a", "b"], ["7"]), (4, "m", ["a", "b"], [])]
    asked = spark.createDataFrame(rows, "entry long, ns string, concepts array<string>, marks array<string>")
    assert [(r.entry, r.hit) for r in judge.cache_hits(asked).collect()] == [(2, 1)]


@pytest.mark.parametrize(("threshold", "hot"), [(0.93, 2048), (0.6, 3), (0.5, 1)])
def test_cache_hits_equal_brute_force(spark, threshold, hot):
    rng = random.Random(int(threshold * 100))
    rows = []
    for entry in rng.sample(range(1000), 150):
        base = [f"w{i}" for i in range(rng.choice([3, 16, 17, 30]))]  # all questions begin with the same concepts
        words = None if rng.random() < 0.05 else [w for w in base if rng.random() < 0.97] + ["own"] * (rng.random() < 0.3)
        rows.append((entry, rng.choice(["n", "n", "m", None]), words, rng.choice([[], [], ["7", "5"], ["5", "7"], None])))
    like = lambda x, y: len(x & y) >= threshold * len(x | y)
    whole = [(e, ns, set(c), sorted(k)) for e, ns, c, k in rows if ns and c and k is not None]
    want = {}
    for e, ns, c, k in whole:
        earlier = [f for f, ns2, c2, k2 in whole if f < e and (ns, k) == (ns2, k2) and like(c, c2)]
        if earlier:
            want[e] = min(earlier)
    asked = spark.createDataFrame(rows, "entry long, ns string, concepts array<string>, marks array<string>").repartition(3)
    assert {r.entry: r.hit for r in judge.cache_hits(asked, threshold, hot).collect()} == want and want
    assert judge.cache_hits(asked.where("false"), threshold, hot).count() == 0


def test_rate_is_over_what_was_attempted(spark):
    attempted = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    scored = spark.createDataFrame([(1, "wrong_confident")], "case_id long, verdict string")
    r = judge.wrong_confident(attempted, scored).first()
    assert (r.attempted, r.scored, r.rate, r.reportable) == (3, 1, round(1 / 3, 6), False)

import json

import pytest
from pyspark.sql import functions as F

from tracelens import cli, engine
from tracelens.operators import calibrate, counterfactual, embed, generate, ingest, judge, suites, vectors
from tracelens.plans import provenance, report
from tracelens.plans.config import Config, compose, plan
from tracelens.session import ship
from tracelens.sources import files, synthetic


@pytest.fixture(scope="module")
def asked(spark):
    return suites.isolation_questions(spark)


@pytest.fixture(scope="module")
def competing(spark, asked):
    ship(spark)
    return engine.Engine(spark, suites.competing_chunks(spark), asked.select("query_id", "tenant_id", "query"))


@pytest.fixture(scope="module")
def traces(competing):
    return competing.query(["no_gate", "no_gate+no_expansion"], "corpus@1").persist()


def test_isolation_holds_and_its_controls_reach_something(spark, competing, asked):
    found = {r.case_id: (r.passed, r.detail) for r in suites.guard(spark, {"isolation": suites.isolation(competing, asked)}).collect()}
    assert len(found) == 12 and all(passed for passed, _ in found.values()), found


def test_isolation_finds_a_leak(spark, asked):
    """The same tenants over chunks that all say they are global: every foreign canary comes through."""
    ship(spark)
    leaky = suites.competing_chunks(spark).withColumn("tenant_id", F.lit("tenant_global"))
    e = engine.Engine(spark, leaky, asked.select("query_id", "tenant_id", "query"))
    found = {r.case_id: r.passed for r in suites.guard(spark, {"isolation": suites.isolation(e, asked)}).collect()}
    assert not found["direct_answer"] and not found["control_own"]


def test_guard_turns_a_crash_into_a_finding(spark):
    def crash():
        raise RuntimeError("x")

    got = {(r.suite, r.case_id): (r.passed, r.severity) for r in suites.guard(spark, {"a": {"p": crash, "q": lambda: suites.finding("a", "q", spark.range(0), 3, "rows")}, "b": suites.failed_suite(spark, "b", crash)}).collect()}
    assert got == {("a", "p"): (False, 2), ("a", "q"): (True, 0), ("b", "__suite__"): (False, 3)}
    assert suites.estimate(12) == 22800


def test_traces_have_ids_stages_and_stamps(spark, competing, traces, tmp_path):
    rows = traces.collect()
    assert len({r.trace_id for r in rows}) == len(rows) and all(len(r.trace_id) == 26 for r in rows)
    r = next(x for x in rows if x.query_id == 0 and x.config_id == "no_gate")
    assert [s.stage for s in r.stages] == [s for s, _ in provenance.STAGES] and r.versions.embed == "sim:concept" and r.versions.corpus == "corpus@1"
    off = next(x for x in rows if x.query_id == 0 and x.config_id == "no_expansion+no_gate")
    assert {s.stage: s.reason for s in off.stages}["expand"] == "ablated" and off.config_hash != r.config_hash
    assert engine.trace(traces, r.trace_id).count() == 1
    with pytest.raises(ValueError):
        engine.trace(traces, "../x")
    read = engine.context_chunks(engine.trace(traces, r.trace_id)).orderBy("final_rank").collect()
    assert [x.final_rank for x in read] == list(range(1, len(read) + 1)) and read
    assert engine.candidate(traces, read[0].chunk_id).count() >= 1 and engine.stage(traces, "gate").count() == len(rows)
    assert engine.foreign_chunks(traces, competing.chunks).count() == 0
    assert engine.chunk(competing.chunks, read[0].chunk_id).count() == 1
    assert competing.meta().first().tenants == list(synthetic.TENANTS)
    with pytest.raises(ValueError):
        competing.query(["no_gate+gate_on_fused"])
    path = f"file://{tmp_path}/traces"
    files.write_traces(traces, path)
    files.write_traces(traces.where("config_id = 'no_gate'"), path)
    assert files.read_traces(spark, path).count() == len(rows)
    assert json.loads(files.schema_json(traces))["type"] == "struct"


def test_scope_assertion(spark, competing):
    own = competing.chunks.where("tenant_id = 'tenant_a'").select("tenant_id", "chunk_id")
    assert engine.assert_scope(own, competing.chunks).count() == own.count()
    with pytest.raises(Exception, match="foreign chunk"):
        engine.assert_scope(own.withColumn("tenant_id", F.lit("tenant_b")), competing.chunks).collect()


def test_index_on_disk(spark, competing, tmp_path):
    path = f"file://{tmp_path}/index"
    competing.save(path, "corpus@1")
    again = engine.Engine.load(spark, path, competing.questions)
    key = ("query_id", "chunk_id", "lexical_rank", "semantic_rank", "lexical_score", "semantic_score")
    assert {tuple(r) for r in again.legs.select(*key).collect()} == {tuple(r) for r in competing.legs.select(*key).collect()}
    with pytest.raises(ValueError, match="another kind"):
        engine.Engine.load(spark, path, competing.questions, model="dense")
    competing.chunks.limit(1).write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(ValueError, match="isn't whole"):
        engine.Engine.load(spark, path, competing.questions)
    with pytest.raises(FileNotFoundError):
        files.read_index(spark, f"file://{tmp_path}/none", {})


def test_made_up_facts(spark, tmp_path):
    ship(spark)
    known = synthetic.facts(spark, modules=3).persist()
    assert known.count() == 90 and synthetic.assert_unique(known).count() == 90
    assert known.select("answer_key").distinct().count() == 90
    assert {(r.doc_id, r.answer_key) for r in synthetic.facts(spark, modules=3).collect()} == {(r.doc_id, r.answer_key) for r in known.collect()}
    with pytest.raises(Exception, match="a key of two documents"):
        synthetic.assert_unique(known.withColumn("answer_key", F.lit("k"))).collect()
    chunks = ingest.chunk_markdown(synthetic.documents(known)).drop("heading_path")
    e = engine.Engine(spark, chunks, known.where("kind = 'identifier'").select(F.xxhash64("doc_id", "n").alias("query_id"), "tenant_id", "query"))
    answers = {r.query_id: r.answer for r in e.run(["no_gate"])["answers"].collect()}
    truth = {r.q: r.answer_key for r in known.where("kind = 'identifier'").select(F.xxhash64("doc_id", "n").alias("q"), "answer_key").collect()}
    assert sum(truth[q] in a for q, a in answers.items()) >= 0.9 * len(truth)


def test_sources_round_trip(spark, tmp_path):
    base = f"file://{tmp_path}"
    case = spark.createDataFrame([("c1", "t", "value", "how many", "12", ["before"])], files.TESTSET)
    files.write_testset(case, f"{base}/tests")
    assert files.read_testset(spark, f"{base}/tests").collect() == case.collect()
    failing = spark.createDataFrame([("s", "x", 3)], "suite string, case_id string, severity int")
    assert files.read_baseline(spark, f"{base}/baseline", "p").count() == 0
    files.write_baseline(failing, f"{base}/baseline", "p")
    assert files.read_baseline(spark, f"{base}/baseline", "p").first().provider == "p"
    counts = spark.createDataFrame([("no_gate", "identical", 4), ("no_gate", "degraded", 6)], "config_id string, outcome string, n long")
    assert files.read_snapshot(spark, f"{base}/snap") is None
    files.write_snapshot(counts, {"corpus": "c"}, f"{base}/snap")
    was, versions = files.read_snapshot(spark, f"{base}/snap")
    assert versions == {"corpus": "c"} and was.count() == 2
    now = spark.createDataFrame([("no_gate", "identical", 9), ("no_gate", "degraded", 1), ("new", "identical", 1)], counts.schema)
    for same, severity in ((True, 3), (False, 2)):
        got = {r.config_id: (r.passed, r.severity) for r in counterfactual.drift_findings(now, was, same).collect()}
        assert got == {"no_gate": (False, severity), "new": (True, 0)}
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "a.jsonl").write_text('{"query": "q", "baseline": "a", "variant": "b", "label": "equivalent"}\n')
    (tmp_path / "labels" / "b.txt").write_text("no label")
    assert [r.label for r in files.read_labels(spark, f"{base}/labels").collect()] == ["equivalent"]
    for tenant in ("one", "two"):
        (tmp_path / tenant / "ten").mkdir(parents=True)
        (tmp_path / tenant / "ten" / f"{tenant}.md").write_text("# x")
    roots = files.default_roots(spark, f"{base}/one", f"{base}/two")
    assert files.union_roots(spark, roots).count() == 2 and files.default_roots(spark, f"{base}/one", f"{base}/none") == [f"{base}/one"]
    with pytest.raises(Exception, match="duplicate document"):
        files.union_roots(spark, [f"{base}/one", f"{base}/one"]).collect()
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, n int")
    files.write_ndjson(df, f"{base}/nd")
    assert sorted(r.k for r in files.read_ndjson(spark, f"{base}/nd", "k string, n int").collect()) == ["a", "b"]
    vectors = spark.createDataFrame([("a",)], "chunk_id string")
    assert [r.chunk_id for r in files.missing_vectors(spark.createDataFrame([("a",), ("b",)], "chunk_id string"), vectors).collect()] == ["b"]
    assert files.fingerprint("v", "m", 3, 4) != files.fingerprint("v", "m", 3, 5) and len(files.fingerprint("v", "m", 3, 4)) == 8


def test_traps(spark, tmp_path):
    whole = {"id": "t1", "failure_class": "x", "tenant": "t", "query": "q", "expected_behaviour": "refuse", "reason": "r"}
    (tmp_path / "a.json").write_text(json.dumps(whole | {"detect": {"must_not_contain_confident_claim": True}}))
    (tmp_path / "b.json").write_text(json.dumps(whole | {"id": "t2", "detect": {"must_contain_any": ["caveat"], "must_not_contain": ["never"], "acceptable_refusal_markers": ["ask us"]}}))
    (tmp_path / "c.json").write_text(json.dumps(whole | {"id": "t3"}))
    traps = files.read_traps(spark, f"file://{tmp_path}")
    kind = "id string, status string, hedged boolean, answer string"
    verdict = lambda rows: {r.id: (r.verdict, r.severity, r.problems) for r in suites.trap_verdicts(traps, spark.createDataFrame(rows, kind)).collect()}
    got = verdict([("t1", "grounded", False, "It is 12."), ("t2", "grounded", False, "Never; but Ask us.")])
    assert got == {"t1": ("wrong_confident", 3, "confident claim"), "t2": ("wrong_flagged", 2, "missing caveat, forbidden word"), "t3": (None, None, "")}
    assert verdict([("t1", "refused", True, "No."), ("t2", "grounded", False, "With a CAVEAT.")])["t2"][0] == "ok"
    (tmp_path / "d.json").write_text(json.dumps(whole))
    with pytest.raises(ValueError, match="one id"):
        files.read_traps(spark, f"file://{tmp_path}")
    (tmp_path / "d.json").write_text(json.dumps({"id": "t9"}))
    with pytest.raises(ValueError, match="lacks"):
        files.read_traps(spark, f"file://{tmp_path}")


def test_attribution(spark):
    sources = spark.createDataFrame([("r", 1, "c1", "The queue depth limit is forty two messages."), ("r", 2, "c2", "Archives are kept for ninety days.")], "reply_id string, n int, chunk_id string, text string")
    replies = spark.createDataFrame([("r", "Archives are kept for ninety days. The limit stands [1]. Nothing of that sort was ever written anywhere. See [7].")], "reply_id string, text string")
    tokens = replies.select("text").union(sources.select("text")).select(F.explode(engine_tokens("text")).alias("token"))
    got = [(r.chunk_ids, r.supported) for r in generate.attribute(replies, sources, ingest.vocabulary(tokens)).orderBy("place").collect()]
    assert got == [(["c2"], True), (["c1"], True), ([], False), ([], False)]


def engine_tokens(column):
    from tracelens.functions import text

    return text.content_tokens(column)


def test_embedding_runs_once_for_each_text(spark):
    ship(spark)
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "id int, text string")
    out = embed.embed(rows, "text", embed.resolve("hashed"), "hashed")
    got = {r.id: r.embedding for r in out.collect()}
    assert got[1] == got[2] and len(got[1]) == 64 and set(got[3]) == {0.0}
    known = out.where("id = 4").select("text_sha", F.lit("hashed").alias("model_id"), F.array(F.lit(9.0).cast("float")).alias("embedding"))
    assert {r.id: r.embedding for r in embed.embed(rows, "text", embed.resolve("hashed"), "hashed", known).collect()}[4] == [9.0]
    with pytest.raises(KeyError):
        embed.resolve("none")


def test_model_judge(spark):
    pairs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, said string")
    replies = {"a": "Equivalent.\nBecause", "b": "hm\nequivalent"}
    out = judge.model_judge(pairs, lambda s: s.map(lambda x: replies.get(x, "")), F.col("said"), "x", "y")
    assert {r.id: r.verdict for r in out.collect()} == {1: "equivalent", 2: "unstable", 3: "unstable"}
    with pytest.raises(ValueError):
        judge.model_judge(pairs, None, F.col("said"), "x", "x")
    two = spark.createDataFrame([("a", "b")], "x string, y string").select(judge.two_way(F.col("x"), F.col("y"), symmetric=True).alias("v"))
    assert two.first().v == "a"


def test_provenance(spark):
    config = Config()
    assert provenance.stage_enabled(config, "rerank") and not provenance.stage_enabled(compose("no_rewrite"), "rewrite")
    with pytest.raises(KeyError):
        provenance.stage_enabled(config, "nothing")
    stamp = provenance.versions(compose("no_rerank"), "c")
    assert stamp["rerank"] == "none" and stamp["generate"] == "sim:extractive" and stamp["code"].startswith("src@")
    report.assert_comparable(stamp, provenance.versions(config, "c"))
    pair = provenance.stamped(spark.range(1), stamp).withColumnRenamed("versions", "a").crossJoin(provenance.stamped(spark.range(1).withColumnRenamed("id", "i"), provenance.versions(config, "c")).withColumnRenamed("versions", "b"))
    assert pair.where(report.comparable("a", "b")).count() == 1
    assert pair.withColumn("b", F.col("b").withField("corpus", F.lit("d"))).where(report.comparable("a", "b")).count() == 0
    provenance.assert_deterministic(0.0)
    with pytest.raises(ValueError):
        provenance.assert_deterministic(0.2)
    names, errors = plan(["baseline", "no_rerank+force_rerank"])
    assert names == ["baseline"] and list(errors) == ["force_rerank+no_rerank"]


def test_failures_are_no_agreement(spark):
    kind = "config_id string, query_id long, status string, hedged boolean, answer string, reason string"
    answers = spark.createDataFrame([("baseline", 1, "grounded", False, None, None), ("v", 1, "grounded", False, None, None), ("baseline", 2, "grounded", False, "x", None), ("v", 2, "grounded", False, "x", None)], kind)
    cases = spark.createDataFrame([(1, "answerable", "x"), (2, "answerable", "x")], "query_id long, kind string, answer_key string")
    got = {(r.config_id, r.query_id): r.outcome for r in counterfactual.diffs(counterfactual.with_failures(answers, {"w": "bad"}, cases), cases).collect()}
    assert got == {("v", 1): "error", ("v", 2): "identical", ("w", 1): "error", ("w", 2): "error"}


def test_samples_and_percentiles(spark):
    df = spark.range(30).select(F.col("id").alias("case_id"), F.when(F.col("id") < 3, "a").otherwise("b").alias("kind"))
    got = calibrate.shared_sample(df, "kind", "case_id", 12).collect()
    assert len(got) == 12 and sum(r.kind == "a" for r in got) == 3
    assert calibrate.shared_sample(df, "kind", "case_id", 99).count() == 30


def test_command_line(spark, tmp_path, capsys):
    base = f"file://{tmp_path}"
    (tmp_path / "docs" / "tenant_a").mkdir(parents=True)
    (tmp_path / "docs" / "tenant_a" / "d.md").write_text("# Limits\n\nThe queue limit of the first gateway is forty two messages, and it was set by the owners of the module in the spring of that year.")
    assert cli.main(["ingest", f"{base}/docs", "--index", f"{base}/index"], spark) == 0
    files.write_testset(spark.createDataFrame([("c1", "tenant_a", "answerable", "what is the queue limit of the first gateway", "forty two", [])], files.TESTSET), f"{base}/cases")
    common = ["--index", f"{base}/index", "--testset", f"{base}/cases"]
    assert cli.main(["query", *common, "--out", f"{base}/traces"], spark) == 0
    assert "forty two" in files.read_traces(spark, f"{base}/traces").first().answer
    assert cli.main(["ablate", *common, "--out", f"{base}/diffs", "--ablations", "baseline", "no_gate"], spark) == 0
    assert cli.main(["schema"], spark) == 0 and "trace_id" in capsys.readouterr().out


def test_projection_equals_the_singular_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1] + 2
    kind = "vec_id long, embedding array<float>"
    vectors_ = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], kind)
    queries = spark.createDataFrame([(100, [float(v) for v in x[7]]), (101, [float(v) for v in x.mean(axis=0)])], kind)
    got = {r.vec_id: r for r in vectors.project(vectors_, queries=queries).collect()}
    x = x.astype(np.float32).astype(float)
    centred = x - x.mean(axis=0)
    _, size, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:3] * np.sign(axes[:3][np.arange(3), np.abs(axes[:3]).argmax(axis=1)])[:, None]
    points = centred @ axes.T
    points /= np.abs(points).max()
    assert np.allclose([got[i].point for i in range(60)], points, atol=1e-6)
    assert np.allclose(got[0].explained, (size**2 / (size**2).sum())[:3], atol=1e-6)
    assert np.allclose(got[100].point, got[7].point) and np.allclose(got[101].point, 0, atol=1e-6)


def test_a_follow_up_is_put_rewritten_unless_that_is_taken_away(spark):
    ship(spark)
    texts = ["The zorblax queue holds forty two messages before its owners hear of it in writing.", "The archive of the north is kept for ninety days and then given to the museum of the town."]
    chunks = spark.createDataFrame([(f"c{k}", "tenant_a", "d", k, t) for k, t in enumerate(texts)], "chunk_id string, tenant_id string, doc_id string, ordinal int, text string")
    asked = spark.createDataFrame([(1, "tenant_a", "and how many does it hold", "tell me about the zorblax queue"), (2, "tenant_a", "how long is the archive kept", None), (3, "tenant_a", "what about that", "")], "query_id long, tenant_id string, query string, previous string")
    e = engine.Engine(spark, chunks, asked)
    r = e.run(["no_gate", "no_gate+no_rewrite"])
    put = {(x.config_id, x.query_id): x.query for x in r["forms"].collect()}
    assert put["no_gate", 1] == "and how many does queue zorblax hold" and put["no_gate+no_rewrite", 1] == "and how many does it hold"
    assert put["no_gate", 2] == put["no_gate+no_rewrite", 2] and len(put) == 6
    first = {(x.config_id, x.query_id): x.chunk_id for x in r["ranked"].where("position = 1").collect()}
    assert first["no_gate", 1] == "c0" and first["no_gate", 2] == first["no_gate+no_rewrite", 2] == "c1"
    assert r["answers"].count() == 6 and "forty two" in next(x.answer for x in r["answers"].collect() if x.query_id == 1 and x.config_id == "no_gate")
    told = {(x.config_id, x.query_id): x.query for x in e.query(["no_gate"]).collect()}
    assert told["no_gate", 1].endswith("queue zorblax hold") and len(told) == 3

"""Anchored substring search, pruned top-k and the threshold against plain computations."""

import random

import pytest

from tracelens.operators import calibrate, pruned, retrieve, search
from tracelens.queries import Index

SF = "/root/testdata/sf0.001"


def found(spark, texts, patterns):
    t = spark.createDataFrame(list(texts), "k long, text string").repartition(3)
    p = spark.createDataFrame(list(patterns), "pattern_id long, pattern string").repartition(2)
    return sorted((r.k, r.pattern_id) for r in search.containing(t, p, ["k"]).collect()), search.containing(t, p, ["k"])


@pytest.mark.parametrize("seed", range(3))
def test_containing_equals_trying_each_pattern(spark, seed):
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "b", "xyz", "xyzzy", "é", "the", ".", "a.b", " "]
    gap = lambda: rng.choice([" ", " ", "  ", "\n", "\t "])
    make = lambda n: "".join(rng.choice(words) + gap() for _ in range(rng.randrange(n)))
    texts = [(i, make(12)) for i in range(60)] + [(100, None), (101, ""), (102, " "), (3, "xyz again"), (103, "q" * 5000 + " end")]
    patterns = []
    for i in range(80):
        source = rng.choice(texts)[1] or ""
        at = rng.randrange(len(source) + 1)
        patterns.append((i, source[at : at + rng.choice([0, 1, 2, 3, 5, 9, 20])] if rng.random() < 0.8 else make(4)))
    patterns += [(100, None), (101, ""), (102, " "), (103, "\n"), (104, "%_"), (5, "xyz"), (7, "ab"), (7, "ab")]
    want = sorted((k, i) for k, t in texts for i, p in patterns if t is not None and p is not None and p in t)
    assert found(spark, texts, patterns)[0] == want


def test_search_has_no_nested_loop(spark):
    texts, patterns = [(i, f"one two{i} three four") for i in range(200)], [(i, f"one two{i} three") for i in range(50)] + [(99, "wo7")]
    got, df = found(spark, texts, patterns)
    assert got == sorted((k, i) for k, t in texts for i, p in patterns if p in t)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert found(spark, texts, [])[0] == [] == found(spark, [], patterns)[0]


def test_hot_anchor_finds_all(spark):
    """Patterns of common words only, and one text a thousand times."""
    texts = [(i, "the cat of the house") for i in range(1000)] + [(2000, "of the house")]
    got, _ = found(spark, texts, [(1, "cat of the house"), (2, "of the"), (3, "the of the")])
    assert len(got) == 1000 + 1001 and {i for _, i in got} == {1, 2}


def rows(df):
    return sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k", [2, 20])
def test_pruned_legs_equal_full_ones(spark, k):
    i = Index.of(spark, SF)
    own, asked, weights = i.concepts
    assert rows(pruned.bm25(i.blocks, i.chunks, i.questions, k)) == rows(retrieve.bm25(i.chunks, i.questions, k, posted=i.postings))
    assert rows(pruned.concept_knn(i.chunks, i.questions, own, asked, weights, k)) == rows(retrieve.concept_knn(i.pairs(), k))


def test_pruned_leg_of_odd_collections(spark):
    """Ties, chunks without words, tenants without chunks, questions of unknown and of common words alone."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "rust", "lint", "cargo"]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([2, 7])]) for _ in range(n))
    chunks = [(f"c{i:03d}", f"tenant_{i % 3}", f"d{i}", 0, text(rng.randrange(1, 9))) for i in range(150)] + [("x", "tenant_0", "d", 0, ""), ("y", "tenant_global", "d", 0, "alpha lint")]
    c = spark.createDataFrame(chunks, "chunk_id string, tenant_id string, doc_id string, ordinal int, text string")
    q = spark.createDataFrame([(1, "tenant_0", "alpha"), (2, "tenant_1", text(9)), (3, "tenant_2", "unknown words"), (4, "tenant_9", "alpha lint cargo"), (5, "tenant_0", ""), (6, "tenant_0", "alpha alpha beta cargo")], "query_id long, tenant_id string, query string")
    posted = retrieve.postings(c)
    for size, k in ((1, 3), (7, 1), (1000, 20)):
        assert rows(pruned.bm25(pruned.blocks(posted, size), c, q, k)) == rows(retrieve.bm25(c, q, k, posted=posted))
    none = posted.where("false")
    assert rows(pruned.bm25(pruned.blocks(none), c, q)) == []


def test_fewer_entries_are_read(spark):
    """A rare word beside a common one: the common word's list gives no candidates."""
    chunks = [(f"c{i:04d}", "tenant_0", f"d{i}", 0, "common " + ("rareword " * 3 if i % 60 == 0 else "filler")) for i in range(3000)]
    c = spark.createDataFrame(chunks, "chunk_id string, tenant_id string, doc_id string, ordinal int, text string")
    q = spark.createDataFrame([(1, "tenant_0", "common rareword")], "query_id long, tenant_id string, query string")
    posted = retrieve.postings(c)
    stored = pruned.blocks(posted)
    assert stored.where("term = 'common'").count() > 10 and stored.agg({"n": "max"}).first()[0] < 400
    read = pruned.rows_read(stored, c, q).first()
    assert (read.listed, read.candidates_from) == (3050, 50)
    assert rows(pruned.bm25(stored, c, q)) == rows(retrieve.bm25(c, q, posted=posted))


def by_hand(pairs):
    from decimal import ROUND_HALF_EVEN, Decimal

    place = lambda x, q: x.quantize(Decimal(q), rounding=ROUND_HALF_EVEN)
    a, o = ([Decimal(str(s)) for k, s in pairs if k is x] for x in (True, False))
    if not a or not o:
        return None, None, None
    errors = lambda t: (sum(x < t for x in a) / len(a), sum(x >= t for x in o) / len(o))
    tried = sorted({place((x + y) / 2, "0.0001") for x in set(a) for y in set(o)})
    best = place(min(tried, key=lambda t: (round(max(errors(t)), 9), t)), "0.001")
    return float(best), *(round(e, 4) for e in errors(best))


@pytest.mark.parametrize("seed", range(8))
def test_threshold_equals_trying_each_candidate(spark, seed):
    rng = random.Random(seed)
    spread, places = rng.choice([0.0003, 0.2, 1.0, 40.0]), rng.choice([1, 3, 6])
    score = lambda up: round(max(0.0, rng.gauss(1.0 + up, 1) * spread), places)
    pairs = [(True, score(rng.choice([0, 0.5, 5]))) for _ in range(rng.choice([1, 5, 60]))] + [(False, score(0)) for _ in range(rng.choice([1, 5, 60]))]
    got = calibrate.threshold(spark.createDataFrame([*pairs, (None, 1.0), (True, None)], "answerable boolean, score double"), "g").first()
    assert (got.threshold, got.false_refusal, got.false_admit, got.name) == (*by_hand(pairs), "g")


def test_threshold_without_one_kind_is_null(spark):
    for pairs in ([], [(True, 1.0)], [(False, 1.0)]):
        got = calibrate.threshold(spark.createDataFrame(pairs, "answerable boolean, score double"))
        assert [tuple(r) for r in got.collect()] == [(None, None, None, "gate")]


def test_threshold_is_rounded_like_the_sql(spark):
    """A thousand times 0.5015 is just under 501.5 as a double, so the SQL's half-even rounding gives 0.501."""
    import duckdb

    got = calibrate.threshold(spark.createDataFrame([(True, 0.6015), (False, 0.4015)], "answerable boolean, score double")).first()
    assert got.threshold == duckdb.execute("SELECT round_even(round_even((0.6015::DOUBLE + 0.4015::DOUBLE) / 2, 4), 3)").fetchall()[0][0] == 0.501


@pytest.mark.parametrize("pairs", [[(True, 1.0)] * 57 + [(True, 3.0)] * 103 + [(False, 1.0)] * 25 + [(False, 3.0)] * 15, [(True, 46.03295), (False, 24.84995)], [(True, 39.0), (True, 78.9084), (False, 73.2265), (False, 76.1)]])
def test_gate_equals_its_sql_where_doubles_miss_ties(spark, pairs):
    """57 of 160 are 0.35625, which the SQL's product of doubles rounds to 0.3562, though the double itself is above; and midpoints
    that are ties at four places as decimals, but not as doubles."""
    import duckdb

    from tracelens.queries import SQL, _gate_sql

    con = duckdb.connect()
    con.execute("CREATE TABLE sc (answerable BOOLEAN, score DOUBLE)")
    con.executemany("INSERT INTO sc VALUES (?, ?)", [list(p) for p in pairs])
    parts, final = _gate_sql("lex_leg"), SQL["gate_calibration_lex_leg"]
    want = con.execute(f"WITH mid AS ({parts['mid'][0]}), err AS ({parts['err'][0]}) " + final[final.index("SELECT b.t AS") :]).fetchall()
    got = calibrate.threshold(spark.createDataFrame(pairs, "answerable boolean, score double"), "lex_leg")
    assert [tuple(r) for r in got.collect()] == want

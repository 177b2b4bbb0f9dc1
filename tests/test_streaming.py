import datetime as dt

from tracelens.operators import judge
from tracelens.streaming import events


def test_windows_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    kind = "event_id long, user_id long, event_type string, value double, ts timestamp"
    rows = [(i, i % 3, "ab"[i % 2], float(i), at(i % 50)) for i in range(200)]
    path = f"file://{tmp_path}/events"
    spark.createDataFrame(rows, kind).repartition(2).write.parquet(path)
    stream = events.windowed(events.read(spark, path, kind), late="2 hours")
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.window.start, r.event_type): (r.n, r.total) for r in spark.table("windows").collect()}
    want = {}
    for _, _, t, v, when in rows:
        key = (when.replace(minute=when.minute // 5 * 5), t)
        n, total = want.get(key, (0, 0.0))
        want[key] = n + 1, total + v
    assert got == want


def test_replay_ends_with_the_answer(spark):
    kind = "config_id string, query_id long, answer string, candidates array<struct<chunk_id:string>>"
    traces = spark.createDataFrame([("b", 1, "yes", [("c1",), ("c2",)]), ("b", 2, "no", [])], kind)
    told = events.replay(traces)
    got = [(r.query_id, r.type, r.payload) for r in told.orderBy("query_id", "seq").collect()]
    assert got == [(1, "candidate", "c1"), (1, "candidate", "c2"), (1, "done", "yes"), (2, "done", "no")]
    last = {r.query_id: r.payload for r in judge.latest(told, ["query_id"], ["seq"], ["payload"]).collect()}
    assert last == {1: "yes", 2: "no"}


def test_rollup_knows_what_is_acknowledged(spark):
    found = spark.createDataFrame([("s", "a", False, 3), ("s", "b", True, 0), ("s", "c", False, 2)], "suite string, case_id string, passed boolean, severity int")
    known = spark.createDataFrame([("s", "a")], "suite string, case_id string")
    assert tuple(judge.rollup(found).first()) == ("s", 3, 1, 3, 1)
    assert tuple(judge.rollup(found, known).first()) == ("s", 3, 1, 2, 0)

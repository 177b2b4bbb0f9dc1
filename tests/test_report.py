import pytest
from pyspark.sql import functions as F

from tracelens.operators import counterfactual, judge
from tracelens.plans import report


def test_table_and_guards(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, n int")
    assert report.table(df, "T") == "## T\n\n| k | n |\n|-|-|\n| a | 1 |\n| b |  |\n"
    with pytest.raises(ValueError):
        report.table(spark.range(report.MOST_ROWS + 1), "big")
    same = dict.fromkeys(report.COMPARED, "x")
    report.assert_comparable(same, same | {"rerank": "none"})
    with pytest.raises(ValueError, match="corpus"):
        report.assert_comparable(same, same | {"corpus": "y"})
    assert report.exit_code(0, 0) == 0 and report.exit_code(1, 0) == 1


def test_two_way_and_example(spark):
    v = spark.createDataFrame([("a", "a"), ("a", "b")], "x string, y string").select(judge.two_way(F.col("x"), F.col("y")).alias("v"))
    assert [r.v for r in v.collect()] == ["a", "unstable"]
    d = spark.createDataFrame([("v", 1, "now_confident_wrong"), ("v", 2, "now_confident_wrong"), ("w", 1, "identical")], "config_id string, query_id long, outcome string")
    deltas = spark.createDataFrame([("v", 1, "c", 0), ("v", 2, "c", 999)], "config_id string, query_id long, chunk_id string, rank_delta int")
    assert counterfactual.worked_example(d, deltas).first()["query_id"] == 2

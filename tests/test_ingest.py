import pytest

from tracelens.operators import ingest
from tracelens.sources import files, fixtures


def test_fences_are_no_headings_and_stay_whole():
    md = "# A\n\nintro " + "word " * 60 + "\n\n```\n# not a heading\n\ncode\n```\n\n## B\n\n" + "text " * 60
    got = ingest.pieces(md)
    assert [p for p, _ in got] == [["A"], ["A", "B"]]
    assert all(t.count("```") % 2 == 0 for _, t in got) and "# not a heading" in got[0][1]


def test_short_sections_join_the_next_and_the_last_joins_the_one_before():
    md = "# A\n\nshort\n\n# B\n\n" + "long " * 60 + "\n\n# C\n\ntail"
    assert [(p, t.split()[0], t.split()[-1]) for p, t in ingest.pieces(md)] == [(["B"], "short", "tail")]
    assert ingest.pieces("") == [] and ingest.pieces("# only") == []


def test_long_sections_are_cut_with_an_overlap():
    blocks = [f"b{i} " + "w" * 396 for i in range(20)]
    got = [t for _, t in ingest.pieces("\n\n".join(blocks), target=200, least=1, overlap=110)]
    assert all(len(t) // 4 <= 320 for t in got)
    assert all(a.split("\n\n")[-1] == b.split("\n\n")[0] for a, b in zip(got, got[1:], strict=False))


def test_chunks_and_version_do_not_depend_on_order(spark):
    rows = [("t", "a", "l1\nl2\n\nl3\nl4\nl5"), ("t", "b", None), ("u", "a", "x")]
    docs = spark.createDataFrame(rows, "tenant_id string, doc_id string, text string")
    got = {(r.doc_id, r.tenant_id, r.ordinal): r.text for r in fixtures.chunks(docs).collect()}
    assert got == {("a", "t", 0): "l1\nl2\nl3\nl4", ("a", "t", 1): "l5", ("a", "u", 0): "x"}
    back = spark.createDataFrame(rows[::-1], docs.schema)
    assert ingest.corpus_version(docs).first() == ingest.corpus_version(back).first()


def test_vocabulary_follows_synonym_chains(spark):
    words = spark.createDataFrame([(w,) for w in ["standby", "replica", "replication", "err_4021", "err_4022", "turn-off", "limits"]], "token string")
    got = {r.token: r.concept for r in ingest.vocabulary(words).collect()}
    assert got["standby"] == got["replica"] == got["replication"]
    assert got["err_4021"] == got["err_4022"] == "id:err_#"
    assert got["turn-off"] == "disable" and got["limits"] == "limit"


def test_incremental_and_duplicates(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    had = spark.createDataFrame([("a", "m"), ("b", "old")], "chunk_id string, model_id string")
    reused, todo = ingest.incremental(chunks, had, "m")
    assert [r.chunk_id for r in reused.collect()] == ["a"] and [r.chunk_id for r in todo.collect()] == ["b"]
    twice = spark.createDataFrame([("t", "a"), ("t", "a")], "tenant_id string, doc_id string")
    with pytest.raises(Exception, match="duplicate document"):
        ingest.guard_duplicates(twice).collect()


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "ten" / "sub").mkdir(parents=True)
    (tmp_path / "ten" / "sub" / "d.md").write_text("# x")
    got = files.markdown_tree(spark, str(tmp_path)).collect()
    assert [(r.tenant_id, r.doc_id, r.markdown) for r in got] == [("ten", "sub/d", "# x")]

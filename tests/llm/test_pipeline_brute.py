"""The pipeline's stages on rows of their own, each against a plain computation on that stage's input."""

import hashlib
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tracelens.llm import quality_pu
from tracelens.session import ship

from .test_brute import kept_lines

KINDS = "doc_id long, text string, lang string, source string, n_chars long, extra int"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
GOOD = "The quiet river runs by the old stone house and nobody knows when it was built, but the garden is kept."


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Nulls, empties, repeats, ties, near copies, shared lines and benchmark passages."""
    ship(spark)
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    own = lambda i: chr(97 + i % 26) + chr(97 + i // 26)

    def make(i: int, each: int = 9) -> str:
        """Words that mostly no other number has, in lines of `each` words."""
        w = [f"{x}{'' if (i + k) % 3 else own(i)}" for k, x in enumerate((GOOD * 3).split())]
        return "\n".join(" ".join(w[k : k + each]) for k in range(0, len(w), each))

    texts = {i: make(i) for i in range(40)}
    # the same words in other lines, with one word changed, and in capitals
    texts |= {100: make(3, 7), 101: make(3, 11).replace("house", "barn", 1), 102: None, 103: "", 104: "  \n ", 105: make(7, 8).upper(), 106: make(3)}
    texts |= {110: make(50) + "\nShared line of the whole site 12\n" + make(51), 111: make(52) + "\nShared line of the whole site 99\nmore", 112: "Shared line of the whole site 7"}
    item = "an item of the benchmark that no one should ever see in a training set"
    texts |= {120: make(60) + " " + item + " " + make(61), 121: item}
    texts |= {i: "$$$ BUY NOW 777 !!! " * (i % 4 + 2) for i in range(200, 230)}
    rows = [(i, t, "en", "s", None if t is None else len(t), 5) for i, t in texts.items()]
    rows += [rows[2], rows[2]]
    spark.createDataFrame(rows, KINDS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 200), 0) for i in texts if i % 2 == 0] + [(None, 1, 0), (3, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_equals_a_plain_computation(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = (before, docs.collect())
        if i < 4:
            assert docs.columns == COLUMNS
    before, after = seen["quality_classifier"]
    model = quality_pu.train(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet"))
    import numpy as np

    good = [r for r in before if model.score(np.array([quality_pu.statistics(r.text or "")]))[0] >= 0.5]
    assert sorted(map(str, ([getattr(r, c) for c in COLUMNS] for r in good))) == sorted(str(list(r)) for r in after)
    assert {r.doc_id for r in after} >= set(range(40)) and not {r.doc_id for r in after} & set(range(200, 230))
    before, after = seen["line_dedup"]
    texts = {r.doc_id: r.text for r in before}
    want = kept_lines(texts)
    want = {i: t for i, t in want.items() if t == texts[i] or t.strip()}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars is None or r.n_chars == len(r.text) for r in after)
    before, after = seen["ngram_jaccard_join"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in after} == {find(i) for i in sets} and len(sets) > len({find(i) for i in sets})
    before, after = seen["benchmark_decontamination"]
    item = "an item of the benchmark that no one should ever see in a training set".split()
    holds = lambda t: sum(" ".join(item[k : k + 5]) in " ".join(re.findall(r"[^\W_]+", (t or "").lower())) for k in range(len(item) - 4)) >= 0.75 * (len(item) - 4)
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not holds(r.text)} and len(after) < len(before)
    before, after = seen["bpe_encoding"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    plain = []
    for r in before:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        plain.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(plain) == sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after)
    assert sorted(map(tuple, corpus_pipeline.run(spark, tables).collect())) == sorted(map(tuple, seen["bpe_encoding"][1]))


def test_stages_take_empty_tables(spark, tables):
    none = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, tables).count() == 0

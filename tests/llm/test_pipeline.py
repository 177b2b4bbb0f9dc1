import re
import zlib

import corpus_pipeline
from tracelens.llm import decontaminate, quality_pu

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        kept.append((before, after))
        if i < 4:
            assert docs.columns == COLUMNS and all(r.n_chars == len(r.text) for r in after.values())
    quality, lines, near, clean, _ = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in quality[0] if labels.get(i) == 1 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(i in quality[1] for i in good) >= 0.9 * len(good)
    sets = {}
    for i, r in sorted(near[0].items()):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    for i in near[1]:
        for j in near[1]:
            assert i >= j or not sets[i] or 100 * len(sets[i] & sets[j]) < 75 * len(sets[i] | sets[j])
    for i in set(near[0]) - set(near[1]):
        assert any(j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in near[0]) or any(sets[i] & sets[j] for j in near[0] if j != i)
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in clean[1].values():
        text = " ".join(re.findall(r"[^\W_]+", r.text.lower()))
        assert not any(" ".join(w) in text for w in items)


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe_encoding"]
    assert quality_pu.MOST_POSITIVE and decontaminate.WORDS == 5

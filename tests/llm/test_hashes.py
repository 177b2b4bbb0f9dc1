"""Inputs for which sums of powers collide, whatever the base: the Thue-Morse word over two letters, and that word with the letters swapped."""

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracelens.llm import bpe_automaton, ngram_join, rlz, token_pack
from tracelens.llm.presplit import PieceTable, encode
from tracelens.llm.wordhash import runs, same_spans, span_hashes, words
from tracelens.session import ship


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


PAIRS = [(thue_morse(n, "a", "b"), thue_morse(n, "b", "a")) for n in (1024, 2048)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoders_tell_them_apart(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    own = (token_pack.Encoder if name.startswith("byte") else bpe_automaton.WordTokenizer)(open(path, encoding="utf-8").read())
    texts = [x for pair in PAIRS for x in pair] * 2
    assert [ids.tolist() for ids in own.texts(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("pair", PAIRS)
def test_operators_tell_them_apart(spark, pair):
    ship(spark)
    rest = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{pair[0]} {rest}"), (2, f"{pair[1]} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in rlz.dedup_substrings(docs).collect()} == {1: 0, 2: 0}
    docs = spark.createDataFrame([(1, pair[0]), (2, pair[1]), (3, " ".join(pair[0])), (4, " ".join(pair[1]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.link_components(docs).collect()}.keys() == {1, 2, 3, 4}
    got = {r.doc_id: (r.component_id, r.class_id) for r in ngram_join.link_components(docs.where("doc_id < 3")).collect()}
    assert got == {1: (1, 1), 2: (2, 2)}


def test_runs_of_words_tell_them_apart():
    for pair in PAIRS:
        a, b = (words(pa.array([" ".join(x)]), False) for x in pair)
        assert runs(a.hash, len(pair[0])) != runs(b.hash, len(pair[0]))
    w = words(pa.array([" ".join(map(str, range(200)))]), False)
    for k in (1, 5, 16, 50):
        assert len(np.unique(runs(w.hash, k))) == 200 - k + 1
    again = words(pa.array(["x y 7 8 9 10 11 z"]), False)
    assert runs(again.hash, 5)[2] == runs(w.hash, 5)[7]


def test_words_and_their_hashes():
    texts = ["", None, " a bb\tccc\n", "é ü 你好世界你好世界 " + "q" * 700 + " " + "q" * 699, "a bb " + "12345678 123456789 1234567 1234567812345678"]
    w = words(pa.array(texts), False)
    plain = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    assert [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)] == [x for p in plain for x in p]
    named = dict(zip(w.hash.tolist(), (x for p in plain for x in p), strict=True))
    assert len(named) == len({x for p in plain for x in p})
    like = np.array([next(j for j in range(len(w.hash)) if w.hash[j] == h) for h in w.hash])
    assert same_spans(w.data, w.start, w.end, like).all()
    assert same_spans(w.data, w.start, w.end, np.zeros(len(like), np.int64)).sum() == sum(x == b"a" for p in plain for x in p)
    assert words(pa.array(["ABC é"]), True).hash.tolist() == words(pa.array(["abc é"]), True).hash.tolist()


def test_pieces_of_one_hash_keep_their_ids(monkeypatch):
    from tracelens.llm import presplit

    monkeypatch.setattr(presplit, "span_hashes", lambda data, a, b: span_hashes(data, a, b) % np.uint64(3))
    table = PieceTable(lambda pieces: [[ord(c) for c in p] for p in pieces], 10)
    for texts in (["one two three", "four é five six"], ["seven one", "two 你 é", ""]):
        assert ["".join(map(chr, ids)) for ids in encode(texts, True, table)] == texts

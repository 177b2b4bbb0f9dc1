"""BPE encoding and decoding with an automaton compiled from the merge list.

The automaton reads arcs labelled by tokens. It begins as one state with an arc to itself for each symbol. Merges are applied one
by one, in priority order, each as a gadget: where an arc u is followed by an arc v, the target of the arcs u is copied into a
new state without the arc v, the arcs u now lead to that, and beside them arcs uv lead where v did. A sequence of arcs is then a
path exactly if it is what byte-pair encoding makes of the text it spells, and every text has one path.

All arcs with one label lead to one state, so a state is what its arcs' label lacks. A closed arc stays closed for those made
from it later (uv gets an arc only beside u), so tokens are numbered such that those made from a token's left end stand together
in the order of their merges, the token itself after them: each merge then closes one interval of numbers. The compiled table
holds, for each state, its closed intervals: those of its own merges, and those that the state it was copied from had by then.
All states' intervals stand in two sorted arrays; a transition is one binary search in them.

Pre-split words are encoded from left to right by the tables alone: from each reached position, the arcs that spell what follows
are read off a trie, and those with a transition from the state there reach their ends. One arc reaches each position, so the
word's path is read back from its end. Decoding emits the labels of the arcs.

Only files of the kind described (see `WordTokenizer`) are taken; others raise. Null or empty text: no ids, and the empty text
decoded. Null ids of rows pass through, repeated rows are rows of their own, an empty table gives an empty one. Very long texts
are encoded one at a time, and so are very long unbroken words, in linear time: 1 MB of letters takes some ten seconds. There are no ties: a text has one path. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import slices, texts_of, trim
from .presplit import UNKNOWN, PieceTable, classes, code_points, encode

#: Words whose ids a worker holds; words that step through the tables together; symbols that a key has room for; symbols from
#: which on a word steps alone, and of which its arcs are looked up at a time.
MOST_WORDS, TOGETHER, SYMBOLS, LONG, BLOCK = 120_000, 8192, 1024, 1024, 1 << 16


def byte_labels() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Automaton:
    """The compiled tables: trie (node and symbol to node), arc (token at a node), number (of a token), closed_from and
    closed_to (state and number, as one integer, of the closed intervals of all states)."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = "</w>"):
        self.end, self.labels = end, {i: t for t, i in vocab.items()}
        self.n = max(vocab.values()) + 1
        pairs = [tuple(vocab[x] for x in (pair if isinstance(pair, list | tuple) else pair.split(" "))) for pair in merges]
        self._number(vocab, pairs)
        self._compile(vocab, pairs)
        self._trie(vocab)
        del self.made, self.first, self.joined, self.number  # only the tables are kept

    def _number(self, vocab: dict[str, int], pairs: list[tuple[int, int]]) -> None:
        """Numbers tokens so that those whose left end is a token come before it, in the order of their merges; made[v] lists
        the merges with v at their left, first[v] the number with which each of their tokens' own run begins."""
        made: list[list[int]] = [[] for _ in range(self.n)]
        self.joined = [vocab[self.labels[u] + self.labels[v]] for u, v in pairs]
        if len(set(self.joined)) < len(self.joined):
            raise ValueError("two merges make one token")
        for rank, (u, _) in enumerate(pairs):
            made[u].append(rank)
        whole = set(self.joined)
        self.number, self.first = [0] * self.n, [[] for _ in range(self.n)]
        now = 0
        for token in sorted(set(vocab.values()) - whole):
            stack = [(token, 0)]
            while stack:
                x, k = stack.pop()
                if k < len(made[x]):
                    self.first[x].append(now)
                    stack += [(x, k + 1), (self.joined[made[x][k]], 0)]
                else:
                    self.number[x] = now
                    now += 1
        self.made = made

    def _closes(self, v: int, rank: int) -> tuple[int, int]:
        """The interval that leaves a state at merge `rank` with the arc v: v, and what is made from its left end from then on."""
        later = bisect_left(self.made[v], rank)
        return (self.first[v][later] if later < len(self.made[v]) else self.number[v]), self.number[v]

    def _compile(self, vocab: dict[str, int], pairs: list[tuple[int, int]]) -> None:
        """Applies the merges one by one; a state is (the state it was copied from, the interval closed then), 0 the first."""
        parent, closed = [0], [(0, -1)]
        target = [0] * self.n  # the state that arcs with a label lead to
        self.dead: set[int] = set()
        for rank, ((u, v), uv) in enumerate(zip(pairs, self.joined, strict=True)):
            state, at = target[u], self.number[v]
            while state and not closed[state][0] <= at <= closed[state][1]:
                state = parent[state]
            if state or u in self.dead or v in self.dead:
                self.dead.add(uv)  # no arc u is followed by an arc v here any more: this merge adds nothing
                continue
            target[uv] = target[v]
            parent.append(target[u])
            closed.append(self._closes(v, rank))
            target[u] = len(parent) - 1
        starts, ends = array("q"), array("q")  # lists of as many integers would take five times the memory
        for label in set(vocab.values()) - self.dead:
            state, base = target[label], label * self.n
            while state:
                a, b = closed[state]
                starts.append(base + a)
                ends.append(base + b)
                state = parent[state]
        order = np.argsort(np.array(starts, np.int64), kind="stable")
        self.closed_from = np.array(starts, np.int64)[order]
        self.closed_to = np.maximum.accumulate(np.array(ends, np.int64)[order]) if len(ends) else np.zeros(0, np.int64)
        self.states = len(parent)

    def _trie(self, vocab: dict[str, int]) -> None:
        """node_key (node and symbol, ascending), node_next: the trie's transitions; arc: the token that ends at a node, or -1."""
        self.symbol: dict[str, int] = {}
        steps: dict[int, int] = {}
        arc = [-1]
        for text, i in vocab.items():
            if i in self.dead:
                continue
            node = 0
            for s in self.symbols_of(text):
                s = self.symbol.setdefault(s, len(self.symbol))
                node = steps.setdefault(node * SYMBOLS + s, len(arc))
                if node == len(arc):
                    arc.append(-1)
            arc[node] = i
        if len(self.symbol) > SYMBOLS:
            raise ValueError("too many symbols")
        keys = np.array(list(steps), np.int64)
        order = np.argsort(keys)
        self.node_key, self.node_next = keys[order], np.array(list(steps.values()), np.int64)[order]
        self.arc, self.places = np.array(arc, np.int64), np.array(self.number, np.int64)

    def symbols_of(self, text: str) -> list[str]:
        if text.endswith(self.end) and len(text) > len(self.end):
            text = text[: -len(self.end)]
            return [*text[:-1], text[-1] + self.end]
        return list(text)

    def steps(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the states that arcs x lead to have the arcs y."""
        key = x * self.n + self.places[y]
        at = np.searchsorted(self.closed_from, key, "right") - 1
        return (at < 0) | (self.closed_to[at] < key) if len(self.closed_to) else np.ones(len(x), dtype=bool)

    def _follow(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The trie's next nodes, -1 where there is none."""
        key = node * SYMBOLS + symbol
        at = np.minimum(np.searchsorted(self.node_key, key), len(self.node_key) - 1)
        return np.where(self.node_key[at] == key, self.node_next[at], -1)

    def encode_all(self, codes: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Tokens of words given as rows of symbols, of `size` symbols each: all words step through the tables together."""
        n, most = codes.shape
        state, back = np.full((n, most + 1), -1, np.int64), np.zeros((n, most + 1), np.int64)
        for i in range(most):
            row = np.flatnonzero((size > i) & ((state[:, i] >= 0) | (i == 0)))
            node = np.zeros(len(row), np.int64)
            for j in range(i, most):
                node = self._follow(node, codes[row, j])
                row, node = row[node >= 0], node[node >= 0]
                to = self.arc[node]
                ends = np.flatnonzero(to >= 0)
                if i:
                    ends = ends[self.steps(state[row[ends], i], to[ends])]
                state[row[ends], j + 1], back[row[ends], j + 1] = to[ends], i
                on = size[row] > j + 1
                row, node = row[on], node[on]
                if not len(row):
                    break
        at, rows, out = size.copy(), np.arange(n), []
        if (state[rows, size] < 0).any():
            raise ValueError("no path")
        while at.any():  # paths are read back from the words' ends
            out.append(np.where(at > 0, state[rows, at], -1))
            at = np.where(at > 0, back[rows, at], 0)
        path = np.array(out[::-1]).reshape(len(out), n).T
        return [x[x >= 0] for x in path]

    @cached_property
    def _closed(self) -> tuple[array, array]:
        return array("q", self.closed_from.tobytes()), array("q", self.closed_to.tobytes())

    def encode_long(self, codes: np.ndarray) -> np.ndarray:
        """Tokens of one long word: the arcs at all places of a block are read off the trie together, then taken in order."""
        n, (closed_from, closed_to), places = len(codes), self._closed, self.places
        state, back = array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1)
        for begin in range(0, n, BLOCK):
            at = np.arange(begin, min(n, begin + BLOCK))
            node, found, j = np.zeros(len(at), np.int64), [], 0
            while len(at):
                node = self._follow(node, codes[at + j])
                at, node = at[node >= 0], node[node >= 0]
                j += 1
                to = self.arc[node]
                ends = np.flatnonzero(to >= 0)
                found.append(np.stack([at[ends], np.full(len(ends), j), to[ends], places[to[ends]]]))
                on = at + j < n
                at, node = at[on], node[on]
            arcs = np.concatenate(found, axis=1)
            arcs = arcs[:, np.argsort(arcs[0], kind="stable")]
            for i, size, token, place in zip(*arcs.tolist(), strict=True):
                if i:
                    if state[i] < 0:
                        continue
                    key = state[i] * self.n + place
                    k = bisect_right(closed_from, key) - 1
                    if k >= 0 and closed_to[k] >= key:
                        continue
                state[i + size], back[i + size] = token, i
        if n and state[n] < 0:
            raise ValueError("no path")
        out, at = [], n
        while at:
            out.append(state[at])
            at = back[at]
        return np.array(out[::-1], np.int64)

    def encode(self, symbols: list[str]) -> list[int]:
        codes = np.array([[self.symbol[s] for s in symbols]], np.int64)
        return self.encode_all(codes, np.array([len(symbols)]))[0].tolist() if symbols else []


class WordTokenizer:
    """A tokenizer file with NFC, lower-casing, word ends and byte labels, through the automaton; another kind of file raises."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        self._check(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.automaton = Automaton(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        self.automaton.labels.update({i: t for t, i in self.special.items()})
        self.label_of = self.automaton.labels.__getitem__
        self.bytes = byte_labels()
        self.byte_of = {c: b for b, c in enumerate(self.bytes)}
        self.file_text = file_text
        self.table = PieceTable(self._words, MOST_WORDS)
        symbol = self.automaton.symbol
        self.inner = np.array([symbol.get(c, -1) for c in self.bytes], np.int64)
        self.last = np.array([symbol.get(c + self.automaton.end, -1) for c in self.bytes], np.int64)
        # what only the library normalises and splits: combining marks, what composes or changes under NFC, and unassigned characters
        self.odd = classes() == UNKNOWN
        for c in range(0x80, 0x110000):
            if unicodedata.combining(chr(c)) or unicodedata.normalize("NFC", chr(c)) != chr(c) or 0x1100 <= c < 0x1200:
                self.odd[c] = True

    @cached_property
    def library(self) -> Tokenizer:
        """For its normalising and splitting; made when a text needs it."""
        return Tokenizer.from_str(self.file_text)

    @staticmethod
    def _check(spec: dict) -> None:
        model, split = spec["model"], {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        normal = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        kind = {
            "normalizer": spec["normalizer"] == {"type": "Sequence", "normalizers": normal},
            "pre_tokenizer": [p.get("type") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and spec["pre_tokenizer"]["pretokenizers"][0] == {"type": "Split", "pattern": split, "behavior": "Removed", "invert": True}
            and not spec["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"]
            and not spec["pre_tokenizer"]["pretokenizers"][1]["use_regex"],
            "decoder": spec["decoder"] is None,
            "model": model["type"] == "BPE" and bool(model["end_of_word_suffix"]) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")),
            "added_tokens": not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
        }
        if wrong := [k for k, right in kind.items() if not right]:
            raise ValueError(f"no tokenizer file of this operator's kind: {', '.join(wrong)}")

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words, those of like length together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        data = [w.encode("utf-8", "surrogateescape") for w in words]
        order = sorted(range(len(words)), key=lambda i: len(data[i]))
        while order:
            longest = len(data[order[-1]])
            if longest > LONG:
                i = order.pop()
                code = self.inner[np.frombuffer(data[i], np.uint8)]
                code[-1] = self.last[data[i][-1]]
                out[i] = self.automaton.encode_long(code)
                continue
            take = max(1, min(TOGETHER, (TOGETHER * 32) // max(1, longest)))
            some, order = order[-take:], order[:-take]
            size = np.array([len(data[i]) for i in some], np.int64)
            flat = np.frombuffer(b"".join([data[i] for i in some]), np.uint8)
            codes = np.zeros((len(some), longest), np.int64)
            codes[np.arange(longest) < size[:, None]] = self.inner[flat]
            ends = np.cumsum(size) - 1
            codes[np.arange(len(some))[size > 0], size[size > 0] - 1] = self.last[flat[ends[size > 0]]]
            for i, ids in zip(some, self.automaton.encode_all(codes, size), strict=True):
                out[i] = ids
        return out

    def _by_library(self, text: str) -> list[int]:
        """The library's own normalising and splitting, and only those; special tokens are cut out first."""
        out, at = [], 0
        for m in [*self.cut.finditer(text), None]:
            part = self.library.normalizer.normalize_str(text[at : m.start() if m else len(text)])
            words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
            labelled = [bytes(map(self.byte_of.__getitem__, w)).decode("utf-8", "surrogateescape") for w in words]
            out += [i for ids in self._words(labelled) for i in ids.tolist()]
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Words go through the automaton once while they are held."""
        plain, whole = [], []
        for t in texts:
            odd = bool(self.cut.search(t))
            if not odd and not t.isascii():
                odd = bool(self.odd[code_points(t)].any())
                t = t if odd else t.replace("Σ", "σ")  # a final sigma is no special case here
            whole.append(odd)
            if not odd:
                plain.append(t.lower())
        done = iter(encode(plain, False, self.table))
        return [np.array(self._by_library(t), "<i4") if odd else next(done) for t, odd in zip(texts, whole, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The arcs' labels, joined by one space: as a file of this kind, which names no decoder, is decoded."""
        return " ".join(map(self.label_of, ids.tolist()))


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(file_text: str) -> WordTokenizer:
    key = hashlib.sha256(file_text.encode()).hexdigest()
    if key not in _tokenizers:
        _tokenizers[key] = WordTokenizer(file_text)
        trim()
    return _tokenizers[key]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, "<i4"), pa.int32()))


def encode_decode(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string, from docs(doc_id, text). The file is read on the driver and broadcast."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(shared.value)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids = tok.texts(texts_of(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids), pa.array([tok.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, decoded, from encoded(doc_id, ids); null ids: the empty text."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([tok.decode(np.array(ids or [], "<i4")) for ids in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded string")


def digest(result: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return result.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


def public_file(spark: SparkSession, name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

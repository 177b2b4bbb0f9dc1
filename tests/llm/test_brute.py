"""Operators against plain computations, and the cases that each one defines: nulls, ties, repeats, long texts, clashing names."""

import hashlib
import html
import math
import random
import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash

from tracelens.llm import bpe_automaton, common, decontaminate, html_density, line_templates, ngram_join, quality_pu, rlz, secrets, spotsigs, token_pack
from tracelens.session import ship

KINDS = "doc_id int, text string, `Gone_0` string, N_LINES long, __gone int"


def frame(spark, texts: dict):
    ship(spark)
    return spark.createDataFrame([(i, t, "x", 7, 1) for i, t in texts.items()], KINDS).repartition(3)


# Line templates


def kept_lines(texts: dict[int, str | None], min_docs=2, min_tokens=3, depth=3, similarity=0.8, word_docs=8, word_values=4) -> dict[int, str | None]:
    """Templates line by line, each compared with every template of its leaf."""
    holders: dict[str, set] = {}
    leaf_of: dict[str, str] = {}
    variable = re.compile(r"[0-9@]|://")

    def form(raw: str) -> str | None:
        tokens = raw.split()
        if not tokens:
            return None
        if len(tokens) >= min_tokens:
            tokens = ["<*>" if variable.search(t) else t for t in tokens]
        line = " ".join(tokens)
        leaf_of[line] = f"= {line}" if len(tokens) < min_tokens else f"{len(tokens)} {' '.join(tokens[:depth])}"
        return line

    for i, t in texts.items():
        for raw in (t or "").split("\n"):
            if (x := form(raw)) is not None:
                holders.setdefault(x, set()).add(i)
    signed = lambda x: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh3_64_intdigest(x))
    leaves: dict[str, list] = {}
    for x in sorted(holders, key=lambda x: (-len(holders[x]), signed(x))):
        leaves.setdefault(leaf_of[x], []).append(x)
    first: dict[str, int] = {}
    for lines in leaves.values():
        templates: list[list] = []
        for x in lines:
            tokens = x.split(" ")
            same = [sum(map(str.__eq__, t[0], tokens)) for t in templates]
            best = max(range(len(same)), key=lambda k: (same[k], -k), default=None)
            if best is None or same[best] < similarity * len(tokens):
                templates.append([tokens, [x]])
            else:
                t = templates[best]
                t[0] = [a if a == b else "<*>" for a, b in zip(t[0], tokens, strict=True)]
                t[1].append(x)
        merged: dict[str, list] = {}
        for t, members in templates:
            merged.setdefault(" ".join(t), []).extend(members)
        for members in merged.values():
            first |= {x: min(holders[x]) for x in members if len(holders[x]) >= min_docs}
            starts = {min(holders[x]) for x in members}
            values = [set(column) for column in zip(*(x.split(" ") for x in members), strict=True)]
            if len(members) > 1 and len(starts) >= max(word_docs, min_docs) and all(len(v) == 1 or len(v - {"<*>"}) >= word_values for v in values):
                first |= dict.fromkeys(members, min(starts))
    out = {}
    for i, t in texts.items():
        out[i] = None if t is None else "\n".join(raw for raw in t.split("\n") if (x := form(raw)) is None or first.get(x, i) == i)
    return out


@pytest.mark.parametrize(("min_docs", "evidence"), [(2, {}), (4, {}), (2, {"word_docs": 3, "word_values": 2})])
def test_line_templates_equal_brute_force(spark, min_docs, evidence):
    rng = random.Random(min_docs)
    words = ["the", "page", "of", "all", "sites", "now", "ends", "12", "a@b", "see", "http://x"]
    line = lambda: " ".join(rng.choice(words[: rng.choice([3, 5, 11])]) for _ in range(rng.choice([1, 2, 3, 5, 6, 6, 6, 10, 10])))
    pool = [line() for _ in range(120)] + ["", "  ", "\t"]
    texts: dict[int, str | None] = {i: "\n".join(rng.choice(pool) if rng.random() < 0.7 else line() for _ in range(rng.randrange(1, 9))) for i in range(60)}
    texts |= {100: None, 101: "", 102: texts[3], 103: "one line " * 60000}
    got = {r.doc_id: r for r in line_templates.drop_recurring(frame(spark, texts), min_docs=min_docs, **evidence).collect()}
    want = kept_lines(texts, min_docs, **evidence)
    assert {i: r.text for i, r in got.items()} == want
    assert got[5]["Gone_0"] == "x" and got[5]["__gone"] == 1 and [c for c in got[5].__fields__ if c.lower() == "n_lines"] == ["n_lines"]
    assert sum(len(texts[i] or "") for i in texts) > sum(len(t or "") for t in want.values())


def test_a_common_leaf_is_not_compared_line_by_line():
    rng = random.Random(2)
    lines = sorted({"a b c " + " ".join(f"{x}{rng.randrange(3000)}" for x in "pqrstuv") for _ in range(4000)})
    rows = [(i, x, 1, i) for i, x in enumerate(lines)]
    asked = 0
    plain = line_templates._Index.like

    def counted(self, tokens):
        nonlocal asked
        out = plain(self, tokens)
        asked += len(out)
        return out

    line_templates._Index.like = counted
    try:
        line_templates.grow(rows, 0.8, 3)
    finally:
        line_templates._Index.like = plain
    assert asked < 40 * len(rows)


# Secrets


def test_the_ledger_is_read_and_nothing_is_scanned_twice(spark, tmp_path):
    ship(spark)
    path = f"file://{tmp_path}/ledger"
    key = "ghp_" + "Z1" * 18
    rows = [(1, "token=abcdefghij"), (2, "token=abcdefghij"), (None, "secret: 12345678"), (None, "secret: 12345678"), (4, f"see {key} -----BEGIN RSA PRIVATE KEY-----"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    paths, ledger = secrets.update(docs, path)
    found = secrets.digest(secrets.findings(paths, ledger, secrets.RULES)).collect()
    assert len(found) == len(rows) and sorted(r.n_assign for r in found if r.doc_id is None) == [1, 1]
    four = next(r for r in found if r.doc_id == 4)
    assert four.spans == f"github:4:{4 + len(key)},private_key:{5 + len(key)}:{5 + len(key) + 31}" and four.base_sha256 == hashlib.sha256(b"").hexdigest()
    n = ledger.count()
    assert n >= 4 * len(secrets.RULES)
    _, again = secrets.update(docs.union(docs.where("doc_id = 1").selectExpr("9L", "text")), path)
    assert again.count() == n
    raised = (secrets.Rule("hex", 2, "[0-9a-f]{40,}", 0, 40), *secrets.RULES[:2])
    _, more = secrets.update(docs.union(spark.createDataFrame([(7, "new")], docs.schema)), path, raised)
    blobs = more.select("blob").distinct().count()
    assert more.where("rule = 'hex' and version = 2").select("blob").distinct().count() == blobs and more.where("rule = 'slack'").select("blob").distinct().count() == blobs - 1


# Decontamination


def test_short_items_inside_long_documents(spark):
    ship(spark)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 4, 5, 40]))) for i in range(60)} | {90: "Alpha, BETA gamma delta " + "w1 " * 300}
    items = {1: "alpha beta gamma delta", 2: "w1", 3: "w2 w3", 4: "w4 w5 w6", 5: "zz yy xx", 6: "", 7: "w1 w2 w3 w4 w5"}
    token = re.compile(r"[^\W_]+")
    want = set()
    for d, t in texts.items():
        w = token.findall(t.lower())
        for i, x in items.items():
            k = token.findall(x.lower())
            want |= {(d, i)} if k and any(w[p : p + len(k)] == k for p in range(len(w) - len(k) + 1)) else set()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == want and (90, 1) in want and len({i for _, i in want}) >= 3


# Substrings


def test_factors_stand_in_their_references(spark):
    ship(spark)
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(200)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    a, b = make(140), make(130)
    texts = {1: make(20) + a, 2: b + make(9), 3: make(7) + a[:70] + b[:60] + make(5), 4: a[20:] + b, 5: a[:49] + make(30), 6: make(60), 7: a + a, 8: (a[:60] + ["x"]) * 2}
    rows = {r.doc_id: r for r in rlz.dedup_substrings(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id int, text string")).collect()}
    for i, r in rows.items():
        gone = set()
        for f in r.factors:
            assert f.source_id < i and f.words >= 50
            assert texts[i][f.place : f.place + f.words] == texts[f.source_id][f.source_place : f.source_place + f.words]
            gone |= set(range(f.place, f.place + f.words))
        assert r.n_removed == len(gone) and r.kept == " ".join(x for k, x in enumerate(texts[i]) if k not in gone)
    assert len(rows[3].factors) == 2 and [f.source_id for f in rows[3].factors] == [1, 2] and rows[5].n_removed == 0
    assert rows[7].n_removed == 280 and rows[1].n_removed == 0


def test_parse_extends_while_the_reference_goes_on():
    tiles = [(0, 0, 5, 10), (0, 50, 5, 60), (0, 63, 5, 73), (200, 200, 5, 300), (200, 250, 4, 0), (200, 260, 4, 10)]
    assert rlz.parse(tiles, 50) == [(0, 113, 5, 10), (200, 50, 5, 300), (250, 60, 4, 0)]


# Main text

LINKS = "<div><ul>" + "".join(f"<li><a href={i}>Item {i}</a></li>" for i in range(9)) + "</ul></div>"


class Tree(HTMLParser):
    """Characters and tags below each element, with those in links, by another parser; for well-formed pages."""

    def __init__(self, page: str):
        super().__init__()
        self.root = self.here = {"tag": "#root", "kids": [], "up": None}
        self.feed(page)

    def handle_starttag(self, tag, attributes):
        node = {"tag": tag, "kids": [], "up": self.here}
        self.here["kids"].append(node)
        self.here = node

    def handle_endtag(self, tag):
        self.here = self.here["up"]

    def handle_data(self, data):
        self.here["kids"].append(data)


def measures(node, inside=False) -> tuple[int, int, int, int]:
    c = t = lc = lt = 0
    for k in node["kids"]:
        if isinstance(k, str):
            n = len(" ".join(k.split()))
            c, lc = c + n, lc + n * inside
        else:
            a = measures(k, inside or k["tag"] == "a")
            c, t, lc, lt = c + a[0], t + a[1] + 1, lc + a[2], lt + a[3] + (inside or k["tag"] == "a")
    return c, t, lc, lt


def test_densities_equal_the_formula():
    para = "<p>Words of the story, with <b>some</b> weight and <a href=x>one link</a> in them, go on for a while here.</p>"
    page = f"<html><body>{LINKS}<div><h1>Title</h1>{para * 3}<div>{para}<span>tail</span></div></div><div>short</div></body></html>"
    nodes, _ = html_density.measure(html_density.parse(page))
    plain, stack = [], [Tree(page).root]
    while stack:
        n = stack.pop()
        plain.append(n)
        stack += [k for k in reversed(n["kids"]) if not isinstance(k, str)]
    body = measures(next(n for n in plain if n["tag"] == "body"))
    assert [n.tag for n in nodes] == [n["tag"] for n in plain]
    density = {}
    for mine, n in zip(nodes, plain, strict=True):
        c, t, lc, lt = measures(n, n["tag"] == "a")
        assert (mine.chars, mine.tags, mine.link_chars) == (c, t, lc)
        base = math.log(c / max(1, c - lc) * lc + body[2] / body[0] * c + math.e)
        want = c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt if n["tag"] != "a" else t))) / math.log(base + math.e - 1)
        assert mine.density == pytest.approx(want)
        density[id(n)] = want
    for mine, n in zip(nodes, plain, strict=True):
        assert mine.total == pytest.approx(sum(density[id(k)] for k in n["kids"] if not isinstance(k, str) and k["tag"] in html_density.BLOCK))


def neutral(page: str) -> str:
    """The page with neither telling elements nor classes."""
    page = re.sub(r"<(/?)(article|main|nav|footer|header|aside|section|form)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_density_alone_finds_the_article():
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"]
    right = [html_density.main_text(neutral(p)) == html_density.main_text(p) for p in pages]
    assert sum(right) >= 0.95 * len(right)
    # what is wrong on those pages is a notice as dense as a short article, never a lost article
    for p, ok in zip(pages, right, strict=True):
        assert ok or html_density.main_text(p) in html_density.main_text(neutral(p))
    rng = random.Random(1)
    for _ in range(40):
        sentence = lambda: " ".join(rng.choice(["river", "stone", "quiet", "morning", "paper", "of", "the"]) for _ in range(rng.randrange(14, 40))).capitalize() + "."
        story = [sentence() for _ in range(rng.randrange(3, 9))]
        inner = "".join(f"<p>{s}</p>" for s in story)
        for _ in range(rng.randrange(1, 4)):
            inner = f"<div>{inner}</div>"
        page = f"<html><body>{LINKS}{inner}<div>&copy; A site</div>{LINKS}</body></html>"
        assert html_density.main_text(page) == html.unescape(" ".join(story))
        # nothing around the paragraphs at all
        assert html_density.main_text(f"<body>{LINKS}{''.join(f'<p>{s}</p>' for s in story)}{LINKS}</body>") == " ".join(story)


# Quality


def test_risk_and_slopes():
    rng = np.random.default_rng(2)
    s = lambda z: 1 / (1 + math.exp(-z))
    for shift in (0.5, -3.0):  # the second has a negative part below 0
        p, u, prior = rng.normal(size=7), rng.normal(size=11) + shift, 0.6
        positive = sum(s(-z) for z in p) / 7
        negative = sum(s(z) for z in u) / 11 - prior * sum(s(z) for z in p) / 7
        assert quality_pu.risk(p, u, prior) == pytest.approx(prior * positive + max(0.0, negative))
        at_p, at_u = quality_pu.slopes(p, u, prior)
        step = 1e-6
        target = (lambda p, u: quality_pu.risk(p, u, prior)) if negative >= 0 else (lambda p, u: -(np.mean([s(z) for z in u]) - prior * np.mean([s(z) for z in p])))
        for k in range(7):
            moved = p.copy()
            moved[k] += step
            assert (target(moved, u) - target(p, u)) / step == pytest.approx(at_p[k], abs=1e-6)
        for k in range(11):
            moved = u.copy()
            moved[k] += step
            assert (target(p, moved) - target(p, u)) / step == pytest.approx(at_u[k], abs=1e-6)


def test_fit_lowers_the_risk_and_repeats_are_learnt_from_once(spark):
    rng = np.random.default_rng(5)
    positive, unlabelled = rng.normal(size=(80, 4)), np.concatenate([rng.normal(size=(60, 4)), rng.normal(size=(60, 4)) + 3])
    model = quality_pu.fit(positive, unlabelled, 0.5)
    score = lambda x: model.design(x) @ model.weight + model.bias
    assert quality_pu.risk(score(positive), score(unlabelled), 0.5) < 0.6 * quality_pu.risk(np.zeros(80), np.zeros(120), 0.5)
    texts = {i: "the quiet river of stone " * (i % 7 + 3) if i % 3 else "$$$ BUY 777 " * (i % 5 + 2) for i in range(60)}
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    once = {r.doc_id: r.score for r in quality_pu.predict(docs, labels).collect()}
    again = {r.doc_id: r.score for r in quality_pu.predict(docs.union(docs).union(docs.where("doc_id < 9")), labels).collect()}
    assert again == pytest.approx(once)


# Every operator: ids of another integer type, extra columns, long texts, nothing at all


def test_other_ids_long_texts_and_extra_columns(spark, tmp_path):
    long = " ".join(f"w{i % 5003}" for i in range(450_000))  # over 2 MB
    texts = {1: long, 2: None, 3: "", 4: "short text here", 5: long}
    docs = frame(spark, texts)
    path = public_tokenizers.path("word_bpe_49k.json")
    assert {r.doc_id: r.component_id for r in ngram_join.link_components(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    removed = {r.doc_id: r.n_removed for r in rlz.dedup_substrings(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 0, 4: 0, 5: 450_000}
    encoded = {r.doc_id: r for r in bpe_automaton.encode_decode(docs, path).collect()}
    assert encoded[1].ids == encoded[5].ids and encoded[2].ids == [] and len(encoded[1].ids) > 450_000
    assert {r.doc_id for r in bpe_automaton.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>"), path).collect()} == {1}
    files = token_pack.write_files(docs, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/t", roll_bytes=1000, rows_per_file=2)
    back = {r.doc_id: (r.start, r.n_tokens) for r in token_pack.digest(token_pack.read_documents(files)).collect()}
    starts = sorted((s, n) for s, n in back.values())
    assert len(back) == 5 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and files.count() > 2
    assert quality_pu.score(docs, None).count() == 5 and spotsigs.fingerprints(docs).count() == 5
    assert secrets.findings(*secrets.scan(docs)).count() == 5
    pages = spark.createDataFrame([(1, "u", "<p>" + "word " * 600_000, 3), (2, None, None, 3)], "page_id int, url string, html string, text int")
    assert [r.n_chars for r in html_density.extract(pages).orderBy("page_id").collect()] == [2_999_999, 0]
    assert decontaminate.clean(docs, spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6")], "item_id int, text string")).columns == docs.columns


def test_files_of_another_kind_raise(tmp_path):
    import json

    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    for change in ({"decoder": {"type": "ByteLevel"}}, {"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError, match=next(iter(change))):
            bpe_automaton.WordTokenizer(json.dumps(spec | change))


def test_small_inputs_get_few_files(spark, tmp_path):
    path = f"file://{tmp_path}/many"
    spark.range(1000).repartition(40).write.parquet(path)
    many = spark.read.parquet(path)
    assert common.compact(many.repartition(40), many).rdd.getNumPartitions() == common.LEAST_FILES
    assert common.compact(spark.range(10).repartition(40), spark.createDataFrame([(1,)], "a int")).rdd.getNumPartitions() in (40, common.LEAST_FILES)
    table = common.cut(spark.range(100).repartition(40), 100)
    assert common.total(table) == 100 and table.count() == 100
    common.drop(table)
    with pytest.raises(Exception, match="(?i)path|file"):
        table.count()

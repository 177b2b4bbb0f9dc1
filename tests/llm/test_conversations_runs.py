"""Conversation repair, chat formatting and periodic runs against plain computations, over the given tables and odd ones."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tracelens.llm import chat_format, conversation_repair, queries, runs
from tracelens.session import ship

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rows_of(df, key):
    out = {}
    for r in df.collect():
        assert r[key] not in out
        out[r[key]] = r.asDict()
    return out


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, role, text))
    return out


def cheapest(rows):
    """Least (cost, audit) and the repaired turns, by trying each edit after each state."""
    best = {"": (0, "", ())}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def put(states, state, value):
        if state not in states or value[:2] < states[state][:2]:
            states[state] = value
            return True
        return False

    def insert(states):
        while any([put(states, after[s], (c + 3, a + "I", (*t, (names[after[s]], "")))) for s, (c, a, t) in list(states.items())]):
            pass
        return states

    best = insert(best)
    for role, text, fault in rows:
        new = {}
        for s, (c, a, t) in best.items():
            put(new, s, (c + 4, a + "D", t))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                want = after[s]
                put(new, want, (c + 3 + more, a + "R", (*t, (names[want], text))))
                if role[:1] == want or (s == "" and role[:1] == "s"):
                    put(new, role[:1], (c + more, a + "K", (*t, (role, text))))
        best = insert(new)
    return min(v for s, v in best.items() if s in ("", "a"))


def repaired(table, damaged=True):
    out = {}
    for conv, turns in by_conversation(table).items():
        rows = []
        for turn, role, text in turns:
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            core = SPACE.findall(text)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        numbers = [t for t, _, _ in rows if t is not None]
        cost, audit, turns = cheapest(marked)
        initials = [r[:1] for r, _, _ in marked]
        out[conv] = {
            "conv_id": conv,
            "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            **{k: sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": sha("\n".join(f"{r}:{t}" for r, t in turns)),
        }
    return out


def test_repair_of_the_given_table(spark):
    table = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    assert rows_of(queries.op11_conversation_repair(spark, SF), "conv_id") == repaired(table)


ODD = "turn int, conv_id int, text string, role string, `here_0` string, fault long, part int"


def odd_rows(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", None, " \t\n", "a\u0085", "Ends. \n", "?", "　", "ü. "]
    rows = [(rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(texts), rng.choice(["user", "assistant", "system", "tool", "", None, "u", "System", "üser"])) for _ in range(60)]
    return rows + rows[:5]


@pytest.mark.parametrize("seed", range(3))
def test_repair_of_odd_rows(spark, seed):
    ship(spark)
    rows = odd_rows(seed)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ODD).repartition(3)
    want = repaired([(c, t, r, x) for t, c, x, r in rows])
    assert rows_of(conversation_repair.digest(conversation_repair.repair(conversation_repair.damage(df))), "conv_id") == want
    plain = repaired([(c, t, r, x) for t, c, x, r in rows], damaged=False)
    assert rows_of(conversation_repair.digest(conversation_repair.repair(df.drop("here_0"))), "conv_id") == plain


def test_repair_of_long_conversations_comes_in_parts(spark):
    """More text than a slice, with turns to delete, to rerole and to insert, beside short conversations."""
    ship(spark)
    rng = random.Random(4)
    rows = [(1, i, rng.choice(["user", "assistant", "user", "tool"]), f"{i} " + "long " * 2000 + rng.choice([".", ""])) for i in range(1500)]
    rows += [(2, 0, "user", "a?"), (2, 1, "assistant", "b."), (3, 0, "x", "")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(5)
    result = conversation_repair.repair(df)
    assert result.where("conv_id = 1").count() > 1 and result.where("conv_id = 1 and cost is not null").count() == 1
    assert rows_of(conversation_repair.digest(result), "conv_id") == repaired(rows, damaged=False)


def test_repair_of_an_empty_table(spark):
    ship(spark)
    df = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    assert conversation_repair.digest(conversation_repair.repair(conversation_repair.damage(df))).collect() == []
    assert chat_format.digest(chat_format.format_chats(df)).collect() == []


def test_repair_shuffles_once(spark):
    df = conversation_repair.faults(conversation_repair.damage(spark.read.parquet(f"{SF}/conversations.parquet")))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_all_items_agree_with_trying_every_edit():
    rng = random.Random(5)
    marks = {"x": "blank", "": ""}
    for _ in range(3000):
        symbols = "".join(rng.choice("suaoSUAOxx") for _ in range(rng.randrange(10)))
        rows = [(s.lower(), "", "blank" if s == "x" else "truncated" if s.isupper() else marks[""]) for s in symbols]
        assert conversation_repair.parse(symbols) == cheapest(rows)[:2]
        chart, said = conversation_repair.Chart(), ""
        for s in symbols:
            chart.read(s)
            said += chart.decided() if rng.random() < 0.3 else ""
        cost, audit = chart.best()
        assert (cost, said + audit) == conversation_repair.parse(symbols)


# Chat formatting


def formatted(table):
    out = {}
    for conv, turns in by_conversation(table).items():
        turns = sorted(((t is not None, t or 0, (r or "").encode(), (x or "").encode()) for t, r, x in turns))
        turns = [(r.decode(), x.decode()) for _, _, r, x in turns]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[conv] = {"conv_id": conv, "n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{x}\n" for r, x in turns)), "loss_chars": len(loss), "loss_sha256": sha(loss)}
    return out


def without_length(rows):
    assert all(r.pop("formatted_chars") > r["n_turns"] for r in rows.values())
    return rows


def test_format_of_the_given_table(spark):
    said = "</s>[INST] ok [/INST]"
    table = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    assert without_length(rows_of(queries.op12_chat_format(spark, SF), "conv_id")) == formatted([*table, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def plain_format(turns):
    """The template by string concatenation."""
    escape = lambda s: re.sub(r"([<\[])(\\*)(/?s>|/?(?:INST|ANS|SYS|ROLE|TURN)\])", r"\1\\\2\3", s)
    form = {"user": "[INST] {} [/INST]", "assistant": "[ANS] {} </s>", "system": "[SYS] {} [/SYS]"}
    return "<s>" + "".join(form[r].format(escape(x)) if r in form else f"[ROLE] {escape(r)} [/ROLE] {escape(x)} [/TURN]" for r, x in turns)


@pytest.mark.parametrize("seed", range(3))
def test_format_of_odd_rows(spark, seed):
    ship(spark)
    rng = random.Random(seed)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\s>", "[", "]", "<", " ", "[ANS] ", " </s>", "é", "\U0001f600", "\n", "{}", "[\\\\/TURN]", "ROLE]", "", "a"]
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
    rows = [(rng.choice([None, 0, 1, 2, 3]), rng.choice([None, 1, 2, 3]), text(), rng.choice(["user", "assistant", "system", "", None, "[/ROLE] x", "user\n"])) for _ in range(60)]
    rows += rows[:3]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ODD).repartition(3)
    result = chat_format.format_chats(df)
    table = [(c, t, r, x) for t, c, x, r in rows]
    assert without_length(rows_of(chat_format.digest(result), "conv_id")) == formatted(table)
    for r in result.collect():
        turns = sorted(((t is not None, t or 0, (o or "").encode(), (x or "").encode()) for t, o, x in by_conversation(table)[r.conv_id]))
        assert r.text == plain_format([(o.decode(), x.decode()) for _, _, o, x in turns])


def test_format_of_long_conversations_comes_in_parts(spark):
    ship(spark)
    rows = [(1, i, ["user", "assistant"][i % 2], f"{i} </s> " + "é long " * 1500) for i in range(1200)] + [(2, 0, "user", "a"), (3, 0, "assistant", "b" * 6_000_000)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(1)
    result = chat_format.format_chats(df)
    assert result.where("conv_id = 1").count() > 1 and result.where("conv_id = 1 and part = 0").count() == 1
    assert result.where("text not like '<s>%' and part = 0 or text like '%<s>%' and part > 0").count() == 0
    assert without_length(rows_of(chat_format.digest(result), "conv_id")) == formatted(rows)


# Periodic runs


def plain_runs(words):
    """Each period's stretches of equal words at that distance; a stretch has its smallest period when it is first seen."""
    seen, out = set(), []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and (i, j + q) not in seen:
                seen.add((i, j + q))
                if j - i + q >= max(6, 4 * q):
                    out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(i, text, bend=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(i).encode())
    if bend and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = plain_runs(words)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = None
    for s, m, q in found:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    s, m, q = best or (None, None, None)
    return {
        "doc_id": i,
        "n_runs": len(found),
        "start": s,
        "length": m,
        "period": q,
        "exponent_milli": best and 1000 * m // q,
        "runs_sha256": sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
        "collapsed_sha256": sha(" ".join(w for k, w in enumerate(words) if k not in gone)),
    }


def test_runs_of_the_given_table(spark):
    table = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' where n_chars < 6000").fetchall()
    got = rows_of(queries.op13_periodic_runs(spark, SF), "doc_id")
    want = {i: run_row(i, t) for i, t in table}
    assert {i: got[i] for i in want} == want and sum(r["n_runs"] > 0 for r in want.values()) > 5


def test_runs_of_odd_texts(spark):
    ship(spark)
    rng = random.Random(6)
    texts = [None, "", " \n", "a a a a a a", "a a a a a", "a a " * 6, "A a " * 8, "x\x00 x " * 9, "a b a b a b a b　", "w" * 300_000, "long" * 40 + " " + ("long" * 40 + " ") * 7]
    for _ in range(200):
        kinds = [rng.choice(["a", "b", "aa", "a" * 9, "a" * 9 + "b", "é", "a" * 70, "a" * 69 + "b"]) for _ in range(rng.choice([1, 2, 3]))]
        words = [rng.choice(kinds) for _ in range(rng.randrange(40))]
        cut = rng.randrange(len(words) + 1)
        texts.append(rng.choice([" ", "\n ", "\t"]).join(words[:cut] + words[cut : cut + 4] * rng.randrange(8) + words[cut:]))
    rows = list(enumerate(texts)) + [(3, texts[3])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id int, text string, runs string, n_words long").repartition(3)
    got = sorted((tuple(r.asDict().items()) for r in runs.digest(runs.find_runs(df)).collect()), key=str)
    assert got == sorted((tuple(run_row(i, t, bend=False).items()) for i, t in rows), key=str)
    bent = sorted((tuple(r.asDict().items()) for r in runs.digest(runs.find_runs(runs.plant(df))).collect()), key=str)
    assert bent == sorted((tuple(run_row(i, t).items()) for i, t in rows), key=str)
    assert runs.digest(runs.find_runs(df.limit(0))).collect() == []


def test_next_smaller_suffixes_and_runs_of_short_sequences():
    rng = random.Random(7)
    for _ in range(3000):
        words = [rng.randint(1, rng.choice([1, 2, 3])) for _ in range(rng.randrange(30))]
        x = [*words, 0]
        want = [next((j for j in range(i + 1, len(words)) if x[j:] < x[i:]), len(words)) for i in range(len(words))]
        nss, match = runs.lyndon(x)
        assert nss == want
        assert all(x[i : i + e] == x[j : j + e] and x[i + e] != x[j + e] for i, (j, e) in enumerate(zip(nss, match, strict=True)))
        assert runs.runs_of(words) == plain_runs(words)


def test_matching_takes_linear_time():
    """Sequences whose suffixes match far: the words looked at grow with the length alone."""

    class Word(int):
        looks = 0

        def __eq__(self, other):
            Word.looks += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    fibonacci, more = [1], [1, 2]
    while len(more) < 4000:
        fibonacci, more = more, more + fibonacci
    for words in ([1] * 4000, more[:4000], [1, 1, 2] * 1333, ([1] * 60 + [2]) * 65, [bin(i).count("1") % 2 + 1 for i in range(4000)]):
        Word.looks = 0
        runs.lyndon([*map(Word, words), Word(0)])
        assert Word.looks < 5 * len(words)

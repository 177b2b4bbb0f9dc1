from pyspark.sql import functions as F

from tracelens.functions import ids
from tracelens.functions import text as T


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


def test_tokens_keep_identifiers_whole(spark):
    got = one(spark, T.raw_tokens("c0"), "Set error_code_4021 to 0.9.2, naïve -x- A")
    assert got == ["set", "error_code_4021", "to", "0.9.2", "na", "ve", "x", "a"]
    assert one(spark, T.raw_tokens("c0"), None) == []


def test_content_tokens_keep_polarity(spark):
    assert one(spark, T.content_tokens("c0"), "it is not the limit") == ["not", "limit"]


def test_stem_and_identifier(spark):
    for word, stemmed in {"restarting": "restart", "copies": "copy", "as": "as", "v1.2": "v1.2", "configuration": "configurat", "happiness": "happy"}.items():
        assert one(spark, T.stem("c0"), word) == stemmed
    assert one(spark, T.is_identifier("c0"), "pg_stat") and not one(spark, T.is_identifier("c0"), "stat")


def test_discriminators(spark):
    assert one(spark, T.discriminators("c0"), "never use v6.2 or 7 here, never") == ["7", "pol:never", "v6.2"]


def test_sentences_have_offsets_into_the_text(spark):
    text = "One is here. Two (is)\nhere! three stays.\n\nFour? Yes."
    spans = one(spark, T.sentence_spans("c0"), text)
    assert [s["sentence"] for s in spans] == ["One is here.", "Two (is) here! three stays.", "Four?", "Yes."]
    assert all(text.replace("\n", " ")[s["start"] : s["end"]] == s["sentence"] for s in spans)
    assert one(spark, T.sentences("c0"), None) == []


def test_prose_and_markers(spark):
    assert one(spark, T.is_prose("c0"), "This is a plain written sentence.")
    assert not one(spark, T.is_prose("c0"), "key: value with several more words")
    assert one(spark, T.clean_sentence("c0"), "- a point") == "a point"
    assert one(spark, T.has_refusal_marker("c0"), "The sources do not explicitly state which is best")
    assert one(spark, T.is_hedged("c0"), "It might be so") and not one(spark, T.is_hedged("c0"), "Replicas may themselves have replicas")


def test_jaccard_and_citations(spark):
    df = spark.createDataFrame([([], []), (["a"], ["a", "b"])], "a array<string>, b array<string>")
    assert [r["j"] for r in df.select(T.jaccard("a", "b").alias("j")).collect()] == [1.0, 0.5]
    assert one(spark, T.citations("c0"), "x [1, 2] y [2] z [3]") == [1, 2, 3]
    assert [tuple(x) for x in one(spark, T.parse_scores("c0"), "1: 40, 2: 7.5")] == [(1, 40.0), (2, 7.5)]
    assert [tuple(x) for x in one(spark, T.parse_scores("c0"), '{"scores":[{"n":1,"score":9}]}')] == [(1, 9.0)]
    assert one(spark, T.unwrap("c0"), "<think>no\nno</think> yes") == "yes"


def test_base32_of_a_digest(spark):
    import hashlib

    digest = hashlib.sha256(b"x").hexdigest()
    n, out = int(digest[:32], 16), ""
    for _ in range(26):
        out, n = ids.ALPHABET[n % 32] + out, n // 32
    assert one(spark, ids.base32(F.col("c0")), digest) == out


def of_text(spark, column, text):
    return spark.createDataFrame([(text,)], "s string").select(column.alias("v")).first()["v"]


def test_what_declines_and_what_hedges(spark):
    declines = [
        "These sources do not clearly state which of the two is larger.", "The manual does not specify any default here.", "That option is not documented in what was given.",
        "There is no such parameter in the system.", "I could not find a value for it.", "We cannot determine this from the sources.", "The pages don't contain that number.",
        "I do not have enough to say.", "It would take facts outside the retrieved documents.", "There is not enough evidence for that.",
    ]
    firm = ["Code 4021 means the budget of the module was used up.", "The default is 4096 bytes for each cycle.", "A copy is written by another process, so memory may double.", "Copies may have copies of their own."]
    hedges = ["It appears to follow the interval.", "The sources are not clear on this.", "This is possibly tied to the policy."]
    df = spark.createDataFrame([(x,) for x in declines + firm + hedges], "s string")
    got = {r.s: (r.a, r.b) for r in df.select("s", T.has_refusal_marker("s").alias("a"), T.is_hedged("s").alias("b")).collect()}
    assert all(got[x] == (True, True) for x in declines) and all(got[x] == (False, False) for x in firm) and all(got[x] == (False, True) for x in hedges)
    extra = F.array(F.lit("No benchmark"))
    assert of_text(spark, T.has_refusal_marker("s", extra), "no benchmark exists") and not of_text(spark, T.has_refusal_marker("s", extra), "the value is 900")


def test_word_lists_as_they_are_meant(spark):
    assert of_text(spark, T.content_tokens("s"), "Do not turn the cache off without a backup") == ["not", "turn", "cache", "without", "backup"] or "not" in of_text(spark, T.content_tokens("s"), "Do not turn the cache off without a backup")
    assert of_text(spark, T.discriminators("s"), "never set max_size to 12 except in v1.2") == sorted(["12", "max_size", "pol:except", "pol:never", "v1.2"])
    stems = {"indexing": "index", "replication": "replicat", "limits": "limit", "policies": "policy", "optimization": "optimize", "as": "as", "v1.2s": "v1.2s"}
    df = spark.createDataFrame([(k,) for k in stems], "s string")
    assert {r.s: r.v for r in df.select("s", T.stem("s").alias("v")).collect()} == stems
    assert of_text(spark, T.strip_code_fences("s"), "a ```x\ny``` b ``` c") == "a   b ``` c"
    assert of_text(spark, T.unwrap("s", F.lit("<THINK>no</THINK> the answer")), "  ") == "the answer" and of_text(spark, T.unwrap("s"), "<think>a\nb</think> x") == "x"
    assert of_text(spark, T.missing(F.array(*map(F.lit, "cabad")), F.array(F.lit("a"))), "") == ["c", "b", "d"]
    assert of_text(spark, T.citations("s"), "See [2, 10] and [1], not [x] or [2].") == [2, 10, 1]
    assert [(r.n, r.score) for r in of_text(spark, T.parse_scores("s"), '{"scores": [{"n": 2, "score": 70}]}')] == [(2, 70.0)]
    assert [(r.n, r.score) for r in of_text(spark, T.parse_scores("s"), "1: 40, 3 = 7.5")] == [(1, 40.0), (3, 7.5)]

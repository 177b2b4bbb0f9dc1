"""The registered queries over the driver's tables, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle as O
from .engine import Engine
from .functions import text as T
from .operators import calibrate, counterfactual, generate, ingest, judge, pruned, retrieve, search, stages, vectors
from .plans.config import ABLATIONS, COMPOSITES, configs, plan
from .session import MANY, cut, ship, small
from .sources import fixtures as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, final: str | None = None, needs: list[str] | None = None, extra: dict | None = None) -> Callable[[Query], Query]:
    """Registers a query and, if given, its SQL: the final SELECT and the tables that it needs."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if final:
            SQL[name] = O.sql(final, needs or [], extra)
        return f

    return put


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "documents")


class Index(Engine):
    """The engine over the driver's tables, once for each collection and application; `docs` are its documents."""

    _built: dict[tuple[str, str], Index] = {}

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf, self.stored = spark, sf, {}

    @classmethod
    def of(cls, spark: SparkSession, sf: str) -> Index:
        key = (spark.sparkContext.applicationId, sf)
        if key not in cls._built:
            cls._built[key] = cls(spark, sf)
        return cls._built[key]

    @cached_property
    def docs(self) -> DataFrame:
        return S.documents(self.spark, self.sf)

    @property
    def given_chunks(self) -> DataFrame:
        return S.chunks(self.docs)

    @property
    def given_questions(self) -> DataFrame:
        return S.questions(self.docs, S.table(self.spark, self.sf, "benchmark"))

    @cached_property
    def sweep(self) -> dict[str, DataFrame]:
        return _sweep(self, SWEEP)


def _base(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, chunks, questions."""
    i = Index.of(spark, sf)
    return i.docs, i.chunks, i.questions


# Text kernel


@query("tokenize", f"SELECT doc_id, CAST(len(l) AS INTEGER) AS n_tokens, CAST(len(list_distinct(l)) AS INTEGER) AS n_distinct, md5(array_to_string(l, ' ')) AS tokens_md5 FROM (SELECT doc_id, {O.raw('text')} AS l FROM documents)")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    t = _docs(spark, sf).select("doc_id", T.raw_tokens("text").alias("l"))
    return t.select("doc_id", F.size("l").alias("n_tokens"), F.size(F.array_distinct("l")).alias("n_distinct"), F.md5(F.array_join("l", " ").cast("binary")).alias("tokens_md5"))


@query("content_tokens", f"SELECT doc_id, CAST(len(l) AS INTEGER) AS n_tokens, md5(array_to_string(l, ' ')) AS tokens_md5 FROM (SELECT doc_id, {O.content('text')} AS l FROM documents)")
def content_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = _docs(spark, sf).select("doc_id", T.content_tokens("text").alias("l"))
    return t.select("doc_id", F.size("l").alias("n_tokens"), F.md5(F.array_join("l", " ").cast("binary")).alias("tokens_md5"))


@query("identifier_flags", f"SELECT token, count(*) AS n, {O.ident('token')} AS is_identifier FROM (SELECT unnest({O.raw('url')}) AS token FROM pages) GROUP BY token")
def identifier_flags(spark: SparkSession, sf: str) -> DataFrame:
    t = S.table(spark, sf, "pages").select(F.explode_outer(T.raw_tokens("url")).alias("token")).where("token is not null")
    return t.groupBy("token").agg(F.count("*").alias("n")).withColumn("is_identifier", T.is_identifier("token"))


@query("stems", f"SELECT token, {O.stem('token')} AS stem FROM (SELECT DISTINCT unnest({O.raw('text')}) AS token FROM documents)")
def stems(spark: SparkSession, sf: str) -> DataFrame:
    t = _docs(spark, sf).select(F.explode_outer(T.raw_tokens("text")).alias("token")).where("token is not null").distinct()
    return t.select("token", T.stem("token").alias("stem"))


@query("discriminators", f"SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform({O.raw('url')}, lambda t: CASE WHEN t IN ({O._list(O.L.POLARITY)}) THEN 'pol:' || t WHEN {O.ident('t')} OR regexp_full_match(t, '[0-9]+') THEN t END), lambda t: t IS NOT NULL))), ' ') AS discriminators FROM pages")
def discriminators(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "pages").select("page_id", F.array_join(T.discriminators("url"), " ").alias("discriminators"))


@query("numeric_literals", "SELECT doc_id, CAST(len(l) AS INTEGER) AS n, array_to_string(list_sort(l), ' ') AS numbers FROM (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '" + O.L.NUMBER + "')) AS l FROM documents)")
def numeric_literals(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.size(T.numbers("text")).alias("n"), F.array_join(F.array_sort(T.numbers("text")), " ").alias("numbers"))


_SENT = "list_filter(list_transform(string_split(regexp_replace(replace(coalesce({0}, ''), chr(10), ' '), '([.!?])\\s+([A-Z(`\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query("sentence_split", f"SELECT doc_id, CAST(len(l) AS INTEGER) AS n_sentences, md5(array_to_string(l, chr(10))) AS sentences_md5 FROM (SELECT doc_id, {_SENT.format('text')} AS l FROM documents)")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    t = _docs(spark, sf).select("doc_id", T.sentences("text").alias("l"))
    return t.select("doc_id", F.size("l").alias("n_sentences"), F.md5(F.array_join("l", "\n").cast("binary")).alias("sentences_md5"))


@query("prose_sentences", f"SELECT doc_id, count(*) AS n, count_if(NOT starts_with(s, '|') AND len(regexp_extract_all(s, '[A-Za-z]{{2,}}')) >= 5 AND NOT (contains(s, ':') AND NOT regexp_matches(s, '[.!?]$'))) AS n_prose FROM (SELECT doc_id, unnest({_SENT.format('text')}) AS s FROM documents) GROUP BY doc_id")
def prose_sentences(spark: SparkSession, sf: str) -> DataFrame:
    t = _docs(spark, sf).select("doc_id", F.explode_outer(T.sentences("text")).alias("s")).where("s is not null")
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.is_prose("s")).alias("n_prose"))


_PRICE = " ".join(f"WHEN '{m}' THEN {i}" for m, (i, _) in O.L.PRICES.items())


@query("token_cost", f"SELECT conv_id, model, tokens, round_even((tokens * CAST(CASE model {_PRICE} ELSE 0 END AS DOUBLE)) / 1e6, 8) AS cost_usd FROM (SELECT conv_id, model, CAST(sum(t) AS BIGINT) AS tokens FROM (SELECT conv_id, CASE WHEN role = 'user' THEN 'small' ELSE 'large' END AS model, greatest(1, length(coalesce(text, '')) // 4) AS t FROM conversations) GROUP BY ALL)")
def token_cost(spark: SparkSession, sf: str) -> DataFrame:
    c = S.table(spark, sf, "conversations").select("conv_id", F.when(F.col("role") == "user", "small").otherwise("large").alias("model"), T.estimate_tokens("text").alias("t"))
    return c.groupBy("conv_id", "model").agg(F.sum("t").alias("tokens")).withColumn("cost_usd", T.price_of("model", F.col("tokens"), F.lit(0)))


_REF, _HED = (O._q("(?i)" + "|".join(p)) for p in (O.L.REFUSAL, O.L.HEDGE + O.L.REFUSAL))


@query("refusal_hedge_flags", f"SELECT conv_id, turn, regexp_matches(text, {_REF}) AS refuses, regexp_matches(text, {_HED}) AS hedges FROM conversations")
def refusal_hedge_flags(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "conversations").select("conv_id", "turn", T.has_refusal_marker("text").alias("refuses"), T.is_hedged("text").alias("hedges"))


# Ingest, scope and retrieval


@query("chunks", "SELECT chunk_id, tenant_id, doc_id, ordinal, length(text) AS n_chars FROM chunks", ["chunks"])
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return S.chunks(S.documents(spark, sf)).select("chunk_id", "tenant_id", "doc_id", "ordinal", F.length("text").cast("long").alias("n_chars"))


@query("questions", "SELECT query_id, tenant_id, query, kind FROM questions", ["questions"])
def questions(spark: SparkSession, sf: str) -> DataFrame:
    return _base(spark, sf)[2].select("query_id", "tenant_id", "query", "kind")


@query("gold_index", "SELECT item_id, doc_no, tenant_id FROM gold", ["gold"])
def gold_index(spark: SparkSession, sf: str) -> DataFrame:
    return S.gold_documents(S.documents(spark, sf), S.table(spark, sf, "benchmark"))


@query("scope_scan", "SELECT s.tenant_id, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM chunks c JOIN scope s ON c.tenant_id = s.chunk_tenant GROUP BY s.tenant_id", ["chunks", "scope"])
def scope_scan(spark: SparkSession, sf: str) -> DataFrame:
    from .operators.scope import scoped_chunks

    _, c, q = _base(spark, sf)
    return scoped_chunks(q, c).join(c.select("chunk_id", "tenant_id", "doc_id").withColumnRenamed("tenant_id", "own"), "chunk_id").groupBy("tenant_id").agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"))


@query("scope_term_stats", "SELECT tenant_id, n, round_even(avgdl, 6) AS avgdl FROM scope_stat", ["scope_stat"])
def scope_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    _, c, q = _base(spark, sf)
    return retrieve.scope_stats(c, q).select("tenant_id", "n", F.bround("avgdl", 6).alias("avgdl"))


@query("bm25_topk", "SELECT query_id, chunk_id, score, rank FROM lex_leg", ["lex_leg"])
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return Index.of(spark, sf).lexical


@query("bm25_pruned_topk", "SELECT query_id, chunk_id, score, rank FROM lex_leg", ["lex_leg"])
def bm25_pruned_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The lexical leg from blocks of the lists that are asked for; those that can't change a rank give no candidates."""
    i = Index.of(spark, sf)
    asked = retrieve.query_terms(i.questions).select("term").distinct()
    stored = cut(pruned.blocks(i.postings.join(small(asked, MANY), "term", "left_semi")))
    return pruned.bm25(stored, i.chunks, i.questions, posted=i.postings)


@query("concept_df_idf", "SELECT concept, df, round_even(idf, 6) AS idf FROM idf", ["idf"])
def concept_df_idf(spark: SparkSession, sf: str) -> DataFrame:
    return Index.of(spark, sf).concepts[2].select("concept", "df", F.bround("idf", 6).alias("idf"))


@query("coverage_matrix", "SELECT query_id, chunk_id, coverage, score FROM pairs", ["pairs"])
def coverage_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return Index.of(spark, sf).pairs()


@query("concept_topk", "SELECT query_id, chunk_id, score, rank FROM sem_leg", ["sem_leg"])
def concept_topk(spark: SparkSession, sf: str) -> DataFrame:
    return Index.of(spark, sf).semantic


_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"


@query("dense_topk", "SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20", ["s"], {"s": (f"SELECT q.vec_id AS query_id, v.vec_id, round_even({_DOT.format('v.embedding', 'q.embedding')} / (sqrt({_DOT.format('v.embedding', 'v.embedding')}) * sqrt({_DOT.format('q.embedding', 'q.embedding')})), 6) AS score FROM embeddings v JOIN embeddings q ON v.label = q.label WHERE q.vec_id % 50 = 0", [])})
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = S.table(spark, sf, "embeddings").withColumnRenamed("label", "scope")
    return retrieve.dense_knn(v, v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))


@query("neighbour_expansion", "SELECT a.chunk_id, b.ordinal - a.ordinal AS delta, b.chunk_id AS neighbour_id FROM chunks a JOIN chunks b ON a.tenant_id = b.tenant_id AND a.doc_id = b.doc_id AND abs(a.ordinal - b.ordinal) BETWEEN 1 AND 2", ["chunks"])
def neighbour_expansion(spark: SparkSession, sf: str) -> DataFrame:
    c = Index.of(spark, sf).chunks
    return retrieve.neighbours(c.select("chunk_id"), c, 2)


# Pipeline stages. One plan serves any list of configurations.


def _run(i: Index, names: list[str]) -> dict[str, DataFrame]:
    return i.retrieve(names)


def _cfg(*names: str) -> dict:
    return {"configs": (O.configs_cte(list(names)), [])}


def _staged(name: str, columns: str, table: str, key: str, *names: str) -> None:
    """Registers a query that reads one relation of the staged plan for the configurations named."""
    cols = columns.split(", ")

    def f(spark: SparkSession, sf: str) -> DataFrame:
        out = _run(Index.of(spark, sf), list(names))
        return (stages.context(out["ranked"], out["chunks"], out["configs"]) if key == "ctx" else out[key]).select(*cols)

    query(name, f"SELECT {columns} FROM {table}", [table], _cfg(*names))(f)


_FUSED = "config_id, query_id, chunk_id, lexical_rank, lexical_score, semantic_rank, semantic_score, fused_score, fused_rank"
_staged("hybrid_rrf", _FUSED, "cand", "cand", "baseline")
_staged("fuse_naive_sum", _FUSED, "cand", "cand", "no_fusion")
_staged("fuse_single_leg", _FUSED, "cand", "cand", "no_lexical", "no_semantic")
_staged("gate_decision", "config_id, query_id, top1, top2, gate_checked, gate_passed", "decided", "decided", "baseline", "no_gate", "gate_on_fused", "no_semantic")
_staged("rerank_grayzone", "config_id, query_id, top1, top2, rerank_reason", "decided", "decided", "baseline", "no_rerank", "force_rerank", "no_gate")
_staged("rerank_order", "config_id, query_id, chunk_id, rerank_score, position, promoted", "ranked", "ranked", "baseline", "force_rerank")
_staged("context_assembly", "config_id, query_id, chunk_id, final_rank, inclusion_reason", "ctx", "ctx", "baseline", "no_gate", "no_expansion", "top_k_1", "force_rerank")



# Answers, traces and counterfactuals over the baseline, all ablations and the composites

SWEEP = [*ABLATIONS, *COMPOSITES]


def _cases(spark: SparkSession, sf: str, q: DataFrame) -> DataFrame:
    """query_id, kind, answer_key: the longest word of the item, the first of equal ones."""
    words = S.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode_outer(T.raw_tokens("text")).alias("w")).where("w is not null")
    key = words.groupBy("query_id").agg(F.min(F.struct((-F.length("w")).alias("n"), "w")).alias("k"))
    return q.join(key, "query_id", "left").select("query_id", "kind", F.col("k.w").alias("answer_key"))


def _sweep(i: Index, names: list[str]) -> dict[str, DataFrame]:
    r = i.run(names)
    r["vocabulary"] = i.vocabulary
    r["cases"] = cut(_cases(i.spark, i.sf, r["questions"]))
    r["gold"] = cut(_gold(r["chunks"], r["cases"]))
    r["diffs"] = cut(counterfactual.diffs(r["answers"], r["cases"]))
    return r


def _gold(c: DataFrame, cases: DataFrame) -> DataFrame:
    few = cases.where("answer_key is not null and kind = 'answerable'")
    lower = c.select("chunk_id", F.lower("text").alias("text"))
    found = search.containing(lower, few.select(F.col("query_id").alias("pattern_id"), F.lower("answer_key").alias("pattern")), ["chunk_id"])
    return found.select(F.col("pattern_id").alias("query_id"), "chunk_id")


_A = {
    "ctxq": ("SELECT DISTINCT query_id, chunk_id FROM ctx", ["ctx"]),
    "sent0": (f"SELECT query_id, chunk_id, unnest(l) AS raw, unnest(range(0, len(l))) AS place FROM (SELECT query_id, chunk_id, {_SENT.format('text')} AS l FROM ctxq JOIN chunks USING (chunk_id))", ["ctxq", "chunks"]),
    "sent": ("SELECT * FROM (SELECT query_id, chunk_id, place, trim(regexp_replace(raw, '^\\s*([-*+]\\s+|[0-9]+[.)]\\s+|#{1,6}\\s+|>\\s+|\\|)', '')) AS s FROM sent0) WHERE length(s) >= 25 AND NOT starts_with(s, '|') AND len(regexp_extract_all(s, '[A-Za-z]{2,}')) >= 5 AND NOT (contains(s, ':') AND NOT regexp_matches(s, '[.!?]$'))", ["sent0"]),
    "said": (f"SELECT DISTINCT query_id, chunk_id, place, concept FROM (SELECT query_id, chunk_id, place, unnest({O.content('s')}) AS token FROM sent) JOIN voc USING (token)", ["sent", "voc"]),
    "sent_cov": ("SELECT query_id, chunk_id, place, s AS sentence, round_even(coalesce(c, 0.0), 6) AS coverage FROM sent LEFT JOIN (SELECT query_id, chunk_id, place, sum(qn * idf) / any_value(whole) AS c FROM said JOIN asked_idf USING (query_id, concept) JOIN whole USING (query_id) GROUP BY ALL) USING (query_id, chunk_id, place)", ["sent", "said", "asked_idf", "whole"]),
    "ctx_cov": ("SELECT config_id, query_id, round_even(sum(qn * idf) / any_value(whole), 6) AS cc FROM (SELECT DISTINCT config_id, query_id, concept FROM ctx JOIN own USING (chunk_id)) JOIN asked_idf USING (query_id, concept) JOIN whole USING (query_id) GROUP BY ALL", ["ctx", "own", "asked_idf", "whole"]),
    "rs0": ("SELECT config_id, query_id, chunk_id, coverage, sentence || ' [' || final_rank || ']' AS quote, row_number() OVER w AS r, first_value(chunk_id) OVER w AS best, count(*) OVER (PARTITION BY config_id, query_id) AS n FROM ctx JOIN sent_cov USING (query_id, chunk_id) WINDOW w AS (PARTITION BY config_id, query_id ORDER BY coverage DESC, final_rank, sentence)", ["ctx", "sent_cov"]),
    "picked": ("SELECT config_id, query_id, any_value(n) AS n, arg_min(quote, r) AS q1, arg_min(chunk_id, r) AS c1, arg_min(coverage, r) AS v1, arg_min(quote, r) FILTER (chunk_id <> best) AS q2, arg_min(chunk_id, r) FILTER (chunk_id <> best) AS c2 FROM rs0 GROUP BY ALL", ["rs0"]),
    "held": (f"SELECT config_id, query_id, count(*) AS sources, list_distinct(flatten(list({O.disc('text')}))) AS held FROM ctx JOIN chunks USING (chunk_id) GROUP BY ALL", ["ctx", "chunks"]),
    "ans0": (f"SELECT c.config_id, q.query_id, c.discriminator_guard AS guard, CASE WHEN NOT coalesce(gate_passed, true) THEN 'gate' WHEN sources IS NULL THEN 'no sources' WHEN coalesce(cc, 0.0) < 0.18 THEN 'unrelated' WHEN q1 IS NULL THEN 'no sentence' END AS reason, list_filter({O.disc('q.query')}, lambda d: NOT list_contains(coalesce(held, []), d)) AS unmet, p.n, q1, c1, v1, q2, c2 FROM configs c, questions q LEFT JOIN decided d ON d.config_id = c.config_id AND d.query_id = q.query_id LEFT JOIN held h ON h.config_id = c.config_id AND h.query_id = q.query_id LEFT JOIN ctx_cov v ON v.config_id = c.config_id AND v.query_id = q.query_id LEFT JOIN picked p ON p.config_id = c.config_id AND p.query_id = q.query_id", ["configs", "questions", "decided", "held", "ctx_cov", "picked"]),
    "ans1": ("SELECT config_id, query_id, reason, (guard AND len(unmet) > 0) AS hedge, (v1 >= 0.55 OR n = 1 OR q2 IS NULL) AS alone, unmet, q1, c1, q2, c2 FROM ans0", ["ans0"]),
    "ans2": ("SELECT config_id, query_id, reason, hedge, CASE WHEN reason IS NOT NULL THEN 'refused' WHEN hedge THEN 'ungrounded' ELSE 'grounded' END AS status, CASE WHEN reason IS NOT NULL THEN 'No supporting evidence: ' || reason WHEN hedge THEN 'Not in the sources: ' || array_to_string(unmet[1:3], ', ') || '. Closest: ' || q1 WHEN alone THEN q1 ELSE q1 || ' ' || q2 END AS answer, CASE WHEN reason IS NOT NULL THEN '' WHEN hedge OR alone THEN c1 ELSE c1 || ' ' || c2 END AS citations FROM ans1", ["ans1"]),
    "ans": (f"SELECT config_id, query_id, status, (reason IS NOT NULL OR hedge OR regexp_matches(answer, {_HED})) AS hedged, answer, citations FROM ans2", ["ans2"]),
    "cases": (f"SELECT query_id, kind, arg_min(w, (-length(w), w)) AS answer_key FROM questions LEFT JOIN (SELECT item_id, unnest({O.raw('text')}) AS w FROM benchmark) ON item_id = query_id GROUP BY ALL", ["questions"]),
    "goldc": ("SELECT query_id, chunk_id FROM cases JOIN chunks ON contains(lower(text), lower(answer_key)) WHERE kind = 'answerable'", ["cases", "chunks"]),
    "marked": ("SELECT a.config_id, query_id, answer, status = 'refused' AS refused, (status = 'refused' OR hedged) AS flagged, CASE WHEN kind = 'out_of_scope' THEN (status = 'refused' OR hedged) ELSE contains(lower(answer), lower(answer_key)) END AS ok FROM ans a JOIN cases USING (query_id)", ["ans", "cases"]),
    "diff": ("SELECT v.config_id, v.query_id, CASE WHEN v.answer = b.answer THEN 'identical' WHEN v.ok IS NOT NULL AND b.ok IS NOT NULL THEN CASE WHEN b.ok AND v.ok THEN 'equivalent' WHEN v.ok THEN 'improved' WHEN b.ok AND v.refused THEN 'now_refuses' WHEN b.ok AND v.flagged THEN 'now_wrong' WHEN b.ok THEN 'now_confident_wrong' WHEN b.flagged AND NOT v.flagged THEN 'now_confident_wrong' WHEN NOT b.flagged AND v.flagged THEN CASE WHEN v.refused THEN 'now_refuses' ELSE 'degraded' END ELSE 'equivalent' END WHEN b.refused AND NOT v.refused THEN 'now_answers' WHEN v.refused AND NOT b.refused THEN 'now_refuses' ELSE 'degraded' END AS outcome FROM marked v JOIN marked b ON b.query_id = v.query_id AND b.config_id = 'baseline' WHERE v.config_id <> 'baseline'", ["marked"]),
    "wrongs": ("SELECT config_id, count_if(outcome = 'now_confident_wrong') AS n FROM diff GROUP BY config_id", ["diff"]),
}
_S = _A | _cfg(*SWEEP)


def _swept(name: str, final: str, needs: list[str], extra: dict | None = None) -> Callable:
    """Registers a query over the whole sweep."""

    def put(f: Callable[[dict[str, DataFrame]], DataFrame]) -> Callable:
        query(name, final, needs, _S | (extra or {}))(lambda spark, sf: f(Index.of(spark, sf).sweep))
        return f

    return put


@_swept("answers", "SELECT config_id, query_id, status, hedged, answer, citations FROM ans", ["ans"])
def answers(r: dict[str, DataFrame]) -> DataFrame:
    return r["answers"].select("config_id", "query_id", "status", "hedged", "answer", F.array_join("citations", " ").alias("citations"))


@_swept("ablation_sweep", "SELECT config_id, status, count(*) AS n, count_if(hedged) AS hedged FROM ans GROUP BY ALL", ["ans"])
def ablation_sweep(r: dict[str, DataFrame]) -> DataFrame:
    return r["answers"].groupBy("config_id", "status").agg(F.count("*").alias("n"), F.count_if("hedged").alias("hedged"))


@_swept("classify_outcomes", "SELECT config_id, query_id, outcome FROM diff", ["diff"])
def classify_outcomes(r: dict[str, DataFrame]) -> DataFrame:
    return r["diffs"]


@_swept("findings_pivot", "SELECT config_id, " + ", ".join(f"count_if(outcome = '{o}') AS {o}" for o in counterfactual.OUTCOMES) + " FROM diff GROUP BY config_id", ["diff"])
def findings_pivot(r: dict[str, DataFrame]) -> DataFrame:
    return counterfactual.tabulate(r["diffs"])


@_swept("interaction_effects", "SELECT a.config_id, a.n, CAST(sum(b.n) AS BIGINT) AS parts, a.n > sum(b.n) + 2 AS interacts FROM (SELECT config_id, n, unnest(string_split(config_id, '+')) AS part FROM wrongs WHERE contains(config_id, '+')) a JOIN wrongs b ON b.config_id = part GROUP BY a.config_id, a.n", ["wrongs"])
def interaction_effects(r: dict[str, DataFrame]) -> DataFrame:
    return counterfactual.interactions(r["diffs"])


@_swept("ablation_verdicts", "SELECT config_id, count(*) AS n, CASE WHEN count_if(outcome = 'now_confident_wrong') > 0 THEN 'confirmed' WHEN count_if(outcome IN ('now_refuses', 'now_wrong')) > 0 THEN 'loud' WHEN count_if(outcome IN ('identical', 'equivalent')) >= 0.98 * count(*) THEN 'no effect' ELSE 'changed' END AS verdict FROM diff GROUP BY config_id", ["diff"])
def ablation_verdicts(r: dict[str, DataFrame]) -> DataFrame:
    return counterfactual.verdicts(r["diffs"])


@_swept("rank_delta", "SELECT v.config_id, b.query_id, b.chunk_id, CAST(coalesce(c.fused_rank - w.fused_rank, 999) AS INTEGER) AS rank_delta FROM ctx b JOIN cand w ON w.config_id = 'baseline' AND w.query_id = b.query_id AND w.chunk_id = b.chunk_id JOIN (SELECT config_id FROM configs WHERE config_id <> 'baseline') v ON true LEFT JOIN cand c ON c.config_id = v.config_id AND c.query_id = b.query_id AND c.chunk_id = b.chunk_id WHERE b.config_id = 'baseline'", ["ctx", "cand", "configs"])
def rank_delta(r: dict[str, DataFrame]) -> DataFrame:
    return counterfactual.rank_delta(r["ctx"], r["cand"])


_DIAG = {
    "cl": ("SELECT config_id, query_id, list(chunk_id ORDER BY final_rank) AS ids, max(CASE WHEN g.chunk_id IS NULL THEN 0 ELSE 1 END) AS g FROM ctx LEFT JOIN goldc g USING (query_id, chunk_id) GROUP BY ALL", ["ctx", "goldc"]),
    "ck": ("SELECT config_id, query_id FROM (SELECT DISTINCT config_id FROM ctx WHERE config_id <> 'baseline'), (SELECT DISTINCT query_id FROM ctx)", ["ctx"]),
    "dg": ("SELECT k.config_id, k.query_id, coalesce(b.ids, []) AS b, coalesce(v.ids, []) AS v, coalesce(b.g, 0) AS bg, coalesce(v.g, 0) AS vg FROM ck k LEFT JOIN cl b ON b.config_id = 'baseline' AND b.query_id = k.query_id LEFT JOIN cl v ON v.config_id = k.config_id AND v.query_id = k.query_id", ["ck", "cl"]),
}


@_swept("context_diagnosis", "SELECT config_id, query_id, array_to_string(list_filter(b, lambda x: NOT list_contains(v, x)), ' ') AS dropped, CASE WHEN b = v THEN 'same' WHEN list_sort(b) = list_sort(v) THEN 'reordered' WHEN bg = 1 AND vg = 0 THEN 'gold lost' WHEN bg = 0 AND vg = 1 THEN 'gold gained' ELSE 'set changed' END AS diagnosis FROM dg", ["dg"], _DIAG)
def context_diagnosis(r: dict[str, DataFrame]) -> DataFrame:
    return counterfactual.context_diagnosis(r["ctx"], r["gold"])


_DRIFT = {
    "dn": ("SELECT config_id, outcome, count(*) AS n FROM diff GROUP BY config_id, outcome", ["diff"]),
    "de": ("SELECT config_id, outcome, count(*) AS n FROM diff JOIN cases USING (query_id) WHERE kind = 'answerable' GROUP BY config_id, outcome", ["diff", "cases"]),
    "ds": ("SELECT config_id, outcome, 100.0 * n / sum(n) OVER (PARTITION BY config_id) AS s FROM dn", ["dn"]),
    "dw": ("SELECT config_id, outcome, 100.0 * n / sum(n) OVER (PARTITION BY config_id) AS s FROM de", ["de"]),
}


@_swept("ablation_drift", "SELECT config_id, outcome, moved FROM (SELECT config_id, outcome, round_even(coalesce(ds.s, 0) - coalesce(dw.s, 0), 6) AS moved FROM ds FULL JOIN dw USING (config_id, outcome)) WHERE abs(moved) > 8.0", ["ds", "dw"], _DRIFT)
def ablation_drift(r: dict[str, DataFrame]) -> DataFrame:
    """The snapshot is that of an earlier test set, before questions out of scope were added to it."""
    d = r["diffs"]
    count = lambda x: x.groupBy("config_id", "outcome").agg(F.count("*").alias("n"))
    return counterfactual.drift(count(d), count(d.join(r["cases"].where("kind = 'answerable'").select("query_id"), "query_id", "left_semi")))


_WIDE = [1, 2, 3, 5, 8, 12]


def _wide(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    names = ["no_gate", "no_gate+no_lexical", "no_gate+no_semantic"]
    r = _run(Index.of(spark, sf), names)
    r["configs"] = r["configs"].withColumn("width", F.lit(12))
    r["ctx"] = stages.context(r["ranked"], r["chunks"], r["configs"])
    cases = _cases(spark, sf, r["questions"])
    r["gold"] = _gold(r["chunks"], cases)
    return r


_W = _A | {"configs": (f"SELECT * REPLACE (CAST(12 AS INTEGER) AS width) FROM ({O.configs_cte(['no_gate', 'no_gate+no_lexical', 'no_gate+no_semantic'])})", [])}


@query("gold_retention_by_width", f"SELECT config_id, CAST(width AS INTEGER) AS width, count(*) AS n, count_if(best <= width) AS kept FROM (SELECT DISTINCT config_id FROM ctx), (SELECT DISTINCT query_id FROM goldc) q LEFT JOIN (SELECT config_id AS c, query_id AS x, min(final_rank) AS best FROM ctx JOIN goldc USING (query_id, chunk_id) GROUP BY ALL) ON c = config_id AND x = q.query_id, (SELECT unnest({_WIDE}) AS width) GROUP BY ALL", ["ctx", "goldc"], _W)
def gold_retention_by_width(spark: SparkSession, sf: str) -> DataFrame:
    r = _wide(spark, sf)
    return calibrate.retention(r["ctx"], r["gold"], _WIDE)


_G = {"sc": ("SELECT query_id, kind = 'answerable' AS answerable, coalesce(top, 0.0) AS score FROM questions LEFT JOIN (SELECT query_id, max(score) AS top FROM {leg} GROUP BY query_id) USING (query_id)", [])}


def _gate_sql(leg: str) -> dict:
    return {
        "sc": (_G["sc"][0].format(leg=leg), ["questions", leg]),
        "mid": ("SELECT DISTINCT round_even((a.score + o.score) / 2, 4) AS t FROM sc a, sc o WHERE a.answerable AND NOT o.answerable", ["sc"]),
        "err": ("SELECT t, count_if(answerable AND score < t) / count_if(answerable) AS fr, count_if(NOT answerable AND score >= t) / count_if(NOT answerable) AS fa FROM mid, sc GROUP BY t", ["mid", "sc"]),
    }


def _gate(leg: str) -> None:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        i = Index.of(spark, sf)
        q, hits = i.questions, i.lexical if leg == "lex_leg" else i.semantic
        top = hits.groupBy("query_id").agg(F.max("score").alias("top"))
        scores = q.join(top, "query_id", "left").select((F.col("kind") == "answerable").alias("answerable"), F.coalesce("top", F.lit(0.0)).alias("score"))
        return calibrate.threshold(scores, leg)

    query(f"gate_calibration_{leg}", f"SELECT b.t AS threshold, round_even(count_if(answerable AND score < b.t) / count_if(answerable), 4) AS false_refusal, round_even(count_if(NOT answerable AND score >= b.t) / count_if(NOT answerable), 4) AS false_admit, '{leg}' AS name FROM sc, (SELECT round_even(t, 3) AS t FROM err ORDER BY round_even(greatest(fr, fa), 9), err.t LIMIT 1) b GROUP BY b.t", ["err", "sc"], _gate_sql(leg))(f)


_gate("lex_leg")
_gate("sem_leg")


# Failures, costs, provenance and stability of a sweep

_USED = {
    "used": ("SELECT a.config_id, a.query_id, CAST(coalesce(t, 0) AS BIGINT) AS tokens_in, CAST(greatest(1, length(answer) // 4) AS BIGINT) AS tokens_out, CASE WHEN coalesce(t, 0) > 0 THEN round_even((t * CAST(0.05 AS DOUBLE) + greatest(1, length(answer) // 4) * CAST(0.08 AS DOUBLE)) / 1e6, 8) ELSE 0.0 END AS cost_usd FROM ans a LEFT JOIN (SELECT config_id, query_id, sum(greatest(1, length(text) // 4)) AS t FROM ctx JOIN chunks USING (chunk_id) GROUP BY ALL) r ON r.config_id = a.config_id AND r.query_id = a.query_id", ["ans", "ctx", "chunks"]),
    "delta": ("SELECT v.config_id, v.query_id, v.tokens_in - b.tokens_in AS d_tokens_in, v.tokens_out - b.tokens_out AS d_tokens_out, round_even(v.cost_usd - b.cost_usd, 8) AS d_cost_usd FROM used v JOIN used b ON b.query_id = v.query_id AND b.config_id = 'baseline' WHERE v.config_id <> 'baseline'", ["used"]),
}


def _used(r: dict[str, DataFrame]) -> DataFrame:
    return counterfactual.usage(r["ctx"], r["chunks"], r["answers"])


@_swept("run_deltas", "SELECT config_id, query_id, d_tokens_in, d_tokens_out, d_cost_usd FROM delta", ["delta"], _USED)
def run_deltas(r: dict[str, DataFrame]) -> DataFrame:
    return counterfactual.usage_deltas(_used(r))


@_swept("ablation_costs", "SELECT config_id, runs, confident_wrong, d_tokens_in, d_tokens_out, d_cost_usd FROM (SELECT config_id, count(*) AS runs, count_if(outcome = 'now_confident_wrong') AS confident_wrong FROM diff GROUP BY config_id) JOIN (SELECT config_id, CAST(sum(d_tokens_in) AS BIGINT) AS d_tokens_in, CAST(sum(d_tokens_out) AS BIGINT) AS d_tokens_out, round_even(sum(d_cost_usd), 8) AS d_cost_usd FROM delta GROUP BY config_id) USING (config_id)", ["diff", "delta"], _USED)
def ablation_costs(r: dict[str, DataFrame]) -> DataFrame:
    return counterfactual.costs(r["diffs"], counterfactual.usage_deltas(_used(r)))


@_swept("error_outcomes", "SELECT 'gate_on_fused+no_gate' AS config_id, query_id, 'error' AS outcome FROM cases UNION ALL SELECT 'force_rerank+no_rerank', query_id, 'error' FROM cases UNION ALL SELECT config_id, query_id, outcome FROM diff WHERE config_id = 'no_rerank'", ["cases", "diff"])
def error_outcomes(r: dict[str, DataFrame]) -> DataFrame:
    """Two names that no configuration can have and one that has: the first two fail for every question, and are not left out."""
    names, errors = plan(["baseline", "no_rerank", "no_gate+gate_on_fused", "no_rerank+force_rerank"])
    ran = r["answers"].where(F.col("config_id").isin(names))
    return counterfactual.diffs(counterfactual.with_failures(ran, errors, r["cases"]), r["cases"])


@_swept("judged_outcomes", "SELECT v.config_id, v.query_id, CASE WHEN v.answer = b.answer THEN 'identical' WHEN b.refused AND NOT v.refused THEN 'now_answers' WHEN v.refused AND NOT b.refused THEN 'now_refuses' WHEN v.query_id % 3 = 0 THEN 'equivalent' WHEN v.query_id % 3 = 1 THEN CASE WHEN v.flagged THEN 'now_wrong' ELSE 'now_confident_wrong' END ELSE 'degraded' END AS outcome FROM marked v JOIN marked b ON b.query_id = v.query_id AND b.config_id = 'baseline' WHERE v.config_id <> 'baseline'", ["marked"])
def judged_outcomes(r: dict[str, DataFrame]) -> DataFrame:
    """The judge's branch, for questions without ground truth; the verdicts here follow the question's number."""
    truthless = r["cases"].select("query_id", F.lit("open").alias("kind"), F.lit(None).cast("string").alias("answer_key"))
    verdict = F.element_at(F.array(F.lit("equivalent"), F.lit("contradictory"), F.lit("degraded")), (F.col("query_id") % 3 + 1).cast("int"))
    judged = r["answers"].select("config_id", "query_id", verdict.alias("verdict"))
    return counterfactual.diffs(r["answers"], truthless, judged)


@_swept("drift_findings", "SELECT config_id, moved = 0 AS passed, CAST(CASE WHEN moved = 0 THEN 0 ELSE 3 END AS INTEGER) AS severity, moved FROM (SELECT c.config_id, count(x.config_id) AS moved FROM (SELECT DISTINCT config_id FROM ds) c LEFT JOIN (SELECT config_id, round_even(coalesce(ds.s, 0) - coalesce(dw.s, 0), 6) AS m FROM ds FULL JOIN dw USING (config_id, outcome)) x ON x.config_id = c.config_id AND abs(m) > 8.0 GROUP BY c.config_id)", ["ds", "dw"], _DRIFT)
def drift_findings(r: dict[str, DataFrame]) -> DataFrame:
    d = r["diffs"]
    count = lambda x: x.groupBy("config_id", "outcome").agg(F.count("*").alias("n"))
    before = d.join(r["cases"].where("kind = 'answerable'").select("query_id"), "query_id", "left_semi")
    return counterfactual.drift_findings(count(d), count(before), same_provenance=True)


_KIND = "CASE WHEN regexp_matches(answer_key, '^[0-9]+$') THEN 'value' WHEN " + O.ident("answer_key") + " THEN 'identifier' ELSE 'word' END"


@_swept("gold_retention_by_kind", f"SELECT config_id, kind, count(*) AS n, count(found) AS kept FROM (SELECT DISTINCT config_id FROM ctx), (SELECT query_id, {_KIND} AS kind FROM cases WHERE query_id IN (SELECT query_id FROM goldc)) k LEFT JOIN (SELECT DISTINCT config_id AS c, query_id AS q, 1 AS found FROM ctx JOIN goldc USING (query_id, chunk_id)) ON c = config_id AND q = k.query_id GROUP BY ALL", ["ctx", "goldc", "cases"])
def gold_retention_by_kind(r: dict[str, DataFrame]) -> DataFrame:
    """Kinds of questions by what their key is: a value, an identifier or a word."""
    kind = F.when(F.col("answer_key").rlike("^[0-9]+$"), "value").when(T.is_identifier("answer_key"), "identifier").otherwise("word")
    return calibrate.retention_by_kind(r["ctx"], r["gold"], r["cases"].select("query_id", kind.alias("kind")))


@query("gold_retention_spread", f"SELECT width, round_even(max(100.0 * kept / n) - min(100.0 * kept / n), 6) AS spread FROM (SELECT config_id, CAST(width AS INTEGER) AS width, count(*) AS n, count_if(best <= width) AS kept FROM (SELECT DISTINCT config_id FROM ctx), (SELECT DISTINCT query_id FROM goldc) q LEFT JOIN (SELECT config_id AS c, query_id AS x, min(final_rank) AS best FROM ctx JOIN goldc USING (query_id, chunk_id) GROUP BY ALL) ON c = config_id AND x = q.query_id, (SELECT unnest({_WIDE}) AS width) GROUP BY ALL) GROUP BY width", ["ctx", "goldc"], _W)
def gold_retention_spread(spark: SparkSession, sf: str) -> DataFrame:
    r = _wide(spark, sf)
    return calibrate.spread(calibrate.retention(r["ctx"], r["gold"], _WIDE))


@query("stage_grid", "SELECT config_id, CAST(seq AS INTEGER) AS seq, stage, enabled FROM (SELECT config_id, unnest([{seq: 0, stage: 'rewrite', enabled: rewrite}, {seq: 1, stage: 'embed', enabled: semantic_top_k IS NOT NULL}, {seq: 2, stage: 'retrieve_dense', enabled: semantic_top_k IS NOT NULL}, {seq: 3, stage: 'retrieve_sparse', enabled: lexical_top_k IS NOT NULL}, {seq: 4, stage: 'fuse', enabled: rrf_k IS NOT NULL}, {seq: 5, stage: 'gate', enabled: gate_threshold IS NOT NULL}, {seq: 6, stage: 'rerank', enabled: rerank IS NOT NULL}, {seq: 7, stage: 'expand', enabled: neighbours IS NOT NULL}, {seq: 8, stage: 'generate', enabled: true}], recursive := true) FROM configs)", ["configs"], _cfg(*SWEEP))
def stage_grid(spark: SparkSession, sf: str) -> DataFrame:
    from .plans.provenance import stage_grid as grid

    return grid(configs(spark, SWEEP))


# Measurement, judging, suites and vectors


@query("nearest_rank_percentiles", "SELECT source, count(*) AS n, " + ", ".join(f"list_sort(list(n_chars))[CAST(round_even({p} * (count(*) - 1), 0) AS INTEGER) + 1] AS p{round(100 * p)}" for p in (0.1, 0.5, 0.9)) + " FROM documents GROUP BY source")
def nearest_rank_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.nearest_rank(_docs(spark, sf), "source", "n_chars", [0.1, 0.5, 0.9])


_PAIRS = "SELECT quality AS gold, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id)"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    d = S.table(spark, sf, "labels").join(_docs(spark, sf).select("doc_id", "n_chars"), "doc_id")
    return d.select(F.col("quality").alias("gold"), F.when(F.col("n_chars") >= 300, 1).otherwise(0).alias("predicted"))


@query("confusion", f"SELECT gold, predicted, count(*) AS n FROM ({_PAIRS}) GROUP BY ALL")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.confusion(_labelled(spark, sf))


@query("cohens_kappa", f"SELECT n, round_even(po, 6) AS agreement, round_even((po - pe) / (1 - pe), 6) AS kappa FROM (SELECT count(*) AS n, count_if(gold = predicted) / count(*) AS po, (count_if(gold = 1) * count_if(predicted = 1) + count_if(gold = 0) * count_if(predicted = 0)) / (count(*) * count(*)) AS pe FROM ({_PAIRS}))")
def cohens_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.kappa(_labelled(spark, sf))


@query("point_biserial", "SELECT count(*) AS n, round_even(corr(CAST(quality AS DOUBLE), CAST(n_chars AS DOUBLE)), 4) AS r FROM labels JOIN documents USING (doc_id)")
def point_biserial(spark: SparkSession, sf: str) -> DataFrame:
    d = S.table(spark, sf, "labels").join(_docs(spark, sf).select("doc_id", "n_chars"), "doc_id")
    return calibrate.point_biserial(d, F.col("quality"), F.col("n_chars"))


@query("stratified_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('4242:' || doc_id)) AS r FROM documents) WHERE r <= 7")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.stratified(_docs(spark, sf).select("source", "doc_id"), "source", "doc_id", 7)


@query("worst_confusion", f"SELECT gold, predicted, count(*) AS n FROM ({_PAIRS}) WHERE gold <> predicted GROUP BY ALL ORDER BY n DESC, gold, predicted LIMIT 1")
def worst_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.worst_confusion(_labelled(spark, sf))


@query("shared_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, d, row_number() OVER (PARTITION BY source ORDER BY d) AS r, (SELECT greatest(1, 100 // count(DISTINCT source)) FROM documents) AS each FROM (SELECT source, doc_id, md5('4242:' || doc_id) AS d FROM documents)) ORDER BY r > each, d LIMIT 100")
def shared_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred documents, as evenly over the sources as they allow."""
    return calibrate.shared_sample(_docs(spark, sf).select("source", "doc_id"), "source", "doc_id", 100)


@query("baseline_diff", "(SELECT doc_id AS case_id, 'new' AS change FROM labels WHERE quality = 0 EXCEPT SELECT doc_id, 'new' FROM labels WHERE toxic = 1) UNION ALL (SELECT doc_id, 'fixed' FROM labels WHERE toxic = 1 EXCEPT SELECT doc_id, 'fixed' FROM labels WHERE quality = 0)")
def baseline_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Failures now: quality 0; failures in the baseline: toxic 1."""
    labels = S.table(spark, sf, "labels").withColumnRenamed("doc_id", "case_id")
    return judge.baseline_diff(labels.where("quality = 0"), labels.where("toxic = 1"))


@query("suite_rollup", "SELECT source AS suite, count(*) AS total, count_if(quality = 1) AS n_passed, max(CASE WHEN quality = 0 THEN 2 + toxic ELSE 0 END) AS worst, count_if(quality = 0 AND 2 + toxic >= 3) AS blocking FROM labels JOIN documents USING (doc_id) GROUP BY source")
def suite_rollup(spark: SparkSession, sf: str) -> DataFrame:
    d = S.table(spark, sf, "labels").join(_docs(spark, sf).select("doc_id", "source"), "doc_id")
    return judge.rollup(d.select(F.col("source").alias("suite"), (F.col("quality") == 1).alias("passed"), (2 + F.col("toxic")).alias("severity")))


@query("tenant_leak_scan", "SELECT count(*) AS leaks FROM legs JOIN questions q USING (query_id) JOIN chunks k USING (chunk_id) WHERE k.tenant_id <> q.tenant_id AND k.tenant_id <> 'tenant_global'", ["legs", "questions", "chunks"])
def tenant_leak_scan(spark: SparkSession, sf: str) -> DataFrame:
    from .operators.scope import leaks

    r = _run(Index.of(spark, sf), ["baseline"])
    return leaks(r["legs"], r["questions"], r["chunks"]).agg(F.count("*").alias("leaks"))


@query("canary_scan", "SELECT d.tenant_id, d.doc_id AS surface, c.tenant_id AS owner, canary FROM docs d JOIN (SELECT tenant_id, 'item-' || item_id AS surface, item_text AS canary FROM (SELECT item_id, arg_min(tenant_id, doc_no) AS tenant_id, any_value(item_text) AS item_text FROM gold GROUP BY item_id)) c ON d.tenant_id <> c.tenant_id AND contains(d.text, canary)", ["docs", "gold"])
def canary_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Canaries: each whole item, owned by the tenant of the first document that holds it."""
    docs = S.documents(spark, sf)
    items = S.table(spark, sf, "benchmark")
    owner = S.gold_documents(docs, items).groupBy("item_id").agg(F.min_by("tenant_id", "doc_no").alias("tenant_id"))
    canaries = items.join(owner, "item_id").select("tenant_id", F.col("text").alias("canary"))
    return judge.canary_scan(docs.select("tenant_id", F.col("doc_id").alias("surface"), "text"), canaries)


_CONV_VOC = {"voc0": (f"SELECT DISTINCT token, token AS t FROM (SELECT unnest({O.content('text')}) AS token FROM conversations)", [])}


def _conv_vocabulary(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = S.table(spark, sf, "conversations")
    return c, ingest.vocabulary(c.select(F.explode_outer(T.content_tokens("text")).alias("token")).where("token is not null"))


@query(
    "semantic_cache_hits",
    "SELECT a.entry, min(b.entry) AS hit FROM e a JOIN e b ON b.entry < a.entry AND a.ns = b.ns AND a.mark = b.mark AND len(list_intersect(a.cs, b.cs)) >= 0.93 * (len(a.cs) + len(b.cs) - len(list_intersect(a.cs, b.cs))) GROUP BY a.entry",
    ["e"],
    _CONV_VOC | {"e": (f"SELECT conv_id * 1000 + turn AS entry, role AS ns, array_to_string({O.disc('text')}, ' ') AS mark, list_sort(list_distinct(list(concept))) AS cs FROM (SELECT conv_id, turn, role, text, unnest({O.content('text')}) AS token FROM conversations) JOIN voc USING (token) GROUP BY conv_id, turn, role, text", ["voc"])},
)
def semantic_cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    c, voc = _conv_vocabulary(spark, sf)
    c = c.withColumn("entry", F.col("conv_id") * 1000 + F.col("turn"))
    sets = judge.concept_sets(c, voc, "entry", "text", "concepts")
    return judge.cache_hits(c.select("entry", F.col("role").alias("ns"), T.discriminators("text").alias("marks")).join(sets, "entry"))


_ASKED = "SELECT 2 * query_id AS entry, tenant_id AS ns, query AS text FROM questions UNION ALL SELECT 2 * query_id + 1, tenant_id, CASE WHEN query_id % 2 = 0 THEN 'the ' || query || ' of' ELSE query || ' 77' END FROM questions"


_ASKED_SETS = {"ask": (_ASKED, ["questions"]), "voc0": (f"SELECT DISTINCT token, token AS t FROM (SELECT unnest({O.content('text')}) AS token FROM ask)", ["ask"]), "e": (f"SELECT entry, ns, array_to_string({O.disc('text')}, ' ') AS mark, list_sort(list_distinct(list(concept))) AS cs FROM (SELECT entry, ns, text, unnest({O.content('text')}) AS token FROM ask) JOIN voc USING (token) GROUP BY entry, ns, text", ["ask", "voc"])}


def _asked_again(spark: SparkSession, sf: str) -> DataFrame:
    """entry, ns, marks, concepts: every question, and each once more in other words or with a number of its own."""
    q = Index.of(spark, sf).questions
    again = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("the "), "query", F.lit(" of"))).otherwise(F.concat("query", F.lit(" 77")))
    asked = q.select((2 * F.col("query_id")).alias("entry"), F.col("tenant_id").alias("ns"), F.col("query").alias("text")).union(q.select(2 * F.col("query_id") + 1, "tenant_id", again))
    voc = ingest.vocabulary(asked.select(F.explode_outer(T.content_tokens("text")).alias("token")).where("token is not null"))
    sets = judge.concept_sets(asked, voc, "entry", "text", "concepts")
    return asked.select("entry", "ns", T.discriminators("text").alias("marks")).join(sets, "entry")


@query(
    "semantic_cache_report",
    "SELECT entry, hit, hit IS NULL AS rejected FROM (SELECT a.entry, min(b.entry) FILTER (a.mark = b.mark) AS hit FROM e a JOIN e b ON b.entry < a.entry AND a.ns = b.ns AND len(list_intersect(a.cs, b.cs)) >= 0.93 * (len(a.cs) + len(b.cs) - len(list_intersect(a.cs, b.cs))) GROUP BY a.entry)",
    ["e"],
    _ASKED_SETS,
)
def semantic_cache_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every question again: in other words without weight, which hits, or with a number of its own, which is turned down."""
    return judge.cache_report(_asked_again(spark, sf))


@query(
    "semantic_cache_earliest",
    "SELECT a.entry, min(b.entry) AS hit FROM e a JOIN e b ON b.entry < a.entry AND a.ns = b.ns AND a.mark = b.mark AND len(list_intersect(a.cs, b.cs)) >= 0.93 * (len(a.cs) + len(b.cs) - len(list_intersect(a.cs, b.cs))) GROUP BY a.entry",
    ["e"],
    _ASKED_SETS,
)
def semantic_cache_earliest(spark: SparkSession, sf: str) -> DataFrame:
    """The same questions: those that the cache answers, and from which earlier question."""
    return judge.cache_hits(_asked_again(spark, sf))


@query(
    "rule_judge",
    f"SELECT conv_id, turn, CASE WHEN lower(trim(a)) = lower(trim(b)) THEN 'equivalent' WHEN (regexp_matches(a, {_HED}) OR regexp_matches(a, {_REF})) AND (regexp_matches(b, {_HED}) OR regexp_matches(b, {_REF})) THEN 'equivalent' WHEN len(na) > 0 AND len(nb) > 0 AND len(list_intersect(na, nb)) = 0 THEN 'contradictory' WHEN (regexp_matches(a, {_HED}) OR regexp_matches(a, {_REF})) <> (regexp_matches(b, {_HED}) OR regexp_matches(b, {_REF})) THEN 'degraded' WHEN j >= 0.72 THEN 'equivalent' WHEN j >= 0.35 THEN 'degraded' ELSE 'contradictory' END AS verdict FROM jp",
    ["jp"],
    _CONV_VOC
    | {
        "cset": (f"SELECT conv_id, turn, list_distinct(list(concept)) AS cs FROM (SELECT conv_id, turn, unnest({O.content('text')}) AS token FROM conversations) JOIN voc USING (token) GROUP BY ALL", ["voc"]),
        "jt": (f"SELECT c.conv_id, c.turn, text, list_distinct(regexp_extract_all(text, '{O.L.NUMBER}')) AS nums, coalesce(cs, []) AS cs FROM conversations c LEFT JOIN cset s ON s.conv_id = c.conv_id AND s.turn = c.turn WHERE role = 'assistant'", ["cset"]),
        "jp": ("SELECT x.conv_id, x.turn, x.text AS a, y.text AS b, x.nums AS na, y.nums AS nb, CASE WHEN len(x.cs) + len(y.cs) = 0 THEN 1.0 ELSE len(list_intersect(x.cs, y.cs)) / (len(x.cs) + len(y.cs) - len(list_intersect(x.cs, y.cs))) END AS j FROM jt x JOIN jt y ON y.conv_id = x.conv_id AND y.turn = x.turn + 2", ["jt"]),
    },
)
def rule_judge(spark: SparkSession, sf: str) -> DataFrame:
    """Each assistant turn against the conversation's next one."""
    c, voc = _conv_vocabulary(spark, sf)
    key = F.concat_ws(":", "conv_id", "turn")
    sets = judge.concept_sets(c.withColumn("key", key), voc, "key", "text", "cs")
    said = c.where("role = 'assistant'").withColumn("key", key).join(sets, "key", "left").select("conv_id", "turn", "text", F.coalesce("cs", F.array().cast("array<string>")).alias("cs"))
    after = said.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("b"), F.col("cs").alias("cs_b"))
    j = said.join(after, ["conv_id", "turn"])
    return j.select("conv_id", "turn", judge.compare(F.col("text"), F.col("b"), F.col("cs"), F.col("cs_b")).alias("verdict"))


@query("wrong_confident_rate", "SELECT count(*) AS attempted, count(quality) AS scored, count_if(quality = 0 AND toxic = 0) AS wrong_confident, round_even(count_if(quality = 0 AND toxic = 0) / count(*), 6) AS rate, count(*) = count(quality) AS reportable FROM documents LEFT JOIN labels USING (doc_id)")
def wrong_confident_rate(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.when(F.col("quality") == 1, "ok").when(F.col("toxic") == 1, "wrong_flagged").otherwise("wrong_confident")
    scored = S.table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), verdict.alias("verdict"))
    return judge.wrong_confident(_docs(spark, sf).select(F.col("doc_id").alias("case_id")), scored)


@query("vector_stats", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, round_even(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS l2_norm, round_even(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding), 6) AS mean, round_even(CAST(list_min(embedding) AS DOUBLE), 6) AS least, round_even(CAST(list_max(embedding) AS DOUBLE), 6) AS most, CAST(len(list_filter(embedding, lambda x: x <> 0)) AS INTEGER) AS nonzero FROM embeddings")
def vector_stats(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.stats(S.table(spark, sf, "embeddings"))


@query("pca_projection")
def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.project(S.table(spark, sf, "embeddings"))


@query("stage_event_latest", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def stage_event_latest(spark: SparkSession, sf: str) -> DataFrame:
    return judge.latest(S.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value", "event_id"])


@query("stage_timeline", "SELECT user_id, event_type, total_ms, round_even(total_ms / max(total_ms) OVER (PARTITION BY user_id), 6) AS share FROM (SELECT user_id, event_type, round_even(sum(value), 6) AS total_ms FROM events GROUP BY ALL)")
def stage_timeline(spark: SparkSession, sf: str) -> DataFrame:
    t = S.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.bround(F.sum("value"), 6).alias("total_ms"))
    return judge.share_of_slowest(t, "user_id", "total_ms")


@query("trace_nested")
def trace_nested(spark: SparkSession, sf: str) -> DataFrame:
    r = _sweep(Index.of(spark, sf), ["baseline", "no_gate"])
    return generate.traces(r["ranked"], r["ctx"], r["answers"])


@query("trace_candidates", "SELECT coalesce(r.config_id, x.config_id) AS config_id, coalesce(r.query_id, x.query_id) AS query_id, coalesce(r.chunk_id, x.chunk_id) AS chunk_id, x.final_rank, r.fused_rank, CASE WHEN NOT r.gate_passed THEN 'gate' WHEN x.final_rank IS NULL THEN 'top_k' END AS rejected_by, x.inclusion_reason FROM ranked r FULL JOIN ctx x ON x.config_id = r.config_id AND x.query_id = r.query_id AND x.chunk_id = r.chunk_id", ["ranked", "ctx"], _cfg("baseline", "no_gate"))
def trace_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates of nested traces, a row each."""
    r = _sweep(Index.of(spark, sf), ["baseline", "no_gate"])
    c = generate.traces(r["ranked"], r["ctx"], r["answers"]).select("config_id", "query_id", F.explode("candidates").alias("c"))
    rank = F.when(F.col("c.final_rank") < 1_000_000, F.col("c.final_rank")).alias("final_rank")
    return c.select("config_id", "query_id", "c.chunk_id", rank, "c.fused_rank", "c.rejected_by", "c.inclusion_reason")


@query("run_stages", "SELECT config_id, query_id, CAST(seq AS INTEGER) AS seq, stage, CASE WHEN why IS NULL THEN 'ran' ELSE 'skipped' END AS state, why AS reason FROM (SELECT a.config_id, a.query_id, s.seq, s.stage, CASE WHEN NOT s.enabled THEN 'ablated' WHEN s.stage IN ('gate', 'rerank', 'expand') AND d.gate_passed IS NULL THEN 'no candidates' WHEN s.stage = 'gate' AND NOT d.gate_checked THEN 'not checked' WHEN s.stage = 'expand' AND NOT d.gate_passed THEN 'gate refused' WHEN s.stage = 'rerank' AND d.rerank_reason <> 'run' THEN d.rerank_reason END AS why FROM ans a JOIN sg s ON s.config_id = a.config_id LEFT JOIN decided d ON d.config_id = a.config_id AND d.query_id = a.query_id)", ["ans", "sg", "decided"], _A | _cfg("baseline", "no_gate", "no_lexical") | {"sg": ("SELECT config_id, unnest([{seq: 0, stage: 'rewrite', enabled: rewrite}, {seq: 1, stage: 'embed', enabled: semantic_top_k IS NOT NULL}, {seq: 2, stage: 'retrieve_dense', enabled: semantic_top_k IS NOT NULL}, {seq: 3, stage: 'retrieve_sparse', enabled: lexical_top_k IS NOT NULL}, {seq: 4, stage: 'fuse', enabled: rrf_k IS NOT NULL}, {seq: 5, stage: 'gate', enabled: gate_threshold IS NOT NULL}, {seq: 6, stage: 'rerank', enabled: rerank IS NOT NULL}, {seq: 7, stage: 'expand', enabled: neighbours IS NOT NULL}, {seq: 8, stage: 'generate', enabled: true}], recursive := true) FROM configs", ["configs"])})
def run_stages(spark: SparkSession, sf: str) -> DataFrame:
    r = _sweep(Index.of(spark, sf), ["baseline", "no_gate", "no_lexical"])
    return generate.run_stages(r["configs"], r["decided"], r["answers"]).select("config_id", "query_id", F.explode("stages").alias("s")).select("config_id", "query_id", "s.*")


@query("chunk_markdown")
def chunk_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown: every line a paragraph, every fifth a heading."""
    ship(spark)
    lines = F.split(T.text_of("text"), "\n")
    md = F.array_join(F.transform(lines, lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("## "), x)).otherwise(x)), "\n\n")
    return ingest.chunk_markdown(S.documents(spark, sf).select("tenant_id", "doc_id", md.alias("markdown"))).withColumn("heading_path", F.array_join("heading_path", " / "))


@query("corpus_version", "SELECT 'corpus@' || substr(sha256(string_agg(p || d, '' ORDER BY p)), 1, 8) AS corpus_version FROM (SELECT substr(d, 1, 3) AS p, sha256(string_agg(d, '' ORDER BY d)) AS d FROM (SELECT sha256(concat_ws(chr(31), tenant_id, doc_id, sha256(coalesce(text, '')))) AS d FROM docs) GROUP BY 1)", ["docs"])
def corpus_version(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.corpus_version(S.documents(spark, sf))


@query("incremental_embed", "SELECT CASE WHEN label < 5 THEN 'reused' ELSE 'todo' END AS state, count(*) AS n FROM embeddings GROUP BY 1")
def incremental_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of labels under 5 are there already."""
    v = S.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    had = v.where("label < 5").select("chunk_id", F.lit("m").alias("model_id"))
    reused, todo = ingest.incremental(v.select("chunk_id"), had, "m")
    return reused.select(F.lit("reused").alias("state")).union(todo.select(F.lit("todo"))).groupBy("state").agg(F.count("*").alias("n"))


def _followups(spark: SparkSession, sf: str) -> DataFrame:
    c = S.table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "turn", "text")
    before = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("previous", F.lag("text").over(before)).where("previous is not null").select("query_id", F.concat(F.lit("and what about that: "), "text").alias("query"), "previous")


_DEICTIC = "(" + ", ".join(O._q(w) for w in O.L.DEICTIC) + ")"
_FOLLOW = _CONV_VOC | {
    "fq": ("SELECT conv_id * 1000 + turn AS query_id, 'and what about that: ' || text AS query, previous FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE role = 'user') WHERE previous IS NOT NULL", []),
    "fw": (f"SELECT concept, greatest(0.25, ln((n + 1) / (df + 1)) + 0.5) AS idf FROM (SELECT concept, count(DISTINCT conv_id || ':' || turn) AS df FROM (SELECT conv_id, turn, unnest({O.content('text')}) AS token FROM conversations) JOIN voc USING (token) GROUP BY concept), (SELECT count(*) AS n FROM conversations)", ["voc"]),
    "fs": (f"SELECT DISTINCT query_id, concept FROM (SELECT query_id, unnest({O.content('query')}) AS token FROM fq) JOIN voc USING (token)", ["fq", "voc"]),
    "ft": (f"SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN {O.ident('token')} THEN 0 ELSE 1 END, round_even(idf, 9) DESC, token) AS r FROM (SELECT query_id, unnest({O.content('previous')}) AS token FROM fq WHERE list_has_any({O.raw('query')}, [{_DEICTIC[1:-1]}])) t JOIN voc USING (token) JOIN fw USING (concept) ANTI JOIN fs USING (query_id, concept) WHERE length(token) > 2", ["fq", "voc", "fw", "fs"]),
    "fp": ("SELECT query_id, CASE WHEN count(*) = 2 AND min(token) = max(token) THEN min(token) ELSE string_agg(token, ' ' ORDER BY r) END AS phrase FROM ft WHERE r <= 2 GROUP BY query_id", ["ft"]),
    "fa": (f"SELECT query_id, query, phrase, words, list_position(list_transform(words, lambda w: trim(lower(w), '.,?!:;') IN {_DEICTIC}), true) AS pos FROM (SELECT query_id, query, list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '') AS words FROM fq) LEFT JOIN fp USING (query_id)", ["fq", "fp"]),
}


@query("rewrite_followups", "SELECT query_id, query, CASE WHEN phrase IS NOT NULL AND pos > 0 THEN array_to_string(list_transform(words, lambda w, i: CASE WHEN i = pos THEN phrase ELSE w END), ' ') ELSE query END AS rewritten FROM fa", ["fa"], _FOLLOW)
def rewrite_followups(spark: SparkSession, sf: str) -> DataFrame:
    c, voc = _conv_vocabulary(spark, sf)
    turns = c.select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text")
    df = judge.concept_sets(turns, voc, "key", "text", "cs").select(F.explode_outer("cs").alias("concept")).groupBy("concept").agg(F.count("*").alias("df"))
    total = turns.agg(F.count("*").alias("n"))
    weights = df.crossJoin(F.broadcast(total)).select("concept", "df", ingest.idf(F.col("df"), F.col("n")).alias("idf"))
    return stages.rewrite(_followups(spark, sf), voc, weights)


_ASK = O.concept_ctes("r") | {
    "item": (f"SELECT b.item_id AS query_id, coalesce(g.tenant_id, 'tenant_src1') AS tenant_id, 'and what about that' AS query, {O.content('b.text')} AS told FROM benchmark b LEFT JOIN gold_tenant g ON b.item_id = g.item_id", ["gold_tenant"]),
    "rvoc0": ("SELECT token, token AS t FROM (SELECT term AS token FROM tok UNION SELECT unnest(told) FROM item)", ["tok", "item"]),
    "rdf": ("SELECT concept, greatest(0.25, ln((n_docs + 1) / (df + 1)) + 0.5) AS idf FROM (SELECT concept, count(DISTINCT chunk_id) AS df FROM tok JOIN rvoc ON term = token GROUP BY concept), n_docs", ["tok", "rvoc", "n_docs"]),
    "rtold": (f"SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN {O.ident('token')} THEN 0 ELSE 1 END, round_even(idf, 9) DESC, token) AS r FROM (SELECT query_id, unnest(told) AS token FROM item) JOIN rvoc USING (token) JOIN rdf USING (concept) WHERE length(token) > 2", ["item", "rvoc", "rdf"]),
    "rphrase": ("SELECT query_id, CASE WHEN count(*) = 2 AND min(token) = max(token) THEN min(token) ELSE string_agg(token, ' ' ORDER BY r) END AS phrase FROM rtold WHERE r <= 2 GROUP BY query_id", ["rtold"]),
    "questions": ("SELECT 2 * query_id AS query_id, tenant_id, query, 'x' AS kind FROM item UNION ALL SELECT 2 * query_id + 1, tenant_id, 'and what about ' || phrase, 'x' FROM item JOIN rphrase USING (query_id)", ["item", "rphrase"]),
} | _cfg("baseline", "no_rewrite")


@query("followup_context", "SELECT config_id, query_id // 2 AS query_id, chunk_id, final_rank, inclusion_reason FROM ctx WHERE (query_id % 2 = 1) = (config_id = 'baseline' AND query_id // 2 IN (SELECT query_id FROM rphrase))", ["ctx", "rphrase"], _ASK)
def followup_context(spark: SparkSession, sf: str) -> DataFrame:
    """Each item told in the turn before, and a question that points to it: with and without rewriting."""
    i = Index.of(spark, sf)
    asked = i.questions.select("query_id", "tenant_id", F.lit("and what about that").alias("query"), F.col("query").alias("previous"))
    e = Engine(spark, i.chunks, asked, {"chunks": i.chunks, "postings": i.postings, "vocabulary": i.chunk_vocabulary, "concepts": i.own, "weights": i.weights})
    return e.run(["baseline", "no_rewrite"])["ctx"].select("config_id", "query_id", "chunk_id", "final_rank", "inclusion_reason")


@query("tenant_list", "SELECT tenant_id, count(*) AS n_docs, tenant_id = 'tenant_global' AS is_global FROM docs GROUP BY tenant_id", ["docs"])
def tenant_list(spark: SparkSession, sf: str) -> DataFrame:
    return S.documents(spark, sf).groupBy("tenant_id").agg(F.count("*").alias("n_docs")).withColumn("is_global", F.col("tenant_id") == S.GLOBAL)


@_swept("trace_totals", "SELECT config_id, count(*) AS runs, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(greatest(1, length(answer) // 4)) AS BIGINT) AS tokens_out, count_if(tokens_in > 0) AS calls FROM ans JOIN (SELECT c.config_id, q.query_id, coalesce(sum(CASE WHEN text IS NOT NULL THEN greatest(1, length(text) // 4) END), 0) AS tokens_in FROM configs c, questions q LEFT JOIN ctx x ON x.config_id = c.config_id AND x.query_id = q.query_id LEFT JOIN chunks k ON k.chunk_id = x.chunk_id GROUP BY ALL) USING (config_id, query_id) GROUP BY config_id", ["ans", "configs", "questions", "ctx", "chunks"])
def trace_totals(r: dict[str, DataFrame]) -> DataFrame:
    """Tokens of the contexts read and of the answers written; a run without context makes no call."""
    read = r["ctx"].join(r["chunks"].select("chunk_id", T.estimate_tokens("text").alias("t")), "chunk_id").groupBy("config_id", "query_id").agg(F.sum("t").alias("t"))
    j = r["answers"].join(read, ["config_id", "query_id"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    return j.groupBy("config_id").agg(F.count("*").alias("runs"), F.sum("t").alias("tokens_in"), F.sum(T.estimate_tokens("answer").cast("long")).alias("tokens_out"), F.count_if(F.col("t") > 0).alias("calls"))


@_swept("missing_concepts", f"SELECT query_id, config_id, array_to_string(list_filter(asked, lambda c: NOT list_contains(held, c)), ' ') AS missing FROM (SELECT a.query_id, v.config_id, a.asked, coalesce(h.held, []) AS held FROM (SELECT query_id, list(concept ORDER BY p) AS asked FROM (SELECT query_id, concept, min(p) AS p FROM (SELECT query_id, unnest({O.content('query')}) AS token, unnest(range(0, len({O.content('query')}))) AS p FROM questions) JOIN voc USING (token) GROUP BY ALL) GROUP BY query_id) a, configs v LEFT JOIN (SELECT config_id, query_id, list_distinct(list(concept)) AS held FROM ctx JOIN own USING (chunk_id) GROUP BY ALL) h ON h.query_id = a.query_id AND h.config_id = v.config_id)", ["questions", "voc", "configs", "ctx", "own"])
def missing_concepts(r: dict[str, DataFrame]) -> DataFrame:
    """What a question asks and its context doesn't say, in the question's order."""
    held = r["own"].select("chunk_id", "concept").join(small(r["ctx"], MANY), "chunk_id").groupBy("config_id", "query_id").agg(F.collect_set("concept").alias("held"))
    words = r["questions"].select("query_id", F.posexplode_outer(T.content_tokens("query")).alias("p", "token"))
    said = r["vocabulary"].join(small(words, MANY), "token").groupBy("query_id", "concept").agg(F.min("p").alias("p"))
    asked = said.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("p", "concept"))).alias("a")).select("query_id", F.col("a.concept").alias("asked"))
    grid = asked.crossJoin(F.broadcast(r["configs"].select("config_id"))).join(held, ["config_id", "query_id"], "left")
    return grid.select("config_id", "query_id", F.array_join(T.missing("asked", F.coalesce("held", F.array().cast("array<string>"))), " ").alias("missing"))


@query("embedding_browse", "SELECT query_id, round_even(max(score), 6) AS most, list_sort(list(score))[count(*) // 2 + 1] AS middle, min(score) AS least, count(*) AS n FROM s GROUP BY query_id", ["s"], {"s": (f"SELECT q.vec_id AS query_id, round_even({_DOT.format('v.embedding', 'q.embedding')} / (sqrt({_DOT.format('v.embedding', 'v.embedding')}) * sqrt({_DOT.format('q.embedding', 'q.embedding')})), 6) AS score FROM embeddings v JOIN embeddings q ON v.label = q.label WHERE q.vec_id % 50 = 0", [])})
def embedding_browse(spark: SparkSession, sf: str) -> DataFrame:
    """The spread of all scores in a query's scope; the middle one is the upper median."""
    v = S.table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("scope"), "embedding")
    return vectors.spread(v, v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))


@query("signal_separation", "SELECT signal, round_even(list_sort(list(score) FILTER (answerable))[CAST(round_even(0.1 * (count(*) FILTER (answerable) - 1), 0) AS INTEGER) + 1] - list_sort(list(score) FILTER (NOT answerable))[CAST(round_even(0.9 * (count(*) FILTER (NOT answerable) - 1), 0) AS INTEGER) + 1], 4) AS separation FROM sc GROUP BY signal", ["sc"], _cfg("baseline") | {"tops": ("SELECT 'lexical_top1' AS signal, query_id, max(score) AS top FROM lex_leg GROUP BY query_id UNION ALL SELECT 'dense_top1', query_id, max(score) FROM sem_leg GROUP BY query_id UNION ALL SELECT 'fused_top1', query_id, max(fused_score) FROM cand GROUP BY query_id", ["lex_leg", "sem_leg", "cand"]), "sc": ("SELECT s.signal, kind = 'answerable' AS answerable, coalesce(top, 0.0) AS score FROM questions q CROSS JOIN (SELECT DISTINCT signal FROM tops) s LEFT JOIN tops t ON t.signal = s.signal AND t.query_id = q.query_id", ["questions", "tops"])})
def signal_separation(spark: SparkSession, sf: str) -> DataFrame:
    """For each gate signal, the 10th percentile of answerable questions less the 90th of the others."""
    r = _run(Index.of(spark, sf), ["baseline"])
    c = r["cand"]
    top = c.groupBy("query_id").agg(F.max("lexical_score").alias("lexical_top1"), F.max("semantic_score").alias("dense_top1"), F.max("fused_score").alias("fused_top1"))
    j = r["questions"].select("query_id", "kind").join(top, "query_id", "left")
    names = ["lexical_top1", "dense_top1", "fused_top1"]
    long = j.select("kind", F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.coalesce(n, F.lit(0.0)).alias("score")) for n in names])).alias("s")).select((F.col("kind") == "answerable").alias("answerable"), "s.signal", "s.score")
    low = calibrate.nearest_rank(long.where("answerable"), "signal", "score", [0.1]).select("signal", "p10")
    high = calibrate.nearest_rank(long.where("not answerable"), "signal", "score", [0.9]).select("signal", "p90")
    return low.join(high, "signal").select("signal", F.bround(F.col("p10") - F.col("p90"), 4).alias("separation"))


@_swept("trap_verdicts", "SELECT query_id, config_id, CASE WHEN NOT problem THEN 'ok' WHEN flagged THEN 'wrong_flagged' ELSE 'wrong_confident' END AS verdict, CASE WHEN NOT problem THEN 0 WHEN flagged THEN 2 ELSE 3 END AS severity FROM (SELECT query_id, config_id, flagged, (kind = 'out_of_scope' AND NOT flagged) OR (kind = 'answerable' AND NOT contains(lower(answer), lower(answer_key)) AND NOT flagged) OR contains(lower(answer), 'lorem') AS problem FROM marked JOIN cases USING (query_id))", ["marked", "cases"])
def trap_verdicts(r: dict[str, DataFrame]) -> DataFrame:
    """Traps: out-of-scope questions must not be answered flatly, others must show their key, and none a word that must not appear."""
    flagged = (F.col("status") == "refused") | F.col("hedged")
    j = r["answers"].join(r["cases"], "query_id").withColumn("flagged", flagged)
    shown = F.contains(F.lower("answer"), F.lower("answer_key"))
    problem = ((F.col("kind") == "out_of_scope") & ~flagged) | ((F.col("kind") == "answerable") & ~shown & ~flagged) | F.contains(F.lower("answer"), F.lit("lorem"))
    return j.select("query_id", "config_id", F.when(~problem, "ok").when(F.col("flagged"), "wrong_flagged").otherwise("wrong_confident").alias("verdict"), F.when(~problem, 0).when(F.col("flagged"), 2).otherwise(3).alias("severity"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round_even(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming extension's tumbling windows, as a batch."""
    e = S.table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 6).alias("total"))
    return e.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@_swept("derived_labels", "SELECT v.query_id, v.config_id, CASE WHEN v.ok AND b.ok THEN 'equivalent' WHEN v.ok <> b.ok THEN CASE WHEN CASE WHEN v.ok THEN b.refused ELSE v.refused END THEN 'degraded' ELSE 'contradictory' END ELSE 'degraded' END AS label FROM marked v JOIN marked b ON b.query_id = v.query_id AND b.config_id = 'baseline' JOIN cases c ON c.query_id = v.query_id WHERE v.config_id <> 'baseline' AND kind = 'answerable' AND v.answer <> b.answer", ["marked", "cases"])
def derived_labels(r: dict[str, DataFrame]) -> DataFrame:
    return counterfactual.derived_labels(r["answers"], r["cases"])


@_swept("movement_explained", "SELECT d.config_id, d.query_id, diagnosis || ': ' || CASE WHEN coalesce(moves, '') = '' THEN 'no candidates' ELSE moves END AS why FROM (SELECT config_id, query_id, CASE WHEN b = v THEN 'same' WHEN list_sort(b) = list_sort(v) THEN 'reordered' WHEN bg = 1 AND vg = 0 THEN 'gold lost' WHEN bg = 0 AND vg = 1 THEN 'gold gained' ELSE 'set changed' END AS diagnosis FROM dg) d LEFT JOIN (SELECT config_id, query_id, concat_ws(', ', CASE WHEN count_if(x = 999) > 0 THEN count_if(x = 999) || ' gone' END, CASE WHEN count_if(x > 0 AND x < 999) > 0 THEN count_if(x > 0 AND x < 999) || ' fell' END, CASE WHEN count_if(x < 0) > 0 THEN count_if(x < 0) || ' rose' END, CASE WHEN count_if(x = 0) > 0 THEN count_if(x = 0) || ' held' END) AS moves FROM (SELECT v.config_id, b.query_id, coalesce(c.fused_rank - w.fused_rank, 999) AS x FROM ctx b JOIN cand w ON w.config_id = 'baseline' AND w.query_id = b.query_id AND w.chunk_id = b.chunk_id JOIN (SELECT config_id FROM configs WHERE config_id <> 'baseline') v ON true LEFT JOIN cand c ON c.config_id = v.config_id AND c.query_id = b.query_id AND c.chunk_id = b.chunk_id WHERE b.config_id = 'baseline') GROUP BY ALL) m ON m.config_id = d.config_id AND m.query_id = d.query_id", ["dg", "ctx", "cand", "configs"], _DIAG)
def movement_explained(r: dict[str, DataFrame]) -> DataFrame:
    return counterfactual.explain(counterfactual.rank_delta(r["ctx"], r["cand"]), counterfactual.context_diagnosis(r["ctx"], r["gold"]))

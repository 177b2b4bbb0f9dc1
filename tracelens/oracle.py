"""DuckDB SQL with the results of queries(), put together from common table expressions.

A statement names the tables it needs; those and what they need come before it. The SQL is written on its own, from the
definitions, with RE2 patterns where Java's look-around isn't there.
"""

from __future__ import annotations

from .functions import lexicon as L

_q = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda words: ", ".join(map(_q, words))
DROPPED = [w for w in L.STOPWORDS if w not in L.POLARITY]


def raw(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), {_q(L.TOKEN)}), lambda t: trim(lower(t), '.-_')), lambda t: t <> '')"


def content(text: str) -> str:
    return f"list_filter({raw(text)}, lambda t: t NOT IN ({_list(DROPPED)}))"


def ident(t: str) -> str:
    return f"((regexp_matches({t}, '[A-Za-z]') AND regexp_matches({t}, '[0-9_.\\-]') AND regexp_full_match({t}, '[A-Za-z0-9_.\\-]+')) OR regexp_full_match({t}, '[0-9]+(\\.[0-9]+)+'))"


def disc(text: str) -> str:
    """Sorted distinct discriminators."""
    return f"list_sort(list_distinct(list_filter(list_transform({raw(text)}, lambda t: CASE WHEN t IN ({_list(L.POLARITY)}) THEN 'pol:' || t WHEN {ident('t')} OR regexp_full_match(t, '[0-9]+') THEN t END), lambda t: t IS NOT NULL)))"


def stem(t: str) -> str:
    cases = " ".join(f"WHEN ends_with({t}, {_q(s)}) AND length({t}) - {len(s)} >= 3 THEN substr({t}, 1, length({t}) - {len(s)}) || {_q(r)}" for s, r in L.SUFFIXES)
    return f"CASE WHEN length({t}) <= 3 OR {ident(t)} THEN {t} {cases} ELSE {t} END"


def concept_ctes(p: str = "") -> dict[str, tuple[str, list[str]]]:
    """voc from voc0; p names another such chain."""
    out = {"lex": (f"SELECT * FROM (VALUES {', '.join(f'({_q(a)}, {_q(b)})' for a, b in L.SYNONYMS.items())}) v(word, instead)", [])}
    last = f"{p}voc0"
    for i in range(4):
        out[f"{p}v{i}a"] = (f"SELECT token, coalesce(instead, t) AS t FROM {last} LEFT JOIN lex ON t = word", [last, "lex"])
        out[f"{p}v{i}b"] = (f"SELECT token, {stem('t')} AS t FROM {p}v{i}a", [f"{p}v{i}a"])
        out[f"{p}v{i}c"] = (f"SELECT token, coalesce(instead, t) AS t FROM {p}v{i}b LEFT JOIN lex ON t = word", [f"{p}v{i}b", "lex"])
        last = f"{p}v{i}c"
    out[f"{p}voc"] = (f"SELECT token, CASE WHEN word IS NULL AND {ident('token')} THEN 'id:' || regexp_replace(token, '[0-9]+', '#', 'g') ELSE t END AS concept FROM {last} LEFT JOIN lex ON token = word", [last, "lex"])
    return out


CTES: dict[str, tuple[str, list[str]]] = {
    "docs": ("SELECT CASE WHEN source = 'src0' THEN 'tenant_global' ELSE 'tenant_' || source END AS tenant_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS doc_id, doc_id AS doc_no, text FROM documents", []),
    "doc_lines": ("SELECT tenant_id, doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS i FROM (SELECT tenant_id, doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM docs)", ["docs"]),
    "chunk_rows": ("SELECT tenant_id, doc_id, CAST(i // 4 AS INTEGER) AS ordinal, string_agg(line, chr(10) ORDER BY i) AS text FROM doc_lines GROUP BY ALL", ["doc_lines"]),
    "chunks": ("SELECT 'c_' || substr(sha256(concat_ws(chr(31), tenant_id, doc_id, CAST(ordinal AS VARCHAR), text)), 1, 16) AS chunk_id, tenant_id, doc_id, ordinal, text FROM chunk_rows", ["chunk_rows"]),
    "gold": ("SELECT item_id, doc_no, tenant_id, b.text AS item_text FROM docs d JOIN benchmark b ON contains(d.text, b.text)", ["docs"]),
    "gold_tenant": ("SELECT item_id, arg_min(tenant_id, doc_no) AS tenant_id FROM gold GROUP BY item_id", ["gold"]),
    "questions": (f"SELECT b.item_id AS query_id, coalesce(g.tenant_id, 'tenant_src1') AS tenant_id, array_to_string({content('b.text')}, ' ') AS query, CASE WHEN g.item_id IS NULL THEN 'out_of_scope' ELSE 'answerable' END AS kind FROM benchmark b LEFT JOIN gold_tenant g ON b.item_id = g.item_id", ["gold_tenant"]),
    "scope": ("SELECT DISTINCT tenant_id, unnest([tenant_id, 'tenant_global']) AS chunk_tenant FROM questions", ["questions"]),
    "tok": (f"SELECT tenant_id, chunk_id, len(l) AS dl, unnest(l) AS term FROM (SELECT tenant_id, chunk_id, {content('text')} AS l FROM chunks)", ["chunks"]),
    "qterm": (f"SELECT query_id, tenant_id, term, count(*) AS qtf FROM (SELECT query_id, tenant_id, unnest({content('query')}) AS term FROM questions) GROUP BY ALL", ["questions"]),
    "post": ("SELECT tenant_id AS chunk_tenant, chunk_id, dl, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM qterm) GROUP BY ALL", ["tok", "qterm"]),
    "scope_stat": (f"SELECT s.tenant_id, count(*) AS n, sum(dl) / count(*) AS avgdl FROM (SELECT tenant_id AS chunk_tenant, len({content('text')}) AS dl FROM chunks) c JOIN scope s USING (chunk_tenant) GROUP BY s.tenant_id", ["chunks", "scope"]),
    "scope_df": ("SELECT s.tenant_id, term, count(*) AS df FROM post JOIN scope s USING (chunk_tenant) GROUP BY ALL", ["post", "scope"]),
    "bm25_all": ("SELECT q.query_id, p.chunk_id, round_even(sum(q.qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qterm q JOIN scope s ON q.tenant_id = s.tenant_id JOIN post p ON p.chunk_tenant = s.chunk_tenant AND p.term = q.term JOIN scope_df d ON d.tenant_id = q.tenant_id AND d.term = q.term JOIN scope_stat t ON t.tenant_id = q.tenant_id GROUP BY ALL", ["qterm", "scope", "post", "scope_df", "scope_stat"]),
    "lex_leg": ("SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM bm25_all WHERE score > 0) WHERE rank <= 20", ["bm25_all"]),
    "voc0": ("SELECT token, token AS t FROM (SELECT term AS token FROM tok UNION SELECT term FROM qterm)", ["tok", "qterm"]),
    "own": ("SELECT DISTINCT tenant_id AS chunk_tenant, chunk_id, concept FROM tok JOIN voc ON term = token", ["tok", "voc"]),
    "own_n": ("SELECT chunk_id, count(*) AS n FROM own GROUP BY chunk_id", ["own"]),
    "asked": ("SELECT query_id, tenant_id, concept, sum(qtf) AS qn FROM qterm JOIN voc ON term = token GROUP BY ALL", ["qterm", "voc"]),
    "n_docs": ("SELECT greatest(count(*), 1) AS n_docs FROM chunks", ["chunks"]),
    "idf": ("SELECT concept, df, n_docs, greatest(0.25, ln((n_docs + 1) / (df + 1)) + 0.5) AS idf FROM (SELECT concept, count(*) AS df FROM own GROUP BY concept), n_docs", ["own", "n_docs"]),
    "asked_idf": ("SELECT query_id, tenant_id, a.concept, qn, coalesce(idf, greatest(0.25, ln((m.n_docs + 1) / 1) + 0.5)) AS idf FROM asked a LEFT JOIN idf i ON a.concept = i.concept, n_docs m", ["asked", "idf", "n_docs"]),
    "whole": ("SELECT query_id, sum(qn * idf) AS whole FROM asked_idf GROUP BY query_id", ["asked_idf"]),
    "pairs": ("SELECT query_id, chunk_id, round_even(part / whole, 6) AS coverage, round_even(part / whole * (1 - 0.30 * n / (n + 80)), 6) AS score FROM (SELECT a.query_id, o.chunk_id, n, sum(qn * idf) AS part FROM asked_idf a JOIN scope s ON a.tenant_id = s.tenant_id JOIN own o ON o.chunk_tenant = s.chunk_tenant AND o.concept = a.concept JOIN own_n USING (chunk_id) GROUP BY ALL) JOIN whole USING (query_id)", ["asked_idf", "scope", "own", "own_n", "whole"]),
    "sem_leg": ("SELECT * FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM pairs WHERE score > 0) WHERE rank <= 20", ["pairs"]),
    "legs": ("SELECT query_id, chunk_id, l.rank AS lexical_rank, l.score AS lexical_score, s.rank AS semantic_rank, s.score AS semantic_score FROM lex_leg l FULL JOIN sem_leg s USING (query_id, chunk_id)", ["lex_leg", "sem_leg"]),
    "cand0": ("SELECT config_id, query_id, chunk_id, CASE WHEN lexical_rank <= lexical_top_k THEN lexical_rank END AS lexical_rank, CASE WHEN lexical_rank <= lexical_top_k THEN lexical_score END AS lexical_score, CASE WHEN semantic_rank <= semantic_top_k THEN semantic_rank END AS semantic_rank, CASE WHEN semantic_rank <= semantic_top_k THEN semantic_score END AS semantic_score, rrf_k, lexical_top_k, semantic_top_k FROM legs, configs", ["legs", "configs"]),
    "cand1": ("SELECT config_id, query_id, chunk_id, lexical_rank, lexical_score, semantic_rank, semantic_score, CASE WHEN lexical_top_k IS NOT NULL AND semantic_top_k IS NOT NULL AND rrf_k IS NOT NULL THEN round_even(coalesce(1 / (rrf_k + lexical_rank), 0) + coalesce(1 / (rrf_k + semantic_rank), 0), 8) WHEN lexical_top_k IS NOT NULL AND semantic_top_k IS NOT NULL THEN coalesce(lexical_score, 0) + coalesce(semantic_score, 0) ELSE 1 / (1 + coalesce(lexical_rank, semantic_rank, 1000000)) END AS fused_score FROM cand0 WHERE lexical_rank IS NOT NULL OR semantic_rank IS NOT NULL", ["cand0"]),
    "cand": ("SELECT *, CAST(row_number() OVER (PARTITION BY config_id, query_id ORDER BY fused_score DESC, chunk_id) AS INTEGER) AS fused_rank FROM cand1", ["cand1"]),
    "signal": ("SELECT config_id, query_id, list_reverse_sort(list(CASE gate_signal WHEN 'dense_top1' THEN semantic_score WHEN 'lexical_top1' THEN lexical_score ELSE fused_score END) FILTER (CASE gate_signal WHEN 'dense_top1' THEN semantic_score WHEN 'lexical_top1' THEN lexical_score ELSE fused_score END IS NOT NULL)) AS v, any_value(gate_threshold) AS thr FROM cand JOIN configs USING (config_id) GROUP BY ALL", ["cand", "configs"]),
    "gated": ("SELECT config_id, query_id, v[1] AS top1, v[2] AS top2, (thr IS NOT NULL AND v[1] IS NOT NULL) AS gate_checked, (thr IS NULL OR v[1] IS NULL OR v[1] >= thr) AS gate_passed FROM signal", ["signal"]),
    "decided": ("SELECT config_id, query_id, top1, top2, gate_checked, gate_passed, CASE WHEN rerank IS NULL THEN 'ablated' WHEN NOT gate_passed THEN 'gate refused' WHEN rerank = 'always' THEN 'run' WHEN top1 IS NULL THEN 'no signal' WHEN top1 < coalesce(gate_threshold, top1) * gray_ratio OR coalesce(top1 - top2 < abs(top1) * margin_ratio, false) THEN 'run' ELSE 'confident' END AS rerank_reason FROM gated JOIN configs USING (config_id)", ["gated", "configs"]),
    "rscore": (f"SELECT query_id, chunk_id, round_even(100.0 * (0.6 * cov + 0.4 * CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, held)) / len(asked) ELSE cov END), 2) AS rs FROM (SELECT DISTINCT c.query_id, c.chunk_id, coalesce(p.coverage, 0.0) AS cov, list_distinct(list_filter({raw('q.query')}, lambda t: {ident('t')})) AS asked, list_distinct(list_filter({raw('k.text')}, lambda t: {ident('t')})) AS held FROM legs c LEFT JOIN pairs p USING (query_id, chunk_id) JOIN questions q ON q.query_id = c.query_id JOIN chunks k ON k.chunk_id = c.chunk_id)", ["legs", "pairs", "questions", "chunks"]),
    "ranked0": ("SELECT c.*, d.gate_passed, CASE WHEN rerank_reason = 'run' AND fused_rank <= shortlist THEN rs END AS rerank_score FROM cand c JOIN decided d USING (config_id, query_id) JOIN configs USING (config_id) LEFT JOIN rscore USING (query_id, chunk_id)", ["cand", "decided", "configs", "rscore"]),
    "ranked1": ("SELECT *, CAST(row_number() OVER (PARTITION BY config_id, query_id ORDER BY rerank_score IS NULL, rerank_score DESC NULLS LAST, fused_score DESC, chunk_id) AS INTEGER) AS position FROM ranked0", ["ranked0"]),
    "ranked": ("SELECT *, (rerank_score IS NOT NULL AND position < fused_rank) AS promoted FROM ranked1", ["ranked1"]),
    "won": ("SELECT config_id, query_id, r.chunk_id, position, width, neighbours, k.tenant_id, k.doc_id, k.ordinal FROM ranked r JOIN configs USING (config_id) JOIN chunks k ON k.chunk_id = r.chunk_id WHERE gate_passed AND position <= width", ["ranked", "configs", "chunks"]),
    "slots": ("SELECT config_id, query_id, chunk_id, position, 0 AS slot, width FROM won UNION ALL SELECT w.config_id, w.query_id, k.chunk_id, position, CASE WHEN k.ordinal < w.ordinal THEN 1 ELSE 2 END, width FROM won w JOIN chunks k ON k.tenant_id = w.tenant_id AND k.doc_id = w.doc_id AND abs(k.ordinal - w.ordinal) = 1 WHERE neighbours = 1", ["won", "chunks"]),
    "ctx0": ("SELECT config_id, query_id, chunk_id, width, min(position * 10 + slot) AS place FROM slots GROUP BY ALL", ["slots"]),
    "ctx1": ("SELECT *, CAST(row_number() OVER (PARTITION BY config_id, query_id ORDER BY place) AS INTEGER) AS final_rank FROM ctx0", ["ctx0"]),
    "ctx": ("SELECT config_id, query_id, chunk_id, final_rank, CASE WHEN r.promoted IS NULL THEN 'neighbor_expansion' WHEN r.promoted THEN 'rerank_promoted' ELSE 'fused_top_k' END AS inclusion_reason FROM ctx1 LEFT JOIN ranked r USING (config_id, query_id, chunk_id) WHERE final_rank <= width", ["ctx1", "ranked"]),
    **concept_ctes(),
}


#: The settings of each configuration, as the survey lists them (A1, A2); they are stated here again, so that the queries'
#: own list can't vouch for itself.
CONFIG_COLUMNS = "config_id, lexical_top_k, k1, b, semantic_top_k, rrf_k, gate_threshold, gate_signal, rerank, gray_ratio, margin_ratio, shortlist, neighbours, width, rewrite, discriminator_guard"
CONFIG_ROWS = {
    "baseline": "('baseline', 20, 1.2, 0.75, 20, 60, 0.42, 'dense_top1', 'gray', 1.6, 0.15, 10, 1, 3, true, true)",
    "no_lexical": "('no_lexical', NULL, 1.2, 0.75, 20, 60, 0.42, 'dense_top1', 'gray', 1.6, 0.15, 10, 1, 3, true, true)",
    "no_semantic": "('no_semantic', 20, 1.2, 0.75, NULL, 60, 0.42, 'dense_top1', 'gray', 1.6, 0.15, 10, 1, 3, true, true)",
    "no_fusion": "('no_fusion', 20, 1.2, 0.75, 20, NULL, 0.42, 'dense_top1', 'gray', 1.6, 0.15, 10, 1, 3, true, true)",
    "no_gate": "('no_gate', 20, 1.2, 0.75, 20, 60, NULL, 'dense_top1', 'gray', 1.6, 0.15, 10, 1, 3, true, true)",
    "no_rerank": "('no_rerank', 20, 1.2, 0.75, 20, 60, 0.42, 'dense_top1', NULL, 1.6, 0.15, 10, 1, 3, true, true)",
    "force_rerank": "('force_rerank', 20, 1.2, 0.75, 20, 60, 0.42, 'dense_top1', 'always', 1.6, 0.15, 10, 1, 3, true, true)",
    "no_expansion": "('no_expansion', 20, 1.2, 0.75, 20, 60, 0.42, 'dense_top1', 'gray', 1.6, 0.15, 10, NULL, 3, true, true)",
    "top_k_1": "('top_k_1', 20, 1.2, 0.75, 20, 60, 0.42, 'dense_top1', 'gray', 1.6, 0.15, 10, 1, 1, true, true)",
    "no_rewrite": "('no_rewrite', 20, 1.2, 0.75, 20, 60, 0.42, 'dense_top1', 'gray', 1.6, 0.15, 10, 1, 3, false, true)",
    "gate_on_fused": "('gate_on_fused', 20, 1.2, 0.75, 20, 60, 0.025, 'fused_top1', 'gray', 1.6, 0.15, 10, 1, 3, true, true)",
    "no_discriminator_guard": "('no_discriminator_guard', 20, 1.2, 0.75, 20, 60, 0.42, 'dense_top1', 'gray', 1.6, 0.15, 10, 1, 3, true, false)",
    "no_discriminator_guard+no_lexical": "('no_discriminator_guard+no_lexical', NULL, 1.2, 0.75, 20, 60, 0.42, 'dense_top1', 'gray', 1.6, 0.15, 10, 1, 3, true, false)",
    "no_gate+no_lexical": "('no_gate+no_lexical', NULL, 1.2, 0.75, 20, 60, NULL, 'dense_top1', 'gray', 1.6, 0.15, 10, 1, 3, true, true)",
    "no_gate+no_semantic": "('no_gate+no_semantic', 20, 1.2, 0.75, NULL, 60, NULL, 'dense_top1', 'gray', 1.6, 0.15, 10, 1, 3, true, true)",
    "no_discriminator_guard+no_gate": "('no_discriminator_guard+no_gate', 20, 1.2, 0.75, 20, 60, NULL, 'dense_top1', 'gray', 1.6, 0.15, 10, 1, 3, true, false)",
}
CONFIG_KINDS = "VARCHAR INTEGER DOUBLE DOUBLE INTEGER INTEGER DOUBLE VARCHAR VARCHAR DOUBLE DOUBLE INTEGER INTEGER INTEGER BOOLEAN BOOLEAN".split()


def configs_cte(names: list[str]) -> str:
    rows = ", ".join(CONFIG_ROWS["+".join(sorted(n.split("+")))] for n in names)
    columns = ", ".join(f"CAST({c} AS {k}) AS {c}" for c, k in zip(CONFIG_COLUMNS.split(", "), CONFIG_KINDS, strict=True))
    return f"SELECT {columns} FROM (VALUES {rows}) c({CONFIG_COLUMNS})"


def sql(final: str, needs: list[str], extra: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """WITH the tables needed, in order; extra: further or other tables."""
    known, order = CTES | (extra or {}), []

    def visit(name: str) -> None:
        if name not in order:
            for n in known[name][1]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    return ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({known[n][0]})" for n in order) + " " if order else "") + final

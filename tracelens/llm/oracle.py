"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_GRAMS = "CASE WHEN len(l) >= 5 THEN list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) WHEN len(l) > 0 THEN ['short ' || array_to_string(l, ' ')] ELSE [] END"

SUBSTRING_DEDUP = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format('text')} AS l FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(l[i:i + 49], ' ') AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) - 48)) AS i FROM w)),
own AS (SELECT t, min(doc_id) AS m FROM win GROUP BY t),
cop AS MATERIALIZED (SELECT doc_id, i FROM win JOIN own USING (t) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM cop),
word AS (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n_words, count(g.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY word.p) FILTER (g.p IS NULL), '') AS k FROM word LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id),
fac AS (SELECT doc_id, count_if(i <> coalesce(b, -9) + 1) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM cop) GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256, coalesce(n, 0) AS n_factors FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN fac USING (doc_id)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS l FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort({_GRAMS}) AS g FROM w),
c AS MATERIALIZED (SELECT g, min(doc_id) AS class_id, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
e AS MATERIALIZED (SELECT class_id, n, unnest(g) AS x FROM c),
p AS (SELECT a.class_id AS a, b.class_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)),
reach(a, b) AS (SELECT class_id, class_id FROM c UNION SELECT r.a, link.b FROM reach r JOIN link ON link.a = r.b),
comp AS (SELECT a AS class_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(c.class_id, s.doc_id) AS class_id FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN comp USING (class_id)
"""

DECONTAMINATE = f"""
WITH i AS (SELECT item_id, {_GRAMS} AS g FROM (SELECT item_id, {_PLAIN.format('text')} AS l FROM benchmark)),
ix AS MATERIALIZED (SELECT item_id, len(g) AS n, unnest(g) AS x FROM i),
t AS MATERIALIZED (SELECT doc_id, {_PLAIN.format('text')} AS l FROM documents),
size AS (SELECT unnest([1, 2, 3, 4]) AS n),
d AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) AS x FROM t
UNION SELECT doc_id, 'short ' || array_to_string(l[i:i + n - 1], ' ') FROM (SELECT doc_id, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM t, size WHERE n IN (SELECT len(l) FROM (SELECT {_PLAIN.format('text')} AS l FROM benchmark)))),
f AS (SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_found FROM d JOIN ix USING (x) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM f WHERE n_found >= 0.75 * n_shingles
"""

SQL = {"op3_ngram_join": NGRAM_JOIN, "op7_substring_dedup": SUBSTRING_DEDUP, "op10_decontaminate": DECONTAMINATE}

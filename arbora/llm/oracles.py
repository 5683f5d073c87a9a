"""DuckDB SQL for the queries that SQL can express over the whole tables in seconds."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANKS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

DECONTAMINATE = f"""WITH
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g
    FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (SELECT doc_id, s.n, k, item FROM (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM starts) s JOIN windows USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM found)) GROUP BY doc_id),
held AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item) FILTER (item IS NOT NULL)), ',') AS items FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN held USING (doc_id)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE
d AS (SELECT doc_id, {_BLANKS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * shared >= 75 * (nx.n + ny.n - shared)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)"""

#: Bytes as hexadecimal digits, two each; texts in parts, as a place in a string is found by counting.
SUFFIX_DEDUP = """WITH
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, 500 * j AS base, substr(h, 1000 * j + 1, 1098) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 1000 + 1)) AS j FROM d)),
w AS (SELECT doc_id, base + k AS k, substr(part, 2 * k + 1, 100) AS g FROM (SELECT doc_id, base, part, unnest(range(0, least(500, length(part) // 2 - 49))) AS k FROM parts)),
f AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, k FROM w JOIN f USING (g) WHERE least < doc_id),
marked AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS starts FROM hits),
runs AS (SELECT doc_id, k, sum(starts) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM marked),
spans AS (SELECT doc_id, min(k) AS s, max(k) + 50 AS e FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept
    FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

SQL = {"op1_suffix_dedup": SUFFIX_DEDUP, "op4_decontaminate": DECONTAMINATE, "op6_minhash_neardup": NEAR_DUPLICATES}

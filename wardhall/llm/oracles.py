"""SQL of the operators whose whole contract SQL can express, for tables of a size that all pairs of equal windows fit.

It states the contracts plainly, from all windows of all texts, and knows nothing of the methods.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_PLAIN_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""WITH RECURSIVE words AS (SELECT doc_id, {_BLANK_WORDS} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM words, unnest(range(1, greatest(2, len(w) - 2))) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS one, b.doc_id AS two, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT one, two FROM shared JOIN sizes x ON x.doc_id = one JOIN sizes y ON y.doc_id = two WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT one AS a, two AS b FROM links UNION ALL SELECT two, one FROM links),
reach(doc_id, other) AS (SELECT a, b FROM ways UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id
FROM words d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)"""

OP4_SQL = f"""WITH docs AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {_PLAIN_WORDS} AS w FROM benchmark),
wanted AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM items, unnest(range(1, greatest(2, len(w) - 8))) AS r(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM wanted),
windows AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM docs, lengths, unnest(range(1, greatest(1, len(w) - n + 2))) AS r(i)),
found AS (SELECT doc_id, n, i, item FROM windows JOIN wanted USING (n, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM found), unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
held AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN held USING (doc_id)"""

OP5_SQL = """WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, 100 * b AS base, substr(h, 200 * b + 1, 298) AS h FROM docs, unnest(range(0, len(h) // 200 + 1)) AS r(b)),
starts AS MATERIALIZED (SELECT doc_id, base + i AS i, substr(h, 2 * i + 1, 100) AS s FROM blocks, unnest(range(0, least(100, len(h) // 2 - 49))) AS r(i)),
firsts AS (SELECT s, min(doc_id) AS least FROM starts GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) + 50 AS fresh FROM starts JOIN firsts USING (s) WHERE least < doc_id),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gone) GROUP BY doc_id, run),
parts AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM runs),
cut AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept FROM parts JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)"""

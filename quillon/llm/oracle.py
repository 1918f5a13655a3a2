"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from quillon.llm import license_scan, mixing, ngram_jaccard, substring_dedup, url_cascade

WORDS = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
n AS (SELECT doc_id, ws, len(ws) AS n FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {substring_dedup.WINDOW - 1}], ' ') AS k FROM n, unnest(range(1, n - {substring_dedup.WINDOW - 2})) AS t(i) WHERE n >= {substring_dedup.WINDOW}),
firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN firsts USING (k), range(0, {substring_dedup.WINDOW}) AS r(j) WHERE f < doc_id),
word AS (SELECT doc_id, p, ws[p] AS word FROM n, unnest(range(1, n + 1)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS c, string_agg(word, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT n.doc_id, n AS n_words, n - coalesce(c, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM n LEFT JOIN kept ON kept.doc_id = n.doc_id"""

NGRAM_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_cascade.UPPER}', '{url_cascade.LOWER}'), '{WORDS}') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {ngram_jaccard.SHINGLE - 1}], ' ') AS k FROM w, unnest(range(1, greatest(2, len(ws) - {ngram_jaccard.SHINGLE - 2}))) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {ngram_jaccard.PERCENT} * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT doc_id AS node, doc_id AS root FROM documents UNION SELECT b, root FROM reach JOIN ways ON a = node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, r.root AS component_id FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN (SELECT node, min(root) AS root FROM reach GROUP BY 1) r ON r.node = d.doc_id"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY 1),
w AS (SELECT source, total, {list(mixing.WEIGHTS)}[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS weight, total * {mixing.MOST}::DOUBLE AS cap FROM s),
l AS (SELECT *, ({mixing.SHARE}::DOUBLE * sum(total) OVER () - (sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING) - cap)) / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, total, least(cap, coalesce((SELECT arg_min(level, (cap / weight, source IS NULL, source)) FROM l WHERE level * weight <= cap) * weight, cap)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, total, target, d.source, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, total AS source_size, target, CAST(CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END * size + greatest(0, least(size, floor(target) - CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END * total - before)) AS BIGINT) AS taken, source FROM p"""

LICENSE_BASE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_cascade.UPPER}', '{url_cascade.LOWER}'), '{ALNUM}') AS ws FROM documents),
places AS (SELECT doc_id, i, label FROM w, unnest(range(1, len(ws) + 1)) AS t(i), (VALUES {', '.join(f"([{', '.join(repr(x) for x in p.split())}], '{label}')" for p, label in license_scan.PHRASES)}) AS p(phrase, label) WHERE ws[i:i + len(phrase) - 1] = phrase),
found AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN found ON found.doc_id = w.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "license_base_places": LICENSE_BASE,
    "op4_substring_dedup": SUBSTRING_DEDUP,
    "op7_mixing": MIXING,
    "op9_url_cascade": url_cascade.oracle_sql(),
    "op10_ngram_jaccard": NGRAM_JACCARD,
}

"""The queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import queries as q
from .quality import RULES
from .licenses import BLANK, HEADER, LICENCE_FILE, TEMPLATES

QUERIES = {
    "op1_exact_dedup": q.op1_exact_dedup,
    "op2_license_scan": q.op2_license_scan,
    "op3_lm_scoring": q.op3_lm_scoring,
    "op4_repeats": q.op4_repeats,
    "op5_toxicity": q.op5_toxicity,
    "op6_secret_scan": q.op6_secret_scan,
    "op7_revisits": q.op7_revisits,
    "op8_packing": q.op8_packing,
    "op9_jaccard_join": q.op9_jaccard_join,
    "op10_decontamination": q.op10_decontamination,
    "op11_token_alignment": q.op11_token_alignment,
    "op12_quality_rules": q.op12_quality_rules,
    "op13_structure_repair": q.op13_structure_repair,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""",
    "op2_license_scan": f"""
WITH tpl(licence, v, body) AS (VALUES {", ".join(f"('{k}', {i}, '{t}')" for k, texts in TEMPLATES.items() for i, t in enumerate(texts))}),
tt AS (SELECT licence, v, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS t FROM tpl),
tf AS (SELECT licence, v, t, count(*) AS n FROM tt GROUP BY ALL),
idf AS (SELECT t, ln((1 + {len(TEMPLATES)}) / (1.0 + count(DISTINCT licence))) + 1 AS idf FROM tf GROUP BY t),
tw AS (SELECT licence, v, t, n * idf / sqrt(sum((n * idf) ** 2) OVER (PARTITION BY licence, v)) AS w FROM tf JOIN idf USING (t)),
f AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CASE WHEN length(text) <= 200 AND regexp_matches(text, '(?i)licen[cs]e') THEN source || CASE WHEN lang = 'en' THEN '' ELSE '/' || lang END || '/LICENSE' END,
  source || '/' || lang || '/' || doc_id || '.txt') AS path FROM documents),
lines AS (SELECT DISTINCT doc_id, path, line, 'header' AS via FROM (SELECT doc_id, path, unnest(string_split(text, chr(10)) || string_split_regex(text, '{BLANK}')) AS line FROM f) WHERE regexp_matches(line, '{HEADER}')
  UNION SELECT doc_id, path, text, 'file' FROM f WHERE regexp_matches(path, '{LICENCE_FILE}')),
lt AS (SELECT line, t, count(*) AS n FROM (SELECT line, unnest(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS t FROM (SELECT DISTINCT line FROM lines)) GROUP BY ALL),
lw AS (SELECT line, t, n * coalesce(idf, ln(1.0 + {len(TEMPLATES)}) + 1) AS x FROM lt LEFT JOIN idf USING (t)),
nm AS (SELECT line, sqrt(sum(x * x)) AS norm FROM lw GROUP BY line),
sc AS (SELECT line, licence, v, round(sum(x * w) / any_value(norm), 6) AS score FROM lw JOIN tw USING (t) JOIN nm USING (line) GROUP BY ALL HAVING score >= 0.5),
own AS (SELECT doc_id, path, licence, score, via FROM lines JOIN sc USING (line) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, via, licence) = 1),
g AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS above, licence, score FROM own WHERE regexp_matches(path, '{LICENCE_FILE}') QUALIFY row_number() OVER (PARTITION BY above ORDER BY score DESC, licence) = 1)
SELECT f.doc_id, f.path, coalesce(o.licence, g1.licence, g2.licence) AS licence, coalesce(o.score, g1.score, g2.score) AS score, CASE WHEN o.doc_id IS NOT NULL THEN o.via ELSE coalesce(g1.above, g2.above) END AS via
FROM f LEFT JOIN own o ON o.doc_id = f.doc_id LEFT JOIN g g1 ON g1.above = regexp_extract(f.path, '^(.*)/[^/]*$', 1) LEFT JOIN g g2 ON g2.above = string_split(f.path, '/')[1]""",
    "op7_revisits": r"""
WITH c AS (SELECT page_id AS i, md5(html) AS tag, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
p AS (SELECT i, tag, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^(?:[^@]*@)?(?:(?:www|m)\.)?', ''), ':(?:80|443)$', '')
  || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*(.*)$', 1), '([?&])ref=[^&]*&?', '\1', 'g'), '[?&]$', ''), '/$', ''), '/\?', '?', 'g') AS url FROM c),
rev AS (SELECT 3 * i + 1 AS record_id, url, 10 * i + 25 AS ts, CASE WHEN i % 5 = 0 THEN 'other' ELSE tag END AS etag, 'date=' || (10 * i + 25) AS h FROM p UNION ALL SELECT 3 * i + 2, url, 10 * i - 5, NULL, NULL FROM p WHERE i % 7 = 0),
j AS (SELECT r.record_id, r.url, p.i, p.tag, r.etag, r.h FROM rev r ASOF LEFT JOIN (SELECT *, 10 * i AS t FROM p) p ON p.url = r.url AND r.ts >= p.t)
SELECT record_id, url, CASE WHEN i IS NOT NULL AND coalesce(etag = tag, true) THEN 3 * i END AS response_id, CASE WHEN i IS NULL THEN 'missing' WHEN coalesce(etag = tag, true) THEN 'resolved' ELSE 'stale' END AS outcome,
CASE WHEN i IS NOT NULL AND coalesce(etag = tag, true) THEN 'content-type=text/html;' || coalesce(h, 'date=' || (10 * i) || ';vary=accept') END AS headers FROM j""",
    "op12_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS g, lead(w, 4) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM g WHERE whole QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) x(k) GROUP BY doc_id),
c AS (SELECT d.doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, unnest([{", ".join(f"{{'rule': '{r}', 'fails': {sql}}}" for r, sql in RULES.items())}]) AS f FROM c),
h AS (SELECT source, f.rule AS rule, count(*)::DOUBLE AS n, count(*) FILTER (f.fails)::DOUBLE AS k FROM f WHERE source IS NOT NULL GROUP BY ALL),
m AS (SELECT rule, count(*) AS hosts, sum(n) AS total, sum(n * n) AS squares, sum(k) / sum(n) AS m, sum(k * k / n) AS part FROM h GROUP BY rule),
p AS (SELECT *, m * (1 - m) * (total - squares / total - (hosts - 1)) AS room FROM m),
v AS (SELECT *, CASE WHEN hosts > 1 AND room > 0 THEN 1 / least(0.999, greatest(0.001, (part - total * m * m - m * (1 - m) * (hosts - 1)) / room)) - 1 ELSE 10 END AS weight FROM p),
bad AS (SELECT DISTINCT source FROM h JOIN v USING (rule) WHERE (k + weight * m) / (n + weight) > 0.5),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.source IS NULL AS kept FROM b LEFT JOIN bad USING (source)""",
}

if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from caseloom.llm.license_scan import K, MAX_GAP, MIN_RUN, MIN_SHARE
from caseloom.llm.license_texts import BASE_PHRASES, PASSAGES
from caseloom.llm.quality_rules import STOP_WORDS
from caseloom.llm.url_filter import LIMIT, RHO_MAX, RHO_MIN, RHO_UNKNOWN, TWO_LABELS, Z

ORACLES: dict = {}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: Kept lines of {docs}: doc_id, text (null becomes empty), the table's name in braces.
LINES_SQL = f"""
lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {{docs}})),
line_keys AS (SELECT doc_id, pos, line, translate(trim(line, {_STRIP}), {_AZ}) AS k FROM lines),
common AS (SELECT k FROM line_keys WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT doc_id, pos, line, k IN (SELECT k FROM common) AS gone FROM line_keys)"""

ORACLES["op1_line_dedup"] = f"""
WITH {LINES_SQL.format(docs="documents")}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

#: Hit windows of {docs} against benchmark.
HITS_SQL = f"""
item_words AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_PLAIN}) AS w FROM benchmark) WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM item_words)),
doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_PLAIN}) AS w FROM {{docs}}),
doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM doc_windows d JOIN item_windows b ON d.gram = b.gram AND d.n = b.n)"""

ORACLES["op9_decontamination"] = f"""
WITH {HITS_SQL.format(docs="documents")},
hit_words AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLES["op10_quality_rules"] = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
  len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
  len(list_filter(w, lambda x: lower(regexp_replace(x, '[^\p{{L}}]+$', '')) IN ({_STOP}))) AS n_stop_words,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis,
  len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•●]\s'))) AS n_bullet
  FROM w LEFT JOIN rep ON w.doc_id IS NOT DISTINCT FROM rep.doc_id),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(n_words, 1) AS nw, greatest(n_lines, 1) AS nl FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / nw >= 2.0 AND word_chars / nw <= 20.0 AND n_symbols / nw <= 0.3 AND n_letter_words / nw >= 0.5 AND n_stop_words / nw >= 0.01
  AND n_dup_lines / nl <= 0.5 AND n_ellipsis / nl <= 0.3 AND n_bullet / nl <= 0.9 AS kept
FROM v"""

_BITS = ", ".join(f"('0x' || substr(h, {5 * i + 1}, 5))::BIGINT" for i in range(8))
ORACLES["op3_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, array_to_string(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v >> 15) & 31) + 1)::BIGINT, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v >> 10) & 31) + 1)::BIGINT, 1),
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v >> 5) & 31) + 1)::BIGINT, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v & 31) + 1)::BIGINT, 1)] for v in [{_BITS}]]), '') AS payload_digest,
  min(page_id) OVER (PARTITION BY h, html) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d"""


def _template_rows():
    rows = []
    for exact, templates in (("true", BASE_PHRASES), ("false", PASSAGES)):
        for label, phrase in templates:
            w = phrase.split()
            rows += [f"('{w[i]} {w[i + 1]}', '{label}', {exact}, {i}, {len(w) - 1})" for i in range(len(w) - 1)]
    return ", ".join(rows)


ORACLES["op5_license_scan"] = f"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_PLAIN}) AS w FROM documents),
grams AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM dw WHERE len(w) >= 2)),
t(gram, label, exact, tpos, n) AS (VALUES {_template_rows()}),
hit AS (SELECT DISTINCT doc_id, label, exact, n, pos, tpos FROM grams JOIN t USING (gram)),
base AS (SELECT doc_id, true AS base, label, pos - tpos AS s, 1.0::DOUBLE AS share FROM hit WHERE exact GROUP BY doc_id, label, n, pos - tpos HAVING count(*) = n),
seq AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, label, n, pos - tpos ORDER BY pos) AS first FROM hit WHERE NOT exact),
run AS (SELECT doc_id, label, n, min(pos) AS s, max(pos) + 1 AS e, min(tpos) AS t, max(tpos) + 1 AS u FROM seq GROUP BY doc_id, label, n, pos - tpos, first HAVING count(*) >= {MIN_RUN}),
chain AS (SELECT *, e - s AS links FROM run UNION
  SELECT y.*, x.links + y.e - y.s FROM chain x JOIN run y ON x.doc_id IS NOT DISTINCT FROM y.doc_id AND x.label = y.label AND x.e <= y.s AND x.u <= y.t AND y.s - x.e <= {MAX_GAP + K - 1} AND y.t - x.u <= {MAX_GAP + K - 1}),
p AS (SELECT doc_id, false AS base, label, NULL::BIGINT AS s, max(links)::DOUBLE / n AS share FROM chain GROUP BY doc_id, label, n HAVING max(links) >= {MIN_SHARE} * n - 1e-9),
a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, list_sort(list(DISTINCT label) FILTER (base)) AS bl, list_sort(list(DISTINCT label)) AS ls, max(share) AS score
  FROM (SELECT * FROM base UNION ALL SELECT * FROM p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(ls, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM dw LEFT JOIN a USING (doc_id)"""


_TWO = ", ".join(f"'{x}'" for x in TWO_LABELS)


def _prior(level, above):
    """SQL of a level's members with m, the mean above, and worth, what the prior is worth."""
    over = "sum(pow(k - n * m, 2) - n * m * (1 - m))"
    rho = f"CASE WHEN sum(n * m * (1 - m) * (n - 1)) > 0 THEN {over} / sum(n * m * (1 - m) * (n - 1)) ELSE {RHO_UNKNOWN!r} END"
    return f"{level}_m AS ({above}),\n{level} AS (SELECT *, (k + worth * m) / (n + worth) AS mean FROM {level}_m, (SELECT 1 / least(greatest({rho}, {RHO_MIN!r}), {RHO_MAX!r}) - 1 AS worth FROM {level}_m))"


ORACLES["op11_url_filter"] = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum((quality = 0 OR toxic = 1)::INT) AS k FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM p LEFT JOIN o USING (page_id) GROUP BY host),
h1 AS (SELECT *, string_split(name, '.') AS l, regexp_matches(name, '^[0-9.]+$|^\\[') AS num FROM h0),
h2 AS (SELECT *, CASE WHEN len(l) >= 2 AND array_to_string(l[-2:], '.') IN ({_TWO}) THEN 2 ELSE 1 END AS c FROM h1),
h3 AS (SELECT host, n, k, CASE WHEN num THEN '' ELSE array_to_string(l[-c:], '.') END AS suffix, CASE WHEN num THEN name ELSE array_to_string(l[-least(c + 1, len(l)):], '.') END AS domain FROM h2),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h3 GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM h3 GROUP BY ALL),
{_prior("s", "SELECT *, (SELECT (sum(k) + 1.0) / (sum(n) + 2.0) FROM s0) AS m FROM s0")},
{_prior("d", "SELECT d0.*, s.mean AS m FROM d0 JOIN s USING (suffix)")},
{_prior("h", "SELECT h3.*, d.mean AS m FROM h3 JOIN d USING (suffix, domain)")},
v AS (SELECT host, CASE WHEN mean + {Z} * sqrt(mean * (1 - mean) / (n + worth + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS by_host FROM h),
t(rule, rhost, rpath, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
hp AS (SELECT DISTINCT host, path FROM p),
r AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS rv FROM hp JOIN t ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.rv, v.by_host) AS verdict FROM p JOIN v USING (host) LEFT JOIN r ON p.host = r.host AND p.path = r.path"""

ORACLES["op12_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT a, c, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5)
SELECT p.a AS anchor_id, p.c AS positive_id, (row_number() OVER w)::INT AS rank, s.c AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.c) QUALIFY row_number() OVER w <= 3"""

#: CRC-32 of the decimal conv_id, bit by bit: a byte is a step, and -1 is a shift.
_CRC = "xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT] || [-1::BIGINT for i in range(8)])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
ORACLES["op13_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
m AS (SELECT c.conv_id, count(t.i) AS m FROM c LEFT JOIN t ON t.conv_id = c.base AND t.i <= c.h GROUP BY 1),
r AS (SELECT c.conv_id, t.i AS d, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h UNION ALL SELECT c.conv_id, m.m + t.i - c.h, role, text FROM c JOIN m USING (conv_id) JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
n AS (SELECT conv_id, d, strlen(text) AS b, list([role, text]) OVER (PARTITION BY conv_id ORDER BY d) AS seq, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM r
  UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[][], conv_id NOT IN (SELECT conv_id FROM r) FROM c),
node AS (SELECT d, seq, min(conv_id) AS rep, count(*) AS n_convs, (count(*) - 1) * min(b) AS w, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM n GROUP BY d, seq),
kid AS (SELECT p.d, p.seq, count(*) AS n_children FROM node u JOIN n x ON x.conv_id = u.rep AND x.d = u.d - 1 JOIN node p ON p.d = x.d AND p.seq = x.seq GROUP BY ALL),
sub AS (SELECT x.d, x.seq, sum(u.w) AS saved, count(*) FILTER (k.n_children IS NULL) AS n_leaves FROM node u LEFT JOIN kid k ON k.d = u.d AND k.seq = u.seq JOIN n x ON x.conv_id = u.rep AND x.d <= u.d GROUP BY ALL)
SELECT v.rep AS conv_id, v.d::BIGINT AS depth, p.rep AS parent_conv_id, v.n_convs, coalesce(kid.n_children, 0) AS n_children, sub.n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(v.ids) AS ends_sha256
FROM node v JOIN sub ON sub.d = v.d AND sub.seq = v.seq LEFT JOIN kid ON kid.d = v.d AND kid.seq = v.seq LEFT JOIN n x ON x.conv_id = v.rep AND x.d = v.d - 1 LEFT JOIN node p ON p.d = x.d AND p.seq = x.seq"""

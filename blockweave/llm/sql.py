"""The results of the queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from .urls import LOWER, RULES, UPPER

_SPACE = r"'[\x20\x09-\x0D]+'"
_WORDS = f"list_filter(regexp_split_to_array({{}}, {_SPACE}), lambda x: x <> '')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE [] END) sh FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
c AS (SELECT a.doc_id x, b.doc_id y, count(*) k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x),
m AS (SELECT node, min(reach) component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m ON d.doc_id = node LEFT JOIN n ON n.doc_id = d.doc_id"""

_RULES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
_HOST = f"translate(regexp_extract(coalesce({{0}}, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
_PATH = "regexp_extract(coalesce({0}, ''), '://[^/?#]*([^?#]*)', 1)"
_RULED = "LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)"
URL_FILTER = f"""
WITH RECURSIVE rules(act, h, p) AS (VALUES {_RULES}),
pg AS (SELECT page_id, url, {_HOST.format('url')} host, {_PATH.format('url')} path, html FROM pages),
best AS (SELECT page_id, any_value(url) url, any_value(host) host, any_value(path) path, arg_max(h || p, length(h || p)) rule, arg_max(act, length(h || p)) act FROM pg {_RULED} GROUP BY page_id),
raw AS (SELECT regexp_replace(url, '#.*$', '') a, unnest([
  regexp_extract(regexp_extract(html, '(?is)(<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>)', 1), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1),
  regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*\\bcontent\\s*=\\s*["''][^"''>]*\\burl\\s*=\\s*([^"''>\\s]+)', 1)]) t FROM pg WHERE url IS NOT NULL),
e0 AS (SELECT a, regexp_replace(CASE WHEN starts_with(t, '//') THEN regexp_extract(a, '^([^:/?#]+:)//', 1) || t WHEN starts_with(t, '/') THEN regexp_extract(a, '^([^:/?#]+://[^/?#]*)', 1) || t WHEN contains(t, '://') THEN t END, '#.*$', '') b FROM raw WHERE t <> ''),
e AS (SELECT a, b FROM e0 WHERE a <> b UNION ALL SELECT b, a FROM e0 WHERE a <> b),
r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
nodes AS (SELECT node, any_value(alias_of) alias_of, arg_max(act, length(h || p)) act FROM (SELECT node, min(reach) alias_of, {_HOST.format('node')} host, {_PATH.format('node')} path FROM r GROUP BY node) {_RULED} GROUP BY node),
comp AS (SELECT alias_of, coalesce(bool_or(act = 'block'), false) blocked FROM nodes GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(best.act, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, nodes.alias_of
FROM best LEFT JOIN nodes ON regexp_replace(url, '#.*$', '') = node LEFT JOIN comp ON comp.alias_of = nodes.alias_of"""

_LINKED = """(SELECT p.page_id, p.url, CASE WHEN p.page_id % 3 = 1 THEN coalesce('<link rel="canonical" href="' || q.url || '">', '') WHEN p.page_id % 3 = 2 THEN coalesce('<meta http-equiv="refresh" content="0; url=' || q.url || '">', '') ELSE '' END html
  FROM pages p LEFT JOIN pages q ON q.page_id + 1 = p.page_id)"""
URL_ALIAS_CHAINS = URL_FILTER.replace("html FROM pages)", f"html FROM {_LINKED})")

_BUCKET = "({0} >> greatest(length(bin({0})) - 7, 0)) << greatest(length(bin({0})) - 7, 0)"


def _bounds(table: str, groups: str) -> str:
    middle, spread = "min(b) FILTER (m = {0} AND upto * 100 >= total * 50)", "(min(b) FILTER (m = {0} AND upto * 100 >= total * 50) - min(b) FILTER (m = {0} AND upto * 100 >= total * 25))"
    high, low = f"{middle} + 8 * {spread}", f"greatest({middle} - 8 * {spread}, 0)"
    over = f"PARTITION BY {groups}{', ' if groups else ''}m"
    return f"""SELECT {groups}{', ' if groups else ''}max(total) total, {high.format(1)} hi1, {low.format(2)} lo2, {high.format(2)} hi2, {high.format(3)} hi3, {high.format(4)} hi4
FROM (SELECT *, sum(n) OVER ({over} ORDER BY b) upto, sum(n) OVER ({over}) total FROM {table}) {'GROUP BY ' + groups if groups else ''}"""


_ABOVE = "{0} * 1000::DOUBLE <= {1} * {2}::DOUBLE + 4 * sqrt({3}000::DOUBLE * {1} * {2}::DOUBLE) + {3}000::DOUBLE * 16"
_BELOW = "{0} * 1000::DOUBLE >= {1} * {2}::DOUBLE - 4 * sqrt(1000::DOUBLE * {1} * {2}::DOUBLE)"
QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(lang, chr(1)) lang, coalesce(source, chr(1)) source, coalesce(text, '') t, {_WORDS.format("coalesce(text, '')")} ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) k FROM (SELECT doc_id, unnest(range(1, len(ws) - 1)) i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] s FROM d WHERE len(ws) > 2)),
h AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM g WHERE k > 1) GROUP BY 1),
c AS (SELECT doc_id, lang, source, len(ws) n_words, length(regexp_replace(t, {_SPACE}, '', 'g')) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(n, 0) n_repeat_words, len(ls) nl FROM d LEFT JOIN h USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed, n_symbols * 1000 // greatest(word_chars, 1) m1, word_chars * 1000 // greatest(n_words, 1) m2, n_dup_lines * 1000 // greatest(nl, 1) m3, n_repeat_words * 1000 // greatest(n_words, 1) m4 FROM c),
u AS (SELECT lang, source, m, {_BUCKET.format('x')} b FROM (SELECT lang, source, unnest([1, 2, 3, 4]) m, unnest([m1, m2, m3, m4])::BIGINT x FROM v WHERE NOT base_failed)),
sk AS (SELECT lang, source, m, b, count(*) n FROM u GROUP BY ALL),
al AS (SELECT m, b, sum(n) n FROM sk GROUP BY ALL),
own AS ({_bounds('sk', 'lang, source')}),
every AS ({_bounds('al', '')}),
th AS (SELECT lang, source, {', '.join(f'((own.total * own.{x} + 50 * every.{x}) // (own.total + 50))::BIGINT {x}' for x in ('hi1', 'lo2', 'hi2', 'hi3', 'hi4'))} FROM own, every)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({_ABOVE.format('n_symbols', 'hi1', 'word_chars', 1)} AND {_ABOVE.format('word_chars', 'hi2', 'n_words', 1)} AND {_BELOW.format('word_chars', 'lo2', 'n_words')}
AND {_ABOVE.format('n_dup_lines', 'hi3', 'nl', 1)} AND {_ABOVE.format('n_repeat_words', 'hi4', 'n_words', 6)}, true) AS kept FROM v LEFT JOIN th USING (lang, source)"""

_TEST_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATION = f"""
WITH b AS (SELECT item_id::VARCHAR item, {_TEST_WORDS} ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') g FROM (SELECT item, ws, least(10, len(ws)) k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_TEST_WORDS} ws FROM documents),
sizes AS (SELECT DISTINCT k FROM win),
hits AS (SELECT doc_id, i, x.k, item FROM (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) i FROM d, sizes WHERE len(ws) >= k)) x JOIN win USING (k, g)),
p AS (SELECT doc_id, count(DISTINCT q) n FROM (SELECT doc_id, unnest(range(i, i + k)) q FROM hits) GROUP BY 1),
it AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n IS NOT NULL AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)"""

ORACLE = {
    "op2_near_duplicates": NEAR_DUPLICATES,
    "op5_url_filter": URL_FILTER,
    "url_alias_chains": URL_ALIAS_CHAINS,
    "op7_quality_rules": QUALITY,
    "op8_decontamination": DECONTAMINATION,
}

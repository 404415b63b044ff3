"""SQL for DuckDB that gives the rows of those queries that SQL can express, from their definitions."""

from __future__ import annotations

from loomery.llm.chat_formatting import CONTROLS, ESCAPE
from loomery.llm.license_scans import NOTICES, PHRASES, split_words
from loomery.llm.quality_rules import RULES, subsets
from loomery.llm.url_filters import PATTERN_RULES

_HOST = "translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"

URL_FILTERS = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
r(rule, h, pre, action) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
j AS (SELECT page_id, host, path, max(row(length(rule), rule, action)) FILTER (rule IS NOT NULL) AS best FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY 1, 2, 3),
w(ordinal, name, regex) AS (VALUES {", ".join(f"({n}, '{r.name}', '{r.regex}')" for n, r in enumerate(PATTERN_RULES))}),
m AS (SELECT page_id, host, path, best, max(row(length(name), ordinal, name)) AS hit FROM j LEFT JOIN w ON best IS NULL AND regexp_matches(host || path, regex) GROUP BY ALL),
u AS (SELECT page_id, host, path, best, CASE WHEN hit[1] IS NOT NULL THEN hit[3] END AS pattern FROM m)
SELECT page_id, host, path, best[2] AS rule, CASE WHEN best IS NOT NULL THEN best[3] WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM u
"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '{ESCAPE}', '{ESCAPE * 2}')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}{ESCAPE}{c[1:]}')"
    return out


CHATS = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length({_escaped("text")}) + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 4 WHEN 'system' THEN 18 ELSE 23 + length({_escaped("role")}) END)::BIGINT AS formatted_chars
FROM t GROUP BY 1
"""

_SETS = ", ".join(f"({n}, {list(rules)})" for n, rules in enumerate(subsets(RULES)))
_SIZES = [len(r.grid) for r in RULES]
_LEVELS = max(_SIZES)
_CUTS = ", ".join(f"({n}, {level}, {r.grid[max(0, len(r.grid) - level)]}::DOUBLE)" for n, r in enumerate(RULES) for level in range(1, _LEVELS + 1))
_VALUES = ", ".join(f"({r.value.replace('n_', 's.n_').replace('word_chars', 's.word_chars').replace(' / ', '::DOUBLE / ')})" for r in RULES)

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT doc_id, i, words[i:i + 4] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM w) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
s AS (SELECT d.doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(l.n, 0) AS n_lines, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN repeats USING (doc_id)),
v AS (SELECT s.doc_id, stratum, unnest([{_VALUES}]) AS value, unnest(range({len(RULES)})) AS rule FROM s),
cut(rule, level, cutoff) AS (VALUES {_CUTS}),
sets(id, rules) AS (VALUES {_SETS}),
known AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1 HAVING max(quality) IS NOT NULL),
fell AS (SELECT doc_id, level, list(rule) AS rules FROM v JOIN cut USING (rule) WHERE value > cutoff GROUP BY 1, 2),
seen AS (SELECT stratum, level, rules, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality <> 1) AS bad FROM s JOIN known USING (doc_id) JOIN fell USING (doc_id) GROUP BY 1, 2, 3),
n AS (SELECT stratum, count(*) FILTER (quality = 1) AS n FROM s JOIN known USING (doc_id) GROUP BY 1),
risk AS (SELECT n.stratum, n.n, sets.id, l.level, coalesce(sum(good) FILTER (list_has_any(seen.rules, sets.rules)), 0) AS k, coalesce(sum(bad) FILTER (list_has_any(seen.rules, sets.rules)), 0) AS bad
    FROM n CROSS JOIN sets CROSS JOIN (SELECT unnest(range(1, {_LEVELS} + 1)) AS level) l LEFT JOIN seen ON seen.stratum = n.stratum AND seen.level = l.level GROUP BY 1, 2, 3, 4),
tail AS (SELECT stratum, id, level, any_value(k) AS k, any_value(bad) AS bad, any_value(n) AS n, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.01) + (n - j) * ln(0.99))) AS p FROM risk, LATERAL (SELECT unnest(range((k + 1)::BIGINT)) AS j) GROUP BY 1, 2, 3),
ok AS (SELECT *, bool_and(n > 0 AND p <= 0.05 / ({len(subsets(RULES))} * (SELECT count(*) FROM n))) OVER (PARTITION BY stratum, id ORDER BY level) AS pass FROM tail),
best AS (SELECT * FROM ok WHERE pass QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY bad DESC, k, id, level) = 1),
gone AS (SELECT DISTINCT v.doc_id FROM v JOIN best USING (stratum) JOIN sets ON sets.id = best.id JOIN cut ON cut.rule = v.rule AND cut.level = best.level WHERE list_contains(sets.rules, v.rule) AND value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND doc_id NOT IN (SELECT doc_id FROM gone) AS kept FROM s
"""

LINE_DEDUP = """
WITH raw AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
solid AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) AS words FROM raw WHERE regexp_matches(line, '\\S')),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto, list(line) OVER (PARTITION BY doc_id) AS lines FROM solid),
runs AS (SELECT a.doc_id, a.n AS first, min(b.n) AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.n >= a.n AND b.upto - a.upto + a.words >= 40 GROUP BY 1, 2
    UNION SELECT a.doc_id, max(b.n), a.n FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.n <= a.n AND a.upto - b.upto + b.words >= 40 GROUP BY 1, a.n),
whole AS (SELECT doc_id, list(line ORDER BY n) AS lines FROM solid GROUP BY 1),
named AS (SELECT doc_id, first, last, lines[first:last] AS run FROM runs JOIN whole USING (doc_id)),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS nth FROM named) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS n FROM later),
marked AS (SELECT raw.doc_id, raw.i, raw.line, solid.n IS NOT NULL AS is_solid, gone.n IS NOT NULL AS is_gone FROM raw LEFT JOIN solid USING (doc_id, i) LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.n = solid.n)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_gone), '') AS text, (count(*) FILTER (is_solid))::INT AS n_lines, (count(*) FILTER (is_gone))::INT AS n_removed FROM marked GROUP BY 1
"""

_WORDS = "list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: lower(regexp_replace(w, '^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+$', '', 'g'))), lambda w: w <> '')"

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
g AS (SELECT doc_id, words[i:i + least(len(words), 5) - 1] AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
u AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id, gram) AS nth FROM g),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.gram = b.gram AND a.nth = b.nth AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b, root FROM reach JOIN edge ON a = node),
class AS (SELECT node AS doc_id, min(root) AS class_id FROM reach GROUP BY 1)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM class
"""

DECONTAMINATION = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
dg AS (SELECT doc_id, p, w[p:p + 4] AS g, len(w) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
ig AS (SELECT item_id, w[p:p + 4] AS g, len(w) - 4 AS m FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i WHERE len(w) >= 5)),
hit AS (SELECT DISTINCT doc_id, item_id, p, g, m, n FROM dg JOIN ig USING (g)),
win AS (SELECT doc_id, item_id, m, s, count(DISTINCT g) AS c FROM (SELECT *, unnest(range(greatest(p - m + 1, 1), p + 1)) AS s FROM hit) WHERE p < s + m GROUP BY 1, 2, 3, 4),
leak AS (SELECT doc_id, item_id, max(c / (2.0 * m - c)) AS similarity FROM win GROUP BY 1, 2 HAVING max(c / (2.0 * m - c)) >= 0.8),
f AS (SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, max(similarity) AS similarity FROM leak GROUP BY 1)
SELECT doc_id, items IS NOT NULL AS contaminated, coalesce(items, '') AS items, round(similarity, 6) AS similarity FROM documents LEFT JOIN f USING (doc_id)
"""

def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PLAIN = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

#: Every block of every text meets every template of its class; phrases are looked for at every word.
LICENSES = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_PLAIN} AS w FROM documents),
t(number, label, size, own, needs, threshold, phrase) AS (VALUES {", ".join(f"({n}, '{t.label}', {t.size}, {_list(t.words)}, '{' '.join(split_words(t.needs))}', {t.threshold}, {t.phrase})" for n, t in enumerate(PHRASES + NOTICES))}),
b AS (SELECT r, size, w[k * size + 1:(k + 2) * size] AS w FROM (SELECT r, w, size, unnest(range(0, (len(w) - 1) // size + 1)) AS k FROM d, (SELECT DISTINCT size FROM t) WHERE len(w) > 0)),
m AS (SELECT r, label, len(list_intersect(list_distinct(own), w)) / len(list_distinct(own)) AS containment, threshold FROM b JOIN t USING (size) WHERE NOT phrase AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || needs || ' ')),
p AS (SELECT r, label, s FROM (SELECT r, w, unnest(range(0, len(w))) AS s FROM d), t WHERE phrase AND w[s + 1] = own[1] AND w[s + 1:s + len(own)] = own),
a AS (SELECT r, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY r),
f AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score FROM (SELECT r, label, containment FROM m WHERE containment >= threshold - 1e-9 UNION ALL SELECT r, label, 1.0 FROM p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN a USING (r) LEFT JOIN f USING (r)
"""

#: crc32 by the bitwise definition, for each different word once.
RESAMPLING = f"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, row_number() OVER () AS r, {_PLAIN} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM (SELECT {_PLAIN} AS w FROM benchmark)),
h AS (SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)), tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN h USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN h USING (word) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain FROM (SELECT DISTINCT bucket FROM h) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
x AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN h USING (word) JOIN g USING (bucket) GROUP BY 1),
y AS (SELECT doc_id, r, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN x USING (r)),
z AS (SELECT doc_id, r, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM y),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM k) * 10 // 100 THEN rank END AS rank FROM z LEFT JOIN k USING (r)
"""

#: Every order is played through on every document.
AUDIT = """
WITH w AS (SELECT doc_id, row_number() OVER () AS r, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, r, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
o AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
e AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM e a JOIN e b ON b.i <> a.i JOIN e c ON c.i NOT IN (a.i, b.i) JOIN e d ON d.i NOT IN (a.i, b.i, c.i) JOIN e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
q AS (SELECT part, fails, good, toxic, n, array_to_string(list_transform(p, lambda i: 'ABCDE'[i]), '') AS filter_order, p, i AS step, fails[p[i]] AS fail, list_bool_or(list_concat([false], list_transform(p[1:i - 1], lambda k: fails[k]))) AS earlier, len(list_filter(fails, lambda x: x)) AS n_fails FROM o, p, e),
s AS (SELECT part, filter_order, step, any_value(p[step]) AS own, coalesce(sum(n) FILTER (NOT fail AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (fail AND NOT earlier), 0) AS removed, coalesce(sum(n) FILTER (fail AND earlier), 0) AS redundant,
  coalesce(sum(n) FILTER (fail AND n_fails = 1), 0) AS unique_fails, coalesce(sum(n) FILTER (fail AND NOT earlier AND good), 0) AS good_lost, coalesce(sum(n) FILTER (fail AND NOT earlier AND toxic), 0) AS toxic_lost FROM q GROUP BY 1, 2, 3)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM s
"""

ORACLES = {
    "op4_chat_formatting": CHATS,
    "op5_decontamination": DECONTAMINATION,
    "op6_line_dedup": LINE_DEDUP,
    "op7_quality_rules": QUALITY,
    "op8_near_dedup": NEAR_DEDUP,
    "op9_url_filters": URL_FILTERS,
    "op11_license_scans": LICENSES,
    "op12_importance_resampling": RESAMPLING,
    "op13_filter_audit": AUDIT,
}

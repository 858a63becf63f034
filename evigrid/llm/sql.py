"""DuckDB SQL that gives the rows of those queries which SQL can express."""

from __future__ import annotations

from evigrid.llm.quality import DELTA, LEVELS, RISK, RULES, cutoffs

_BLANK = r"'[\x20\x09-\x0D]+'"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), {_BLANK}), lambda x: x <> '')"


def _quality() -> str:
    falls = ", ".join(f"len(list_filter({cutoffs(r)}::DOUBLE[], lambda c: c >= {ratio.replace(' / ', '::DOUBLE / ')}))" for r, (ratio, _, _) in RULES.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
again AS (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM win JOIN again USING (doc_id, s)) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
c AS (SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_echo_words
  FROM d JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
f AS (SELECT *, CASE WHEN n_words > 0 THEN least({falls}) ELSE {LEVELS} END AS fall FROM b),
good AS (SELECT * FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1)),
tests AS (SELECT stratum, level, count(*) AS n, count(*) FILTER (fall <= level) AS k FROM good, range({LEVELS}) AS r(level) GROUP BY stratum, level),
bound AS (SELECT *, {DELTA} / count(*) OVER (PARTITION BY level) AS share,
  list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) AS tail FROM tests),
levels AS (SELECT stratum, max(level) AS level FROM bound WHERE k <= n * {RISK} AND tail <= share GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(fall <= level, false) AS kept
FROM f LEFT JOIN levels USING (stratum)"""


def _repair() -> str:
    """Least (cost, letters) of each state as text, row by row; states: nothing, system, user, assistant."""
    add = lambda x, cost, letter: f"lpad((substr({x}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{letter}'"
    a = [f"a[{i}]" for i in range(1, 5)]
    gone, more = "x[2] = 'gone'", "(x[3] = 'cut')::INT"
    reads = lambda i, *ways: ", ".join([add(a[i], 3, "D"), *(f"CASE WHEN NOT {gone} AND {when} THEN {add(a[q], f'({cost} + {more})', letter)} END" for q, letter, cost, when in ways)])
    kept = lambda q, c: (q, "K", 0, f"x[1] = '{c}'")
    rerole = lambda q: (q, "R", 2, "true")
    user = [w for q in (0, 1, 3) for w in (kept(q, "u"), rerole(q))]
    read = f"[{reads(0)}, least({reads(1, kept(0, 's'))}), least({reads(2, *user)}), least({reads(3, kept(2, 'a'), rerole(2))})]"
    one = lambda x: add(x, 2, "I")
    z = [f"z[{i}]" for i in range(1, 5)]
    filled = f"[z[1], z[2], least(z[3], {one(z[0])}, {one(z[1])}, {one(z[3])}), least(z[4], {one(z[2])}, {one('(' + one(z[0]) + ')')}, {one('(' + one(z[1]) + ')')})]"
    start = "['000000000', NULL, '000000002I', '000000004II']"
    return rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 20 AS fate
  FROM conversations, crc),
h AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fate <> 0),
r AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, NOT regexp_matches(text, '[^ 	-
]') AS empty,
  NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS cut, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE '?' END AS c
  FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
g AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS two FROM r),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (empty) AS blank, count(*) FILTER (NOT empty AND again) AS duplicate,
  count(*) FILTER (NOT empty AND NOT again AND cut) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal,
  list([c, CASE WHEN empty OR again THEN 'gone' END, CASE WHEN cut THEN 'cut' END] ORDER BY i) AS rows FROM g GROUP BY conv_id),
best AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal,
  list_reduce(rows, lambda a, x: list_transform([{read.replace("x[2] = 'gone'", "coalesce(x[2], '') = 'gone'").replace("(x[3] = 'cut')", "(coalesce(x[3], '') = 'cut')")}], lambda z: {filled})[1], {start}) AS a FROM n),
e AS (SELECT *, substr(least(a[1], a[4]), 1, 9)::BIGINT AS cost, substr(least(a[1], a[4]), 10) AS audit FROM best),
l AS (SELECT conv_id, k, substr(audit, k, 1) AS letter, len(replace(substr(audit, 1, k), 'I', '')) AS i, len(replace(substr(audit, 1, k), 'D', '')) AS place FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS k FROM e)),
o AS (SELECT l.*, r.role, r.text, r.c FROM l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i WHERE letter <> 'D'),
s AS (SELECT *, place - max(CASE WHEN place = 1 AND letter = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS nth FROM o),
p AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS t FROM s GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM d.conv_id"""


ORACLE = {
    "op2_quality_rules": _quality(),
    "op3_byte_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT doc_id, i FROM win JOIN f USING (s) WHERE doc_id > m),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM hit),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (prev IS NULL OR prev < k - 1) AS n_spans FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM cov) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * k + 1, 2), '' ORDER BY k) AS h FROM (SELECT doc_id, h, unnest(range(0, n)) AS k FROM d WHERE doc_id IN (SELECT doc_id FROM runs)) ANTI JOIN cov USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN runs.doc_id IS NULL THEN d.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op7_decontamination": r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM low),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM pat) WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, win.size AS size, item_id FROM win JOIN pat ON win.s = pat.s AND win.size = pat.size),
words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM win JOIN f USING (s) WHERE doc_id > m),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d) ANTI JOIN cov USING (doc_id, k) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op11_reply_trees": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, len(regexp_extract_all(text, '[<\[]\\*(\|im_(start|end)\|>|/?s>|</?SYS>>|/?INST\])')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(url_encode(role)) + 1 + length(text) + n + 11)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id""",
    "op13_conversation_repair": _repair(),
    "op12_source_divergence": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
o AS (SELECT doc_id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM (SELECT DISTINCT doc_id, lang, term FROM o) GROUP BY lang, term HAVING count(*) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (total + v.v)::HUGEINT AS p
  FROM g JOIN v USING (lang) JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM p GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)::HUGEINT) // (total + v)::HUGEINT AS q FROM l JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
}

"""SQL with the rows of the queries, for another engine."""

from __future__ import annotations

from promptloom.llm.lines import FIELD, FIXED, LEADING, MIN_DOCS, MIN_TOKENS, SHORT_DOCS, TWICE
from promptloom.llm.quality import CUTOFFS, ERROR, RISK, RULES

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def _quality() -> str:
    bins = ",\n    ".join("(" + " + ".join(f"CAST((100 * {num}) // greatest({den}, 1) >= {e} AS INTEGER)" for e in edges) + f") AS b_{rule}" for rule, (num, den, edges) in RULES.items())
    cells = " UNION ALL ".join(f"SELECT good, '{rule}' AS rule, b_{rule} AS bin FROM marked WHERE half = 0" for rule in RULES)
    sizes = ", ".join(f"('{rule}', {len(edges) + 1})" for rule, (_, _, edges) in RULES.items())
    long = " UNION ALL ".join(f"SELECT rid, '{rule}' AS rule, b_{rule} AS bin FROM binned" for rule in RULES)
    cutoffs = ", ".join(f"({c})" for c in CUTOFFS)
    return rf"""
WITH f0 AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), wins AS (
  SELECT rid, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM f0)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM wins) WHERE n > 1
), cov AS (
  SELECT rid, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid
), f AS (
  SELECT f0.rid, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(len(list_distinct(words)) AS BIGINT) AS n_distinct,
    CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_capitals,
    CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_bangs,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM f0 LEFT JOIN cov ON f0.rid = cov.rid
), binned AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    {bins}
  FROM f
), marked AS (
  SELECT b.*, good, CAST('0x' || substr(md5(CAST(b.doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 2 AS half
  FROM binned b JOIN (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) l ON b.doc_id = l.doc_id
), cells AS ({cells}),
counts AS (SELECT rule, bin, sum(1 - good) AS bad, sum(good) AS ok FROM cells GROUP BY rule, bin),
sizes AS (SELECT col0 AS rule, col1 AS size FROM (VALUES {sizes})),
grid AS (SELECT rule, size, unnest(range(size)) AS bin FROM sizes),
totals AS (SELECT s.rule, coalesce(sum(bad), 0) AS n_bad, coalesce(sum(ok), 0) AS n_ok FROM sizes s LEFT JOIN counts c ON s.rule = c.rule GROUP BY s.rule),
weights AS (
  SELECT g.rule, g.bin, CAST(round_even(100 * (ln((coalesce(bad, 0) + 1) / (n_bad + size)) - ln((coalesce(ok, 0) + 1) / (n_ok + size))), 0) AS BIGINT) AS weight
  FROM grid g JOIN totals t ON g.rule = t.rule LEFT JOIN counts c ON c.rule = g.rule AND c.bin = g.bin
), scores AS (
  SELECT rid, CAST(sum(weight) AS BIGINT) AS score FROM ({long}) x JOIN weights w ON x.rule = w.rule AND x.bin = w.bin GROUP BY rid
), held AS (SELECT m.stratum, s.score FROM marked m JOIN scores s ON m.rid = s.rid WHERE half = 1 AND good = 1),
strata AS (SELECT stratum, count(*) AS n FROM held GROUP BY stratum),
cut AS (SELECT col0 AS cutoff FROM (VALUES {cutoffs})),
k AS (SELECT s.stratum, s.n, c.cutoff, (SELECT count(*) FROM held h WHERE h.stratum = s.stratum AND h.score >= c.cutoff) AS k FROM strata s, cut c),
tests AS (
  SELECT stratum, cutoff, CASE WHEN k > n * {RISK} THEN FALSE ELSE
    list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))))
      <= {ERROR} / ((SELECT count(*) FROM strata) * {len(CUTOFFS)}) END AS sure
  FROM k
), chosen AS (
  SELECT stratum, min(cutoff) AS cutoff FROM tests t
  WHERE cutoff > coalesce((SELECT max(cutoff) FROM tests u WHERE u.stratum = t.stratum AND NOT sure), -1) GROUP BY stratum
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (cutoff IS NULL OR score < cutoff) AS kept
FROM binned b JOIN scores s ON b.rid = s.rid LEFT JOIN chosen c ON b.stratum = c.stratum
"""


QUALITY = _quality()

LINES = rf"""
WITH d AS (SELECT doc_id AS key, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
l0 AS (SELECT key, unnest(range(len(all_lines))) AS line_no, unnest(all_lines) AS line FROM d),
l1 AS (SELECT key, line_no, trim(regexp_replace(line, '[ \t\x0b\f\r]+', ' ', 'g'), ' ') AS c FROM l0),
l2 AS (SELECT key, line_no, c, string_split(c, ' ') AS plain, string_split(regexp_replace(c, '[^ ]*[0-9][^ ]*', '{FIELD}', 'g'), ' ') AS tokens FROM l1),
l AS (
  SELECT *, len(plain) AS n, len(list_filter(tokens, lambda t: t <> '{FIELD}')) AS m FROM l2
  WHERE len(plain) >= {MIN_TOKENS} OR regexp_matches(c, '[\p{{L}}\p{{N}}]')
), p AS (
  SELECT key, line_no, n, m, tokens, CASE WHEN 100 * m >= {FIXED} * n THEN array_to_string(tokens, ' ') ELSE c END AS form,
    CASE WHEN 100 * m >= {FIXED} * n AND n >= {MIN_TOKENS} THEN n || ' ' || array_to_string(tokens[1:{LEADING}], ' ') END AS leaf FROM l
), rec_form AS (SELECT form, min(key) AS first FROM p GROUP BY form HAVING count(DISTINCT key) >= CASE WHEN max(n) < {MIN_TOKENS} THEN {SHORT_DOCS} ELSE {TWICE} END),
leaves AS (SELECT leaf FROM p WHERE leaf IS NOT NULL GROUP BY leaf HAVING count(DISTINCT key) >= {MIN_DOCS} AND count(DISTINCT form) > 1),
mixed AS (SELECT p.* FROM p JOIN leaves USING (leaf)),
words AS (SELECT * FROM (SELECT key, line_no, leaf, n, m, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM mixed) WHERE token <> '{FIELD}'),
support AS (SELECT leaf, pos, token, count(DISTINCT key) AS docs FROM words GROUP BY ALL HAVING count(DISTINCT key) >= {MIN_DOCS}),
known AS (SELECT w.*, docs FROM words w JOIN support USING (leaf, pos, token)),
lists AS (SELECT key, line_no, leaf, n, m, list({{'pos': pos, 'token': token, 'docs': docs}} ORDER BY pos) AS ws FROM known GROUP BY ALL),
ways AS (
  SELECT key, line_no, leaf, n, unnest(list_concat(
    list_transform(ws, lambda w: list_filter(ws, lambda x: x.docs >= w.docs)),
    CASE WHEN len(ws) = m THEN list_transform(ws, lambda w: list_filter(ws, lambda x: x.pos <> w.pos)) ELSE [] END)) AS fixed FROM lists
), templates AS (
  SELECT DISTINCT key, line_no, leaf, list_transform(fixed, lambda x: x.pos || ' ' || x.token) AS fixed FROM ways WHERE 100 * len(fixed) >= {FIXED} * n
), rec_template AS (SELECT leaf, fixed, min(key) AS first FROM templates GROUP BY ALL HAVING count(DISTINCT key) >= {MIN_DOCS}),
dropped AS (
  SELECT key, line_no FROM p JOIN rec_form USING (form) WHERE key <> first
  UNION SELECT key, line_no FROM templates JOIN rec_template USING (leaf, fixed) WHERE key <> first
), gone AS (SELECT key, list(line_no) AS drop FROM dropped GROUP BY key)
SELECT d.key AS doc_id, CAST(len(all_lines) AS BIGINT) AS n_lines, CAST(coalesce(len(drop), 0) AS BIGINT) AS n_dropped,
  sha256(array_to_string(list_filter(all_lines, lambda x, i: drop IS NULL OR NOT list_contains(drop, i - 1)), chr(10))) AS kept_sha256
FROM d LEFT JOIN gone ON d.key = gone.key
"""

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh
  FROM w
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS h FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id FROM n JOIN reach ON n.doc_id = reach.doc_id GROUP BY n.doc_id, n.n
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
occurrences AS (
  SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
  FROM p, (VALUES (1), (2), (3), (4)) AS sizes(size)
), f AS (SELECT lang, size, phrase, count(*) AS f FROM occurrences GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE size > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c),
scored AS (
  SELECT u.lang, u.phrase, u.a, k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * u.a // (x.f + y.f) AS BIGINT) AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')
), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, size, ws, a, unnest(range(2, size)) AS m FROM c WHERE size > 2),
inside AS (SELECT lang, a, unnest(list_transform(range(1, size - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM parts),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT w.* FROM worst w LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked r JOIN total ON r.lang = total.lang WHERE rank <= 2000
"""

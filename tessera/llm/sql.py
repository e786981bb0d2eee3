"""DuckDB twins of the registered queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

#: Prior and shrinkage of one rule over hosts, as quality.host_verdicts has it.
_RULES = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
    "stutter": "100 * n_stutter > 30 * n_words",
}
_FAILS = ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS f_{r}" for r, c in _RULES.items())
_MOMENTS = ", ".join(f"avg(f_{r} / n_docs) AS m_{r}, var_pop(f_{r} / n_docs) AS v_{r}" for r in _RULES)
_STRENGTH = ", ".join(f"CASE WHEN v_{r} <= 0 OR m_{r} <= 0 OR m_{r} >= 1 THEN 1000.0 ELSE greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 1.0) END AS s_{r}" for r in _RULES)
_RATES = ", ".join(f"(f_{r} + s_{r} * m_{r}) / (n_docs + s_{r})" for r in _RULES)
_ANY = " OR ".join(f"({c})" for c in _RULES.values())

QUALITY = f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, source, text, regexp_extract_all(text, '{WORD}') AS ws FROM t
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '{WORD}') GROUP BY rid
), pos AS (
  SELECT rid, ws, unnest(generate_series(1, len(ws))) AS i FROM w
), grams AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i + 7], ' ')) AS n FROM pos WHERE i <= len(ws) - 7
), covered AS (
  SELECT rid, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS j FROM grams WHERE n > 1) GROUP BY rid
), stutter AS (
  SELECT rid, count(*) AS n_stutter FROM pos WHERE i > 1 AND ws[i] = ws[i - 1] GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_stutter, 0) AS n_stutter
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN stutter USING (rid)
), hosts AS (
  SELECT source AS host, count(*) AS n_docs, {_FAILS} FROM m GROUP BY source
), prior AS (SELECT *, {_STRENGTH} FROM (SELECT {_MOMENTS} FROM hosts)),
verdict AS (SELECT host, greatest({_RATES}) > 0.5 AS failed FROM hosts, prior)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT ({_ANY}) AND NOT coalesce(failed, false) AS kept
FROM m LEFT JOIN verdict ON m.source IS NOT DISTINCT FROM verdict.host
"""

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""
WITH raw AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, source, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS i FROM raw
), k AS (
  SELECT *, trim(line, {_BLANK}) AS t FROM l
), wide AS (
  SELECT t FROM k WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10
), placed AS (
  SELECT k.*, wide.t IS NOT NULL AS is_wide, row_number() OVER (PARTITION BY k.t ORDER BY doc_id NULLS LAST, i) AS rn
  FROM k LEFT JOIN wide ON k.t = wide.t
)
SELECT doc_id, count(*) FILTER (t <> '') AS n_lines, count(*) FILTER (is_wide AND rn > 1) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (is_wide AND rn > 1)), '')) AS kept_sha256
FROM placed GROUP BY rid, doc_id
"""

_SHARE = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * {terms})"
_GAP = "((({p} - {q}) * ({p} - {q})) // ({p} + {q}))"

#: Every group against every kept term of its language, no inclusion and exclusion.
DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), t AS (
  SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL
), kept AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(*) >= 10
), c AS (
  SELECT lang, source, term, sum(n) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
  SELECT lang, source, term, n, {_SHARE.format(n="n", total="sum(n) OVER g", terms="count(*) OVER g")} AS p
  FROM full_counts WINDOW g AS (PARTITION BY lang, source)
), q AS (
  SELECT lang, term, {_SHARE.format(n="n", total="sum(n) OVER g", terms="count(*) OVER g")} AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) WINDOW g AS (PARTITION BY lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0) AS value
  FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum({_GAP.format(p="x.p", q="y.p")}) AS v
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, term AS item, {_GAP.format(p="p", q="q")} AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms)
) WHERE part = 'pair' OR rank <= 10
"""

#: CRC-32 of a decimal number, byte by byte and bit by bit.
_CRC = "xor(list_reduce([4294967295] || flatten(list_transform(string_split({x}::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"

#: Every prefix as the list of its turns; subtrees by all ancestors of every node.
PREFIXES = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS own, {_CRC.format(x="conv_id")} % 9 AS h FROM t GROUP BY conv_id
), r AS (
  SELECT c.conv_id, coalesce(b.own[1:c.h], []) || c.own[c.h + 1:] AS turns FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5
), x AS (
  SELECT conv_id, d AS depth, turns[1:d] AS p, d = len(turns) AS is_end FROM (SELECT *, unnest(generate_series(0, len(turns))) AS d FROM r)
), n AS (
  SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE strlen(p[-1].text) END AS saves,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM x GROUP BY depth, p
), k AS (
  SELECT n.*, m.conv_id AS parent_conv_id, count(*) OVER (PARTITION BY n.depth, m.p) AS siblings, m.p AS up
  FROM n LEFT JOIN n m ON m.depth = n.depth - 1 AND m.p = n.p[1:n.depth - 1]
), children AS (
  SELECT depth - 1 AS depth, up AS p, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN children USING (depth, p)
), below AS (
  SELECT a AS depth, p[1:a] AS p, sum(saves) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(generate_series(0, depth)) AS a FROM full_nodes) GROUP BY ALL
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM full_nodes JOIN below USING (depth, p)
"""

#: All pairs that share a shingle, then the closure of the links.
NEAR = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), g AS (
  SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT rid, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT rid, count(*) AS n FROM g GROUP BY rid
), common AS (
  SELECT x.rid AS a, y.rid AS b, count(*) AS m FROM g x JOIN g y ON x.gram = y.gram AND x.rid < y.rid GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * m >= 85 * (p.n + q.n - m)
), way AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(rid, r) AS (
  SELECT rid, rid FROM d UNION SELECT rid, b FROM reach JOIN way ON r = a
), part AS (
  SELECT reach.rid, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.rid = reach.r GROUP BY reach.rid
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN part USING (rid) LEFT JOIN n USING (rid)
"""

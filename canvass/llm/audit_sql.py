"""DuckDB SQL of the audits and scans that plain SQL can express."""

from __future__ import annotations

from canvass.llm.license_scan import PHRASES, TEMPLATES

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SOURCE_DIVERGENCE = rf"""WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
 u AS (SELECT r, lang, source, unnest(terms) AS term FROM t),
 kept AS (SELECT lang, term, count(*) AS lang_n FROM u GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
 langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM t),
 c AS (SELECT lang, source, term, count(*) AS n FROM u SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
 totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
 d AS (SELECT lang, source, term, coalesce(n, 0) AS n, CAST(1 + 1000000000 * (coalesce(n, 0) + 1) // (coalesce(total, 0) + v) AS BIGINT) AS p,
   CAST(1 + 1000000000 * (lang_n + 1) // (lang_total + v) AS BIGINT) AS q
  FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN c USING (lang, source, term)),
 pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM d AS a JOIN d AS b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
 found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM d WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
WHERE part = 'pair' OR rank <= 200"""

_quoted = lambda values: ", ".join(f"'{v}'" for v in values)
_PLACES = ", ".join(
    "[i - 1 FOR i IN range(1, len(w) + 1) IF " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) + f"] AS p{n}"
    for n, phrase in enumerate(PHRASES)
)
_ROWS = ", ".join(f"('{t.label}', {t.step}, {t.need}, [{_quoted(sorted(set(t.words)))}])" for t in TEMPLATES)

LICENSE_SCAN = rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, [x FOR x IN string_split_regex({_LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
 b AS (SELECT r, doc_id, w, {_PLACES} FROM t),
 a AS (SELECT r, doc_id, len(w) AS n_words, {" || ".join(f"p{n}" for n in range(len(PHRASES)))} AS places,
   {" || ".join(f"(CASE WHEN len(p{n}) > 0 THEN ['{label}'] ELSE [] END)" for n, label in enumerate(PHRASES.values()))} AS base FROM b),
 templates(label, step, need, words) AS (VALUES {_ROWS}),
 steps AS (SELECT DISTINCT step FROM templates),
 blocks AS (SELECT r, step, list_distinct(w[k + 1 : k + 2 * step]) AS held FROM (SELECT r, w, step, unnest(range(0, len(w), step)) AS k FROM t, steps)),
 hits AS (SELECT r, label, len(list_intersect(held, words)) / len(words) AS containment FROM blocks JOIN templates USING (step) WHERE len(list_intersect(held, words)) >= need),
 found AS (SELECT r, list(DISTINCT label) AS more, max(containment) AS best FROM hits GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
 array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
 CAST(CASE WHEN len(places) > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score FROM a LEFT JOIN found USING (r)"""

TURN_REPAIR = r"""WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
 keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
 hashed AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ord(k[i]) AS BIGINT))),
   lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc_table),
 damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
   unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE kind <> 0),
 convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
 placed AS (SELECT c, d.*, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged AS d JOIN convs ON convs.conv_id IS NOT DISTINCT FROM d.conv_id),
 faulty AS (SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS earlier,
   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
 rows AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS x FROM faulty),
 counts AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
   count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY c),
 back AS (
  SELECT c, n + 1 AS i, 0 AS v0, 4 AS v1, 2 AS v2, 0 AS v3 FROM counts
  UNION ALL
  SELECT c, i, least(w0, 2 + w2, 4 + w3), least(w1, 2 + w2, 4 + w3), least(w2, 2 + w3), least(w3, 2 + w2) FROM (
   SELECT b.c, r.i,
    least(3 + v0, CASE WHEN gone THEN 9999999 ELSE least(2 + x + v2, CASE initial WHEN 's' THEN x + v1 WHEN 'u' THEN x + v2 ELSE 9999999 END) END) AS w0,
    least(3 + v1, CASE WHEN gone THEN 9999999 ELSE least(2 + x + v2, CASE initial WHEN 'u' THEN x + v2 ELSE 9999999 END) END) AS w1,
    least(3 + v2, CASE WHEN gone THEN 9999999 ELSE least(2 + x + v3, CASE initial WHEN 'a' THEN x + v3 ELSE 9999999 END) END) AS w2,
    least(3 + v3, CASE WHEN gone THEN 9999999 ELSE least(2 + x + v2, CASE initial WHEN 'u' THEN x + v2 ELSE 9999999 END) END) AS w3
   FROM back AS b JOIN rows AS r ON r.c = b.c AND r.i = b.i - 1)),
 costs AS (SELECT c, i, [v0, v1, v2, v3] AS v FROM back),
 moves AS (SELECT a.c, a.i, a.v AS v, b.v AS later, r.role, r.text, r.initial, r.gone, r.x FROM costs AS a LEFT JOIN costs AS b ON b.c = a.c AND b.i = a.i + 1 LEFT JOIN rows AS r ON r.c = a.c AND r.i = a.i),
 walk AS (
  SELECT c, CAST(1 AS BIGINT) AS i, 0 AS s, '' AS audit, '' AS repaired, CAST(0 AS BIGINT) AS step FROM counts
  UNION ALL
  SELECT c, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN kept ELSE next END, audit || e,
   repaired || CASE WHEN e = 'D' THEN '' ELSE CASE WHEN s = 0 THEN '' ELSE chr(10) END || CASE e WHEN 'K' THEN role || ':' || text
     ELSE CASE WHEN next = 2 THEN 'user:' ELSE 'assistant:' END || CASE WHEN e = 'R' THEN text ELSE '' END END END, step + 1
  FROM (SELECT *, CASE WHEN later IS NOT NULL AND 3 + later[s + 1] = v[s + 1] THEN 'D' WHEN 2 + v[next + 1] = v[s + 1] THEN 'I'
     WHEN kept IS NOT NULL AND x + later[kept + 1] = v[s + 1] THEN 'K' ELSE 'R' END AS e
   FROM (SELECT w.*, m.* EXCLUDE (c, i), CASE WHEN s = 2 THEN 3 ELSE 2 END AS next,
      CASE WHEN gone THEN NULL WHEN initial = 's' AND s = 0 THEN 1 WHEN initial = 'u' AND s <> 2 THEN 2 WHEN initial = 'a' AND s = 2 THEN 3 END AS kept
     FROM walk AS w JOIN moves AS m ON m.c = w.c AND m.i = w.i WHERE later IS NOT NULL OR v[s + 1] > 0))),
 ended AS (SELECT c, arg_max(audit, step) AS audit, arg_max(repaired, step) AS repaired FROM walk GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
 coalesce(illegal, 0) AS illegal, CAST(coalesce(v[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM convs LEFT JOIN counts USING (c) LEFT JOIN ended USING (c) LEFT JOIN costs ON costs.c = convs.c AND costs.i = 1"""

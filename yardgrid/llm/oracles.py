"""SQL for DuckDB of the text operators that have one."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op11_quality_cascade"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT row, unnest(range(1, len(words) - 3)) AS place,
    unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS gram
  FROM split WHERE len(words) >= 5
), repeated AS (
  SELECT row, place, count(*) OVER (PARTITION BY row, gram) AS n FROM windows
), covered AS (
  SELECT row, count(DISTINCT place + step) AS n
  FROM repeated, (SELECT unnest(range(5)) AS step) AS steps WHERE n > 1 GROUP BY row
), counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(text, '[\p{L}\p{M}]')) AS n_letters,
    len(regexp_extract_all(text, '\p{Lu}')) AS n_capitals
  FROM split LEFT JOIN covered USING (row)
), based AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words
    OR 2 * n_dup_lines > n_lines OR 2 * n_letters < word_chars OR 2 * n_capitals > n_letters) AS kept
FROM based
"""

ORACLES["op12_source_divergence"] = r"""
WITH rows AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows
), kept AS (
  SELECT lang, term, count(*) AS all_n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(all_n) AS all_words FROM kept GROUP BY lang
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source, coalesce(words, 0) AS words, coalesce(v, 0) AS v, all_words
  FROM (SELECT DISTINCT lang, source FROM rows)
  LEFT JOIN (SELECT lang, source, sum(n) AS words FROM counted GROUP BY lang, source) USING (lang, source)
  LEFT JOIN langs USING (lang)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (words + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (all_n + 5)) // (all_words + 5 * v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), results AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM results
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLES["op13_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS said
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (
  SELECT c, said, xor(list_reduce(
    flatten(list_transform(string_split(c::VARCHAR, ''), lambda t: [ord(t), -1, -1, -1, -1, -1, -1, -1, -1]))::BIGINT[],
    lambda crc, t: CASE WHEN t >= 0 THEN xor(crc, t) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END,
    4294967295::BIGINT), 4294967295) % 9 AS h
  FROM turns
), whole AS (
  SELECT a.c, list_concat(coalesce(b.said, [])[1:a.h], a.said[a.h + 1:]) AS said
  FROM hashed a LEFT JOIN turns b ON b.c = a.c - a.c % 5
), prefixes AS (
  SELECT c, d, said[1:d] AS said, len(said) AS n FROM whole, LATERAL (SELECT unnest(range(0, len(said) + 1)) AS d)
), nodes AS (
  SELECT d, said, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(said[d]['text']) END AS saved
  FROM prefixes GROUP BY d, said
), children AS (
  SELECT d - 1 AS d, said[1:d - 1] AS said, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), full_nodes AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (d, said)
), above AS (
  SELECT up AS d, said[1:up] AS said, saved, n_children
  FROM full_nodes, LATERAL (SELECT unnest(range(0, d + 1)) AS up)
), sums AS (
  SELECT d, said, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY d, said
)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, s.saved_tokens, x.ends_sha256
FROM full_nodes x JOIN sums s USING (d, said)
LEFT JOIN nodes p ON p.d = x.d - 1 AND p.said = x.said[1:x.d - 1]
"""

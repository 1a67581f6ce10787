"""The same results in DuckDB SQL, where SQL can express them. Ids are taken to be unique."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op2_line_templates"] = r"""
WITH texts AS (
  SELECT DISTINCT text FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT DISTINCT text, line FROM (SELECT text, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), parsed AS (
  -- n: distinct texts that hold the line
  SELECT line, count(*) AS n, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS tokens FROM lines GROUP BY line
), placed AS (
  SELECT *, md5(concat(len(tokens)::VARCHAR, ' ', array_to_string(
    [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END FOR t IN tokens[1:3]], ' '))) AS leaf
  FROM parsed
), reached AS (
  SELECT leaf FROM placed GROUP BY leaf HAVING sum(n) >= 5
), tokens AS (
  SELECT leaf, line, n, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM placed JOIN reached USING (leaf)
), support AS (
  SELECT leaf, i, token, sum(n) AS support FROM tokens GROUP BY leaf, i, token HAVING sum(n) >= 5
), whole AS (
  SELECT t.line, list(t.token ORDER BY t.i) AS words, list(coalesce(s.support, 0) ORDER BY t.i) AS known,
    list(regexp_matches(t.token, '[0-9]') ORDER BY t.i) AS digit
  FROM tokens t LEFT JOIN support s ON t.leaf = s.leaf AND t.i = s.i AND t.token = s.token GROUP BY t.line
), levels AS (
  SELECT *, unnest([5 * 4 ** k FOR k IN range(14)]) AS level FROM whole
), ways AS (
  SELECT *, unnest([false, true]) AS masked FROM levels WHERE level <= list_max(known)
), forms AS (
  SELECT line, words, digit, [known[j] >= level AND NOT (masked AND digit[j]) FOR j IN range(1, len(words) + 1)] AS c
  FROM ways
), templates AS (
  SELECT DISTINCT line,
    array_to_string([CASE WHEN c[j] THEN words[j] ELSE '<*>' END FOR j IN range(1, len(words) + 1)], ' ') AS template
  FROM forms
  WHERE len([1 FOR x IN c IF x]) >= least(2, len(words))
    AND len([1 FOR x IN c IF x])
      >= 0.6::DOUBLE * len([1 FOR j IN range(1, len(words) + 1) IF c[j] OR NOT digit[j]])
), recurring AS (
  SELECT template FROM templates JOIN lines USING (line) GROUP BY template HAVING count(DISTINCT text) >= 5
), gone AS (
  SELECT DISTINCT line FROM templates JOIN recurring USING (template)
), sizes AS (
  SELECT text, sum(length(line)) AS size FROM lines GROUP BY text
), losses AS (
  SELECT text, sum(length(line)) AS lost, min(md5(line)) AS low, min(reverse(md5(line))) AS back
  FROM lines JOIN gone USING (line) GROUP BY text
), heavy AS (
  SELECT doc_id, text, low, back FROM documents JOIN losses USING (text) JOIN sizes USING (text) WHERE lost > 0.5 * size
), whole_ids AS (
  SELECT min(doc_id) AS doc_id FROM heavy GROUP BY low HAVING count(DISTINCT text) > 1
  UNION SELECT min(doc_id) FROM heavy GROUP BY back HAVING count(DISTINCT text) > 1
), numbered AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents WHERE text IS NOT NULL
), marked AS (
  SELECT n.doc_id, n.i, n.line, g.line IS NOT NULL AND n.doc_id NOT IN (SELECT doc_id FROM whole_ids) AS gone
  FROM numbered n LEFT JOIN gone g ON n.line = g.line
), rebuilt AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, r.text
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id
"""

ORACLES["op8_snapshot_collapse"] = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
), convs AS (
  SELECT conv_id, count(*) AS n_turns,
    list(concat('<|', role, '|>', chr(10), text, chr(10)) ORDER BY turn NULLS FIRST, role, text) AS parts
  FROM turns GROUP BY conv_id
), openings AS (
  SELECT DISTINCT parts[1:k] AS parts
  FROM (SELECT parts, unnest(range(1, n_turns)) AS k FROM convs WHERE n_turns > 1)
), equal AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_snapshots, parts FROM convs GROUP BY parts
)
SELECT conv_id, len(parts)::BIGINT AS n_turns, n_snapshots, array_to_string(parts, '') AS text
FROM equal WHERE parts NOT IN (SELECT parts FROM openings)
"""

ORACLES["op10_sentence_spans"] = r"""
WITH split AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?\n]*[ \t\r\n]*|[.!?\n]+[ \t\r\n]*') AS pieces
  FROM documents
), trimmed AS (
  SELECT doc_id, [trim(p, chr(32) || chr(9) || chr(13) || chr(10)) FOR p IN pieces] AS s FROM split
), counted AS (
  SELECT doc_id, s, [CASE WHEN x = '' THEN 0 ELSE len(string_split_regex(x, '[ \t\r\n]+')) END FOR x IN s] AS w
  FROM trimmed
), each AS (
  SELECT doc_id, s, w, len(s) AS count, unnest(range(len(s))) AS i FROM counted
), sized AS (
  -- the shortest run of two sentences or more and ten words or more from each sentence on,
  SELECT doc_id, s, i AS start, [n FOR n IN range(2, 12) IF i + n <= count AND list_sum(w[i + 1:i + n]) >= 10][1] AS n
  FROM each
  UNION ALL  -- up to each sentence,
  SELECT doc_id, s, i + 1 - n, n FROM (
    SELECT doc_id, s, i, [n FOR n IN range(2, 12) IF i + 1 >= n AND list_sum(w[i + 2 - n:i + 1]) >= 10][1] AS n FROM each
  )
  UNION ALL  -- sentences long enough alone, texts of one sentence
  SELECT doc_id, s, i, 1 FROM each WHERE w[i + 1] >= 20 OR (count = 1 AND w[1] >= 10)
), spans AS (
  SELECT DISTINCT doc_id, start, n, array_to_string(s[start + 1:start + n], chr(10)) AS span FROM sized WHERE n IS NOT NULL
), ranked AS (
  SELECT *, rank() OVER (PARTITION BY span ORDER BY doc_id, start) AS nth FROM spans
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + n)) AS i FROM ranked WHERE nth > 1
), pieces AS (
  SELECT doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM split
), rebuilt AS (
  SELECT p.doc_id, count(*) AS n_sentences, count(g.i) AS n_removed,
    coalesce(string_agg(piece, '' ORDER BY p.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM pieces p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
)
SELECT s.doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(r.text, s.text) AS text
FROM split s LEFT JOIN rebuilt r ON s.doc_id = r.doc_id
"""

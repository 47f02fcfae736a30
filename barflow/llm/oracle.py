"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Words in order, windows of 8, lines, and the rules as one conjunction.
OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT k, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), many AS (
  SELECT k, x FROM v GROUP BY k, x HAVING count(*) > 1
), rep AS (
  SELECT k, count(DISTINCT j) AS n FROM (SELECT v.k, unnest(range(v.i, v.i + 8)) AS j FROM v JOIN many USING (k, x)) GROUP BY k
), ln AS (
  SELECT k, count(*) AS lines, count(*) - count(DISTINCT s) AS dup
  FROM (SELECT k, unnest(string_split(t, chr(10))) AS s FROM d) WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY k
), c AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(ln.dup, 0) AS n_dup_lines, coalesce(ln.lines, 0) AS lines, coalesce(rep.n, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}]', '', 'g')) AS upper, length(regexp_replace(t, '\P{L}', '', 'g')) AS letters,
    length(regexp_replace(t, '[^\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3000}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}]', '', 'g')) AS unspaced,
    (length(t) - length(replace(t, '!!', ''))) // 2 AS shouts
  FROM d LEFT JOIN ln USING (k) LEFT JOIN rep USING (k)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 10 * word_chars) AND NOT (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * lines) AND NOT (letters >= 40 AND 100 * upper > 50 * letters)
    AND NOT (100 * shouts > 30 * n_words) AND word_chars >= 2 * n_words AND (word_chars <= 20 * n_words OR 2 * unspaced > word_chars) AS kept
FROM b
"""

#: All windows of all items joined to all windows of all documents.
OP8 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), it AS (
  SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM it)
), dw AS (
  SELECT k, m, i, array_to_string(w[i:i + m - 1], ' ') AS x
  FROM (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM it) WHERE len(w) >= m)
), hit AS (
  SELECT dw.k, dw.i, dw.m, iw.item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.x = iw.x
), words AS (
  SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + m)) AS j FROM hit) GROUP BY k
), items AS (
  SELECT k, count(item_id) AS n, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM (SELECT DISTINCT k, item_id FROM hit) GROUP BY k
)
SELECT d.doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, coalesce(items.s, sha256('')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""

#: Shared shingles counted for every two documents, links closed by recursion.
OP5 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT k, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT k, count(*) AS n FROM s GROUP BY k
), p AS (
  SELECT a.k AS p, b.k AS q, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.k <> b.k GROUP BY a.k, b.k
), l AS (
  SELECT p, q FROM p JOIN n x ON x.k = p JOIN n y ON y.k = q WHERE 100 * c >= 90 * (x.n + y.n - c)
), reach AS (
  SELECT k AS p, k AS q FROM d UNION SELECT reach.p, l.q FROM reach JOIN l ON l.p = reach.q
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(e.doc_id) FROM reach r JOIN d e ON e.k = r.q WHERE r.p = d.k) AS component_id
FROM d LEFT JOIN n USING (k)
"""

#: All anchors scored against all rows.
OP11 = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

#: Cuts from the hash of the id, parts by code points.
OP13 = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), k AS (
  SELECT *, CAST('0x' || s[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || s[9:16] AS BIGINT) % (n + 1) AS c2,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || s[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || s[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

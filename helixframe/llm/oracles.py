"""SQL, in DuckDB's dialect, of the operators that SQL can express."""

from helixframe.llm import chat, filter_audit, quality

_WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS w FROM docs),
grams AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY r),
lines AS (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM docs),
normal AS (
  SELECT *, trim(lower(regexp_replace(regexp_replace(line, '[\x09-\x0D\x20]+', ' ', 'g'), '[0-9]+', '0', 'g')), ' ') AS n FROM lines WHERE regexp_matches(line, '{_WORD}')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM normal GROUP BY r),
frequent AS (SELECT host, n FROM (SELECT DISTINCT host, n, text FROM normal) GROUP BY host, n HAVING count(*) > {quality.LIMIT}),
lost AS (SELECT r, sum(len(regexp_extract_all(line, '{_WORD}'))) AS n FROM normal SEMI JOIN frequent USING (host, n) GROUP BY r),
measured AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
         coalesce(p.n, 0)::BIGINT AS n_repeat_words, (len(w) - coalesce(l.n, 0))::BIGINT AS n_left_words
  FROM words w LEFT JOIN dups d USING (r) LEFT JOIN repeats p USING (r) LEFT JOIN lost l USING (r))
SELECT *, NOT base_failed AND n_left_words >= {quality.MIN_WORDS} AND n_left_words >= {quality.MIN_LEFT} * n_words AS kept
FROM (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM measured)"""

JACCARD = r"""
WITH RECURSIVE docs AS (SELECT doc_id, md5(coalesce(text, '')) AS key, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM documents),
texts AS (SELECT key, any_value(w) AS w, count(*) AS copies, min(doc_id) AS least FROM docs WHERE len(w) > 0 GROUP BY key),
shingles AS MATERIALIZED (
  SELECT DISTINCT key, array_to_string(w[i:i + 4], ' ') || CASE WHEN len(w) < 5 THEN ' .' ELSE '' END AS s
  FROM (SELECT key, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM texts)),
sizes AS (SELECT key, count(*) AS n FROM shingles GROUP BY key),
shared AS (SELECT a.key AS a, b.key AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.key <> b.key GROUP BY ALL),
linked AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.key = a JOIN sizes y ON y.key = b WHERE shared.n >= 0.8 * (x.n + y.n - shared.n) - 1e-6),
reach AS (SELECT key AS a, key AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b),
classes AS (SELECT r.a AS key, min(t.least) AS class_id FROM reach r JOIN texts t ON t.key = r.b GROUP BY r.a),
counts AS (SELECT t.key, t.copies - 1 + coalesce(sum(o.copies), 0) AS n FROM texts t LEFT JOIN linked l ON l.a = t.key LEFT JOIN texts o ON o.key = l.b GROUP BY t.key, t.copies)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n, 0)::BIGINT AS n_links, doc_id = coalesce(class_id, doc_id) AS is_kept, upper(d.key) AS text_key
FROM docs d LEFT JOIN classes c USING (key) LEFT JOIN counts k USING (key)"""

SQL = {"op3_quality_rules": QUALITY, "op6_ngram_jaccard_join": JACCARD, "op7_chat_formatting": chat.ORACLE_SQL, "op11_filter_audit": filter_audit.ORACLE_SQL}

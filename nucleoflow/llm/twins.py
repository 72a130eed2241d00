"""SQL twins of corpus queries that SQL can express, for small tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s
  FROM w WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(size.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM documents d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP8_SQL = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM
    (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
win AS (
  SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: struct_pack(i := i, s := array_to_string(w[i:i + 7], ' ')))) AS x FROM w),
twice AS (SELECT doc_id, x.i AS i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x.s) > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY 1),
m AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
         (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN line USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (
  SELECT doc_id, lang, source, unnest([
    struct_pack(m := 'word_length', v := CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END),
    struct_pack(m := 'symbols', v := CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END),
    struct_pack(m := 'dup_lines', v := CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END),
    struct_pack(m := 'repeats', v := CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END)]) AS x FROM m),
sketch AS (
  SELECT lang, source, x.m AS m, ceil(ln(x.v + 1) / ln(1.02) - 1e-9)::INT AS bucket, count(*) AS n FROM v GROUP BY ALL),
run AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, m ORDER BY bucket) AS through, sum(n) OVER (PARTITION BY lang, source, m) AS total FROM sketch),
own AS (
  SELECT lang, source, m, max(total) AS total, min(CASE WHEN through >= 0.25 * total THEN pow(1.02, bucket) - 1 END) AS q1,
         min(CASE WHEN through >= 0.75 * total THEN pow(1.02, bucket) - 1 END) AS q3 FROM run GROUP BY ALL),
lsum AS (SELECT lang, m, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
lrun AS (SELECT *, sum(n) OVER (PARTITION BY lang, m ORDER BY bucket) AS through, sum(n) OVER (PARTITION BY lang, m) AS total FROM lsum),
per_lang AS (
  SELECT lang, m, min(CASE WHEN through >= 0.25 * total THEN pow(1.02, bucket) - 1 END) AS q1,
         min(CASE WHEN through >= 0.75 * total THEN pow(1.02, bucket) - 1 END) AS q3 FROM lrun GROUP BY ALL),
lim AS (
  SELECT lang, source, m, q1, q3, greatest(4.0 * (q3 - q1), CASE m WHEN 'word_length' THEN 3000 WHEN 'symbols' THEN 100 WHEN 'dup_lines' THEN 500 ELSE 300 END) AS width
  FROM (SELECT o.lang, o.source, o.m, CASE WHEN o.total >= 200 THEN o.q1 ELSE l.q1 END AS q1, CASE WHEN o.total >= 200 THEN o.q3 ELSE l.q3 END AS q3
        FROM own o JOIN per_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.m = l.m)),
good AS (
  SELECT v.doc_id, bool_and(x.v <= q3 + width AND (x.m <> 'word_length' OR x.v >= q1 - least(width, q1 / 2))) AS ok
  FROM v JOIN lim ON v.lang IS NOT DISTINCT FROM lim.lang AND v.source IS NOT DISTINCT FROM lim.source AND x.m = lim.m GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND ok AS kept
FROM m JOIN good USING (doc_id)
"""

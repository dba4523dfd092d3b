"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# CRC-32 of the UTF-8 bytes, folded over a table built from the polynomial
ORACLE["op1_sharding"] = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1
           THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                        lambda x: ('0x' || x)::BIGINT),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM documents, tab
), placed AS (
  SELECT *, sum(size) OVER w - size AS start, sum(size) OVER () AS total
  FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS UNBOUNDED PRECEDING)
), cut AS (
  SELECT *, ((2 * start + size) * 24 // (2 * total))::INT AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, NULL::INT AS grown_shard
FROM cut
"""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE["op2_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM d WHERE len(ws) >= 5
), grams AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM win
), twice AS (
  SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY r
), s AS (
  SELECT d.r, doc_id, text, len(ws) AS n_words, len(ls) AS n_lines, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (r)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed
            OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 7 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * length(regexp_replace(text, '[^!]+', '', 'g')) > n_words
            OR 2 * len(regexp_extract_all(text, '(\.\.\.|…)[\x20\x09\x0B-\x0D]*(\n|$)')) > n_lines + 1
            OR 10 * len(regexp_extract_all(text, '(^|\n)[\x20\x09]*[•◦‣▪*-][\x20\x09]')) > 9 * n_lines + 1
            OR 2 * len(regexp_extract_all(text, '\p{{L}}[^\x20\x09-\x0D]*')) < n_words) AS kept
FROM b
"""

ORACLE["op10_url_filters"] = r"""
WITH r(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), after AS (
  SELECT row_number() OVER () AS n, page_id,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM after
), fit AS (
  SELECT n, r.host || r.path AS rule, verdict FROM p JOIN r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (n)
"""


ORACLE["op7_substring_dedup"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents
), win AS (
  SELECT r, doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM d WHERE len(ws) >= 50
), keyed AS (
  SELECT r, doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS w FROM win
), later AS (
  SELECT r, i FROM keyed QUALIFY doc_id > min(doc_id) OVER (PARTITION BY w)
), gone AS (
  SELECT r, list(DISTINCT i + k) AS gone_at FROM later, (SELECT unnest(range(50)) AS k) GROUP BY r
), kept AS (
  SELECT doc_id, ws, list_filter(ws, lambda w, j: gone_at IS NULL OR NOT list_contains(gone_at, j)) AS ks
  FROM d LEFT JOIN gone USING (r)
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(ks))::BIGINT AS n_removed,
       sha256(array_to_string(ks, ' ')) AS kept_sha256
FROM kept
"""


ORACLE["op12_spelling_variants"] = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1
           THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
), per_doc AS (
  SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, c, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'),
                                                lambda x: ('0x' || x)::BIGINT),
                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM per_doc, tab
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
              ELSE run END AS word, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(c) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, c.word, c.n FROM words w JOIN cut c ON w.word = c.rest
  UNION SELECT c.word, w.word, w.n FROM words w JOIN cut c ON w.word = c.rest
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
         CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), way AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT way.word, f.form FROM way JOIN formed f ON f.word = way.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT way.word, way.root FROM way JOIN formed f ON f.word = way.root WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM formed JOIN ends USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

"""The SQL that registered queries must agree with, where SQL can express them."""

from __future__ import annotations

from dispatchmart.llm.records import duckdb_records

# The phrases of boilerplate lines, as in the rules.
_PHRASES = (
    "all rights reserved|licensed under|terms of use|terms of service|privacy policy|cookie policy|uses cookies|"
    "accept cookies|enable javascript|lorem ipsum|click here|read more|sign up|log in|subscribe to|share this|"
    "skip to content|back to top"
)

QUALITY_RULES = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, i, w FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs))
),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times
  FROM (
    SELECT doc_id, i, w AS a, lead(w, 1) OVER one AS b, lead(w, 2) OVER one AS c
    FROM words WINDOW one AS (PARTITION BY doc_id ORDER BY i))
  WHERE c IS NOT NULL
),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM windows WHERE times > 1) GROUP BY doc_id
),
per_word AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         len(regexp_extract_all(line, '[|»›•·>]')) AS seps,
         len(regexp_extract_all(line, '[!?]{{2,}}')) AS shouted
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
),
judged AS (
  SELECT *, has_word AND (
      NOT regexp_matches(line, '[.!?…。！？]["''”’»)\]]*(\s|$)') OR 3 * shouted > n
      OR (seps >= 3 AND n <= 6 * seps)
      OR (n <= 25 AND regexp_matches(line, '{_PHRASES}', 'i'))) AS failed
  FROM lines
),
per_line AS (
  SELECT doc_id, count(*) FILTER (has_word) - count(DISTINCT line) FILTER (has_word) AS n_dup_lines,
         sum(length(line)) AS size, coalesce(sum(length(line)) FILTER (failed), 0) AS lost
  FROM judged GROUP BY doc_id
),
measured AS (
  SELECT docs.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         CASE WHEN size > 0 THEN lost::DOUBLE / size ELSE 0.0 END AS lost_share
  FROM docs LEFT JOIN per_word USING (doc_id) LEFT JOIN per_line USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_share <= 0.5 AS kept,
       round(lost_share, 6) AS lost_share
FROM measured
"""

URL_FILTER = """
WITH split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
addressed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
),
rules AS (
  SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS r(verdict, of_host, start)
),
fitting AS (
  SELECT page_id, arg_max(of_host || start, length(of_host || start)) AS rule, arg_max(verdict, length(of_host || start)) AS verdict
  FROM addressed JOIN rules ON (host = of_host OR ends_with(host, '.' || of_host)) AND starts_with(path, start)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM (SELECT *, regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)') AS listed FROM addressed)
LEFT JOIN fitting USING (page_id)
"""

REVISITS = f"""
WITH records AS ({duckdb_records()}),
split AS (
  SELECT *, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS p,
         regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q
  FROM records
),
named AS (
  SELECT *, regexp_replace(regexp_replace(lower(h), '^www\\.', ''), ':(80|443)$', '') || regexp_replace(p, '/+$', '') AS site,
         list_sort(list_filter(string_split(q, '&'), lambda v: v <> '' AND NOT regexp_matches(lower(v),
           '^(utm_[a-z]+|gclid|fbclid|sid|sessionid|phpsessid|jsessionid)(=|$)'))) AS wanted
  FROM split
),
canonical AS (
  SELECT *, CASE WHEN contains(url, '://')
                 THEN site || CASE WHEN len(wanted) > 0 THEN '?' || array_to_string(wanted, '&') ELSE '' END END AS canonical
  FROM named
),
joined AS (
  SELECT *, last_value(CASE WHEN kind = 'response' AND canonical IS NOT NULL THEN
           {{'id': record_id, 'etag': etag, 'last_modified': last_modified, 'cache_control': cache_control,
             'content_length': content_length}} END IGNORE NULLS) OVER (
           PARTITION BY canonical ORDER BY seconds, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM canonical
),
checked AS (
  SELECT *, CASE WHEN canonical IS NULL THEN 'no_url'
                 WHEN r IS NULL THEN 'no_earlier_response'
                 WHEN coalesce(regexp_replace(r.etag, '^W/', '') = regexp_replace(etag, '^W/', ''),
                               r.last_modified = last_modified) THEN 'resolved'
                 WHEN coalesce(regexp_replace(r.etag, '^W/', '') = regexp_replace(etag, '^W/', ''),
                               r.last_modified = last_modified) IS NULL THEN 'no_validator'
                 ELSE 'validator_mismatch' END AS outcome
  FROM joined WHERE kind = 'revisit'
)
SELECT record_id, canonical, outcome,
       CASE WHEN outcome = 'resolved' THEN r.id END AS refers_to,
       CASE WHEN outcome = 'resolved' THEN coalesce(etag, r.etag) END AS etag,
       CASE WHEN outcome = 'resolved' THEN r.last_modified END AS last_modified,
       CASE WHEN outcome = 'resolved' THEN coalesce(cache_control, r.cache_control) END AS cache_control,
       CASE WHEN outcome = 'resolved' THEN r.content_length END AS content_length
FROM checked
"""

LINE_DEDUP = r"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM numbered),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT r, doc_id, line, pos, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

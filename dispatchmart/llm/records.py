"""Archive records derived from the given pages, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

# Every page is fetched, then asked for again three times: unchanged, unchanged with a weak tag, and with a tag that may
# have changed or be missing. Each fetch also asks for the site's robots.txt, which few of them receive in full, so the
# address of a large site is that of a large part of all records.
RECORDS = """
SELECT page_id * 5 + k AS record_id,
       CASE WHEN k = 0 OR (k = 4 AND page_id % 40 = 0) THEN 'response' ELSE 'revisit' END AS kind,
       CASE WHEN k = 4 THEN regexp_replace(url, '(://[^/?#]*).*$', '{first}/robots.txt') ELSE url END AS url,
       (page_id * 7919 % 1000003) * 97 + k * 86400 AS seconds,
       CASE WHEN k = 0 OR (k = 4 AND page_id % 40 = 0) THEN 200 ELSE 304 END AS status,
       CASE WHEN k = 4 THEN '"r' || CAST(page_id % 3 AS VARCHAR(9)) || '"'
            WHEN k = 3 AND page_id % 7 = 0 THEN NULL
            WHEN k = 3 AND page_id % 5 = 0 THEN '"changed"'
            WHEN k = 2 THEN 'W/"' || tag || '"'
            ELSE '"' || tag || '"' END AS etag,
       CASE WHEN k < 4 AND page_id % 3 = 0 THEN 'day ' || CAST(page_id % 11 AS VARCHAR(9)) END AS last_modified,
       CASE WHEN k = 1 THEN NULL ELSE 'max-age=' || CAST(60 * (k + 1) AS VARCHAR(9)) END AS cache_control,
       CAST(CASE WHEN k = 0 THEN size WHEN k = 4 THEN 99 ELSE 0 END AS VARCHAR(20)) AS content_length
FROM (SELECT page_id, url, substr(md5(html), 1, 12) AS tag, length(html) AS size, {numbers} AS k FROM {pages})
"""


def spark_records(pages: str) -> str:
    return RECORDS.format(pages=pages, first="$1", numbers="explode(array(0, 1, 2, 3, 4))")


def duckdb_records() -> str:
    return RECORDS.format(pages="pages", first="\\1", numbers="unnest([0, 1, 2, 3, 4])")

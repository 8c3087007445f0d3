"""Dispatch data derived from the given tables.

The given tables hold no taxi data, so every input is computed from whole tables
by SQL that Spark and DuckDB read alike. ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "benchmark", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run portable SQL over the tables it names."""
    named = {name: table(spark, sf_dir, name) for name in TABLES if f"{{{name}}}" in sql}
    return spark.sql(sql, **named)


def portable(sql: str) -> str:
    """The same SQL with plain table names and standard quotes."""
    return sql.format(**{name: name for name in TABLES}).replace("`", '"')


def pick(number: str, words: str) -> str:
    """SQL that takes one of some comma-separated words by a whole number."""
    return f"split_part('{words}', ',', CAST(({number}) % {len(words.split(','))} AS INT) + 1)"


def pick_with_commas(number: str, words: str) -> str:
    """Like ``pick``; semicolons in the words become commas in the result."""
    return f"replace({pick(number, words)}, ';', ',')"


def text(number: str) -> str:
    return f"CAST({number} AS STRING)"


def padded(number: str, width: int) -> str:
    return f"lpad({text(number)}, {width}, '0')"


def us_date(day: str) -> str:
    return f"{padded(f'month({day})', 2)} || '/' || {padded(f'day({day})', 2)} || '/' || {text(f'year({day})')}"


_CLOCK = f"{text('o_orderkey % 12 + 1')} || ':' || {padded('o_custkey % 60', 2)} || ':00 ' || {pick('o_orderkey', 'am,PM')}"
_HOUSE = text("o_custkey % 900 + 1")

STREETS = f"""
SELECT o_orderkey,
       {_HOUSE} || ' ' || {pick('o_custkey', 'W 45,E 11,PARK,N 2,S 103,MAIN')} || ' ' ||
       {pick('o_orderkey + o_custkey', 'AV,AVENUE,ST,STREET,BL,COURT,LANE,ROAD,DRIVE,HY,PZ,TP,PL,AVE,AV X')} AS address
FROM {{orders}}
"""

PADDED_PARTS = """
SELECT p_partkey AS `Part Key`, '  ' || p_name || ' ' AS `Name `, p_brand || '   ' AS brand, ' ' || p_type AS `Part TYPE`
FROM {part}
"""

DATED_ORDERS = f"""
SELECT o_orderkey AS order_key, {us_date('o_orderdate')} AS date, {_CLOCK} AS time
FROM {{orders}}
"""

CROSS_STREETS = f"""
SELECT o_orderkey,
       {_HOUSE} || '  ' || {pick('o_orderkey', 'FIRST AVE,MAIN ST,BROADWAY')} || ' ' ||
       {pick('o_custkey', 'ON 5 MAIN X,ON MAIN ST B,ON B,ON,AT PARK,ON W 7 END')} AS address
FROM {{orders}}
"""

NUMBER_WORDS = f"""
SELECT c_custkey, {text('c_custkey % 90')} || ' ' ||
       {pick('c_custkey', 'FIRST,SECOND,THIRD,FOURTH,FIFTH,SIXTH,SEVENTH,EIGHTH,NINTH,TENTH,ELEVENTH,TWELFTH,MAINFIRST')}
       || ' AVE ' || {pick('c_nationkey', 'TENTH,X,THIRDS')} AS address
FROM {{customer}}
"""

FREE_ADDRESSES = f"""
SELECT o_orderkey,
       {_HOUSE} || ' ' || {pick('o_orderkey', 'W 45 ST NEW YORK,MAIN ST,BROADWAY NEW YORK NY,E 3 PLAZA APT 4 ON TOP,KINGS HWY X')}
       || {pick('o_custkey', ', LGA, DR Y, PL')} AS address
FROM {{orders}}
"""

PART_LABELS = "SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS address FROM {part}"

COMPASS_ADDRESSES = f"""
SELECT o_orderkey,
       {_HOUSE} || ' ' || {pick('o_custkey', 'W,E,S,N,X')} || '  ' || {text('o_orderkey % 130')} || ' ST' AS address
FROM {{orders}}
"""

DIGIT_STREETS = f"""
SELECT o_orderkey,
       {pick('o_custkey', 'W ,,EAST ,AVENUE ')} || {text('o_orderkey % 1000')} ||
       {pick('o_orderkey', ' ST,ND ST,, AVE X,TH AVE,-A')} AS street
FROM {{orders}}
"""

LOCATIONS = f"""
SELECT o_orderkey, {_HOUSE} || ' MAIN ST' AS address,
       {pick('o_custkey + o_orderkey', 'M,BK,BX,QU,HOBOKEN NJ,STAMFORD CT,ISLIP LI,NWK,JFK,LAG,PHILLY PA,CA,ST,WE,MA,XM,')} AS location,
       {pick('o_orderkey', 'NY,NJ,PA,CT,VA,RI,M,MA,NEW JERSEY,EWR,JFK,LGA,LAG,NWK,ISP,TEB,HPN,TX')} AS state,
       {pick('o_custkey', 'JFK AIRPORT,LGA TERMINAL B,XEWR,TO JFK,5 PARK AVE,')} AS words
FROM {{orders}}
"""

FRAGMENTS = f"""
SELECT o_orderkey, {_HOUSE} || {pick_with_commas('o_orderkey', ' NEW ST; NEW YORK, RENEW AVE, PARK')} || ', ' ||
       {pick('o_custkey', 'BRONX,BX,A BX,NYC,N NY,NEW YORK,BROOKLYN,X QU,NY.,NYX,STATEN ISLAND')} AS address
FROM {{orders}}
"""

EVENT_TIMES = f"""
SELECT event_id,
       {text('month(ts)')} || '-' || {text('day(ts)')} || '-' || {text('year(ts)')} || ' ' ||
       {text("(hour(ts) + 11) % 12 + 1")} || ':' || {padded('minute(ts)', 2)} || ':' || {padded("CAST(second(ts) AS INT)", 2)}
       || CASE WHEN hour(ts) < 12 THEN ' AM' ELSE ' PM' END AS clock
FROM {{events}}
"""

CITIES_AND_SOURCES = f"""
SELECT c_custkey,
       {pick('c_custkey', 'BRONX,BROOKLYN,JAMAICA,EAST ELMHURST,MANHATTAN,NEW YORK CITY,NEWARK,Other,QUEENS,bronx')} AS city,
       {pick('c_nationkey', 'DIAL7,FIRSTCLASS,LYFT,SKYLINE,UBER')} AS source
FROM {{customer}}
"""

_VISIT = "(DATE '2014-11-20' + CAST(c_custkey * 7 % 97 AS INT))"
PLACED_CUSTOMERS = f"""
SELECT c_custkey, replace({us_date(_VISIT)}, '/', '-') || ' ' || {text('c_custkey % 12 + 1')} || ':05:00 ' || {pick('c_custkey', 'AM,PM,am')} AS datetime, 'STAND ' || {text('c_nationkey')} AS street_address,
       c_mktsegment AS city, CASE WHEN c_acctbal < 0 THEN 'UNLISTED' ELSE {text('c_nationkey % 5')} END AS state
FROM {{customer}}
"""

GAZETTEER = f"""
SELECT 'STAND ' || {text('s_nationkey')} AS street_address, c_mktsegment AS city, {text('s_nationkey % 5')} AS state,
       s_acctbal AS latitude, CAST(s_suppkey AS DOUBLE) AS longitude
FROM {{supplier}} JOIN (SELECT DISTINCT c_nationkey, c_mktsegment FROM {{customer}}) AS c ON s_nationkey = c_nationkey
"""

# Every order at a house number; a third of them on one street. Some streets and cities have no ranges.
NUMBERED_PICKUPS = f"""
SELECT o_orderkey, {text('o_custkey % 1200')} || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN 'BROADWAY' ELSE 'STREET ' || {text('o_custkey % 60')} END AS street_address,
       {pick('o_custkey', 'BRONX,QUEENS,NOWHERE,BROOKLYN')} AS city, 'NEW YORK' AS state
FROM {{orders}}
UNION ALL
SELECT -1 - c_custkey, {pick('c_custkey', 'JFK AIRPORT,STREET 5,12345678901 BROADWAY')}, 'QUEENS', 'NEW YORK' FROM {{customer}}
"""

# Ranges of every part, with coordinates that doubles hold exactly.
HOUSE_RANGES = f"""
SELECT CASE WHEN p_partkey % 4 = 0 THEN 'BROADWAY' ELSE 'STREET ' || {text('p_partkey % 45')} END AS street,
       {pick('p_partkey', 'BRONX,QUEENS,BROOKLYN')} AS city, 'NEW YORK' AS state,
       p_partkey * 7 % 1000 AS house_from, p_partkey * 7 % 1000 + CASE WHEN p_partkey % 50 = 0 THEN 1000 ELSE p_size - 1 END AS house_to,
       {pick('p_partkey', 'odd,even,both,odd,even')} AS side,
       40 + CAST(p_partkey % 64 AS DOUBLE) / 64 AS latitude_from, -74 + CAST(p_partkey % 32 AS DOUBLE) / 64 AS longitude_from,
       40 + CAST(p_partkey % 16 AS DOUBLE) / 64 AS latitude_to, -73 + CAST(p_partkey % 8 AS DOUBLE) / 64 AS longitude_to
FROM {{part}}
"""

# Pickup feeds, with the column names and untidy values of the files.
LOCATION_FEED = f"""
SELECT o_orderkey, {us_date('o_orderdate')} AS `Date`, {_CLOCK} AS `Time`,
       '  ' || {_HOUSE} || ' ' || {pick('o_custkey', 'first,Second,fourth,Tenth,main,Park')} || ' ' ||
       {pick('o_orderkey', 'av,Street,BL,Court,lane on 5 main x,road on broadway st end,drive')} || ' ' AS `Street_Address`,
       ' ' || {pick('o_orderkey + o_custkey', 'm,bk,bx,qu,Hoboken nj,Stamford ct,Islip LI,nwk,jfk,lag,Philly PA,ca,we,ma')} AS `City_State`
FROM {{orders}}
"""

FREE_TEXT_FEED = f"""
SELECT o_orderkey, {us_date('o_orderdate')} AS `DATE`, {_CLOCK} AS `TIME`,
       {pick('o_orderkey', 'corner ,,front door ')} || {_HOUSE} || ' ' ||
       {pick_with_commas('o_custkey', 'w 45 st apt 4; nyc,broadway new york ny,E 11 ave brooklyn,jfk airport 3 bx,newark plaza x qu')} ||
       {pick_with_commas('o_orderkey + o_custkey', '; nyc, ,; bronx')} AS `PICK UP ADDRESS`
FROM {{orders}}
"""

SPLIT_FIELD_FEED = f"""
SELECT o_orderkey, {us_date('o_orderdate')} AS `DATE`, {_CLOCK} AS `TIME`,
       {pick('o_orderkey', 'ny,nj,pa,ct,va,ri,m,ma,ewr,jfk,lga,lag,nwk,isp,teb,hpn,texas')} AS `STATE`,
       {pick('o_custkey', 'Bronx,Queens ,Albany')} AS `PUFROM`, {_HOUSE} AS `ADDRESS`,
       {pick('o_orderkey + o_custkey', 'w ,,east ')} || {text('o_orderkey % 130')} ||
       {pick('o_custkey', ' street,th av,, hy')} AS `STREET`
FROM {{orders}}
"""

# Whole texts with several ON and several runs of digits.
_MANY_ON = "replace(replace(replace(text, ' the ', ' ON '), ' of ', ' ON 5 '), ' de ', ' ON ON ')"
MANY_CROSS_STREETS = f"SELECT doc_id, {_MANY_ON} AS address FROM {{documents}}"
_MANY_RUNS = "replace(replace(replace(replace(replace(text, ' the ', ' 11'), 'er', '2'), 'en', '31 '), 'in', '1ST'), 'on', '23RD ')"
MANY_DIGIT_RUNS = f"SELECT doc_id, {_MANY_RUNS} AS street FROM {{documents}}"

# A second source of pickups, with the name of the first feed.
SECOND_SOURCE = f"""
SELECT replace({us_date('o_orderdate')}, '/', '-') || ' 1:00:00 AM' AS datetime, {_HOUSE} || ' SECOND ST' AS street_address,
       'BRONX' AS city, 'NEW YORK' AS state, 'SKYLINE' AS source, 40.5 AS latitude, -73.5 AS longitude
FROM {{orders}} WHERE o_orderstatus = 'F'
"""

PICKUP_PLACES = f"""
SELECT DISTINCT {text('c_custkey % 900 + 1')} || ' BROADWAY YORK' AS street_address, 'NEW YORK CITY' AS city, 'NEW YORK' AS state,
       CAST(c_custkey % 900 AS DOUBLE) / 4 AS latitude, CAST(-(c_custkey % 900) AS DOUBLE) AS longitude
FROM {{customer}}
UNION ALL
SELECT '148-18 134TH ST', 'JAMAICA', 'NEW YORK', 40.5, -73.75
"""

# Driver dimension: customers with one closed and one current version, suppliers with a current one.
_OPEN = "DATE '9999-12-31'"
DRIVER_DIM = f"""
SELECT c_custkey * 2 + 1 AS driverrecordkey, c_custkey + 1 AS driverkey, 'DRIVER ' || {text('c_custkey')} AS drivername,
       CAST(c_custkey % 3 + 1 AS INT) AS shifttimekey, c_nationkey AS coveragekey,
       CAST(c_custkey % (SELECT count(*) FROM {{supplier}}) AS INT) AS companykey,
       DATE '1989-01-01' + CAST(c_custkey % 700 AS INT) AS hiredate, {_OPEN} AS firedate, DATE '1992-01-01' AS effectivedate,
       DATE '1992-01-02' AS loaddate, {_OPEN} AS expireddate, 1 AS current_record
FROM {{customer}}
UNION ALL
SELECT c_custkey * 2 + 2, c_custkey + 1, 'DRIVER ' || {text('c_custkey')},
       CAST((c_custkey + 1) % 3 + 1 AS INT), c_nationkey, CAST(c_custkey % 7 AS INT),
       DATE '1989-01-01' + CAST(c_custkey % 700 AS INT), {_OPEN}, DATE '1989-01-01' + CAST(c_custkey % 700 AS INT),
       DATE '1991-12-01', DATE '1991-12-31', 0
FROM {{customer}}
UNION ALL
SELECT 800000000 + s_suppkey, 500000000 + s_suppkey, 'RESERVE ' || {text('s_suppkey')},
       CAST(s_suppkey % 3 + 1 AS INT), s_nationkey, CAST(s_suppkey AS INT),
       DATE '1990-05-05', {_OPEN}, DATE '1990-05-05', DATE '1990-05-06', {_OPEN}, 1
FROM {{supplier}}
"""

# Driver feed: every order is an event; some name no known coverage or company, some follow a hire of the feed, have no
# date, come late or share a day with others of the driver.
_EFFECTIVE = """CASE WHEN o_orderkey % 50 = 0 THEN CAST(NULL AS DATE) WHEN o_orderkey % 50 = 1 THEN DATE '1991-06-01'
            WHEN o_orderkey % 50 < 5 THEN DATE '1999-01-01' ELSE CAST(o_orderdate AS DATE) END"""
DRIVER_FEED = f"""
SELECT CASE WHEN o_orderstatus = 'P' THEN 'NEW ' || {text('o_orderkey % 3000')}
            WHEN o_orderkey % 40 = 5 THEN 'NEW ' || {text('o_custkey % 3000')}
            ELSE 'DRIVER ' || {text('o_custkey')} END AS drivername,
       CASE o_orderstatus WHEN 'P' THEN 'HIRED' WHEN 'F' THEN 'FIRED' ELSE 'CHANGE' END AS action,
       {padded('o_orderkey % 5 * 4', 2)} || ':00' AS beginshift, {padded('o_orderkey % 5 * 4 + 3', 2)} || ':59' AS endshift,
       'NATION_' || {text('(o_orderkey + o_custkey) % 27')} AS coverage,
       'Supplier#' || {padded('o_orderkey % ((SELECT count(*) FROM {supplier}) + 1)', 9)} AS source,
       {_EFFECTIVE} AS effdt, CAST(o_orderdate AS DATE) + 1 AS filedt
FROM {{orders}}
"""
SHIFT_DIM = f"""
SELECT r_regionkey + 1 AS shifttimekey, {padded('r_regionkey * 4', 2)} || ':00' AS starttime,
       {padded('r_regionkey * 4 + 3', 2)} || ':59' AS endtime
FROM {{region}}
"""
COVERAGE_DIM = "SELECT n_nationkey AS coveragekey, n_name AS coverage FROM {nation}"
COMPANY_DIM = "SELECT CAST(s_suppkey AS INT) AS companykey, s_name AS company FROM {supplier}"

PICKUPS = f"""
SELECT clock AS datetime, 'USER ' || {text('user_id')} AS street_address, ' NATION_' || {text('user_id % 26')} || ' ' AS city,
       event_type AS state, 'Supplier#' || {padded('event_id % (SELECT count(*) FROM {supplier})', 9)} AS source,
       value AS latitude, CAST(event_id AS DOUBLE) AS longitude
FROM ({EVENT_TIMES.replace('SELECT event_id,', 'SELECT event_id, user_id, event_type, value,')}) AS e
"""

SOURCED_ORDERS = f"""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_custkey % 10 = 0 THEN NULL ELSE {text('o_orderkey')} END AS source
FROM {{orders}}
"""

RECORDS = f"""
SELECT {padded('doc_id', 12)} AS created_at,
       CASE WHEN n_chars > 140 THEN substr(text, 1, 140) ELSE text END AS text, lang,
       CASE WHEN n_chars > 140 THEN text END AS full_text,
       CASE WHEN source = 'src0' THEN text END AS retweeted
FROM {{documents}}
"""
# The documents as JSON lines of many shapes: as they should be, with missing, further and wrongly typed fields, and broken.
_SAID = "text"
for _code in (9, 10, 13, 34, 92):  # what JSON would have to escape
    _SAID = f"replace({_SAID}, chr({_code}), ' ')"
_STAMPED = """'"created_at": "' || stamp || '"'"""
_TEXT = """'"text": "' || said || '"'"""
FLEXIBLE_LINES = f"""
SELECT doc_id, said, CASE CAST(doc_id % 11 AS INT)
    WHEN 0 THEN '{{{{' || {_STAMPED} || ', ' || {_TEXT} || ', "lang": "' || lang || '"}}}}'
    WHEN 1 THEN '{{{{' || {_TEXT} || ', ' || {_STAMPED} || '}}}}'
    WHEN 2 THEN '{{{{' || {_STAMPED} || ', "text": "short", "lang": "en", "user": {{{{"id": [1, 2]}}}}, "extended_tweet": {{{{"full_text": "' || said || '"}}}}}}}}'
    WHEN 3 THEN '{{{{' || {_STAMPED} || ', "text": {{{{"full": "' || said || '"}}}}, "lang": "en"}}}}'
    WHEN 4 THEN '{{{{"created_at": ' || {text('doc_id')} || ', ' || {_TEXT} || ', "lang": 7}}}}'
    WHEN 5 THEN '{{{{' || {_STAMPED} || ', "text": "' || said
    WHEN 6 THEN '{{{{' || {_STAMPED} || ', ' || {_TEXT} || ', "extended_tweet": "none", "retweeted_status": {{{{"text": "x"}}}}}}}}'
    WHEN 7 THEN '{{{{"created_at": ["' || stamp || '"], ' || {_TEXT} || ', "retweeted_status": null}}}}'
    WHEN 8 THEN '["' || said || '"]'
    WHEN 9 THEN '{{{{' || {_STAMPED} || ', "text": true, "lang": null}}}}'
    ELSE '  ' END AS value
FROM (SELECT doc_id, lang, {padded('doc_id', 12)} AS stamp, {_SAID} AS said FROM {{documents}}) AS d
"""
CAPTURE_WORDS = ("with", "by")

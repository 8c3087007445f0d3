"""SQL that must give the rows of the query of the same name, for DuckDB."""

from __future__ import annotations

from dispatchmart.catalog import inputs as I
from dispatchmart.functions.fixed_values import STOP_WORDS

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, **derived: str) -> None:
    """Register SQL that may use the given derived inputs as tables."""
    tables = ", ".join(f"{alias} AS ({I.portable(source)})" for alias, source in derived.items())
    ORACLES[name] = f"WITH {tables} {sql}" if tables and not sql.lstrip().startswith("WITH") else (
        f"WITH {tables}, {sql.lstrip()[4:]}" if tables else sql
    )


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


def _suffix(digits: str, lower: bool = False) -> str:
    sql = f"""CASE WHEN right({digits}, 2) IN ('11', '12', '13') THEN 'TH' WHEN right({digits}, 1) = '1' THEN 'ST'
              WHEN right({digits}, 1) = '2' THEN 'ND' WHEN right({digits}, 1) = '3' THEN 'RD' ELSE 'TH' END"""
    return f"lower({sql})" if lower else sql


def _short_street(address: str) -> str:
    """The address with its last word shortened; other last words are kept."""
    last = f"regexp_extract({address}, ' ([^ ]*)$', 1)"
    return f"""CASE WHEN {last} IN ('BL', 'AV', 'AVENUE', 'COURT', 'STREET', 'LANE', 'ROAD', 'DRIVE', 'HY', 'PZ', 'TP')
      THEN left({address}, length({address}) - length({last})) ||
        CASE {last} WHEN 'BL' THEN 'BLVD' WHEN 'AV' THEN 'AVE' WHEN 'AVENUE' THEN 'AVE' WHEN 'COURT' THEN 'CT'
          WHEN 'STREET' THEN 'ST' WHEN 'LANE' THEN 'LN' WHEN 'ROAD' THEN 'RD' WHEN 'DRIVE' THEN 'DR'
          WHEN 'HY' THEN 'HWY' WHEN 'PZ' THEN 'PLZ' ELSE 'TPKE' END
      ELSE {address} END"""


def _without_cross_street(pieces: str) -> str:
    """For lists of words with ON at most once, or with a second ON that nothing follows."""
    at = f"coalesce(list_position({pieces}, 'ON'), 0)"
    inside = f"{at} + 2 <= len({pieces})"
    return f"""array_to_string(CASE WHEN {at} = 0 THEN {pieces} ELSE list_transform({pieces}, lambda w, i:
      CASE WHEN i = {at} THEN '' WHEN {inside} AND i = {at} + 2 THEN ''
           WHEN {inside} AND i = {at} + 1 AND NOT regexp_matches(w, '^[A-Z]+$') THEN '' ELSE w END) END, ' ')"""


# Number words and their ordinals, in the order the rules take them.
_ORDINALS = [
    ("FIRST", "1ST"), ("SECOND", "2ND"), ("THIRD", "3RD"), ("FIFTH", "5TH"), ("SIXTH", "6TH"), ("SEVENTH", "7TH"),
    ("EIGHTH", "8TH"), ("NINTH", "9TH"), ("TENTH", "10TH"), ("ELEVENTH", "11TH"), ("TWELFTH", "12TH"), ("FOURTH", "4TH"),
]


def _number_words(address: str, fourth: bool = True) -> str:
    sql = address
    for word, number in _ORDINALS:
        if fourth or word != "FOURTH":
            sql = f"regexp_replace({sql}, '{word}', '{number}', 'g')"
    return sql


_CUTTERS = "('AVE', 'ST', 'BLVD', 'LANE', 'LN', 'HWY', 'TPKE', 'TURNPIKE', 'PL', 'PLAZA', 'DR')"


def _first_cutter(pieces: str) -> str:
    return f"list_min(list_filter(list_transform({pieces}, lambda w, i: CASE WHEN w IN {_CUTTERS} THEN i END), lambda i: i IS NOT NULL))"


def _kept(pieces: str, p: str, inside: str) -> str:
    n = f"len({pieces})"
    return f"array_to_string({pieces}[1:CASE WHEN {inside} THEN {p} WHEN {n} > 1 THEN {n} - 1 ELSE {n} END], ' ')"


def _compass(pieces: str, lower: bool = False) -> str:
    return f"""array_to_string(list_transform({pieces}, lambda w, i: CASE WHEN i > 1 AND {pieces}[i - 1] IN ('W', 'E', 'S', 'N')
      AND regexp_matches(w, '^[0-9]+$') THEN w || {_suffix('w', lower)} ELSE w END), ' ')"""


def _location_code(location: str) -> str:
    return f"trim(right({location}, 2))"


def _location_state(code: str) -> str:
    return f"""CASE WHEN {code} IN ('M', 'QU', 'BX', 'CA', 'ST', 'WE', 'BK', 'FK', 'AG') THEN 'NEW YORK'
      WHEN {code} = 'PA' THEN 'PENNSYLVANIA' WHEN {code} = 'CT' THEN 'CONNECTICUT' WHEN {code} = 'LI' THEN 'LONG ISLAND'
      WHEN {code} IN ('NJ', 'WK') THEN 'NEW JERSEY' ELSE '' END"""


def _location_city(code: str) -> str:
    return f"""CASE WHEN {code} IN ('NJ', 'LI', 'PA', 'CT', 'WE') THEN '' ELSE CASE {code} WHEN 'M' THEN 'MANHATTAN'
      WHEN 'BK' THEN 'BROOKLYN' WHEN 'BX' THEN 'BRONX' WHEN 'QU' THEN 'QUEENS' WHEN 'FK' THEN 'JAMAICA'
      WHEN 'WK' THEN 'NEWARK' WHEN 'AG' THEN 'EAST ELMHURST' ELSE {code} END END"""


# City codes and their cities, in the order the older rules take them.
_CITY_CODES = [
    ("M", "MANHATTAN"), ("BK", "BROOKLYN"), ("BX", "BRONX"), ("QU", "QUEENS"), ("FK", "JAMAICA"), ("WK", "NEWARK"), ("AG", "EAST ELMHURST"),
]


def _location_city_compat(code: str) -> str:
    sql = f"CASE WHEN {code} IN ('NJ', 'LI', 'PA', 'CT', 'WE') THEN '' ELSE {code} END"
    for key, city in _CITY_CODES:
        sql = f"replace({sql}, '{key}', '{city}')"
    return sql


def _blanked(city: str, state: str) -> str:
    return f"CASE WHEN {state} IN ('NEW JERSEY', 'CONNECTICUT', 'PENNSYLVANIA', 'LONG ISLAND') THEN '' ELSE {city} END"


def _by_location(address: str, location: str) -> str:
    return f"""CASE {location} WHEN 'NWK' THEN '3 BREWSTER' WHEN 'JFK' THEN '148-18 134TH ST'
      WHEN 'LAG' THEN '102-05 DITMARS BLVD' ELSE {address} END"""


def _by_word(text: str) -> str:
    first = f"coalesce({_tokens(text)}[1], '')"
    return f"""CASE WHEN contains({first}, 'JFK') THEN '148-18 134TH ST' WHEN contains({first}, 'EWR') THEN '3 BREWSTER RD'
      WHEN contains({first}, 'LGA') THEN '102-05 DITMARS BLVD' ELSE {text} END"""


_AIRPORTS = """(VALUES ('EW', 'BREWSTER RD', '3', 'NEW JERSEY', 'NEWARK'), ('JF', '134TH ST', '148-18', 'NEW YORK', 'JAMAICA'),
  ('LG', 'DITMARS BLVD', '102-05', 'NEW YORK', 'EAST ELMHURST'), ('LA', 'DITMARS BLVD', '102-05', 'NEW YORK', 'EAST ELMHURST'),
  ('NW', 'BREWSTER RD', '3', 'NEW JERSEY', 'NEWARK'), ('IS', 'ARRIVAL AVE', '100', 'NEW YORK', 'RONKONKOMA'),
  ('TE', 'INDUSTRIAL AVE', '111', 'NEW JERSEY', 'TETERBORO'), ('HP', 'AIRPORT RD', '240', 'NEW YORK', 'WHITE PLAINS'))
  AS a(code, a_street, a_house, a_state, a_city)"""


def _state_name(code: str, state: str) -> str:
    return f"""CASE {code} WHEN 'NY' THEN 'NEW YORK' WHEN 'NJ' THEN 'NEW JERSEY' WHEN 'PA' THEN 'PENNSYLVANIA'
      WHEN 'CT' THEN 'CONNECTICUT' WHEN 'VA' THEN 'VIRGINIA' WHEN 'RI' THEN 'RHODE ISLAND' WHEN 'M' THEN 'MANHATTAN'
      WHEN 'MA' THEN 'MASSACHUSETTS' ELSE {state} END"""


def _fragment_city(tail: str) -> str:
    return f"""CASE trim({tail}) WHEN 'ONX' THEN 'BRONX' WHEN 'BX' THEN 'BRONX' WHEN 'NYC' THEN 'NEW YORK CITY'
      WHEN 'NY' THEN 'NEW YORK CITY' WHEN 'ORK' THEN 'NEW YORK CITY' WHEN 'QU' THEN 'QUEENS' WHEN 'NY.' THEN 'YONKERS'
      WHEN 'LYN' THEN 'BROOKLYN' ELSE trim({tail}) END"""


def _fragment_city_compat(tail: str) -> str:
    step = f"replace(replace({tail}, 'ONX', 'BRONX'), 'BX', 'BRONX')"
    named = f"CASE WHEN {step} IN ('NYC', 'NY', 'ORK') THEN 'NEW YORK CITY' ELSE {step} END"
    return f"replace(regexp_replace(replace({named}, 'QU', 'QUEENS'), 'NY.', 'YONKERS', 'g'), 'LYN', 'BROOKLYN')"


def _digit_run(street: str, compat: bool = False) -> str:
    """For streets with one digit run: a suffix unless nothing or a suffix follows."""
    part = f"regexp_extract({street}, '^([^0-9]*)([0-9]+)(.*)$', {{}})"
    before, digits, rest = part.format(1), part.format(2), part.format(3)
    suffixed = "false" if compat else f"regexp_matches({rest}, '^(ST|ND|RD|TH)\\b')"
    return f"""CASE WHEN {digits} = '' OR {rest} = '' OR {suffixed} THEN {street}
      ELSE {before} || {digits} || {_suffix(digits, compat)} || ' ' || substr({rest}, 2) END"""


# Text rules

oracle("street_suffix_abbrev", f"SELECT o_orderkey, {_short_street('address')} AS street_address FROM src", src=I.STREETS)
oracle(
    "trim_upper_all",
    """SELECT trim(upper(CAST("Part Key" AS VARCHAR))) AS part_key, trim(upper("Name ")) AS name,
       trim(upper(brand)) AS brand, trim(upper("Part TYPE")) AS part_type FROM src""",
    src=I.PADDED_PARTS,
)
oracle("merge_date_time", "SELECT order_key, replace(date, '/', '-') || ' ' || time AS datetime FROM src", src=I.DATED_ORDERS)
oracle(
    "cross_street_removal",
    f"SELECT o_orderkey, {_without_cross_street('t')} AS street_address FROM (SELECT o_orderkey, {_tokens('address')} AS t FROM src) AS x",
    src=I.CROSS_STREETS,
)
oracle(
    "ordinal_words",
    f"""SELECT c_custkey, {_number_words('address')} AS street_address,
        {_number_words('address', fourth=False)} AS street_address_compat FROM src""",
    src=I.NUMBER_WORDS,
)
oracle(
    "cut_after_suffix",
    f"""SELECT o_orderkey, {_kept('t', 'p', 'p IS NOT NULL')} AS street_address,
        {_kept('t', 'p', 'p < len(t)')} AS street_address_compat
        FROM (SELECT o_orderkey, t, {_first_cutter('t')} AS p FROM (SELECT o_orderkey, {_tokens('address')} AS t FROM src) AS x) AS y""",
    src=I.FREE_ADDRESSES,
)
oracle(
    "first_digit_cut",
    "SELECT p_partkey, CASE WHEN regexp_matches(address, '[0-9]') THEN regexp_extract(address, '[0-9].*') ELSE address END AS street_address FROM src",
    src=I.PART_LABELS,
)
oracle(
    "ordinal_after_direction",
    f"""SELECT o_orderkey, {_compass('t')} AS street_address, {_compass('t', lower=True)} AS street_address_compat
        FROM (SELECT o_orderkey, {_tokens('address')} AS t FROM src) AS x""",
    src=I.COMPASS_ADDRESSES,
)
oracle(
    "ordinal_digit_runs",
    f"""SELECT o_orderkey, {_digit_run('street')} AS street,
        {_digit_run('street', compat=True)} AS street_compat
        FROM src""",
    src=I.DIGIT_STREETS,
)
oracle(
    "suburb_to_street",
    f"""SELECT o_orderkey, CASE WHEN right(location, 2) IN ('NJ', 'CT', 'LI', 'PA')
          THEN address || ' ' || left(location, length(location) - 2) ELSE address END AS street_address,
        {_location_code('location')} AS code FROM src""",
    src=I.LOCATIONS,
)
oracle(
    "state_city_codes",
    f"""SELECT o_orderkey, location_state, {_blanked('city', 'location_state')} AS city,
        {_blanked(_location_city_compat('code'), 'location_state')} AS city_compat,
        {_state_name('left(state, 2)', 'state')} AS state
        FROM (SELECT *, {_location_city('code')} AS city, {_location_state('code')} AS location_state
              FROM (SELECT *, {_location_code('location')} AS code FROM src) AS x) AS y""",
    src=I.LOCATIONS,
)
oracle(
    "airport_lookup",
    f"""SELECT o_orderkey, {_by_location('address', 'location')} AS by_location, {_by_word('words')} AS by_word,
        coalesce(a_house, '9') || ' ' || coalesce(a_street, address) AS by_code,
        coalesce(a_state, state) AS state, coalesce(a_city, 'NONE') AS city
        FROM src LEFT JOIN {_AIRPORTS} ON left(state, 2) = a.code""",
    src=I.LOCATIONS,
)
oracle(
    "city_fragment",
    f"""SELECT o_orderkey, replace(split_part(address, ',', 1), 'NEW', ' ') AS street_address,
        {_fragment_city('right(address, 3)')} AS city, {_fragment_city_compat('right(address, 3)')} AS city_compat FROM src""",
    src=I.FRAGMENTS,
)

# Time and keys

_SHIFT = "CASE WHEN {0} BETWEEN '{1}' AND '07:59' THEN 1 WHEN {0} BETWEEN '08:00' AND '15:59' THEN 2 WHEN {0} BETWEEN '16:00' AND '23:59' THEN 3 ELSE -1 END"
oracle(
    "time_to_shift",
    f"""SELECT event_id, minute, minute_compat, {_SHIFT.format('minute', '00:00')} AS shifttimekey,
        {_SHIFT.format('minute_compat', '00:01')} AS shifttimekey_compat
        FROM (SELECT event_id, strftime(ts, '%H:%M') AS minute, strftime(ts, '%I:%M') AS minute_compat FROM events) AS x""",
)
oracle("day_before", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - 1, '%m/%d/%Y') AS expireddate FROM orders")
oracle(
    "map_keys_default",
    """SELECT c_custkey, coalesce(coveragekey, -1) AS coveragekey, companykey FROM src
       LEFT JOIN (VALUES ('BRONX', 1), ('BROOKLYN', 2), ('JAMAICA', 3), ('EAST ELMHURST', 4), ('MANHATTAN', 5),
         ('NEW YORK CITY', 6), ('NEWARK', 7), ('Other', 8)) AS v(city, coveragekey) USING (city)
       LEFT JOIN (VALUES ('DIAL7', 1), ('FIRSTCLASS', 2), ('LYFT', 3), ('SKYLINE', 4)) AS c(source, companykey) USING (source)""",
    src=I.CITIES_AND_SOURCES,
)
oracle(
    "surrogate_keys",
    """SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
       100 + row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record_key FROM lineitem""",
)

# Places, sets, head and rest

_PLACES = """places AS (SELECT street_address, city, state, min(struct_pack(a := latitude, b := longitude)) AS geo FROM gazetteer GROUP BY ALL)"""
oracle(
    "geocode_gazetteer",
    f"""WITH {_PLACES} SELECT c.*, geo.a AS latitude, geo.b AS longitude
        FROM customers AS c LEFT JOIN places USING (street_address, city, state)""",
    customers=I.PLACED_CUSTOMERS,
    gazetteer=I.GAZETTEER,
)
oracle(
    "geocode_budget",
    f"""WITH {_PLACES} SELECT c.c_custkey, c.datetime, street_address, city, state,
        CASE WHEN rn <= 100 THEN geo.a END AS latitude, CASE WHEN rn <= 100 THEN geo.b END AS longitude
        FROM (SELECT *, row_number() OVER (ORDER BY strptime(upper(datetime), '%m-%d-%Y %I:%M:%S %p'), datetime, c_custkey) AS rn
          FROM customers) AS c
        LEFT JOIN places USING (street_address, city, state)""",
    customers=I.PLACED_CUSTOMERS,
    gazetteer=I.GAZETTEER,
)
oracle(
    "split_head_rest",
    "SELECT o_orderdate, o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= 100 AS is_head FROM orders",
)
oracle(
    "first_rows",
    """SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem
       ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey LIMIT 100""",
)
oracle(
    "except_distinct",
    """WITH pairs AS (SELECT l_partkey, CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END AS l_suppkey, l_returnflag FROM lineitem)
       SELECT l_partkey, l_suppkey FROM pairs EXCEPT SELECT l_partkey, l_suppkey FROM pairs WHERE l_returnflag = 'R'""",
)
oracle(
    "union_feeds",
    """SELECT o_orderkey, o_custkey, 'FEED O' AS source FROM orders WHERE o_orderstatus = 'O'
       UNION ALL SELECT o_orderkey, o_custkey, 'FEED F' FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT o_orderkey, o_custkey, 'FEED P' FROM orders WHERE o_orderstatus = 'P'""",
)
oracle(
    "not_in_insert",
    """SELECT *, 'filled' AS target FROM src WHERE source NOT IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem)
       UNION ALL SELECT *, 'with null' FROM src
         WHERE source NOT IN (SELECT CASE WHEN l_linenumber <> 1 THEN CAST(l_orderkey AS VARCHAR) END FROM lineitem)
       UNION ALL SELECT *, 'empty' FROM src WHERE source NOT IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE false)""",
    src=I.SOURCED_ORDERS,
)

# Feeds


def _location(compat: bool = False) -> str:
    city = _location_city_compat("code") if compat else _location_city("code")
    return f"""
SELECT datetime, trim({_number_words(_without_cross_street(_tokens('street')), fourth=not compat)}) AS street_address,
       {_blanked('city', 'state')} AS city, state, 'SKYLINE' AS source
FROM (SELECT datetime, trim({_by_location('street', 'location')}) AS street, {city} AS city,
             {_location_state('code')} AS state
      FROM (SELECT datetime, location, {_location_code('location')} AS code,
                   trim(CASE WHEN right(location, 2) IN ('NJ', 'CT', 'LI', 'PA')
                     THEN street || ' ' || left(location, length(location) - 2) ELSE street END) AS street
            FROM (SELECT datetime, location, {_short_street('address')} AS street
                  FROM (SELECT trim(replace(upper("Date"), '/', '-') || ' ' || upper("Time")) AS datetime,
                               trim(upper("Street_Address")) AS address, trim(upper("City_State")) AS location
                        FROM location_src) AS a) AS b) AS c) AS d"""


def _free_text(compat: bool = False) -> str:
    digits = "CASE WHEN regexp_matches(step, '[0-9]') THEN regexp_extract(step, '[0-9].*') ELSE step END"
    city = f"trim({_fragment_city_compat('right(entered, 3)')})" if compat else _fragment_city("right(entered, 3)")
    inside = "p < len(t)" if compat else "p IS NOT NULL"
    return f"""
SELECT datetime, trim({_compass(_tokens(digits), lower=compat)}) AS street_address,
       city, 'NEW YORK' AS state, 'FIRSTCLASS' AS source
FROM (SELECT datetime, city, replace({_by_word('address')}, 'NEW', ' ') AS step
      FROM (SELECT datetime, city, {_kept('t', 'p', inside)} AS address
            FROM (SELECT datetime, city, t, {_first_cutter('t')} AS p
                  FROM (SELECT datetime, {city} AS city, {_tokens("split_part(entered, ',', 1)")} AS t
                        FROM (SELECT trim(replace(upper("DATE"), '/', '-') || ' ' || upper("TIME")) AS datetime,
                                     trim(upper("PICK UP ADDRESS")) AS entered FROM free_text_src) AS a) AS b) AS c) AS d) AS e"""


def _split_field(compat: bool = False) -> str:
    return f"""
SELECT datetime, {_short_street("(coalesce(a_house, house) || ' ' || coalesce(a_street, street))")} AS street_address,
       coalesce(a_city, city) AS city, coalesce(a_state, {_state_name('left(state, 2)', 'state')}) AS state, 'DIAL7' AS source
FROM (SELECT trim(replace(upper("DATE"), '/', '-') || ' ' || upper("TIME")) AS datetime, trim(upper("STATE")) AS state,
             trim(upper("PUFROM")) AS city, trim(upper("ADDRESS")) AS house, trim({_digit_run('upper("STREET")', compat)}) AS street
      FROM split_field_src) AS s LEFT JOIN {_AIRPORTS} ON left(s.state, 2) = a.code"""


for _name, _compat in (("", False), ("_compat", True)):
    oracle(f"location_feed{_name}", _location(_compat), location_src=I.LOCATION_FEED)
    oracle(f"free_text_feed{_name}", _free_text(_compat), free_text_src=I.FREE_TEXT_FEED)
    oracle(f"split_field_feed{_name}", _split_field(_compat), split_field_src=I.SPLIT_FIELD_FEED)
oracle(
    "standard_pickups",
    f"""WITH loc AS ({_location()}), free AS ({_free_text()}), split AS ({_split_field()}),
        united AS (SELECT * FROM loc UNION ALL SELECT * FROM free UNION ALL SELECT * FROM split)
        SELECT u.datetime, u.street_address, u.city, u.state, u.source,
               CAST(p.latitude AS DOUBLE) AS latitude, CAST(p.longitude AS DOUBLE) AS longitude
        FROM united AS u LEFT JOIN places AS p
          ON u.street_address = p.street_address AND u.city = p.city AND u.state = p.state""",
    location_src=I.LOCATION_FEED,
    free_text_src=I.FREE_TEXT_FEED,
    split_field_src=I.SPLIT_FIELD_FEED,
    places=I.PICKUP_PLACES,
)

# Dimension and facts

_SCD = {
    "dim": I.DRIVER_DIM,
    "feed": I.DRIVER_FEED,
    "shifts": I.SHIFT_DIM,
    "coverages": I.COVERAGE_DIM,
    "companies": I.COMPANY_DIM,
}
_COLUMNS = """driverrecordkey, driverkey, drivername, shifttimekey, coveragekey, companykey, hiredate, firedate, effectivedate,
  loaddate, expireddate, current_record"""
_RESOLVED = """resolved AS (SELECT f.*, s.shifttimekey, g.coveragekey, c.companykey FROM (SELECT DISTINCT * FROM feed) AS f
  LEFT JOIN shifts AS s ON f.beginshift = s.starttime AND f.endshift = s.endtime
  LEFT JOIN coverages AS g ON f.coverage = g.coverage LEFT JOIN companies AS c ON f.source = c.company),
  applicable AS (SELECT * FROM resolved WHERE effdt IS NOT NULL AND (action = 'FIRED' OR (action = 'CHANGE'
    AND shifttimekey IS NOT NULL AND coveragekey IS NOT NULL AND companykey IS NOT NULL)))"""
_HIRED = """SELECT CAST(-1 AS INTEGER) AS driverrecordkey, (SELECT coalesce(max(driverkey), 0) FROM dim) +
    row_number() OVER (ORDER BY effdt, filedt, drivername, shifttimekey, coveragekey, companykey) AS driverkey,
  drivername, shifttimekey, coveragekey, companykey, effdt AS hiredate, DATE '9999-12-31' AS firedate,
  effdt AS effectivedate, filedt AS loaddate, DATE '9999-12-31' AS expireddate, 1 AS current_record
FROM resolved WHERE action = 'HIRED' AND effdt IS NOT NULL
  AND shifttimekey IS NOT NULL AND coveragekey IS NOT NULL AND companykey IS NOT NULL"""


def _day_events(known: str, actions: str = "'FIRED', 'CHANGE'") -> str:
    """Of each driver and day after the current version's start the one event that counts, the last of the day."""
    return f"""known AS ({known}),
  events AS (SELECT * FROM (
    SELECT k.driverkey, a.effdt, a.filedt, a.action,
           CASE WHEN a.action = 'CHANGE' THEN a.shifttimekey END AS e1, CASE WHEN a.action = 'CHANGE' THEN a.coveragekey END AS e2,
           CASE WHEN a.action = 'CHANGE' THEN a.companykey END AS e3,
           row_number() OVER (PARTITION BY k.driverkey, a.effdt ORDER BY a.filedt DESC, a.action DESC, e1 DESC, e2 DESC, e3 DESC) AS place
    FROM known AS k JOIN applicable AS a ON k.drivername = a.drivername AND a.effdt > k.effectivedate
    WHERE k.current_record = 1 AND a.action IN ({actions})) AS d WHERE place = 1)"""


_UNCHANGED = f"""SELECT DISTINCT {_COLUMNS} FROM known
  WHERE current_record <> 1 OR driverkey NOT IN (SELECT driverkey FROM events)"""

# A version starts on its own day and ends the day before the next one; keys last until an event replaces them.
_VERSIONS = """SELECT CASE WHEN effdt = effectivedate THEN driverrecordkey ELSE -1 END AS driverrecordkey, driverkey, drivername,
  last_value(e1 IGNORE NULLS) OVER w AS shifttimekey, last_value(e2 IGNORE NULLS) OVER w AS coveragekey,
  last_value(e3 IGNORE NULLS) OVER w AS companykey, hiredate,
  CASE action WHEN 'BASE' THEN firedate WHEN 'FIRED' THEN effdt ELSE DATE '9999-12-31' END AS firedate,
  effdt AS effectivedate, filedt AS loaddate,
  coalesce(min(effdt) OVER later - 1, DATE '9999-12-31') AS expireddate,
  CASE WHEN min(effdt) OVER later IS NULL THEN 1 ELSE 0 END AS current_record
FROM (SELECT k.*, 'BASE' AS action, effectivedate AS effdt, loaddate AS filedt, shifttimekey AS e1, coveragekey AS e2, companykey AS e3
      FROM known AS k WHERE current_record = 1 AND driverkey IN (SELECT driverkey FROM events)
      UNION ALL
      SELECT k.*, e.action, e.effdt, e.filedt, e1, e2, e3 FROM known AS k JOIN events AS e USING (driverkey)
      WHERE k.current_record = 1) AS chain
WINDOW w AS (PARTITION BY driverkey ORDER BY effdt ROWS UNBOUNDED PRECEDING),
       later AS (PARTITION BY driverkey ORDER BY effdt ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""
_DIM_ONLY = f"SELECT {_COLUMNS} FROM dim"
_DIM_AND_HIRED = f"SELECT {_COLUMNS} FROM dim UNION ALL SELECT {_COLUMNS} FROM ({_HIRED}) AS h"

oracle("scd2_unchanged", f"WITH {_RESOLVED}, {_day_events(_DIM_ONLY)} {_UNCHANGED}", **_SCD)
oracle("scd2_fired", f"""WITH {_RESOLVED}, {_day_events(_DIM_ONLY, "'FIRED'")} {_VERSIONS}""", **_SCD)
oracle("scd2_changed", f"""WITH {_RESOLVED}, {_day_events(_DIM_ONLY, "'CHANGE'")} {_VERSIONS}""", **_SCD)
oracle("scd2_hired", f"WITH {_RESOLVED} {_HIRED}", **_SCD)
oracle(
    "scd2_rejects",
    f"""WITH {_RESOLVED}, known AS ({_DIM_AND_HIRED}),
        since AS (SELECT drivername, min(effectivedate) AS since FROM known WHERE current_record = 1 GROUP BY drivername),
        ranked AS (SELECT *, rank() OVER (PARTITION BY drivername, effdt ORDER BY filedt DESC, action DESC,
          CASE WHEN action = 'CHANGE' THEN shifttimekey END DESC, CASE WHEN action = 'CHANGE' THEN coveragekey END DESC,
          CASE WHEN action = 'CHANGE' THEN companykey END DESC) AS place FROM applicable)
        SELECT drivername, action, beginshift, endshift, coverage, source, effdt, filedt, reason
        FROM (SELECT r.*, CASE
              WHEN r.action IN ('HIRED', 'CHANGE') AND (r.shifttimekey IS NULL OR r.coveragekey IS NULL OR r.companykey IS NULL)
                THEN 'unknown shift, coverage or company'
              WHEN r.effdt IS NULL THEN 'no effective date'
              WHEN r.action <> 'HIRED' AND since IS NULL THEN 'no current driver'
              WHEN r.action <> 'HIRED' AND r.effdt <= since THEN 'not after the current version'
              WHEN r.action <> 'HIRED' AND place > 1 THEN 'superseded on the same day' END AS reason
              FROM resolved AS r LEFT JOIN since USING (drivername)
              LEFT JOIN ranked AS a ON a.drivername = r.drivername AND a.effdt = r.effdt AND a.action = r.action
                AND a.beginshift = r.beginshift AND a.coverage = r.coverage AND a.source = r.source AND a.filedt = r.filedt) AS x
        WHERE reason IS NOT NULL""",
    **_SCD,
)
oracle(
    "scd2_interval_faults",
    f"""WITH {_RESOLVED}, known AS ({_DIM_AND_HIRED})
        SELECT DISTINCT driverkey, 0 AS backward, 0 AS overlaps, 1 AS current_versions FROM known""",
    **_SCD,
)
_FOUND = "r.shifttimekey IS NOT NULL AND r.coveragekey IS NOT NULL AND r.companykey IS NOT NULL"
_FIRED_COMPAT = """SELECT -1 AS driverrecordkey, d.driverkey, d.drivername, d.shifttimekey, d.coveragekey, d.companykey, d.hiredate,
    r.effdt AS firedate, r.effdt AS effectivedate, r.filedt AS loaddate, DATE '9999-12-31' AS expireddate, 1 AS current_record
  FROM dim AS d JOIN resolved AS r ON d.drivername = r.drivername AND r.action = 'FIRED'"""
_CHANGED_COMPAT = f"""SELECT d.driverrecordkey, d.driverkey, d.drivername, r.shifttimekey, r.coveragekey, r.companykey, d.hiredate,
    d.firedate, d.effectivedate, d.loaddate, r.effdt - 1 AS expireddate, CASE WHEN d.current_record = 1 THEN 0 END AS current_record
  FROM dim AS d JOIN resolved AS r ON d.drivername = r.drivername AND r.action = 'CHANGE' AND {_FOUND}
  UNION ALL
  SELECT d.driverrecordkey, d.driverkey, d.drivername, r.shifttimekey, r.coveragekey, r.companykey, d.hiredate,
    DATE '9999-12-31', r.effdt, r.filedt, DATE '9999-12-31', 1
  FROM dim AS d JOIN resolved AS r ON d.drivername = r.drivername AND r.action = 'CHANGE' AND {_FOUND}"""
_UNCHANGED_COMPAT = f"SELECT DISTINCT {_COLUMNS} FROM dim WHERE drivername NOT IN (SELECT drivername FROM feed)"
oracle("scd2_fired_compat", f"WITH {_RESOLVED} {_FIRED_COMPAT}", **_SCD)
oracle("scd2_changed_compat", f"WITH {_RESOLVED} {_CHANGED_COMPAT}", **_SCD)
oracle("scd2_unchanged_compat", _UNCHANGED_COMPAT, dim=I.DRIVER_DIM, feed=I.DRIVER_FEED)
for _name, _parts in (
    ("scd2_dimension", (_UNCHANGED, _VERSIONS)),
    ("scd2_dimension_compat", (_UNCHANGED_COMPAT, _FIRED_COMPAT, _CHANGED_COMPAT, _HIRED)),
):
    _with = f"{_RESOLVED}, {_day_events(_DIM_AND_HIRED)}" if _name == "scd2_dimension" else _RESOLVED
    oracle(
        _name,
        f"""WITH {_with}, united AS ({" UNION ALL ".join(f"SELECT * FROM ({part}) AS p" for part in _parts)})
        SELECT row_number() OVER (ORDER BY driverkey NULLS FIRST, effectivedate NULLS FIRST, expireddate NULLS FIRST, drivername, shifttimekey, coveragekey,
          companykey, hiredate, firedate NULLS FIRST, loaddate, current_record NULLS FIRST) AS driverrecordkey,
        driverkey, drivername, shifttimekey, coveragekey, companykey, hiredate, firedate, effectivedate, loaddate, expireddate,
        current_record FROM united""",
        **_SCD,
    )
oracle(
    "scd2_incremental",
    f"""WITH {_RESOLVED}, {_day_events(_DIM_AND_HIRED)}, united AS (SELECT * FROM ({_UNCHANGED}) AS p UNION ALL SELECT * FROM ({_VERSIONS}) AS q)
    SELECT drivername, shifttimekey, coveragekey, companykey, hiredate, firedate, effectivedate, loaddate, expireddate, current_record
    FROM united""",
    **_SCD,
)
oracle(
    "dimension_as_text",
    """SELECT driverrecordkey, driverkey, drivername, shifttimekey, coveragekey, companykey, strftime(hiredate, '%m/%d/%Y') AS hiredate,
       strftime(firedate, '%m/%d/%Y') AS firedate, strftime(effectivedate, '%m/%d/%Y') AS effectivedate,
       strftime(loaddate, '%m/%d/%Y') AS loaddate, strftime(expireddate, '%m/%d/%Y') AS expireddate, current_record FROM dim""",
    dim=I.DRIVER_DIM,
)
_FACT_INPUTS = {"dim": I.DRIVER_DIM, "coverages": I.COVERAGE_DIM, "companies": I.COMPANY_DIM}


def _keyed(compat: bool = False) -> str:
    clock, midnight = ("%I:%M", "00:01") if compat else ("%H:%M", "00:00")
    return f"""places AS (SELECT event_id, strftime(ts, '{clock}') AS datetime, 'USER ' || user_id AS street_address,
    'NATION_' || (user_id % 26) AS city, event_type AS state,
    'Supplier#' || lpad(CAST(event_id % (SELECT count(*) FROM supplier) AS VARCHAR), 9, '0') AS source,
    value AS latitude, CAST(event_id AS DOUBLE) AS longitude FROM events),
  keyed AS (SELECT p.*, {_SHIFT.format('datetime', midnight)} AS shifttimekey, coalesce(g.coveragekey, -1) AS coveragekey, c.companykey
    FROM places AS p LEFT JOIN coverages AS g ON p.city = g.coverage LEFT JOIN companies AS c ON p.source = c.company)"""


_KEYED = _keyed()
for _name, _compat in (("fact_with_keys", False), ("fact_with_keys_compat", True)):
    oracle(
        _name,
        f"""WITH {_keyed(_compat)} SELECT d.driverrecordkey, d.driverkey, datetime, street_address, city, state, source, latitude, longitude
        FROM keyed AS k JOIN dim AS d USING (shifttimekey, coveragekey, companykey) WHERE d.current_record = 1""",
        **_FACT_INPUTS,
    )
oracle(
    "fact_without_driver",
    f"""WITH {_KEYED} SELECT datetime, street_address, city, state, source, latitude, longitude, shifttimekey, coveragekey, companykey
        FROM keyed AS k WHERE NOT EXISTS (SELECT 1 FROM dim AS d WHERE d.current_record = 1 AND d.shifttimekey = k.shifttimekey
          AND d.coveragekey = k.coveragekey AND d.companykey = k.companykey)""",
    **_FACT_INPUTS,
)
oracle(
    "keyed_facts",
    f"""WITH {_KEYED} SELECT datetime, street_address, city, state, source, latitude, longitude, shifttimekey, coveragekey, companykey
        FROM keyed""",
    **_FACT_INPUTS,
)
oracle(
    "driver_bridge",
    """SELECT shifttimekey, coveragekey, companykey, driverrecordkey, driverkey FROM dim WHERE current_record = 1
       AND shifttimekey IS NOT NULL AND coveragekey IS NOT NULL AND companykey IS NOT NULL""",
    dim=I.DRIVER_DIM,
)
oracle(
    "fact_fan_out",
    f"""WITH {_KEYED} SELECT shifttimekey, coveragekey, companykey, count(DISTINCT k.event_id) AS pickups,
        count(DISTINCT d.driverrecordkey) AS drivers, count(*) AS fact_rows
        FROM keyed AS k JOIN dim AS d USING (shifttimekey, coveragekey, companykey) WHERE d.current_record = 1 GROUP BY ALL""",
    **_FACT_INPUTS,
)

# Messages

_CLEAN = "lower(regexp_replace({}, '[^a-zA-Z \\t\\n\\x0B\\f\\r]', '', 'g'))"
_STOP = ", ".join("'" + word.replace("'", "''") + "'" for word in STOP_WORDS)
_WORDS = f"""words AS (SELECT doc_id, unnest(string_split_regex({_CLEAN.format('text')}, '[^a-z]+')) AS term FROM documents),
  terms AS (SELECT * FROM words WHERE term <> '' AND term NOT IN ({_STOP})),
  counts AS (SELECT term, count(*) AS n FROM terms GROUP BY term)"""
_TOP5 = "top5 AS (SELECT term FROM counts ORDER BY n DESC, term LIMIT 5)"
_LEXICON = f"""lexicon AS (SELECT term, CAST(length(term) * 7 % 5 - 2 AS DOUBLE) / 2 AS polarity, CAST(length(term) % 5 AS DOUBLE) / 4 AS subjectivity
  FROM (SELECT DISTINCT unnest(string_split_regex({_CLEAN.format('text')}, '[^a-z]+')) AS term FROM benchmark) AS b WHERE term <> '')"""
oracle("term_counts", f"WITH {_WORDS} SELECT term, n FROM counts")
oracle("document_term_counts", f"WITH {_WORDS} SELECT doc_id, term, count(*) AS n FROM terms GROUP BY ALL")
oracle("top_terms", f"WITH {_WORDS} SELECT term, n FROM counts ORDER BY n DESC, term LIMIT 10")
_TAGS = f"""tags AS (SELECT doc_id, CAST(count(DISTINCT term) > 2 AS INTEGER) AS tags FROM terms WHERE term IN (SELECT term FROM top5) GROUP BY doc_id)"""
oracle(
    "top_term_tag",
    f"WITH {_WORDS}, {_TOP5}, {_TAGS} SELECT doc_id, coalesce(tags, 0) AS tags FROM documents LEFT JOIN tags USING (doc_id)",
)
oracle(
    "count_vectors",
    f"""WITH {_WORDS}, vocabulary AS (SELECT term, CAST(row_number() OVER (ORDER BY n DESC, term) - 1 AS INTEGER) AS term_index
          FROM counts)
        SELECT doc_id, term_index, CAST(count(*) AS DOUBLE) AS n FROM terms JOIN vocabulary USING (term) GROUP BY ALL""",
)
_SCORES = """scores AS (SELECT doc_id, avg(polarity) AS polarity, avg(subjectivity) AS subjectivity FROM words JOIN lexicon USING (term) GROUP BY doc_id)"""
_ROUNDED = "round(coalesce(polarity, 0), 9) AS polarity, round(coalesce(subjectivity, 0), 9) AS subjectivity"
oracle(
    "lexicon_sentiment",
    f"WITH {_WORDS}, {_LEXICON}, {_SCORES} SELECT doc_id, {_ROUNDED} FROM documents LEFT JOIN scores USING (doc_id)",
)
oracle(
    "message_facts",
    f"""WITH {_WORDS}, {_TOP5}, {_TAGS}, {_LEXICON}, {_SCORES} SELECT doc_id, {_CLEAN.format('text')} AS tweet, coalesce(tags, 0) AS tags, {_ROUNDED}
        FROM documents LEFT JOIN tags USING (doc_id) LEFT JOIN scores USING (doc_id)""",
)

# Streams

_MENTIONS = "regexp_matches(lower(text), '(^|[^a-z0-9_])(with|by)([^a-z0-9_]|$)') AND lang = 'en'"
oracle(
    "stream_capture",
    f"""SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS created_at, text AS tweet, source = 'src0' AS is_retweet
        FROM documents WHERE {_MENTIONS}""",
)
oracle(
    "bounded_capture",
    f"""SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS created_at, text AS tweet FROM documents WHERE {_MENTIONS}
        ORDER BY doc_id LIMIT 120""",
)
oracle(
    "stream_scored",
    f"""WITH {_WORDS}, {_TOP5}, {_LEXICON},
        turns AS (SELECT conv_id || '-' || turn AS created_at, {_CLEAN.format('text')} AS tweet FROM conversations),
        said AS (SELECT created_at, unnest(string_split_regex(tweet, '[^a-z]+')) AS term FROM turns),
        tagged AS (SELECT created_at, CAST(count(DISTINCT term) > 2 AS INTEGER) AS tags FROM said
                   WHERE term IN (SELECT term FROM top5) GROUP BY created_at),
        scored AS (SELECT created_at, avg(polarity) AS polarity, avg(subjectivity) AS subjectivity FROM said JOIN lexicon USING (term) GROUP BY created_at)
        SELECT created_at, tweet, coalesce(tags, 0) AS tags, {_ROUNDED}
        FROM turns LEFT JOIN tagged USING (created_at) LEFT JOIN scored USING (created_at)""",
)

# Loads

oracle("csv_roundtrip", "SELECT * FROM customer")
oracle(
    "message_file_roundtrip",
    "SELECT conv_id || '-' || turn AS created_at, text AS tweet FROM conversations",
)
oracle("full_refresh", "SELECT * FROM orders")
oracle(
    "append_load",
    "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'O'",
)
oracle("load_error_budget", "SELECT * FROM customer WHERE c_custkey <> 7")
oracle(
    "second_source",
    """WITH second AS (SELECT o_orderkey, o_orderpriority AS source FROM orders WHERE o_orderstatus = 'F'),
       first AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN '1-URGENT' ELSE 'SKYLINE' END AS source FROM orders WHERE o_orderstatus <> 'F')
       SELECT * FROM second UNION ALL SELECT * FROM first WHERE source NOT IN (SELECT source FROM second)""",
)
oracle(
    "audit_rows",
    """SELECT job_id, job_completed, (SELECT count(*) FROM orders) AS loaded_rows
       FROM (VALUES (1, 'TRUE'), (2, 'FALSE (Tweet)')) AS v(job_id, job_completed)""",
)
oracle(
    "stage_durations",
    """SELECT job_id, job_completed, TRUE AS in_time, (SELECT count(*) FROM orders) AS loaded_rows
       FROM (VALUES (1, 'TRUE'), (2, 'FALSE (Tweet)')) AS stages(job_id, job_completed)""",
)

_ALL_ORDERS = "SELECT '{step}' AS step, 'orders' AS target, count(*) AS n, sum(o_orderkey) AS keys FROM orders {where}"
_ALL_LINES = "SELECT '{step}', 'lines', count(*), sum(l_partkey) FROM lineitem {where}"
oracle(
    "atomic_loads",
    " UNION ALL ".join(
        [
            *(_ALL_ORDERS.format(step=step, where="WHERE o_orderstatus = 'O'") for step in ("first", "broken")),
            *(_ALL_ORDERS.format(step=step, where="") for step in ("restarted", "rolled back")),
            *(_ALL_LINES.format(step=step, where="WHERE l_linenumber = 1") for step in ("first", "broken")),
            *(_ALL_LINES.format(step=step, where="") for step in ("restarted", "rolled back")),
        ]
    ),
)

oracle(
    "stable_keys",
    """WITH keys AS (SELECT o_custkey, o_orderpriority, bool_or(o_orderstatus = 'F') AS in_first_feed FROM orders GROUP BY ALL),
    sizes AS (SELECT in_first_feed, count(*) AS n FROM keys GROUP BY ALL),
    first AS (SELECT count(*) FILTER (in_first_feed) AS n FROM keys)
    SELECT s.in_first_feed, s.n AS n_keys, s.n AS n_numbers, CASE WHEN in_first_feed THEN 1001 ELSE 1001 + first.n END AS lowest,
      CASE WHEN in_first_feed THEN 1000 + s.n ELSE 1000 + first.n + s.n END AS highest, 0 AS changed, 0 AS changed_again,
      0 AS blocks_with_gaps
    FROM sizes AS s, first""",
)

_MIDDLE = ", ".join(
    f"(least(min({c}_from), min({c}_to)) + greatest(max({c}_from), max({c}_to))) / 2 AS {c}" for c in ("latitude", "longitude")
)
oracle(
    "geocode_ranges",
    f"""WITH addresses AS (
      SELECT DISTINCT street_address, city, state, regexp_extract(street_address, '^(\\d+) (.+)$', 1) AS digits,
        regexp_extract(street_address, '^(\\d+) (.+)$', 2) AS rest FROM pickups),
    parted AS (
      SELECT *, CASE WHEN rest = '' THEN street_address ELSE rest END AS street,
        CASE WHEN length(digits) BETWEEN 1 AND 9 THEN CAST(digits AS BIGINT) END AS number FROM addresses),
    covered AS (
      SELECT p.street_address, p.city, p.state, p.number, r.*,
        row_number() OVER (PARTITION BY p.street_address, p.city, p.state
          ORDER BY house_to - house_from, house_from, latitude_from, longitude_from, latitude_to, longitude_to) AS rn
      FROM parted AS p JOIN ranges AS r ON p.street = r.street AND p.city = r.city AND p.state = r.state
        AND p.number BETWEEN r.house_from AND r.house_to
        AND (side = 'both' OR (side = 'odd' AND number % 2 = 1) OR (side = 'even' AND number % 2 = 0))),
    exact AS (
      SELECT street_address, city, state,
        latitude_from + (latitude_to - latitude_from) * ((number - house_from) / greatest(house_to - house_from, 1)) AS latitude,
        longitude_from + (longitude_to - longitude_from) * ((number - house_from) / greatest(house_to - house_from, 1)) AS longitude
      FROM covered WHERE rn = 1),
    streets AS (SELECT street, city, state, {_MIDDLE} FROM ranges GROUP BY ALL),
    cities AS (SELECT city, state, {_MIDDLE} FROM ranges GROUP BY ALL)
    SELECT o_orderkey, k.street_address, k.city, k.state,
      round(coalesce(e.latitude, s.latitude, c.latitude), 9) AS latitude, round(coalesce(e.longitude, s.longitude, c.longitude), 9) AS longitude,
      CASE WHEN e.latitude IS NOT NULL THEN 'number' WHEN s.latitude IS NOT NULL THEN 'street' WHEN c.latitude IS NOT NULL THEN 'city' END AS precision
    FROM pickups AS k LEFT JOIN parted AS p USING (street_address, city, state) LEFT JOIN exact AS e USING (street_address, city, state)
      LEFT JOIN streets AS s ON s.street = p.street AND s.city = p.city AND s.state = p.state
      LEFT JOIN cities AS c ON c.city = p.city AND c.state = p.state""",
    pickups=I.NUMBERED_PICKUPS,
    ranges=I.HOUSE_RANGES,
)

_UPPER_WORDS = "SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS {} FROM {}"
oracle(
    "misspelt_streets",
    f"""WITH wanted AS ({_UPPER_WORDS.format('street', 'conversations')}), listed AS ({_UPPER_WORDS.format('nearest', 'benchmark')}),
    pairs AS (SELECT *, levenshtein(street, nearest) AS distance FROM wanted, listed
      WHERE length(street) BETWEEN length(nearest) - 2 AND length(nearest) + 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY street ORDER BY distance, nearest) AS rn FROM pairs WHERE distance <= 2)
    SELECT street, nearest, distance FROM best WHERE rn = 1""",
)

oracle(
    "flexible_capture",
    """SELECT CASE CAST(doc_id % 11 AS INT) WHEN 4 THEN CAST(doc_id AS VARCHAR) WHEN 5 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN NULL
        ELSE lpad(CAST(doc_id AS VARCHAR), 12, '0') END AS created_at,
      CASE WHEN doc_id % 11 IN (0, 1, 2, 4, 6, 7) THEN said WHEN doc_id % 11 = 9 THEN 'true' END AS tweet,
      CASE CAST(doc_id % 11 AS INT) WHEN 0 THEN lang WHEN 2 THEN 'en' WHEN 3 THEN 'en' WHEN 4 THEN '7' END AS lang,
      doc_id % 11 = 6 AS is_retweet,
      CASE CAST(doc_id % 11 AS INT) WHEN 3 THEN 'no text' WHEN 5 THEN 'no JSON' WHEN 8 THEN 'no object' END AS problem,
      CASE WHEN doc_id % 11 IN (3, 5, 8) THEN md5(value) END AS kept
    FROM lines JOIN documents USING (doc_id) WHERE doc_id % 11 < 10""",
    lines=I.FLEXIBLE_LINES,
)
oracle("stream_leading_terms", ORACLES["top_terms"])

# Whole texts: ON after ON, each on what the one before has left; every run of digits by the characters around its end.
oracle(
    "cross_streets_in_texts",
    f"""WITH cut AS (SELECT doc_id, {_tokens('address')} AS t FROM src),
    steps AS (SELECT doc_id, list_prepend(t, list_transform(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'ON'),
      lambda i: [CAST(i AS VARCHAR)])) AS folds FROM cut)
    SELECT doc_id, md5(array_to_string(list_reduce(folds, lambda acc, p: CASE WHEN acc[CAST(p[1] AS INT)] <> 'ON' THEN acc ELSE
      list_transform(acc, lambda w, i: CASE WHEN i = CAST(p[1] AS INT) THEN ''
        WHEN CAST(p[1] AS INT) + 2 > len(acc) THEN w
        WHEN i = CAST(p[1] AS INT) + 2 THEN ''
        WHEN i = CAST(p[1] AS INT) + 1 AND NOT regexp_full_match(w, '\\p{{L}}+') THEN '' ELSE w END) END), ' ')) AS street_address
    FROM steps""",
    src=I.MANY_CROSS_STREETS,
)


def _digit_runs(compat: bool) -> str:
    ordinal = "CASE WHEN before[i - 2] = '1' THEN 'TH' WHEN c[i - 1] = '1' THEN 'ST' WHEN c[i - 1] = '2' THEN 'ND' WHEN c[i - 1] = '3' THEN 'RD' ELSE 'TH' END"
    ordinal = ordinal.replace("before[i - 2]", "CASE WHEN i > 2 THEN c[i - 2] END")
    kept = "false" if compat else "i < len(c) AND c[i] || c[i + 1] IN ('ST', 'ND', 'RD', 'TH') AND (i + 2 > len(c) OR NOT regexp_matches(c[i + 2], '[\\p{L}\\p{Nd}_]'))"
    return f"""md5(array_to_string(list_transform(c, lambda x, i: CASE WHEN i > 1 AND regexp_matches(c[i - 1], '[0-9]') AND NOT regexp_matches(x, '[0-9]') AND NOT ({kept})
      THEN {f'lower({ordinal})' if compat else ordinal} || ' ' ELSE x END), ''))"""


oracle(
    "ordinal_runs_in_texts",
    f"""WITH cut AS (SELECT doc_id, regexp_extract_all(street, '(?s).') AS c FROM src)
    SELECT doc_id, {_digit_runs(False)} AS street, {_digit_runs(True)} AS street_compat FROM cut""",
    src=I.MANY_DIGIT_RUNS,
)


def _job_rows(what: str, rows: str, where: str = "true", outcome: str = "TRUE") -> str:
    return f"SELECT '{what}' AS what, count(*) AS n, '{outcome}' AS outcome FROM ({rows}) AS t WHERE {where}"


oracle(
    "whole_job",
    " UNION ALL ".join(
        [
            _job_rows("pickup_data", ORACLES["standard_pickups"]),
            _job_rows("pickup_data_keyed", ORACLES["standard_pickups"]),
            _job_rows("quarantine_location_feed", "SELECT 1", "false"),
            _job_rows("tweet_analysis", "FROM documents"),
            _job_rows("driver_dim_updated", ORACLES["scd2_dimension"]),
            _job_rows("driver_feed_rejects", ORACLES["scd2_rejects"]),
            _job_rows("driver_bridge", ORACLES["scd2_dimension"], "current_record = 1 AND shifttimekey + coveragekey + companykey IS NOT NULL"),
            f"""SELECT 'pickupdata_with_anothersource', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') +
              (SELECT count(*) FROM ({ORACLES["standard_pickups"]}) AS p WHERE source <> 'SKYLINE'), 'TRUE'""",
            "SELECT 'stage 1', 3 * count(*), 'TRUE' FROM orders",
            _job_rows("stage 2", "FROM documents"),
            _job_rows("stage 3", ORACLES["scd2_dimension"]),
            _job_rows("stage 4", "SELECT 1 FROM orders WHERE o_orderstatus = 'F'"),
        ]
    ),
)

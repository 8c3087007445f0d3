"""Every text and time rule against values traced by hand."""

import pytest
from pyspark.sql import functions as F

from dispatchmart.functions import address as A
from dispatchmart.functions import clock as C
from dispatchmart.functions import columns as K
from dispatchmart.functions import messages as M


def apply(spark, rule, values):
    """The rule's results for values (or tuples of values), computed as one table."""
    rows = [value if isinstance(value, tuple) else (value,) for value in values]
    names = [f"c{i}" for i in range(len(rows[0]))]
    schema = ", ".join(["n int", *[f"{name} string" for name in names]])
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)
    result = df.select("n", rule(*[F.col(name) for name in names]).alias("r")).orderBy("n").collect()
    return [row.r for row in result]


def on_words(rule, **options):
    return lambda text: rule(A.words(text), **options)


def check(spark, rule, cases):
    assert dict(zip(cases, apply(spark, rule, list(cases)))) == cases


def test_street_types(spark):
    check(
        spark,
        A.shorten_street_type,
        {
            "OCEAN AV": "OCEAN AVE",
            "1 PARK AVENUE": "1 PARK AVE",
            "QUEENS BL": "QUEENS BLVD",
            "A COURT": "A CT",
            "B STREET": "B ST",
            "C LANE": "C LN",
            "D ROAD": "D RD",
            "E DRIVE": "E DR",
            "F HY": "F HWY",
            "G PZ": "G PLZ",
            "H TP": "H TPKE",
            "AV": "AV",
            "AV X": "AV X",
            "KAV": "KAV",
            "": "",
            None: None,
        },
    )


def test_street_types_are_stable(spark):
    once = ["OCEAN AVE", "B ST", "G PLZ", "F HWY"]
    assert apply(spark, A.shorten_street_type, once) == once


def test_suburb(spark):
    check(
        spark,
        A.add_suburb,
        {
            ("1 A ST", "HOBOKEN NJ"): "1 A ST HOBOKEN ",
            ("1 A ST", "NJ"): "1 A ST ",
            ("1 A ST", "M"): "1 A ST",
            ("1 A ST", None): "1 A ST",
        },
    )


def test_location_codes(spark):
    check(spark, A.location_code, {"M": "M", "HOBOKEN NJ": "NJ", "X M": "M", None: None})
    check(
        spark,
        lambda c: A.location_state(c, F.lit("")),
        {"M": "NEW YORK", "WK": "NEW JERSEY", "LI": "LONG ISLAND", "ZZ": "", "CT": "CONNECTICUT", "PA": "PENNSYLVANIA"},
    )
    check(
        spark,
        lambda c: A.location_city(c, compat=True),
        {"M": "MANHATTAN", "MA": "MANHATTANA", "NJ": "", "WE": "", "FK": "JAMAICA", "AG": "EAST ELMHURST", "CA": "CA"},
    )
    check(
        spark,
        A.location_city,
        {"M": "MANHATTAN", "MA": "MA", "NJ": "", "WK": "NEWARK", "QU": "QUEENS", None: None},
    )
    check(
        spark,
        A.blank_city_outside,
        {("NEWARK", "NEW JERSEY"): "", ("BRONX", "NEW YORK"): "BRONX", ("X", "LONG ISLAND"): "", ("X", None): "X"},
    )


def test_cross_street(spark):
    check(
        spark,
        on_words(A.remove_cross_street),
        {
            "10 FIRST AVE ON 5 MAIN X": "10 FIRST AVE    X",
            "ON MAIN": " MAIN",
            "A ON MAIN ST B": "A  MAIN  B",
            "A ON B ON": "A  B ",
            "A  B   C": "A B C",
            "": "",
            None: None,
        },
    )


def test_ordinal_words(spark):
    cases = {"1 FIRST AVE": "1 1ST AVE", "TWELFTH ST": "12TH ST", "SEVENTHX": "7THX", None: None}
    check(spark, A.ordinal_words, {**cases, "FOURTH ST": "4TH ST"})
    check(spark, lambda c: A.ordinal_words(c, compat=True), {**cases, "FOURTH ST": "FOURTH ST"})
    assert apply(spark, A.ordinal_words, ["1 1ST AVE 12TH"]) == ["1 1ST AVE 12TH"]


def test_cut_after_street_type(spark):
    check(
        spark,
        on_words(A.cut_after_street_type, compat=True),
        {
            "123 W 45 ST NEW YORK": "123 W 45 ST",
            "123 MAIN ST": "123 MAIN",
            "200 BROADWAY NEW YORK NY": "200 BROADWAY NEW YORK",
            "JFK AIRPORT": "JFK",
            "JFK": "JFK",
            "": "",
            None: None,
        },
    )
    check(
        spark,
        on_words(A.cut_after_street_type),
        {"123 MAIN ST": "123 MAIN ST", "123 W 45 ST NEW YORK": "123 W 45 ST", "200 BROADWAY NY": "200 BROADWAY"},
    )


def test_airports(spark):
    check(
        spark,
        lambda c: A.airport_by_word(F.get(A.words(c), F.lit(0)), c),
        {
            "JFK": "148-18 134TH ST",
            "XEWRX T": "3 BREWSTER RD",
            "LGA": "102-05 DITMARS BLVD",
            "TO JFK": "TO JFK",
            "": "",
            None: None,
        },
    )
    check(
        spark,
        A.airport_by_location,
        {("X", "NWK"): "3 BREWSTER", ("X", "JFK"): "148-18 134TH ST", ("X", "LAG"): "102-05 DITMARS BLVD", ("X", "M"): "X"},
    )
    check(spark, lambda c, old: A.airport_field(c, 3, old), {("IS", "X"): "RONKONKOMA", ("NY", "X"): "X"})


def test_fragments(spark):
    check(
        spark,
        lambda c: A.fragment_city(c, compat=True),
        {
            "ONX": "BRONX",
            " BX": " BRONX",
            "NYC": "NEW YORK CITY",
            "ORK": "NEW YORK CITY",
            "NYX": "YONKERS",
            " NY": " NY",
            "LYN": "BROOKLYN",
            "QUX": "QUEENSX",
            None: None,
        },
    )
    check(
        spark,
        A.fragment_city,
        {"ONX": "BRONX", " BX": "BRONX", " NY": "NEW YORK CITY", "NYX": "NYX", "NY.": "YONKERS", "QU": "QUEENS"},
    )
    check(spark, A.before_comma, {"1 A ST, NY, NY": "1 A ST", "1 A ST": "1 A ST", ",X": "", None: None})
    check(spark, A.address_tail, {"1 A ST NYC": "NYC", "NY": "NY", "": ""})
    check(spark, A.drop_new, {"NEWARK": " ARK", "A NEW B": "A   B"})


def test_first_digit(spark):
    check(spark, A.from_first_digit, {"ABC 12 W 3": "12 W 3", "NO DIGIT": "NO DIGIT", "X\n5\nY": "5\nY", "": "", None: None})


def test_ordinal_after_compass(spark):
    check(
        spark,
        on_words(A.ordinal_after_compass, compat=True),
        {
            "123 W 45 ST": "123 W 45th ST",
            "E 11 ST": "E 11th ST",
            "N 2": "N 2nd",
            "S 103": "S 103rd",
            "W 113 ST": "W 113th ST",
            "X  21": "X 21",
            "": "",
            None: None,
        },
    )
    check(spark, on_words(A.ordinal_after_compass), {"123 W 45 ST": "123 W 45TH ST", "E 21 ST": "E 21ST ST"})


def test_ordinal_digit_runs(spark):
    check(
        spark,
        lambda c: A.ordinal_digit_runs(c, compat=True),
        {
            "42 ST": "42nd ST",
            "42ND ST": "42nd D ST",
            "W 11 ST": "W 11th ST",
            "112 ST 23": "112th ST 23",
            "1-2-3 X": "1st 2nd 3rd X",
            "MAIN": "MAIN",
            "": "",
            None: None,
        },
    )
    check(
        spark,
        A.ordinal_digit_runs,
        {"42 ST": "42ND ST", "42ND ST": "42ND ST", "W 11 ST": "W 11TH ST", "5 AVE": "5TH AVE"},
    )


def test_states(spark):
    check(spark, A.state_code, {"NY": "NY", "NEW": "NE", "M": "M", "": ""})
    check(
        spark,
        A.state_name,
        {("NY", "NY"): "NEW YORK", ("M", "M"): "MANHATTAN", ("MA", "MA"): "MASSACHUSETTS", ("ZZ", "ZZQ"): "ZZQ"},
    )


def test_dates(spark):
    check(spark, C.day_before_text, {"1/1/2020": "12/31/2019", "03/01/2020": "02/29/2020", None: None})


def test_minutes(spark):
    check(
        spark,
        lambda c: C.minute_of_day(c, compat=True),
        {
            "07-01-2014 12:05:00 AM": "12:05",
            "7-1-2014 1:05:00 PM": "01:05",
            "7-1-2014 0:02:00": "014 0",
            None: None,
        },
    )
    check(
        spark,
        C.minute_of_day,
        {
            "07-01-2014 12:05:00 AM": "00:05",
            "7-1-2014 12:05:00 PM": "12:05",
            "7-1-2014 1:05:00 PM": "13:05",
            "7-1-2014 0:02:00": "00:02",
            "2014-07-01 23:59": "23:59",
            "2014-07-01 23:59:10.123": "23:59",
            "13:05 PM": None,
            "24:00": None,
            "12:75": None,
            "no time": None,
            None: None,
        },
    )


def test_shifts(spark):
    edges = {"00:01": 1, "07:59": 1, "08:00": 2, "15:59": 2, "16:00": 3, "23:59": 3, "zz": -1, None: -1}
    check(spark, C.shift_key, {**edges, "00:00": 1})
    check(spark, lambda c: C.shift_key(c, compat=True), {**edges, "00:00": -1})


def test_messages(spark):
    assert apply(spark, M.clean_text, ["It's 5 TAXIS!\nNow"]) == ["its  taxis\nnow"]
    words = apply(spark, lambda c: M.without_stop_words(M.message_words(M.clean_text(c))), ["The taxi, the TAXI is here", ""])
    assert words == [["taxi", "taxi"], []]
    check(
        spark,
        lambda c: M.mentions(c, ("taxi", "a.b")),
        {"My TAXI!": True, "taxis": False, "#taxi": True, "xa.b": False, "a.b": True, "axb": False},
    )


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    from dispatchmart.functions.fixed_values import STOP_WORDS

    assert list(STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_whole_table_columns(spark):
    df = spark.createDataFrame([(" a ", 5, "1/2/2020", "10:02")], "`Pick Up` string, n int, Date string, TIME string")
    lowered = K.lower_names(df)
    assert lowered.columns == ["pick_up", "n", "date", "time"]
    assert K.upper_values(K.trim_values(lowered)).first()[:2] == ("A", "5")
    merged = K.merge_date_time(lowered.withColumn("date", K.dashed_date(F.col("date"))))
    assert merged.columns == ["pick_up", "n", "datetime"]
    assert merged.first().datetime == "1-2-2020 10:02"
    only_date = lowered.drop("time")
    assert K.merge_date_time(only_date).columns == only_date.columns
    only_time = lowered.drop("date")
    assert K.merge_date_time(only_time).columns == only_time.columns


@pytest.mark.parametrize("compat", [False, True])
def test_rules_stay_in_the_jvm(spark, compat):
    df = spark.createDataFrame([("1 W 2 ST NYC",)], "a string")
    plan = df.select(
        A.ordinal_after_compass(A.words(A.cut_after_street_type(A.words(F.col("a")), compat)), compat),
        A.ordinal_digit_runs(F.col("a"), compat),
        A.remove_cross_street(A.words(F.col("a"))),
        C.minute_of_day(F.col("a"), compat),
    )._jdf.queryExecution().toString()
    assert "Python" not in plan

"""Operators on small tables, both sides of every size check."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from dispatchmart import schemas, session
from dispatchmart.functions import fixed_values as V
from dispatchmart.functions.messages import clean_text, message_words
from dispatchmart.operators import dimension as D
from dispatchmart.operators import facts as X
from dispatchmart.operators import joins as J
from dispatchmart.operators import ordered as O
from dispatchmart.operators import sets as S
from dispatchmart.operators import terms as W
from dispatchmart.operators.geocode import add_coordinates, geocode_feeds
from dispatchmart.operators.sentiment import add_sentiment
from dispatchmart.plans.messages import score_messages

OPEN = date(9999, 12, 31)


def rows(df, *order):
    return [tuple(row) for row in (df.orderBy(*order) if order else df).collect()]


# Joins


@pytest.mark.parametrize("max_rows", [J.BROADCAST_ROWS, 0])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_is_a_join(spark, how, max_rows):
    big = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 != 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    ).repartition(6)
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4), (None, 5)], "k string, v int")
    got = J.lookup_join(big, side, ["k"], how, max_rows)
    want = big.join(side, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(repr, rows(got))) == sorted(map(repr, rows(want)))


def test_lookup_join_paths(spark):
    big = spark.range(10).withColumn("k", F.col("id") % 3)
    side = spark.createDataFrame([(0, "a")], "k long, v string")
    small = J.lookup_join(big, side, ["k"])._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in small
    salted = J.lookup_join(big, side, ["k"], max_rows=0)._jdf.queryExecution().toString()
    assert "SPARK_PARTITION_ID" in salted and "CartesianProduct" not in salted
    assert not J.fits_broadcast(side, max_bytes=4)
    with pytest.raises(ValueError):
        J.lookup_join(big, side, ["k"], "full")


def test_a_hot_key_is_shared_by_many_tasks(spark):
    big = spark.range(80000).select(F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    side = big.distinct().withColumn("v", F.lit(1))
    joined = J.lookup_join(big.repartition(16), side, ["k"], "left", max_rows=0)
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 80000 and max(sizes) < 40000


# Order


@pytest.mark.parametrize("rows_differ", [False, True])
def test_number_rows_is_row_number(spark, rows_differ):
    rng = random.Random(5)
    values = [(rng.choice([1, 1, 1, rng.randint(0, 40)]), rng.randint(0, 9), i) for i in range(2000)]
    df = spark.createDataFrame(values, "a int, b int, i int").repartition(5)
    got = rows(O.number_rows(df, "n", ["a", "b"], after=10, rows_differ=rows_differ).select("n", "a", "b", "i"), "n")
    want = [(10 + n, *value) for n, value in enumerate(sorted(values), start=1)]
    assert got == want


def test_number_rows_with_copies_and_nulls(spark):
    df = spark.createDataFrame([(1, None)] * 500 + [(None, "x")] * 300 + [(2, "y")], "a int, b string").repartition(4)
    numbered = O.number_rows(df, "n", ["a"])
    assert sorted(row.n for row in numbered.collect()) == list(range(1, 802))
    first = numbered.where("n <= 300").select("a", "b").distinct()
    assert rows(first) == [(None, "x")]


def test_copies_are_cut_into_ranges(spark):
    df = spark.range(40000).select(F.lit(7).alias("a"))
    ordered = O.in_order(df.repartition(8), ["a"])
    sizes = [row["count"] for row in ordered.groupBy(O.RANGE).count().collect()]
    assert sum(sizes) == 40000 and max(sizes) < 30000


def test_number_rows_of_nothing(spark):
    empty = spark.createDataFrame([], "a int")
    assert rows(O.number_rows(empty, "n", ["a"])) == []


def test_next_and_latest_crosses_ranges(spark):
    rng = random.Random(9)
    values = []
    for i in range(3000):
        group = 1 if rng.random() < 0.4 else rng.randint(2, 60)
        values.append((group, i, 1000 + i, rng.choice([None, None, None, f"v{i}"])))
    df = spark.createDataFrame(values, "g int, at int, nxt int, val string").repartition(6)
    got = {(r.g, r.at): (r.val, r.next_nxt) for r in O.next_and_latest(df, "g", ["at"], "nxt", "val", rows_differ=True).collect()}
    want = {}
    by_group = {}
    for value in sorted(values):
        by_group.setdefault(value[0], []).append(value)
    for group, members in by_group.items():
        latest = None
        for here, after in zip(members, [*members[1:], None]):
            latest = here[3] if here[3] is not None else latest
            want[(group, here[1])] = (latest, after[2] if after else None)
    assert got == want
    hot = O.in_order(df, ["g", "at"], rows_differ=True).where("g = 1")
    assert hot.select(O.RANGE).distinct().count() > 1


# Sets, head and rest


def test_except_distinct(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "b"), (2, "b"), (3, "c"), (None, None)], "a int, b string")
    right = spark.createDataFrame([("c", 3), (None, 1)], "b string, a int")
    assert sorted(rows(S.except_distinct(left, right)), key=repr) == sorted([(2, "b"), (None, None)], key=repr)
    assert sorted(rows(left.subtract(right.select("a", "b"))), key=repr) == sorted([(2, "b"), (None, None)], key=repr)


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2)], "b string, a int")
    assert rows(S.union_feeds(a, b, a), "a", "b") == [(1, "x"), (1, "x"), (2, "y")]


def test_mark_head(spark):
    df = spark.createDataFrame([(i % 50, i) for i in range(500)], "a int, i int").repartition(4)
    head = S.mark_head(df, 100, ["a"]).where("is_head").select("a", "i")
    assert sorted(rows(head)) == sorted(rows(df))[:100]
    assert S.mark_head(df, 10_000, ["a"]).where("not is_head").count() == 0
    assert S.mark_head(df.where("a < 0"), 5, ["a"]).count() == 0
    assert rows(S.first_rows(df, 3, ["a"])) == sorted(rows(df))[:3]


@pytest.mark.parametrize(
    "target, admitted",
    [
        (["A"], ["B", "B"]),
        (["A", None], []),
        ([None], []),
        ([], ["A", "B", "B", None]),
        (["Z"], ["A", "B", "B"]),
    ],
)
def test_not_in(spark, target, admitted):
    incoming = spark.createDataFrame([("A", 1), ("B", 2), ("B", 3), (None, 4)], "source string, i int")
    present = spark.createDataFrame([(value,) for value in target], "source string")
    got = S.insert_missing_sources(present, incoming)
    assert got.columns == ["source", "i"]
    assert sorted([row.source for row in got.collect()], key=repr) == sorted(admitted, key=repr)
    want = spark.sql(
        "SELECT source FROM {incoming} WHERE source NOT IN (SELECT source FROM {present})", incoming=incoming, present=present
    )
    assert sorted([row.source for row in want.collect()], key=repr) == sorted(admitted, key=repr)


# Places


@pytest.mark.parametrize("max_rows", [J.BROADCAST_ROWS, 0])
def test_coordinates(spark, max_rows):
    pickups = spark.createDataFrame(
        [("1", "A", "X", "NY"), ("2", "A", "X", "NY"), ("3", "B", "X", "NY"), ("4", None, "X", "NY")],
        "datetime string, street_address string, city string, state string",
    )
    gazetteer = spark.createDataFrame(
        [("A", "X", "NY", 40.5, -73.0), ("A", "X", "NY", 40.25, -74.0), (None, "X", "NY", 1.0, 1.0)],
        "street_address string, city string, state string, latitude double, longitude double",
    )
    got = add_coordinates(pickups, gazetteer, max_rows).select("datetime", "latitude", "longitude")
    assert rows(got, "datetime") == [("1", 40.25, -74.0), ("2", 40.25, -74.0), ("3", None, None), ("4", None, None)]
    budgeted = geocode_feeds([pickups, pickups], gazetteer, 1).select("datetime", "latitude")
    assert rows(budgeted, "datetime", F.desc("latitude")) == [
        ("1", 40.25), ("1", 40.25), ("2", None), ("2", None), ("3", None), ("3", None), ("4", None), ("4", None),
    ]


# Driver dimension


def _dim_row(record, key, name, keys=(1, 1, 1), eff=date(2020, 1, 1), exp=OPEN, current=1):
    return (record, key, name, *keys, date(2019, 1, 1), OPEN, eff, eff, exp, current)


@pytest.fixture
def drivers(spark):
    return spark.createDataFrame(
        [
            _dim_row(1, 10, "A"),
            _dim_row(2, 11, "B"),
            _dim_row(3, 12, "C", keys=(2, 2, 2), eff=date(2018, 1, 1), exp=date(2019, 12, 31), current=0),
            _dim_row(4, 12, "C"),
            _dim_row(5, 13, "D"),
        ],
        schemas.DRIVER_DIMENSION,
    )


@pytest.fixture
def lookups(spark):
    return D.Lookups(
        spark.createDataFrame([(1, "00:00", "07:59"), (3, "16:00", "23:59")], "shifttimekey int, starttime string, endtime string"),
        spark.createDataFrame([(1, "BRONX"), (7, "NEWARK")], "coveragekey int, coverage string"),
        spark.createDataFrame([(1, "DIAL7"), (4, "SKYLINE")], "companykey int, company string"),
    )


def feed(spark, *events):
    full = [
        (name, action, begin, end, place, company, day, day and day.replace(year=day.year + 1))
        for name, action, begin, end, place, company, day in events
    ]
    return spark.createDataFrame(full, schemas.DRIVER_FEED)


EVENING = ("16:00", "23:59", "NEWARK", "SKYLINE")
NIGHT = ("00:00", "07:59", "BRONX", "DIAL7")


def simple_feed(spark):
    return feed(
        spark,
        ("B", "FIRED", None, None, None, None, date(2021, 3, 1)),
        ("C", "CHANGE", *EVENING, date(2021, 1, 1)),
        ("E", "HIRED", *NIGHT, date(2021, 5, 5)),
    )


def test_dimension_seed(spark, drivers, lookups):
    update = D.update_dimension(drivers, simple_feed(spark), lookups)
    got = rows(
        update.dimension.select(
            "driverrecordkey", "driverkey", "drivername", "shifttimekey", "companykey",
            "firedate", "effectivedate", "loaddate", "expireddate", "current_record",
        ),
        "driverrecordkey",
    )
    start = date(2020, 1, 1)
    assert got == [
        (1, 10, "A", 1, 1, OPEN, start, start, OPEN, 1),
        (2, 11, "B", 1, 1, OPEN, start, start, date(2021, 2, 28), 0),
        (3, 11, "B", 1, 1, date(2021, 3, 1), date(2021, 3, 1), date(2022, 3, 1), OPEN, 1),
        (4, 12, "C", 2, 2, OPEN, date(2018, 1, 1), date(2018, 1, 1), date(2019, 12, 31), 0),
        (5, 12, "C", 1, 1, OPEN, start, start, date(2020, 12, 31), 0),
        (6, 12, "C", 3, 4, OPEN, date(2021, 1, 1), date(2022, 1, 1), OPEN, 1),
        (7, 13, "D", 1, 1, OPEN, start, start, OPEN, 1),
        (8, 14, "E", 1, 1, OPEN, date(2021, 5, 5), date(2022, 5, 5), OPEN, 1),
    ]
    assert update.rejects.count() == 0


def test_vocabulary_has_no_default_limit(spark):
    n = 270_000
    word = F.concat(F.lit("zz"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))
    messages = spark.range(0, n, 1, 8).groupBy((F.col("id") % 500).alias("id")).agg(F.concat_ws(" ", F.collect_list(word)).alias("tweet"))
    entries = W.count_vectors(messages, "id").select(F.explode("indices").alias("i"))
    assert entries.agg(F.count("*"), F.countDistinct("i"), F.max("i")).first() == (n, n, n - 1)


def test_several_events_of_one_driver(spark, drivers, lookups):
    events = feed(
        spark,
        ("A", "FIRED", None, None, None, None, date(2023, 1, 1)),
        ("A", "CHANGE", *EVENING, date(2021, 1, 1)),
        ("A", "CHANGE", *EVENING, date(2021, 1, 1)),
        ("A", "CHANGE", *NIGHT, date(2022, 1, 1)),
    )
    dim = D.update_dimension(drivers, events, lookups).dimension.where("drivername = 'A'")
    got = rows(dim.select("effectivedate", "expireddate", "coveragekey", "firedate", "current_record"), "effectivedate")
    assert got == [
        (date(2020, 1, 1), date(2020, 12, 31), 1, OPEN, 0),
        (date(2021, 1, 1), date(2021, 12, 31), 7, OPEN, 0),
        (date(2022, 1, 1), date(2022, 12, 31), 1, OPEN, 0),
        (date(2023, 1, 1), OPEN, 1, date(2023, 1, 1), 1),
    ]


def test_rejects_leave_the_dimension_alone(spark, drivers, lookups):
    events = feed(
        spark,
        ("A", "CHANGE", "01:00", "02:00", "BRONX", "DIAL7", date(2021, 1, 1)),
        ("X", "FIRED", None, None, None, None, date(2021, 1, 1)),
        ("D", "PROMOTED", *NIGHT, date(2021, 1, 1)),
        ("E", "HIRED", "00:00", "07:59", "MARS", "DIAL7", date(2021, 1, 1)),
    )
    update = D.update_dimension(drivers, events, lookups)
    assert rows(update.dimension.drop("driverrecordkey"), "driverkey", "effectivedate") == rows(
        drivers.drop("driverrecordkey"), "driverkey", "effectivedate"
    )
    assert dict(rows(update.rejects.select("drivername", "reason"))) == {
        "A": "unknown shift, coverage or company",
        "X": "no current driver",
        "D": "unknown action",
        "E": "unknown shift, coverage or company",
    }


def test_late_undated_and_same_day_events(spark, drivers, lookups):
    events = feed(
        spark,
        ("A", "CHANGE", *EVENING, date(2018, 5, 5)),
        ("A", "CHANGE", *EVENING, date(2020, 1, 1)),
        ("A", "FIRED", None, None, None, None, None),
        ("A", "CHANGE", *EVENING, date(2021, 3, 3)),
        ("A", "FIRED", None, None, None, None, date(2021, 3, 3)),
        ("H", "HIRED", *NIGHT, date(2021, 1, 1)),
        ("H", "CHANGE", *EVENING, date(2021, 2, 1)),
        ("H", "FIRED", None, None, None, None, date(2021, 3, 1)),
    )
    update = D.update_dimension(drivers, events, lookups)
    changed = update.dimension.where("drivername IN ('A', 'H')")
    got = rows(changed.select("drivername", "effectivedate", "expireddate", "coveragekey", "firedate", "current_record"), "drivername", "effectivedate")
    assert got == [
        ("A", date(2020, 1, 1), date(2021, 3, 2), 1, OPEN, 0),
        ("A", date(2021, 3, 3), OPEN, 1, date(2021, 3, 3), 1),
        ("H", date(2021, 1, 1), date(2021, 1, 31), 1, OPEN, 0),
        ("H", date(2021, 2, 1), date(2021, 2, 28), 7, OPEN, 0),
        ("H", date(2021, 3, 1), OPEN, 7, date(2021, 3, 1), 1),
    ]
    assert sorted(rows(update.rejects.select("drivername", "action", "reason"))) == [
        ("A", "CHANGE", "not after the current version"),
        ("A", "CHANGE", "not after the current version"),
        ("A", "CHANGE", "superseded on the same day"),
        ("A", "FIRED", "no effective date"),
    ]


def test_dimension_invariants(spark, lookups):
    rng = random.Random(3)
    names = [f"N{i}" for i in range(40)]
    dim = spark.createDataFrame([_dim_row(i, i + 1, name) for i, name in enumerate(names)], schemas.DRIVER_DIMENSION)
    days = rng.sample(range(1, 2000), 400)
    events = []
    for day in days:
        when = date.fromordinal(date(2020, 6, 1).toordinal() + day)
        name = "N0" if rng.random() < 0.4 else rng.choice(names)
        action = rng.choice(["FIRED", "CHANGE", "HIRED"])
        events.append((f"H{day}" if action == "HIRED" else name, action, *rng.choice([EVENING, NIGHT]), when))
    updated = D.update_dimension(dim, feed(spark, *events), lookups).dimension
    whole = rows(updated.select("driverkey", "effectivedate", "expireddate", "current_record"), "driverkey", "effectivedate")
    assert len(whole) == 40 + 400
    assert sorted(r.driverrecordkey for r in updated.collect()) == list(range(1, 441))
    by_key = {}
    for key, start, end, current in whole:
        by_key.setdefault(key, []).append((start, end, current))
    for versions in by_key.values():
        assert [v[2] for v in versions] == [0] * (len(versions) - 1) + [1]
        for (_, end, _), (start, _, _) in zip(versions, versions[1:]):
            assert end.toordinal() + 1 == start.toordinal()


def test_compat_dimension(spark, drivers, lookups):
    dim = D.compat_update_dimension(drivers, simple_feed(spark), lookups)
    got = rows(
        dim.select("driverkey", "drivername", "shifttimekey", "effectivedate", "expireddate", "current_record"),
        "driverkey", "effectivedate", "expireddate", "current_record",
    )
    start, changed = date(2020, 1, 1), date(2021, 1, 1)
    assert got == [
        (10, "A", 1, start, OPEN, 1),
        (11, "B", 1, date(2021, 3, 1), OPEN, 1),
        (12, "C", 3, date(2018, 1, 1), date(2020, 12, 31), None),
        (12, "C", 3, start, date(2020, 12, 31), 0),
        (12, "C", 3, changed, OPEN, 1),
        (12, "C", 3, changed, OPEN, 1),
        (13, "D", 1, start, OPEN, 1),
        (14, "E", 1, date(2021, 5, 5), OPEN, 1),
    ]
    text = rows(D.dimension_as_text(dim).select("expireddate").distinct(), "expireddate")
    assert text == [("12/31/2020",), ("12/31/9999",)]


# Facts


@pytest.mark.parametrize("max_rows", [J.BROADCAST_ROWS, 0])
def test_facts(spark, drivers, max_rows):
    pickups = spark.createDataFrame(
        [
            ("7-1-2014 12:05:00 AM", " 1 A ST", "BRONX ", "NY", "DIAL7", None, None),
            ("7-1-2014 1:05:00 PM", "2 B ST", "BRONX", "NY", "DIAL7", 1.0, 2.0),
            ("7-1-2014 3:05:00 AM", "3 C ST", "QUEENS", "NY", "DIAL7", None, None),
            ("7-1-2014 3:05:00 AM", "4 D ST", "BRONX", "NY", "UBER", None, None),
        ],
        schemas.PICKUP,
    )
    keyed = X.add_pickup_keys(pickups)
    assert rows(keyed.select("street_address", "shifttimekey", "coveragekey", "companykey"), "street_address") == [
        ("1 A ST", 1, 1, 1),
        ("2 B ST", 2, 1, 1),
        ("3 C ST", 1, -1, 1),
        ("4 D ST", 1, 1, None),
    ]
    facts = X.facts_with_keys(keyed, drivers, max_rows)
    assert facts.columns == X.FACT
    assert rows(facts.select("driverkey", "datetime", "street_address", "city"), "driverkey") == [
        (key, "00:05", "1 A ST", "BRONX") for key in (10, 11, 12, 13)
    ]
    assert rows(X.pickups_without_driver(keyed, drivers).select("street_address"), "street_address") == [
        ("2 B ST",), ("3 C ST",), ("4 D ST",),
    ]
    check = X.drivers_per_pickup_key(keyed, drivers)
    assert rows(check) == [(1, 1, 1, 1, 4, 4)]
    assert check.agg(F.sum("fact_rows")).first()[0] == facts.count()


# Messages

TEXTS = [
    (1, "Taxi taxi! the cab, the cab is late"),
    (2, "cab late rain taxi"),
    (3, "rain RAIN"),
    (4, ""),
    (5, "snow"),
]


@pytest.fixture
def messages(spark):
    return spark.createDataFrame(TEXTS, "id int, tweet string")


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame(
        [("late", -0.5, 1.0), ("taxi", 0.25, 0.5), ("taxi", 0.75, 0.5)], "term string, polarity double, subjectivity double"
    )


def test_terms(messages):
    assert rows(W.term_counts(messages), "term") == [("cab", 3), ("late", 2), ("rain", 3), ("snow", 1), ("taxi", 3)]
    assert rows(W.top_terms(messages, 3)) == [("cab", 3), ("rain", 3), ("taxi", 3)]
    assert rows(W.add_tag(messages).select("id", "tags"), "id") == [(1, 1), (2, 1), (3, 0), (4, 0), (5, 0)]
    assert W.add_tag(messages).where("id = 1").first().tweet == "taxi taxi the cab the cab is late"
    assert W.add_words(messages).where("id = 1").first().words_clean == ["taxi", "taxi", "cab", "cab", "late"]


@pytest.mark.parametrize("max_rows", [J.BROADCAST_ROWS, 0])
def test_count_vectors(messages, max_rows):
    got = rows(W.count_vectors(messages, "id", max_rows=max_rows), "id")
    assert got == [
        (1, [0, 2, 3], [2.0, 2.0, 1.0]),
        (2, [0, 1, 2, 3], [1.0, 1.0, 1.0, 1.0]),
        (3, [1], [2.0]),
        (4, [], []),
        (5, [4], [1.0]),
    ]
    assert rows(W.count_vectors(messages, "id", size=2), "id")[1] == (2, [0, 1], [1.0, 1.0])


def test_ml_features_hold_the_same_counts(messages):
    vectors = {r.id: sorted(r.features.values.tolist()) for r in W.add_features(messages, 100).collect()}
    assert vectors == {r[0]: sorted(r[2]) for r in rows(W.count_vectors(messages, "id"))}


@pytest.mark.parametrize("key", ["id", None])
@pytest.mark.parametrize("max_rows", [J.BROADCAST_ROWS, 0])
def test_sentiment(messages, lexicon, key, max_rows):
    twice = messages.union(messages.withColumn("id", F.col("id") + 10))
    got = rows(add_sentiment(twice, lexicon, key=key, max_rows=max_rows).select("id", "polarity", "subjectivity"), "id")
    one = [(0.0, 2 / 3), (-0.125, 0.75), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    assert got == [(i + offset, *scores) for offset in (1, 11) for i, scores in enumerate(one)]


def test_small_lexicons_are_looked_up_in_the_row(spark, sf_dir):
    """One scan of the texts and no exchange; the lexicon value is in no row; both ways give the same scores."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = texts.select(F.explode(F.split(F.lower("text"), r"\W+")).alias("term")).distinct()
    length = F.length("term")
    lexicon = words.where("length(term) > 1").select(
        "term", (F.crc32("term") % 2001 / 1000 - 1).alias("polarity"), (1 / length).alias("subjectivity")
    )
    lexicon = lexicon.union(lexicon.limit(5)).union(spark.createDataFrame([(None, 1.0, 1.0)], "term string, polarity double, subjectivity double"))
    small = add_sentiment(texts, lexicon, text="text", small=True)
    plan = small._jdf.queryExecution().executedPlan()
    node, kinds = plan.inputPlan(), []  # without the plans of subqueries
    while True:
        kinds.append(node.nodeName().split(" ")[0])
        if node.children().size() != 1:
            break
        node = node.children().apply(0)
    assert kinds == ["Project", "Project", "Scan"] and "AS _lexicon" not in plan.toString()
    large = add_sentiment(texts, lexicon, text="text", key="doc_id", max_rows=0)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert small.where("polarity <> 0").count() > 50


def test_message_facts(messages, lexicon):
    facts = score_messages(messages, lexicon, features=100)
    assert facts.columns == ["id", "tweet", "tags", "polarity", "subjectivity"]


def test_events_of_a_name_are_held_once_for_all_its_drivers(spark, lookups, monkeypatch):
    """Sixty drivers of one name and sixty days of events: 60 x 60 / 2 versions, but no table of so many on the way."""
    day = [date.fromordinal(date(2021, 1, 1).toordinal() + n) for n in range(120)]
    events = [("N", "HIRED", *NIGHT, day[2 * n]) for n in range(60)]
    events += [("N", "CHANGE" if n % 3 else "FIRED", *(NIGHT if n % 2 else EVENING), day[2 * n + 1]) for n in range(60)]
    sizes = []

    def counting(df, name="stored", write=session.stored):
        sizes.append(write(df, name).count())
        return write(df, name)

    for module in (D, O):
        monkeypatch.setattr(module, "stored", counting)
    nobody = spark.createDataFrame([], schemas.DRIVER_DIMENSION)
    got = rows(D.update_dimension(nobody, feed(spark, *events), lookups).dimension.select(
        "driverrecordkey", "driverkey", "effectivedate", "expireddate", "coveragekey", "firedate", "current_record"))
    want, number = [], 0
    coverage = {"HIRED": lambda n: 1, "CHANGE": lambda n: 1 if n % 2 else 7}
    for driver in range(60):
        keys, starts = coverage["HIRED"](driver), [(day[2 * driver], "HIRED", driver)]
        starts += [(day[2 * n + 1], "CHANGE" if n % 3 else "FIRED", n) for n in range(driver, 60)]
        for at, (start, action, n) in enumerate(starts):
            keys, number = coverage[action](n) if action == "CHANGE" else keys, number + 1
            last = at + 1 == len(starts)
            end = OPEN if last else date.fromordinal(starts[at + 1][0].toordinal() - 1)
            want.append((number, driver + 1, start, end, keys, start if action == "FIRED" else OPEN, int(last)))
    assert sorted(got) == want and len(want) == 60 + 60 * 61 // 2
    assert sizes and max(sizes) <= 120


def test_pieces_are_cleaned_once_each(spark):
    """Terms are those of the cleaned texts, but cleaning sees each different piece of the texts once."""
    texts = ["Taxi! taxi\ttaxi\nTAXI\r\nfast", "t-a-x-i  42 fast\u00e9 the \u000bfast\u00a0x", "", None, "\n", "caf\u00e9\fcab"] * 50
    df = spark.createDataFrame([(t,) for t in texts], "tweet string")
    want = dict(rows(df.select(F.explode(message_words(clean_text(F.col("tweet")))).alias("t")).where(~F.col("t").isin(*V.STOP_WORDS)).groupBy("t").count()))
    assert dict(rows(W.term_counts(df))) == want and want["taxi"] == 250
    plan = W.term_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_replace") < plan.rindex("Aggregate"), "cleaning comes after the first count"


def test_count_vectors_write_their_counts_by_column(spark, monkeypatch):
    written = []
    monkeypatch.setattr(W, "stored", lambda df, name: written.append(name) or session.stored(df, name))
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", None)
    df = spark.createDataFrame([(1, "taxi cab taxi"), (2, "")], "id long, tweet string")
    assert rows(W.count_vectors(df, "id"), "id") == [(1, [0, 1], [2.0, 1.0]), (2, [], [])]
    assert written == ["counts"]

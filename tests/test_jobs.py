"""Readers, loads, audit, streams and the whole job on small files."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from dispatchmart import schemas
from dispatchmart.operators.dimension import DIMENSION
from dispatchmart.plans import job
from dispatchmart.plans.standardize import location_feed, split_field_feed, standard_pickups
from dispatchmart.session import checkpoint_dir, scratch_path
from dispatchmart.sources import loads as L
from dispatchmart.sources import readers as R
from dispatchmart.sources.audit import run_stage, stage_durations
from dispatchmart.streaming.capture import captured_messages, run_bounded_capture, start_capture
from dispatchmart.streaming.scoring import fit_leading_terms, run_scoring


def rows(df, *order):
    return [tuple(row) for row in (df.orderBy(*order) if order else df).collect()]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


# Session


def test_shared_folder_is_the_sessions(spark):
    assert scratch_path(spark, "x").startswith(checkpoint_dir(spark) + "/x-")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


# Readers and loads


def test_csv_header_must_fit(spark, tmp_path):
    good = write(tmp_path / "a.csv", "Date,Time,Street_Address,City_State\n1/2/2020,00123,\"1 A ST, B\",M\n")
    assert rows(R.read_csv(spark, good, schemas.LOCATION_FEED)) == [("1/2/2020", "00123", "1 A ST, B", "M")]
    bad = write(tmp_path / "b.csv", "Time,Date,Street_Address,City_State\nx,y,z,w\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        R.read_csv(spark, bad, schemas.LOCATION_FEED).collect()


def test_csv_keeps_values(spark, tmp_path):
    df = spark.createDataFrame([(' "a", b\\', None), (" ", "x~y "), ("\\", '"')], "c string, d string")
    for sep, header in ((",", True), ("~", False)):
        path = str(tmp_path / f"out{header}")
        L.write_csv(df, path, sep, header)
        assert sorted(rows(R.read_csv(spark, path, df.schema, sep, header)), key=repr) == sorted(rows(df), key=repr)


def test_read_table_from_the_catalog(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert R.read_table(spark, "three").count() == 3
    with pytest.raises(ValueError):
        R.read_table(spark, "three", jdbc={"url": "jdbc:none"}, split_on="id")


@pytest.mark.parametrize("bad, passes", [(0, True), (1, True), (2, False), (3, False), (50, False)])
def test_error_budget(spark, tmp_path, bad, passes):
    lines = ["k,v", *[f"{i},{i}.5" for i in range(20)], *[f"x{i},1.0" for i in range(bad)]]
    path = write(tmp_path / "in.csv", "\n".join(lines) + "\n")
    target, quarantine = str(tmp_path / "t"), str(tmp_path / "q")
    L.full_refresh(spark.range(1), target)
    schema = "k int, v double"
    from pyspark.sql.types import StructType

    arguments = (spark, path, StructType.fromDDL(schema), target, quarantine)
    if passes:
        result = L.load_with_error_budget(*arguments)
        assert rows(result.loaded, "k") == [(i, i + 0.5) for i in range(20)]
        assert [r.record for r in result.rejected.collect()] == [f"x{i},1.0" for i in range(bad)]
    else:
        with pytest.raises(L.LoadRejected):
            L.load_with_error_budget(*arguments)
        assert L.read_target(spark, target).columns == ["id"]
        assert L.read_target(spark, quarantine).count() == bad


def test_refresh_append_and_second_source(spark, tmp_path):
    target = str(tmp_path / "t")
    one = spark.createDataFrame([("A", 1)], "source string, i int")
    two = spark.createDataFrame([("A", 2), ("B", 3), ("B", 3), (None, 4)], "source string, i int")
    L.full_refresh(two, target)
    L.full_refresh(one, target)
    assert rows(L.read_target(spark, target)) == [("A", 1)]
    for _ in range(2):  # a repeated run replaces what the first has written
        assert rows(L.merge_second_source(one, two, target), "i") == [("A", 1), ("B", 3), ("B", 3)]


def test_refresh_that_breaks_leaves_the_old_target(spark, tmp_path):
    target = str(tmp_path / "t")
    L.full_refresh(spark.range(5), target)
    half = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        L.full_refresh(half, target)
    assert L.read_target(spark, target).count() == 5
    L.full_refresh(L.read_target(spark, target).where("id > 2"), target)
    assert rows(L.read_target(spark, target), "id") == [(3,), (4,)]


def test_table_target(spark):
    L.full_refresh(spark.range(2), "refreshed_numbers")
    L.append_load(spark.range(2), "refreshed_numbers")
    try:
        assert L.read_target(spark, "refreshed_numbers").count() == 4
    finally:
        spark.sql("DROP TABLE refreshed_numbers")


def test_audit(spark, tmp_path):
    audit, target = str(tmp_path / "audit"), str(tmp_path / "t")
    assert run_stage(spark, audit, 1, "Load", lambda: L.full_refresh(spark.range(3), target))
    failing = spark.range(3).select(F.raise_error(F.lit("broken")).alias("id"))
    assert not run_stage(spark, audit, 2, "Tweet", lambda: L.full_refresh(spark.read.parquet("/nowhere/at/all"), target))
    assert not run_stage(spark, audit, 3, "Late", lambda: failing.collect())
    got = stage_durations(L.read_target(spark, audit))
    assert rows(got.select("job_id", "job_completed"), "job_id") == [(1, "TRUE"), (2, "FALSE (Tweet)"), (3, "FALSE (Late)")]
    assert got.where("seconds < 0").count() == 0
    assert got.where(r"job_start_time rlike '^\\d\\d/\\d\\d/\\d{4} \\d\\d:\\d\\d:\\d\\d$'").count() == 3
    assert L.read_target(spark, target).count() == 3


# Streams


def records(path, batch, count, start=0, lang="en", word="Taxi"):
    lines = []
    for i in range(start, start + count):
        record = {"created_at": f"{i:05d}", "text": f"a {word} no {i}", "lang": lang}
        if i % 3 == 0:
            record["extended_tweet"] = {"full_text": f"{record['text']} in full"}
        if i % 5 == 0:
            record["retweeted_status"] = {"text": "x"}
        lines.append(json.dumps(record))
    write(path / f"{batch}.json", "\n".join(lines) + "\n")


def test_capture_equals_batch_and_restarts(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    records(source, "a", 30)
    records(source, "b", 10, 100, lang="fr")
    records(source, "c", 10, 200, word="bus")

    def run():
        messages = captured_messages(R.stream_records(spark, str(source), 1), keep=("is_retweet",))
        start_capture(messages, out, state).awaitTermination()
        return rows(spark.read.parquet(out), "created_at")

    batch = captured_messages(spark.read.schema(schemas.STREAM_RECORD).json(str(source)), keep=("is_retweet",))
    first = run()
    assert first == rows(batch, "created_at") and len(first) == 30
    assert first[3] == ("00003", "a Taxi no 3 in full", False) and first[5][2]
    assert run() == first
    records(source, "d", 5, 300)
    assert len(run()) == 35


def test_capture_as_lines(spark, tmp_path):
    source = tmp_path / "in"
    write(source / "a.json", json.dumps({"created_at": "1", "text": " taxi\nhere ~ ", "lang": "en"}) + "\n")
    messages = captured_messages(R.stream_records(spark, str(source)))
    start_capture(messages, str(tmp_path / "out"), str(tmp_path / "state"), fmt="csv").awaitTermination()
    assert rows(R.read_messages(spark, str(tmp_path / "out"))) == [("1", " taxi here ~ ")]


def test_bounded_capture_stops_at_the_limit(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run(limit):
        messages = captured_messages(R.stream_records(spark, str(source), 1))
        return rows(run_bounded_capture(messages, out, state, limit), "created_at")

    records(source, "a", 7)
    assert len(run(10)) == 7
    records(source, "b", 7, 100)
    records(source, "c", 7, 200)
    got = run(10)
    assert len(got) == 10 and len(set(got)) == 10
    assert len(run(10)) == 10


def test_stream_scoring(spark, tmp_path):
    source = tmp_path / "in"
    records(source, "a", 8)
    records(source, "b", 4, 100)
    lexicon = spark.createDataFrame([("full", 0.5, 1.0)], "term string, polarity double, subjectivity double")
    batch = captured_messages(spark.read.schema(schemas.STREAM_RECORD).json(str(source)))
    leading = fit_leading_terms(batch)
    assert leading == ["taxi", "full"]
    stream = captured_messages(R.stream_records(spark, str(source), 1))
    scored = run_scoring(stream, leading, lexicon, str(tmp_path / "out"), str(tmp_path / "state"), key="created_at")
    got = rows(scored.select("created_at", "tags", "polarity"), "created_at")
    assert len(got) == 12
    assert got[0] == ("00000", 0, 0.5) and got[1] == ("00001", 0, 0.0)


# Feeds and the whole job


def test_feeds_with_missing_values(spark):
    location = spark.createDataFrame([("1/2/2020", "1:00 AM", None, None), (None, "x", "1 a av", "m")], schemas.LOCATION_FEED)
    assert rows(location_feed(location).select("street_address", "city", "state"), F.desc_nulls_last("street_address")) == [
        ("1 A AVE", "MANHATTAN", "NEW YORK"),
        (None, None, ""),
    ]
    split = spark.createDataFrame([("1/2/2020", "1:00 AM", None, None, None, "42 st ")], schemas.SPLIT_FIELD_FEED)
    assert rows(split_field_feed(split)) == [("1-2-2020 1:00 AM", None, None, None, "DIAL7")]


def test_compat_feeds(spark):
    split = spark.createDataFrame([("1/2/2020", "1:00 AM", "ny", "Bronx", "5", "42nd st")], schemas.SPLIT_FIELD_FEED)
    assert split_field_feed(split, compat=True).first().street_address == "5 42nd D ST"
    assert split_field_feed(split).first().street_address == "5 42ND ST"


def test_standard_pickups_budget(spark):
    location = spark.createDataFrame([(f"1/{d}/2020", "1:00 AM", "1 a st", "m") for d in range(1, 5)], schemas.LOCATION_FEED)
    free = spark.createDataFrame([("1/1/2020", "1:00 AM", "5 w 45 st, nyc")], schemas.FREE_TEXT_FEED)
    split = spark.createDataFrame([("1/1/2020", "1:00 AM", "jfk", "x", "9", "y")], schemas.SPLIT_FIELD_FEED)
    gazetteer = spark.createDataFrame(
        [("1 A ST", "MANHATTAN", "NEW YORK", 1.0, 2.0), ("148-18 134TH ST", "JAMAICA", "NEW YORK", 3.0, 4.0)],
        "street_address string, city string, state string, latitude double, longitude double",
    )
    got = standard_pickups(location, free, split, gazetteer, budget=2)
    assert got.columns == schemas.PICKUP.names
    assert rows(got.select("datetime", "street_address", "city", "source", "latitude"), "source", "datetime") == [
        ("1-1-2020 1:00 AM", "148-18 134TH ST", "JAMAICA", "DIAL7", 3.0),
        ("1-1-2020 1:00 AM", "5 W 45TH ST", "NEW YORK CITY", "FIRSTCLASS", None),
        ("1-1-2020 1:00 AM", "1 A ST", "MANHATTAN", "SKYLINE", 1.0),
        ("1-2-2020 1:00 AM", "1 A ST", "MANHATTAN", "SKYLINE", 1.0),
        ("1-3-2020 1:00 AM", "1 A ST", "MANHATTAN", "SKYLINE", None),
        ("1-4-2020 1:00 AM", "1 A ST", "MANHATTAN", "SKYLINE", None),
    ]


@pytest.fixture
def mart(spark, tmp_path):
    """Input files and warehouse tables of a small data mart."""
    inputs = job.Inputs(
        write(tmp_path / "in/location.csv", "Date,Time,Street_Address,City_State\n07/01/2014,1:05:00 AM,1 a av,m\n"),
        write(tmp_path / "in/free.csv", 'DATE,TIME,PICK UP ADDRESS\n07/01/2014,1:05:00 PM,"5 w 45 st, nyc"\n'),
        write(tmp_path / "in/split.csv", "DATE,TIME,STATE,PUFROM,ADDRESS,STREET\n07/01/2014,9:00:00 PM,jfk,x,9,y\n"),
        write(tmp_path / "in/messages.txt", "1~Late TAXI\n2~a taxi\n"),
        write(
            tmp_path / "in/second.csv",
            "datetime,street_address,city,state,source,latitude,longitude\n7-2-2014 1:00:00 AM,9 Z ST,BRONX,NEW YORK,UBER,1.5,2.5\n",
        ),
    )
    targets = job.Targets(str(tmp_path / "mart"))

    def table(name, data, schema):
        L.full_refresh(spark.createDataFrame(data, schema), targets[name])

    table("gazetteer", [("1 A AVE", "MANHATTAN", "NEW YORK", 1.0, 2.0)],
          "street_address string, city string, state string, latitude double, longitude double")
    table("lexicon", [("late", -0.5, 1.0)], "term string, polarity double, subjectivity double")
    table("shifttime_dim", [(1, "00:00", "07:59"), (3, "16:00", "23:59")], "shifttimekey int, starttime string, endtime string")
    table("coverage_dim", [(3, "JAMAICA"), (5, "MANHATTAN")], "coveragekey int, coverage string")
    table("company_dim", [(1, "DIAL7"), (4, "SKYLINE")], "companykey int, company string")
    day, end = date(2014, 1, 1), date(9999, 12, 31)
    table("driver_dim", [(1, 1, "A", 1, 5, 4, day, end, day, day, end, 1)], schemas.DRIVER_DIMENSION)
    table("driver_feed", [("B", "HIRED", "16:00", "23:59", "JAMAICA", "DIAL7", day, day)], schemas.DRIVER_FEED)
    return inputs, targets


def test_whole_job(spark, mart, tmp_path):
    inputs, targets = mart
    audit = job.run_job(spark, inputs, targets, expand_facts=True)
    assert rows(audit.select("job_id", "job_completed"), "job_id") == [(i, "TRUE") for i in range(1, 5)]
    keyed = L.read_target(spark, targets["pickup_data_keyed"]).join(
        L.read_target(spark, targets["driver_bridge"]), ["shifttimekey", "coveragekey", "companykey"]
    )
    assert rows(keyed.select("driverrecordkey", "source"), "source") == [(2, "DIAL7"), (1, "SKYLINE")]
    facts = L.read_target(spark, targets["pickup_data_withkeys"])
    assert rows(facts.select("driverrecordkey", "driverkey", "datetime", "source", "latitude"), "source") == [
        (2, 2, "21:00", "DIAL7", None),
        (1, 1, "01:05", "SKYLINE", 1.0),
    ]
    assert rows(L.read_target(spark, targets["pickup_data_unserved"]).select("source")) == [("FIRSTCLASS",)]
    tweets = L.read_target(spark, targets["tweet_analysis"])
    assert rows(tweets.select("created_at", "tweet", "tags", "polarity"), "created_at") == [
        ("1", "late taxi", 0, -0.5),
        ("2", "a taxi", 0, 0.0),
    ]
    merged = L.read_target(spark, targets["pickupdata_with_anothersource"])
    assert sorted(r.source for r in merged.collect()) == ["DIAL7", "FIRSTCLASS", "SKYLINE", "UBER"]
    job.export_dimension(spark, targets, str(tmp_path / "export"))
    exported = spark.read.option("header", True).csv(str(tmp_path / "export"))
    assert exported.columns == DIMENSION
    assert exported.where("drivername = 'B'").first().expireddate == "12/31/9999"


def test_malformed_feed_rows_are_set_aside_or_fail_the_stage(spark, mart):
    inputs, targets = mart
    with open(inputs.location_feed, "a") as file:
        file.write("one,two\n")
    assert {r.job_completed for r in job.run_job(spark, inputs, targets).collect()} == {"TRUE"}
    assert L.read_target(spark, targets["quarantine_location_feed"]).count() == 1
    loaded = L.read_target(spark, targets["pickup_data"]).count()
    with open(inputs.location_feed, "a") as file:
        file.write("a,b,c,d,e\n" * 3)
    outcomes = [r.job_completed for r in job.run_job(spark, inputs, targets).orderBy("job_start_time").collect()]
    assert outcomes[4:] == ["FALSE (Standardization)", "TRUE", "TRUE", "TRUE"]
    assert L.read_target(spark, targets["quarantine_location_feed"]).count() == 4
    assert L.read_target(spark, targets["pickup_data"]).count() == loaded


def test_failed_stage_does_not_load(spark, mart):
    inputs, targets = mart
    job.run_job(spark, inputs, targets)
    write_again = inputs.location_feed
    with open(write_again, "w") as file:
        file.write("Wrong,Header,Of,File\n1,2,3,4\n")
    audit = job.run_job(spark, inputs, targets)
    outcomes = [r.job_completed for r in audit.orderBy("job_start_time").collect()]
    assert outcomes[4:] == ["FALSE (Standardization)", "TRUE", "TRUE", "TRUE"]
    assert L.read_target(spark, targets["pickup_data"]).count() == 3

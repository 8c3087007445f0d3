"""Key registry, and the dimension applied batch by batch."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from dispatchmart import schemas
from dispatchmart.operators import dimension as D
from dispatchmart.operators.registry import register
from dispatchmart.plans import incremental as N
from dispatchmart.sources.commits import CommitConflict, Store

END = date(9999, 12, 31)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "mart"))


def numbers(store, df, **options):
    commit = store.begin()
    rows = register(commit, "keys", df, **options).collect()
    commit.publish()
    return {tuple(r)[: len(df.columns)]: r["number"] for r in rows}


def test_keys_keep_their_numbers(spark, store):
    def keys(*pairs):
        return spark.createDataFrame(list(pairs), "a string, b int")

    first = numbers(store, keys(("x", 1), ("x", 1), ("x", 2), (None, 1), (None, None)), buckets=4, after=10)
    assert sorted(first.values()) == [11, 12, 13, 14]
    second = numbers(store, keys(("y", 1), ("x", 2), (None, None), ("x", 1), (None, 2)), buckets=4)
    assert all(second[key] == first[key] for key in second if key in first)
    assert sorted(second[key] for key in second if key not in first) == [15, 16]
    assert numbers(store, keys(("y", 1), ("y", 1)), buckets=4)["y", 1] == second["y", 1]
    assert numbers(store, keys().limit(0), buckets=4) == {}
    everything = store.read("keys")
    assert everything.count() == 6 and everything.agg(F.count_distinct("number"), F.max("number")).first() == (6, 16)


def test_blocks_are_dense_and_a_feed_touches_few_buckets(spark, store):
    numbers(store, spark.range(1000).select("id"), buckets=8)
    blocks = store.read("keys").groupBy("block").agg(F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"))
    assert all(r.high - r.low + 1 == r.n and r.low == r.block for r in blocks.collect()) and blocks.count() == 8
    before = store.snapshot().tables["keys"].parts
    numbers(store, spark.range(1000, 1001).select("id"), buckets=8)
    after = store.snapshot().tables["keys"].parts
    assert sum(before[b] != after[b] for b in before) == 1
    numbers(store, spark.range(5).select("id"), buckets=8)
    assert store.snapshot().tables["keys"].parts == after  # nothing new, nothing written


def test_two_feeds_at_once_never_give_a_number_twice(spark, store):
    one, two = store.begin(), store.begin()
    register(one, "keys", spark.range(3))
    register(two, "keys", spark.range(3, 5))
    one.publish()
    with pytest.raises(CommitConflict):
        two.publish()


def lookups(spark):
    return D.Lookups(
        spark.createDataFrame([(1, "00:00", "07:59"), (2, "08:00", "15:59")], "shifttimekey int, starttime string, endtime string"),
        spark.createDataFrame([(1, "BRONX"), (2, "QUEENS")], "coveragekey int, coverage string"),
        spark.createDataFrame([(1, "UBER"), (2, "LYFT")], "companykey int, company string"),
    )


def day(n):
    return date(2020, 1, n)


def dimension(spark, drivers=20):
    rows = [(100 + i, i, f"D{i}", 1, 1, 1, day(1), END, day(1), day(1), END, 1) for i in range(drivers)]
    return spark.createDataFrame(rows, schemas.DRIVER_DIMENSION)


def feed(spark, *rows):
    full = [(name, action, "08:00", "15:59", where, "LYFT", on, on) for name, action, where, on in rows]
    return spark.createDataFrame(full, schemas.DRIVER_FEED)


BATCHES = [
    [("D1", "CHANGE", "QUEENS", day(3)), ("NEW", "HIRED", "BRONX", day(4)), ("D2", "FIRED", None, day(4)), ("D3", "CHANGE", "X", day(4))],
    [("NEW", "CHANGE", "QUEENS", day(6)), ("D1", "FIRED", None, day(6)), ("D4", "CHANGE", "QUEENS", None)],
    [("D1", "CHANGE", "BRONX", day(8)), ("D5", "CHANGE", "QUEENS", day(8)), ("D5", "FIRED", None, day(8)), ("NEW", "HIRED", "BRONX", day(9))],
    [("NEW", "FIRED", None, day(11)), ("NEW", "FIRED", None, day(11)), ("D2", "CHANGE", "QUEENS", day(2))],
]


def versions(df):
    return sorted(map(str, df.drop("driverrecordkey", "driverkey").collect()))


def test_batches_give_what_one_feed_gives(spark, store):
    in_time = sum(BATCHES, [])[:-1]  # the last row comes late and is rejected
    at_once = D.update_dimension(dimension(spark), feed(spark, *in_time), lookups(spark))
    N.create_dimension(store, dimension(spark), buckets=4)
    keys = {}
    for number, rows in enumerate(BATCHES):
        assert N.apply_batch(store, feed(spark, *rows), lookups(spark), number, buckets=4)
        state = store.snapshot().number
        assert not N.apply_batch(store, feed(spark, *rows), lookups(spark), number, buckets=4)
        assert store.snapshot().number == state
        now = {(r.driverkey, r.effectivedate): r.driverrecordkey for r in store.read(N.DIMENSION).collect()}
        assert {key: now[key] for key in keys} == keys  # no version loses its number
        keys = now
    result = store.read(N.DIMENSION)
    assert versions(result) == versions(at_once.dimension)
    assert sorted(keys.values()) == [*range(100, 120), *range(120, 120 + len(keys) - 20)]
    assert store.read(N.REJECTS).groupBy("batch").count().orderBy("batch").collect() == [(0, 1), (1, 1), (2, 1), (3, 1)]


def test_rehired_names_are_drivers_of_their_own(spark, store):
    """A hire of a name that has a current driver makes another one; later events of the name apply to both."""
    N.create_dimension(store, dimension(spark), buckets=4)
    N.apply_batch(store, feed(spark, ("D7", "HIRED", "BRONX", day(5))), lookups(spark), 0, buckets=4)
    N.apply_batch(store, feed(spark, ("D7", "FIRED", None, day(9))), lookups(spark), 1, buckets=4)
    rows = store.read(N.DIMENSION).where("drivername = 'D7'").orderBy("driverkey", "effectivedate").collect()
    assert [(r.driverkey, r.effectivedate, r.firedate, r.current_record) for r in rows] == [
        (7, day(1), END, 0), (7, day(9), day(9), 1), (20, day(5), END, 0), (20, day(9), day(9), 1),
    ]


def test_untouched_buckets_keep_their_files(spark, store):
    N.create_dimension(store, dimension(spark, 60), buckets=8)
    before = store.snapshot().tables[N.DIMENSION].parts
    N.apply_batch(store, feed(spark, ("D1", "CHANGE", "QUEENS", day(3))), lookups(spark), 0, buckets=8)
    after = store.snapshot().tables[N.DIMENSION].parts
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert store.read(N.DIMENSION).count() == 61


def test_a_batch_that_breaks_changes_nothing(spark, store, monkeypatch):
    N.create_dimension(store, dimension(spark), buckets=4)
    state = store.snapshot()
    with monkeypatch.context() as broken:
        broken.setattr(D, "rejected_rows", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            N.apply_batch(store, feed(spark, *BATCHES[0]), lookups(spark), 0, buckets=4)
    assert store.snapshot() == state
    assert N.apply_batch(store, feed(spark, *BATCHES[0]), lookups(spark), 0, buckets=4)
    assert store.read(N.DIMENSION).count() == 23


def test_a_streamed_feed_is_applied_once(spark, store, tmp_path):
    N.create_dimension(store, dimension(spark), buckets=4)
    source, state = str(tmp_path / "feed"), str(tmp_path / "state")

    def run():
        events = spark.readStream.schema(schemas.DRIVER_FEED).option("maxFilesPerTrigger", 1).parquet(source)
        N.follow_feed(events, store, lookups(spark), state, buckets=4).awaitTermination()
        return store.read(N.DIMENSION)

    feed(spark, *BATCHES[0]).coalesce(1).write.parquet(source)
    assert run().count() == 23
    feed(spark, *BATCHES[1]).coalesce(1).write.mode("append").parquet(source)
    assert versions(run()) == versions(D.update_dimension(dimension(spark), feed(spark, *BATCHES[0], *BATCHES[1]), lookups(spark)).dimension)
    number = store.snapshot().number
    run()
    assert store.snapshot().number == number


def test_closed_versions_are_written_once(spark, store):
    """A batch leaves what earlier ones closed in the folders they wrote, and does not read it again."""
    N.create_dimension(store, dimension(spark, 4), buckets=1)
    for number, on in enumerate((3, 5, 7)):
        rows = [(f"D{i}", "CHANGE", "QUEENS", day(on)) for i in range(4)]
        N.apply_batch(store, feed(spark, *rows), lookups(spark), number, buckets=1)
    version = store.snapshot().tables[N.DIMENSION]
    counts = sorted((store.read_version(version, [part]).count(), part == "0") for part in version.parts)
    assert counts == [(4, False), (4, False), (4, False), (4, True)]
    assert store.read(N.DIMENSION).count() == 16 and store.read(N.DIMENSION, ["0"]).where("current_record = 1").count() == 4

"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchmart import schemas
from dispatchmart.catalog import inputs as I
from dispatchmart.functions import address as A
from dispatchmart.functions import clock as C
from dispatchmart.functions import columns as K
from dispatchmart.functions import fixed_values as V
from dispatchmart.functions.messages import clean_text, message_words, off_one_line, on_one_line
from dispatchmart.operators import dimension as D
from dispatchmart.operators import facts as X
from dispatchmart.operators import sets as S
from dispatchmart.operators import terms as W
from dispatchmart.operators.address_ranges import locate_by_range, nearest_names
from dispatchmart.operators.geocode import add_coordinates, geocode_feeds
from dispatchmart.operators.ordered import number_rows
from dispatchmart.operators.registry import register
from dispatchmart.operators.sentiment import add_sentiment
from dispatchmart.plans import incremental as N
from dispatchmart.plans import job as J
from dispatchmart.plans import standardize as P
from dispatchmart.plans.messages import score_messages
from dispatchmart.session import scratch_path
from dispatchmart.sources import loads as L
from dispatchmart.sources.audit import run_stage
from dispatchmart.sources.commits import Store
from dispatchmart.sources.audit import stage_durations as stage_times
from dispatchmart.sources.readers import flexible_records, read_csv, read_messages, stream_records
from dispatchmart.streaming.capture import captured_messages, run_bounded_capture, start_capture
from dispatchmart.streaming.leading import follow_terms, leading_terms
from dispatchmart.streaming.scoring import fit_leading_terms, run_scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# Text rules


def _cut(df: DataFrame) -> DataFrame:
    return df.withColumn("pieces", A.words(F.col("address")))


@query
def street_suffix_abbrev(spark, sf_dir):
    streets = I.derive(spark, sf_dir, I.STREETS)
    return streets.select("o_orderkey", A.shorten_street_type(F.col("address")).alias("street_address"))


@query
def trim_upper_all(spark, sf_dir):
    return K.trim_values(K.upper_values(K.lower_names(I.derive(spark, sf_dir, I.PADDED_PARTS))))


@query
def merge_date_time(spark, sf_dir):
    orders = I.derive(spark, sf_dir, I.DATED_ORDERS)
    return K.merge_date_time(orders.withColumn("date", K.dashed_date(F.col("date"))))


@query
def cross_street_removal(spark, sf_dir):
    streets = _cut(I.derive(spark, sf_dir, I.CROSS_STREETS))
    return streets.select("o_orderkey", A.remove_cross_street(F.col("pieces")).alias("street_address"))


@query
def cross_streets_in_texts(spark, sf_dir):
    texts = _cut(I.derive(spark, sf_dir, I.MANY_CROSS_STREETS))
    return texts.select("doc_id", F.md5(A.remove_cross_street(F.col("pieces"))).alias("street_address"))


@query
def ordinal_runs_in_texts(spark, sf_dir):
    texts = I.derive(spark, sf_dir, I.MANY_DIGIT_RUNS)
    return texts.select(
        "doc_id",
        F.md5(A.ordinal_digit_runs(F.col("street"))).alias("street"),
        F.md5(A.ordinal_digit_runs(F.col("street"), compat=True)).alias("street_compat"),
    )


@query
def ordinal_words(spark, sf_dir):
    streets = I.derive(spark, sf_dir, I.NUMBER_WORDS)
    return streets.select(
        "c_custkey",
        A.ordinal_words(F.col("address")).alias("street_address"),
        A.ordinal_words(F.col("address"), compat=True).alias("street_address_compat"),
    )


@query
def cut_after_suffix(spark, sf_dir):
    addresses = _cut(I.derive(spark, sf_dir, I.FREE_ADDRESSES))
    return addresses.select(
        "o_orderkey",
        A.cut_after_street_type(F.col("pieces")).alias("street_address"),
        A.cut_after_street_type(F.col("pieces"), compat=True).alias("street_address_compat"),
    )


@query
def first_digit_cut(spark, sf_dir):
    labels = I.derive(spark, sf_dir, I.PART_LABELS)
    return labels.select("p_partkey", A.from_first_digit(F.col("address")).alias("street_address"))


@query
def ordinal_after_direction(spark, sf_dir):
    addresses = _cut(I.derive(spark, sf_dir, I.COMPASS_ADDRESSES))
    return addresses.select(
        "o_orderkey",
        A.ordinal_after_compass(F.col("pieces")).alias("street_address"),
        A.ordinal_after_compass(F.col("pieces"), compat=True).alias("street_address_compat"),
    )


@query
def ordinal_digit_runs(spark, sf_dir):
    streets = I.derive(spark, sf_dir, I.DIGIT_STREETS)
    return streets.select(
        "o_orderkey",
        A.ordinal_digit_runs(F.col("street")).alias("street"),
        A.ordinal_digit_runs(F.col("street"), compat=True).alias("street_compat"),
    )


@query
def suburb_to_street(spark, sf_dir):
    places = I.derive(spark, sf_dir, I.LOCATIONS)
    return places.select(
        "o_orderkey",
        A.add_suburb(F.col("address"), F.col("location")).alias("street_address"),
        A.location_code(F.col("location")).alias("code"),
    )


@query
def state_city_codes(spark, sf_dir):
    places = I.derive(spark, sf_dir, I.LOCATIONS)
    coded = places.select(
        "o_orderkey", A.location_code(F.col("location")).alias("code"), A.state_code(F.col("state")).alias("state_code"), "state"
    )
    placed = coded.withColumn("location_state", A.location_state(F.col("code"), F.lit("")))
    return placed.select(
        "o_orderkey",
        "location_state",
        A.blank_city_outside(A.location_city(F.col("code")), F.col("location_state")).alias("city"),
        A.blank_city_outside(A.location_city(F.col("code"), compat=True), F.col("location_state")).alias("city_compat"),
        A.state_name(F.col("state_code"), F.col("state")).alias("state"),
    )


@query
def airport_lookup(spark, sf_dir):
    places = I.derive(spark, sf_dir, I.LOCATIONS)
    code = A.state_code(F.col("state"))
    return places.select(
        "o_orderkey",
        A.airport_by_location(F.col("address"), F.col("location")).alias("by_location"),
        A.airport_by_word(F.get(A.words(F.col("words")), F.lit(0)), F.col("words")).alias("by_word"),
        A.full_street(A.airport_field(code, 1, F.lit("9")), A.airport_field(code, 0, F.col("address"))).alias("by_code"),
        A.airport_field(code, 2, F.col("state")).alias("state"),
        A.airport_field(code, 3, F.lit("NONE")).alias("city"),
    )


@query
def city_fragment(spark, sf_dir):
    addresses = I.derive(spark, sf_dir, I.FRAGMENTS)
    tail = A.address_tail(F.col("address"))
    return addresses.select(
        "o_orderkey",
        A.drop_new(A.before_comma(F.col("address"))).alias("street_address"),
        A.fragment_city(tail).alias("city"),
        A.fragment_city(tail, compat=True).alias("city_compat"),
    )


# Time and keys


@query
def time_to_shift(spark, sf_dir):
    times = I.derive(spark, sf_dir, I.EVENT_TIMES)
    minute = times.select(
        "event_id",
        C.minute_of_day(F.col("clock")).alias("minute"),
        C.minute_of_day(F.col("clock"), compat=True).alias("minute_compat"),
    )
    return minute.select(
        "*",
        C.shift_key(F.col("minute")).alias("shifttimekey"),
        C.shift_key(F.col("minute_compat"), compat=True).alias("shifttimekey_compat"),
    )


@query
def day_before(spark, sf_dir):
    days = I.derive(spark, sf_dir, f"SELECT o_orderkey, {I.us_date('o_orderdate')} AS effdt FROM {{orders}}")
    return days.select("o_orderkey", C.day_before_text(F.col("effdt")).alias("expireddate"))


@query
def map_keys_default(spark, sf_dir):
    named = I.derive(spark, sf_dir, I.CITIES_AND_SOURCES)
    return named.select(
        "c_custkey",
        K.recode(F.col("city"), V.COVERAGE_KEYS, F.lit(V.UNKNOWN_KEY)).alias("coveragekey"),
        K.recode(F.col("source"), V.COMPANY_KEYS).alias("companykey"),
    )


@query
def surrogate_keys(spark, sf_dir):
    lines = I.table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return number_rows(lines, "record_key", ["l_shipdate", "l_orderkey", "l_linenumber"], after=100)


@query
def stable_keys(spark, sf_dir):
    """Customers of two feeds in a key registry, the first again among the second; what became of the numbers."""
    orders = I.table(spark, sf_dir, "orders")
    store = Store(spark, scratch_path(spark, "mart"))

    def apply(feed):
        commit = store.begin()
        numbers = register(commit, "customers", feed.select("o_custkey", "o_orderpriority"), after=1000)
        commit.publish()
        return numbers.select("o_custkey", "o_orderpriority", F.col("number").alias("given"), "block")

    first = apply(orders.where(F.col("o_orderstatus") == "F"))
    second = apply(orders)
    again = apply(orders)
    seen = second.join(first.withColumnRenamed("given", "before").drop("block"), ["o_custkey", "o_orderpriority"], "left")
    seen = seen.join(again.withColumnRenamed("given", "after").drop("block"), ["o_custkey", "o_orderpriority"])
    old = F.col("before").isNotNull()
    blocks = seen.groupBy("block").agg((F.max("given") - F.min("given") + 1 != F.count("*")).alias("gap"))
    gaps = blocks.agg(F.count_if("gap")).scalar()
    return seen.groupBy(old.alias("in_first_feed")).agg(
        F.count("*").alias("n_keys"),
        F.count_distinct("given").alias("n_numbers"),
        F.min("given").alias("lowest"),
        F.max("given").alias("highest"),
        F.count_if(old & (F.col("before") != F.col("given"))).alias("changed"),
        F.count_if(F.col("after") != F.col("given")).alias("changed_again"),
        F.any_value(gaps).alias("blocks_with_gaps"),
    )


# Places, sets, head and rest


@query
def geocode_gazetteer(spark, sf_dir):
    return add_coordinates(I.derive(spark, sf_dir, I.PLACED_CUSTOMERS), I.derive(spark, sf_dir, I.GAZETTEER))


@query
def geocode_budget(spark, sf_dir):
    customers = I.derive(spark, sf_dir, I.PLACED_CUSTOMERS)
    return geocode_feeds([customers], I.derive(spark, sf_dir, I.GAZETTEER), V.GEOCODE_BUDGET)


@query
def geocode_ranges(spark, sf_dir):
    """Any house number of a street: within a range, else the middle of the street, else that of the city."""
    located = locate_by_range(I.derive(spark, sf_dir, I.NUMBERED_PICKUPS), I.derive(spark, sf_dir, I.HOUSE_RANGES))
    return located.withColumns({c: F.round(c, 9) for c in ("latitude", "longitude")})


def _words_as_streets(df):
    """Every word of the texts as the name of a street."""
    words = df.select(F.explode(F.split("text", "[^A-Za-z]+")).alias("street")).where(F.col("street") != "")
    return words.select(F.upper("street").alias("street")).distinct().select("street", F.lit("NEW YORK CITY").alias("city"), F.lit("NEW YORK").alias("state"))


@query
def misspelt_streets(spark, sf_dir):
    """The words of the conversations looked up among those of the benchmark, up to two edits apart."""
    wanted, listed = (_words_as_streets(I.table(spark, sf_dir, name)) for name in ("conversations", "benchmark"))
    return nearest_names(wanted, listed).select("street", "nearest", "distance")


@query
def split_head_rest(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_custkey")
    return S.mark_head(orders, 100, ["o_orderdate"])


@query
def first_rows(spark, sf_dir):
    lines = I.table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return S.first_rows(lines, 100, ["l_shipdate", "l_orderkey"])


@query
def except_distinct(spark, sf_dir):
    lines = I.table(spark, sf_dir, "lineitem")
    pairs = lines.select("l_partkey", F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey")).alias("l_suppkey"), "l_returnflag")
    returned = pairs.where(F.col("l_returnflag") == "R").drop("l_returnflag")
    return S.except_distinct(pairs.drop("l_returnflag"), returned)


@query
def union_feeds(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders")

    def feed(status, *columns):
        return orders.where(F.col("o_orderstatus") == status).select(*columns, F.lit(f"FEED {status}").alias("source"))

    return S.union_feeds(
        feed("O", "o_orderkey", "o_custkey"), feed("F", "o_custkey", "o_orderkey"), feed("P", "o_orderkey", "o_custkey")
    )


@query
def not_in_insert(spark, sf_dir):
    rows = I.derive(spark, sf_dir, I.SOURCED_ORDERS)
    lines = I.table(spark, sf_dir, "lineitem")
    target = lines.select(F.col("l_orderkey").cast("string").alias("source"))
    with_null = lines.select(F.when(F.col("l_linenumber") != 1, F.col("l_orderkey")).cast("string").alias("source"))
    cases = {"filled": target, "with null": with_null, "empty": target.where(F.lit(False))}
    return S.union_feeds(
        *[S.insert_missing_sources(tbl, rows).withColumn("target", F.lit(name)) for name, tbl in cases.items()]
    )


# Feeds


@query
def location_feed(spark, sf_dir):
    return P.location_feed(I.derive(spark, sf_dir, I.LOCATION_FEED).drop("o_orderkey"))


@query
def free_text_feed(spark, sf_dir):
    return P.free_text_feed(I.derive(spark, sf_dir, I.FREE_TEXT_FEED).drop("o_orderkey"))


@query
def split_field_feed(spark, sf_dir):
    return P.split_field_feed(I.derive(spark, sf_dir, I.SPLIT_FIELD_FEED).drop("o_orderkey"))


@query
def location_feed_compat(spark, sf_dir):
    return P.location_feed(I.derive(spark, sf_dir, I.LOCATION_FEED).drop("o_orderkey"), compat=True)


@query
def free_text_feed_compat(spark, sf_dir):
    return P.free_text_feed(I.derive(spark, sf_dir, I.FREE_TEXT_FEED).drop("o_orderkey"), compat=True)


@query
def split_field_feed_compat(spark, sf_dir):
    return P.split_field_feed(I.derive(spark, sf_dir, I.SPLIT_FIELD_FEED).drop("o_orderkey"), compat=True)


@query
def standard_pickups(spark, sf_dir):
    """The three feeds as CSV files, read back, standardized, located and united."""
    paths = {}
    for name in ("LOCATION_FEED", "FREE_TEXT_FEED", "SPLIT_FIELD_FEED"):
        paths[name] = scratch_path(spark, name.lower())
        L.write_csv(I.derive(spark, sf_dir, getattr(I, name)).drop("o_orderkey"), paths[name])
    files = [read_csv(spark, path, getattr(schemas, name)) for name, path in paths.items()]
    return P.standard_pickups(*files, I.derive(spark, sf_dir, I.PICKUP_PLACES), budget=None)


# Dimension and facts


def _lookups(spark, sf_dir):
    return D.Lookups(*[I.derive(spark, sf_dir, sql) for sql in (I.SHIFT_DIM, I.COVERAGE_DIM, I.COMPANY_DIM)])


def _dim(spark, sf_dir):
    return I.derive(spark, sf_dir, I.DRIVER_DIM)


def _resolved(spark, sf_dir):
    return D.resolve_feed(I.derive(spark, sf_dir, I.DRIVER_FEED), _lookups(spark, sf_dir))


@query
def scd2_unchanged(spark, sf_dir):
    dim = _dim(spark, sf_dir)
    return D.unchanged(dim, D.day_events(dim, _resolved(spark, sf_dir)))


@query
def scd2_fired(spark, sf_dir):
    fired = _resolved(spark, sf_dir).where(F.col("action") == "FIRED")
    dim = _dim(spark, sf_dir)
    return D.applied_versions(dim, D.day_events(dim, fired))


@query
def scd2_changed(spark, sf_dir):
    changed = _resolved(spark, sf_dir).where(F.col("action") == "CHANGE")
    dim = _dim(spark, sf_dir)
    return D.applied_versions(dim, D.day_events(dim, changed))


@query
def scd2_hired(spark, sf_dir):
    return D.hired_versions(_dim(spark, sf_dir), _resolved(spark, sf_dir))


@query
def scd2_dimension(spark, sf_dir):
    feed = I.derive(spark, sf_dir, I.DRIVER_FEED)
    return D.update_dimension(_dim(spark, sf_dir), feed, _lookups(spark, sf_dir)).dimension


@query
def scd2_rejects(spark, sf_dir):
    resolved = _resolved(spark, sf_dir)
    return D.rejected_rows(D.with_hired(_dim(spark, sf_dir), resolved), resolved)


@query
def scd2_interval_faults(spark, sf_dir):
    """Per driver of the updated dimension: backward intervals, overlaps and current versions."""
    versions = scd2_dimension(spark, sf_dir)
    following = Window.partitionBy("driverkey").orderBy("effectivedate", "expireddate")  # a driver's versions
    checked = versions.withColumn("_next", F.lead("effectivedate").over(following))
    return checked.groupBy("driverkey").agg(
        F.count_if(F.col("expireddate") < F.col("effectivedate")).alias("backward"),
        F.count_if(F.col("_next") <= F.col("expireddate")).alias("overlaps"),
        F.sum("current_record").alias("current_versions"),
    )


@query
def scd2_incremental(spark, sf_dir):
    """The dimension after three batches, the second sent twice; keys that batches number otherwise are left out."""
    store, lookups = Store(spark, scratch_path(spark, "mart")), _lookups(spark, sf_dir)
    feed = I.derive(spark, sf_dir, I.DRIVER_FEED)
    N.create_dimension(store, _dim(spark, sf_dir), buckets=8)
    number = F.when(F.col("effdt") >= "1997-01-01", 2).when(F.col("effdt") >= "1994-06-01", 1).otherwise(0)
    for batch in (0, 1, 1, 2):
        N.apply_batch(store, feed.where(number == batch), lookups, batch, buckets=8)
    return store.read(N.DIMENSION).drop("driverrecordkey", "driverkey")


@query
def scd2_fired_compat(spark, sf_dir):
    return D.compat_fired(_dim(spark, sf_dir), _resolved(spark, sf_dir))


@query
def scd2_changed_compat(spark, sf_dir):
    return D.compat_changed(_dim(spark, sf_dir), _resolved(spark, sf_dir))


@query
def scd2_unchanged_compat(spark, sf_dir):
    return D.compat_unchanged(_dim(spark, sf_dir), I.derive(spark, sf_dir, I.DRIVER_FEED))


@query
def scd2_dimension_compat(spark, sf_dir):
    feed = I.derive(spark, sf_dir, I.DRIVER_FEED)
    return D.compat_update_dimension(_dim(spark, sf_dir), feed, _lookups(spark, sf_dir))


@query
def dimension_as_text(spark, sf_dir):
    return D.dimension_as_text(_dim(spark, sf_dir))


def _keyed_pickups(spark, sf_dir, compat=False):
    lookups = _lookups(spark, sf_dir)
    return X.add_pickup_keys(I.derive(spark, sf_dir, I.PICKUPS), lookups.coverages, lookups.companies, compat)


@query
def fact_with_keys(spark, sf_dir):
    return X.facts_with_keys(_keyed_pickups(spark, sf_dir), _dim(spark, sf_dir))


@query
def fact_with_keys_compat(spark, sf_dir):
    return X.facts_with_keys(_keyed_pickups(spark, sf_dir, compat=True), _dim(spark, sf_dir))


@query
def fact_without_driver(spark, sf_dir):
    return X.pickups_without_driver(_keyed_pickups(spark, sf_dir), _dim(spark, sf_dir))


@query
def keyed_facts(spark, sf_dir):
    """Each pickup once, with the keys that lead to its drivers."""
    return _keyed_pickups(spark, sf_dir)


@query
def driver_bridge(spark, sf_dir):
    return X.driver_bridge(_dim(spark, sf_dir))


@query
def fact_fan_out(spark, sf_dir):
    return X.drivers_per_pickup_key(_keyed_pickups(spark, sf_dir), _dim(spark, sf_dir))


# Messages


def _documents(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("tweet"))


def _lexicon(spark, sf_dir):
    """Every word of the benchmark texts, with scores made from its length."""
    words = I.table(spark, sf_dir, "benchmark").select(F.explode(message_words(clean_text(F.col("text")))).alias("term"))
    length = F.length("term")
    return words.distinct().select(
        "term",
        ((length * 7 % 5 - 2).cast("double") / 2).alias("polarity"),
        ((length % 5).cast("double") / 4).alias("subjectivity"),
    )


@query
def term_counts(spark, sf_dir):
    return W.term_counts(_documents(spark, sf_dir))


@query
def document_term_counts(spark, sf_dir):
    return W.document_term_counts(_documents(spark, sf_dir), "doc_id")


@query
def top_terms(spark, sf_dir):
    return W.top_terms(_documents(spark, sf_dir))


@query
def top_term_tag(spark, sf_dir):
    return W.add_tag(_documents(spark, sf_dir)).select("doc_id", "tags")


@query
def count_vectors(spark, sf_dir):
    """The vectors' entries: document, place of the term in the vocabulary, count."""
    vectors = W.count_vectors(_documents(spark, sf_dir), "doc_id")
    entries = vectors.select("doc_id", F.explode(F.arrays_zip("indices", "values")).alias("e"))
    return entries.select("doc_id", F.col("e.indices").alias("term_index"), F.col("e.values").alias("n"))


@query
def lexicon_sentiment(spark, sf_dir):
    scored = add_sentiment(_documents(spark, sf_dir), _lexicon(spark, sf_dir), key="doc_id")
    return scored.select("doc_id", F.round("polarity", 9).alias("polarity"), F.round("subjectivity", 9).alias("subjectivity"))


@query
def message_facts(spark, sf_dir):
    scored = score_messages(_documents(spark, sf_dir), _lexicon(spark, sf_dir), key="doc_id")
    rounded = {c: F.round(c, 9) for c in ("polarity", "subjectivity")}
    return scored.withColumns(rounded)


# Streams


def _record_files(spark, sf_dir):
    records = I.derive(spark, sf_dir, I.RECORDS).select(
        "created_at",
        "text",
        "lang",
        F.when(F.col("full_text").isNotNull(), F.struct("full_text")).alias("extended_tweet"),
        F.when(F.col("retweeted").isNotNull(), F.struct(F.col("retweeted").alias("text"))).alias("retweeted_status"),
    )
    path = scratch_path(spark, "records")
    records.write.json(path)
    return path


@query
def stream_capture(spark, sf_dir):
    records = stream_records(spark, _record_files(spark, sf_dir))
    out, checkpoint = scratch_path(spark, "captured"), scratch_path(spark, "capture-state")
    messages = captured_messages(records, I.CAPTURE_WORDS, keep=("is_retweet",))
    start_capture(messages, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query
def bounded_capture(spark, sf_dir):
    records = stream_records(spark, _record_files(spark, sf_dir))
    out, checkpoint = scratch_path(spark, "bounded"), scratch_path(spark, "bounded-state")
    return run_bounded_capture(captured_messages(records, I.CAPTURE_WORDS), out, checkpoint, V.CAPTURE_LIMIT)


@query
def flexible_capture(spark, sf_dir):
    """JSON lines of many shapes as a stream: what can be used, and what cannot with the reason."""
    path = scratch_path(spark, "lines")
    I.derive(spark, sf_dir, I.FLEXIBLE_LINES).select("value").write.text(path)
    out = scratch_path(spark, "flexible")
    records = flexible_records(spark.readStream.text(path))
    query = records.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "flexible-state"))
    query.trigger(availableNow=True).start(out).awaitTermination()
    usable = F.when(F.col("problem").isNull(), F.coalesce("full_text", "text"))
    kept = F.when(F.col("problem").isNotNull(), F.md5("record"))
    return spark.read.parquet(out).select("created_at", usable.alias("tweet"), "lang", "is_retweet", "problem", kept.alias("kept"))


@query
def stream_leading_terms(spark, sf_dir):
    """The leading terms of a stream of four files, merged into a summary of few terms, in two runs."""
    source, state = scratch_path(spark, "messages"), scratch_path(spark, "terms-state")
    store = Store(spark, scratch_path(spark, "mart"))
    documents = _documents(spark, sf_dir)
    for halves in ((0, 1), (2, 3)):
        part = documents.where((F.col("doc_id") % 4).isin(*halves))
        part.repartitionByRange(2, "doc_id").write.mode("append").parquet(source)
        stream = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 1).parquet(source)
        follow_terms(stream, store, state, counters=2_000)
    return leading_terms(store)


@query
def stream_scored(spark, sf_dir):
    """Conversation turns as a stream, tagged with terms fitted on the documents."""
    stored = I.table(spark, sf_dir, "conversations")
    # A pattern, as a stream takes a single file by a pattern only; a folder of files fits it, too.
    turns = spark.readStream.schema(stored.schema).parquet(f"{sf_dir}/conversations.parque[t]")
    messages = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("created_at"), F.col("text").alias("tweet")
    )
    out, checkpoint = scratch_path(spark, "scored"), scratch_path(spark, "scored-state")
    leading = fit_leading_terms(_documents(spark, sf_dir))
    scored = run_scoring(messages, leading, _lexicon(spark, sf_dir), out, checkpoint, key="created_at")
    return scored.withColumns({c: F.round(c, 9) for c in ("polarity", "subjectivity")})


# Loads


_CUSTOMER = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)


def _mart_table(spark, name):
    """A table in a folder of its own, below which nothing else is kept."""
    return f"{scratch_path(spark, 'mart')}/{name}"


@query
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "customer-csv")
    L.write_csv(I.table(spark, sf_dir, "customer"), path)
    return read_csv(spark, path, _CUSTOMER)


@query
def message_file_roundtrip(spark, sf_dir):
    """Whole conversation turns as a ``~`` file without a header, and back."""
    turns = I.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("created_at"), on_one_line(F.col("text")).alias("tweet")
    )
    path = scratch_path(spark, "messages-csv")
    L.write_csv(turns, path, sep="~", header=False)
    return read_messages(spark, path).withColumn("tweet", off_one_line(F.col("tweet")))


@query
def full_refresh(spark, sf_dir):
    target = _mart_table(spark, "refreshed")
    L.full_refresh(I.table(spark, sf_dir, "customer").select("c_custkey"), target)
    L.full_refresh(I.table(spark, sf_dir, "orders"), target, partition_by=("o_orderstatus",))
    return L.read_target(spark, target)


@query
def append_load(spark, sf_dir):
    target = _mart_table(spark, "appended")
    for status in ("O", "F", "P", "O"):
        L.append_load(I.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status), target)
    return L.read_target(spark, target)


@query
def atomic_loads(spark, sf_dir):
    """What readers see of two tables: first load, a job broken between its two loads, its restart, one rolled back."""
    orders, lines = (I.table(spark, sf_dir, name) for name in ("orders", "lineitem"))
    store, seen = Store(spark, scratch_path(spark, "mart")), []
    first = store.begin()
    first.replace("orders", orders.where(F.col("o_orderstatus") == "O"), ("o_orderpriority",))
    first.replace("lines", lines.where(F.col("l_linenumber") == 1))
    first.publish()
    seen.append(("first", store.snapshot()))
    store.begin("nightly").replace("orders", orders)
    seen.append(("broken", store.snapshot()))
    again = store.begin("nightly")
    again.replace("orders", orders)
    again.append("lines", lines.where(F.col("l_linenumber") > 1))
    again.publish()
    seen.append(("restarted", store.snapshot()))
    dropped = store.begin("dropped")
    dropped.replace("orders", orders.where(F.col("o_orderstatus") == "F"))
    dropped.roll_back()
    seen.append(("rolled back", store.snapshot()))

    def summary(step, snapshot, table, key):
        rows = store.read(table, snapshot=snapshot)
        return rows.agg(F.count("*").alias("n"), F.sum(key).alias("keys")).select(F.lit(step).alias("step"), F.lit(table).alias("target"), "n", "keys")

    keys = {"orders": "o_orderkey", "lines": "l_partkey"}
    return S.union_feeds(*[summary(step, state, table, key) for step, state in seen for table, key in keys.items()])


@query
def load_error_budget(spark, sf_dir):
    """The customers as CSV, with one account balance that is no number."""
    customers = I.table(spark, sf_dir, "customer")
    broken = F.when(F.col("c_custkey") == 7, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    path = scratch_path(spark, "broken-csv")
    L.write_csv(customers.withColumn("c_acctbal", broken), path)
    mart = scratch_path(spark, "mart")
    return L.load_with_error_budget(spark, path, _CUSTOMER, f"{mart}/loaded", f"{mart}/quarantine").loaded


@query
def second_source(spark, sf_dir):
    """Pickups of a second source, then those of the first whose source is missing."""
    orders = I.table(spark, sf_dir, "orders")
    second = orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", F.col("o_orderpriority").alias("source"))
    first = orders.where(F.col("o_orderstatus") != "F").select(
        "o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.lit("1-URGENT")).otherwise(F.lit("SKYLINE")).alias("source")
    )
    return L.merge_second_source(second, first, _mart_table(spark, "second_source"))


@query
def audit_rows(spark, sf_dir):
    """Two stages, of which the second fails before it loads; what was loaded is counted."""
    audit, target = _mart_table(spark, "audit"), _mart_table(spark, "audited")
    orders = I.table(spark, sf_dir, "orders")

    def fails():
        missing = I.table(spark, sf_dir, "no_such_feed")
        L.full_refresh(missing, target)

    run_stage(spark, audit, 1, "Standardization", lambda: L.full_refresh(orders, target))
    run_stage(spark, audit, 2, "Tweet", fails)
    loaded = L.read_target(spark, target).agg(F.count("*").alias("n")).scalar()
    return L.read_target(spark, audit).select("job_id", "job_completed", loaded.alias("loaded_rows"))


@query
def stage_durations(spark, sf_dir):
    """A stage that loads and one that fails: outcome, and that neither ended before it began."""
    audit, target = _mart_table(spark, "audit"), _mart_table(spark, "timed")
    orders = I.table(spark, sf_dir, "orders")

    def fails():
        L.full_refresh(I.table(spark, sf_dir, "no_such_feed"), target)

    run_stage(spark, audit, 1, "Standardization", lambda: L.full_refresh(orders, target))
    run_stage(spark, audit, 2, "Tweet", fails)
    timed = stage_times(L.read_target(spark, audit))
    in_time = (F.col("seconds") >= 0) & (F.col("job_start_time") <= F.col("job_end_time"))
    loaded = L.read_target(spark, target).agg(F.count("*")).scalar()
    return timed.select("job_id", "job_completed", in_time.alias("in_time"), loaded.alias("loaded_rows"))


@query
def whole_job(spark, sf_dir):
    """All stages over derived feeds: rows of each target, and of each stage its outcome and the rows it loaded."""
    folder = scratch_path(spark, "arrived")
    feeds = {"location": I.LOCATION_FEED, "free_text": I.FREE_TEXT_FEED, "split_field": I.SPLIT_FIELD_FEED, "second": I.SECOND_SOURCE}
    for name, sql in feeds.items():
        feed = I.derive(spark, sf_dir, sql)
        L.write_csv(feed.drop("o_orderkey"), f"{folder}/{name}")
    messages = I.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), on_one_line(F.col("text")))
    L.write_csv(messages, f"{folder}/messages", sep="~", header=False)
    targets = J.Targets(scratch_path(spark, "mart"))
    warehouse = Store(spark, targets.root).begin()
    tables = {"shifttime_dim": I.SHIFT_DIM, "coverage_dim": I.COVERAGE_DIM, "company_dim": I.COMPANY_DIM, "gazetteer": I.PICKUP_PLACES,
              "driver_dim": I.DRIVER_DIM, "driver_feed": I.DRIVER_FEED}
    for name, sql in tables.items():
        warehouse.replace(name, I.derive(spark, sf_dir, sql))
    warehouse.replace("lexicon", _lexicon(spark, sf_dir))
    warehouse.publish()
    inputs = J.Inputs(*[f"{folder}/{name}" for name in ("location", "free_text", "split_field", "messages", "second")])
    audit = stage_times(J.run_job(spark, inputs, targets), counts=True)
    names = ("pickup_data", "quarantine_location_feed", "tweet_analysis", "driver_dim_updated", "driver_feed_rejects",
             "pickup_data_keyed", "driver_bridge", "pickupdata_with_anothersource")
    counted = [
        L.read_target(spark, targets[name]).agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n", F.lit("TRUE").alias("outcome"))
        for name in names
    ]
    stages = audit.where("seconds >= 0").select(F.concat(F.lit("stage "), "job_id").alias("what"), F.col("rows_loaded").alias("n"), F.col("job_completed").alias("outcome"))
    return S.union_feeds(*counted, stages)

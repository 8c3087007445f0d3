"""The three pickup feeds, each brought to one layout by its own list of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchmart.functions import address as A
from dispatchmart.functions import fixed_values as V
from dispatchmart.functions.columns import dashed_date, lower_names, merge_date_time, trim_values, upper_values
from dispatchmart.operators.geocode import geocode_feeds

STANDARD = ["datetime", "street_address", "city", "state", "source"]


def _upper(raw: DataFrame) -> DataFrame:
    return upper_values(lower_names(raw))


def _dated(df: DataFrame) -> DataFrame:
    """Dashed dates, one date-time column, no outer spaces."""
    return trim_values(merge_date_time(df.withColumn("date", dashed_date(F.col("date")))))


def _finished(df: DataFrame) -> DataFrame:
    return trim_values(df.select(STANDARD))


def location_feed(raw: DataFrame, compat: bool = False, source: str = V.LOCATION_SUFFIX_SOURCE) -> DataFrame:
    """Feed whose location text ends in a city or state code."""
    street, location, code, state = (F.col(c) for c in ("street_address", "city_state", "code", "state"))
    address = F.trim(A.add_suburb(A.shorten_street_type(street), location))
    coded = _dated(_upper(raw)).select(
        "datetime",
        A.words(F.trim(A.airport_by_location(address, location))).alias("pieces"),
        A.location_code(location).alias("code"),
    )
    placed = coded.withColumn("state", A.location_state(code, F.lit("")))
    cleaned = placed.select(
        "datetime",
        A.ordinal_words(A.remove_cross_street(F.col("pieces")), compat).alias("street_address"),
        A.blank_city_outside(F.trim(A.location_city(code, compat)), state).alias("city"),
        "state",
        F.lit(source).alias("source"),
    )
    return _finished(cleaned)


def free_text_feed(raw: DataFrame, compat: bool = False, source: str = V.FREE_TEXT_SOURCE) -> DataFrame:
    """Feed with one free-text address; its state is always New York."""
    entered, pieces = F.col("pick_up_address"), F.col("pieces")
    cut = _dated(_upper(raw)).select(
        "datetime",
        A.words(A.before_comma(entered)).alias("pieces"),
        A.fragment_city(A.address_tail(entered), compat).alias("city"),
    )
    address = A.airport_by_word(F.get(pieces, F.lit(0)), A.cut_after_street_type(pieces, compat))
    numbered = cut.withColumn("pieces", A.words(A.from_first_digit(A.drop_new(address))))
    return _finished(
        numbered.select(
            "datetime",
            A.ordinal_after_compass(pieces, compat).alias("street_address"),
            "city",
            F.lit("NEW YORK").alias("state"),
            F.lit(source).alias("source"),
        )
    )


def split_field_feed(raw: DataFrame, compat: bool = False, source: str = V.SPLIT_FIELD_SOURCE) -> DataFrame:
    """Feed with state, city, house number and street in separate fields."""
    code, house, street, state, city = (F.col(c) for c in ("code", "address", "street", "state", "pufrom"))
    # Suffixes go on before the fields are trimmed: a trailing space ends a digit run.
    numbered = _upper(raw).withColumn("street", A.ordinal_digit_runs(street, compat))
    coded = _dated(numbered).withColumn("code", A.state_code(state))
    address = A.full_street(A.airport_field(code, 1, house), A.airport_field(code, 0, street))
    return coded.select(
        "datetime",
        A.shorten_street_type(address).alias("street_address"),
        A.airport_field(code, 3, city).alias("city"),
        A.airport_field(code, 2, A.state_name(code, state)).alias("state"),
        F.lit(source).alias("source"),
    )


def standard_pickups(
    location: DataFrame,
    free_text: DataFrame,
    split_field: DataFrame,
    gazetteer: DataFrame,
    budget: int | None = None,
    compat: bool = False,
) -> DataFrame:
    """All three feeds in one table, with coordinates; ``budget`` limits these to the first pickups of each feed."""
    feeds = [
        location_feed(location, compat),
        free_text_feed(free_text, compat),
        split_field_feed(split_field, compat),
    ]
    return geocode_feeds(feeds, gazetteer, budget)

"""Not-modified revisits of a web archive: which earlier response they stand for, and with which headers.

A revisit record of a server's 304 answer has no body. It stands for the latest earlier full response of the same canonical
URL, provided their validators agree; the answer's permitted headers replace those of the response.

The as-of join takes no group together: records are range-sorted by canonical URL and time, each range is
scanned on its own, and what a range inherits comes from one summary row per earlier range. A URL with a
third of all records is shared by as many tasks as it fills ranges. Bodies do not take part; ``with_payload`` fetches
them by record afterwards.

Defined results: records of equal time are in the order of their identifiers, and a record is no earlier than its copies; a
revisit without a URL or a time is ``no_url`` or ``no_date`` and a response without either serves no revisit; headers that
are null are none; repeated rows are resolved one by one; an empty table gives an empty one; columns besides
those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchmart.operators.ordered import PLACE, RANGE, in_order

# Header fields a 304 answer carries for the stored response (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")

# Query parameters that name a visitor or a campaign, not a page.
IGNORED_PARAMETERS = "^(utm_[a-z]+|gclid|fbclid|sid|sessionid|phpsessid|jsessionid)(=|$)"

RESOLVED, MISMATCH, NO_VALIDATOR, NO_RESPONSE = "resolved", "validator_mismatch", "no_validator", "no_earlier_response"
NO_URL, NO_DATE = "no_url", "no_date"


def canonical_url(url: Column) -> Column:
    """Host, path and query that stand for one page.

    Scheme, fragment, default port, a leading ``www.`` and the slash at the end go, the host is lower-cased,
    campaign parameters are left out and the others sorted. Null without ``://``.
    """
    parts = "^[^:/?#]+://([^/?#]*)([^?#]*)(?:\\?([^#]*))?"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, parts, 1)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, parts, 2), "/+$", "")
    values = F.split(F.regexp_extract(url, parts, 3), "&")
    wanted = F.array_sort(F.filter(values, lambda v: (v != "") & ~F.lower(v).rlike(IGNORED_PARAMETERS)))
    query = F.when(F.size(wanted) > 0, F.concat(F.lit("?"), F.array_join(wanted, "&"))).otherwise(F.lit(""))
    return F.when(url.contains("://"), F.concat(host, path, query))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that only differ in case the first stays."""
    entries = F.transform(
        F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
    )
    names = F.transform(entries, lambda e: e["key"])
    first = F.filter(entries, lambda e, i: (F.array_position(names, e["key"]) == i + 1) & e["value"].isNotNull())
    return F.map_from_entries(first)


def _strength(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(stored: Column, answer: Column) -> Column:
    """``stored`` with the permitted headers of ``answer`` in place of its own."""
    new = F.map_filter(answer, lambda name, _: name.isin(*PERMITTED))
    old = F.map_filter(stored, lambda name, _: ~F.map_contains_key(new, name))
    return F.map_concat(old, new)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``record_id, canonical, outcome, refers_to, headers`` of every revisit record.

    ``records`` has ``record_id`` long, ``kind`` (``response``, ``revisit``, others are passed over), ``url``,
    ``date`` timestamp, ``status`` int and ``headers`` map. Of validators both sides have, the entity tag decides
    before the date of change. Unresolved revisits have neither ``refers_to`` nor ``headers``.
    """
    rows = records.where(
        (F.col("kind") == "revisit") | ((F.col("kind") == "response") & (F.col("status") == 200))
    ).select(
        canonical_url(F.col("url")).alias("canonical"),
        F.col("date"),
        F.col("record_id").cast("long").alias("record_id"),
        (F.col("kind") == "response").alias("full"),
        _lower_keys(F.col("headers")).alias("headers"),
    )
    ordered = in_order(rows, ["canonical", "date", "record_id"])
    response = F.when(
        F.col("full") & F.col("canonical").isNotNull() & F.col("date").isNotNull(),
        F.struct("canonical", "record_id", "headers"),
    )
    before = Window.partitionBy(RANGE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    tails = ordered.groupBy(RANGE).agg(F.max_by(response, F.when(response.isNotNull(), F.col(PLACE))).alias("_tail"))
    # One row per range: the last response of all earlier ranges.
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    inherited = tails.select(RANGE, F.last("_tail", ignorenulls=True).over(earlier).alias("_inherited"))
    scanned = ordered.withColumn("_within", F.last(response, ignorenulls=True).over(before))
    found = scanned.where(~F.col("full")).join(F.broadcast(inherited), RANGE)
    latest = F.coalesce("_within", "_inherited")
    found = found.withColumn("_r", F.when(latest["canonical"] == F.col("canonical"), latest))
    return _checked(found)


def _checked(found: DataFrame) -> DataFrame:
    stored, answer = F.col("_r.headers"), F.col("headers")
    tags = [_strength(F.element_at(h, F.lit("etag"))) for h in (stored, answer)]
    changes = [F.element_at(h, F.lit("last-modified")) for h in (stored, answer)]
    agree = F.coalesce(tags[0] == tags[1], changes[0] == changes[1])  # null when neither is on both sides
    outcome = (
        F.when(F.col("canonical").isNull(), F.lit(NO_URL))
        .when(F.col("date").isNull(), F.lit(NO_DATE))
        .when(F.col("_r").isNull(), F.lit(NO_RESPONSE))
        .when(agree, F.lit(RESOLVED))
        .when(~agree, F.lit(MISMATCH))
        .otherwise(F.lit(NO_VALIDATOR))
    )
    found = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == RESOLVED
    return found.select(
        "record_id",
        "canonical",
        "outcome",
        F.when(resolved, F.col("_r.record_id")).alias("refers_to"),
        F.when(resolved, merged_headers(stored, answer)).alias("headers"),
    )


def with_payload(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """``resolved`` with the ``body`` of the response each row refers to; ``bodies`` has ``record_id, body``."""
    of = bodies.select(F.col("record_id").alias("refers_to"), "body")
    return resolved.join(of, "refers_to", "left")

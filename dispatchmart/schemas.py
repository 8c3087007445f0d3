"""Layouts of the files and tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# Pickup feeds arrive as text; types are given by the rules, never inferred.
LOCATION_FEED = _text("Date", "Time", "Street_Address", "City_State")
FREE_TEXT_FEED = _text("DATE", "TIME", "PICK UP ADDRESS")
SPLIT_FIELD_FEED = _text("DATE", "TIME", "STATE", "PUFROM", "ADDRESS", "STREET")

PICKUP = _text("datetime", "street_address", "city", "state", "source")
PICKUP.add("latitude", T.DoubleType()).add("longitude", T.DoubleType())

MESSAGE = _text("created_at", "tweet")

STREAM_RECORD = T.StructType(
    [
        T.StructField("created_at", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("extended_tweet", T.StructType([T.StructField("full_text", T.StringType())])),
        T.StructField("retweeted_status", T.StructType([T.StructField("text", T.StringType())])),
    ]
)

DRIVER_DIMENSION = T.StructType(
    [
        T.StructField("driverrecordkey", T.LongType()),
        T.StructField("driverkey", T.LongType()),
        T.StructField("drivername", T.StringType()),
        T.StructField("shifttimekey", T.IntegerType()),
        T.StructField("coveragekey", T.IntegerType()),
        T.StructField("companykey", T.IntegerType()),
        T.StructField("hiredate", T.DateType()),
        T.StructField("firedate", T.DateType()),
        T.StructField("effectivedate", T.DateType()),
        T.StructField("loaddate", T.DateType()),
        T.StructField("expireddate", T.DateType()),
        T.StructField("current_record", T.IntegerType()),
    ]
)

DRIVER_FEED = T.StructType(
    [
        T.StructField("drivername", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("beginshift", T.StringType()),
        T.StructField("endshift", T.StringType()),
        T.StructField("coverage", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("effdt", T.DateType()),
        T.StructField("filedt", T.DateType()),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("job_id", T.IntegerType()),
        T.StructField("job_start_time", T.TimestampType()),
        T.StructField("job_end_time", T.TimestampType()),
        T.StructField("job_completed", T.StringType()),
        T.StructField("rows_loaded", T.LongType()),
        T.StructField("rows_rejected", T.LongType()),
    ]
)

"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchmart import schemas


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited file; a header that does not fit the schema is an error."""
    return spark.read.schema(schema).options(header=header, sep=sep, escape='"', enforceSchema=not header).csv(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Captured messages, ``created_at~text`` without a header."""
    return read_csv(spark, path, schemas.MESSAGE, sep="~", header=False)


def read_table(
    spark: SparkSession,
    name: str,
    jdbc: dict[str, str] | None = None,
    split_on: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 32,
) -> DataFrame:
    """A warehouse table: from the catalog, or by parallel JDBC reads split on a column.

    ``bounds`` are the split column's smallest and largest value; they only place the
    cuts, rows beyond them are read as well.
    """
    if jdbc is None:
        return spark.table(name)
    reader = spark.read.format("jdbc").options(**jdbc).option("dbtable", name)
    if split_on is not None:
        if bounds is None:
            raise ValueError("a split read needs the bounds of its column")
        low, high = bounds
        reader = reader.options(
            partitionColumn=split_on, lowerBound=low, upperBound=high, numPartitions=partitions
        )
    return reader.load()


def stream_records(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of JSON message records from files as they arrive."""
    reader = spark.readStream.schema(schemas.STREAM_RECORD)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def flexible_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """Message records of any shape, one JSON text per row: ``created_at, text, lang, full_text, is_retweet, problem, record``.

    Each line becomes a VARIANT and each field is asked for on its own, so missing, further and wrongly typed fields
    cost no other field its value: a number or a truth value where a text should be becomes text, anything else that does not fit is
    NULL. ``problem`` is NULL for a record that can be used; else it says why not, and ``record`` keeps the line: it is no
    JSON, it is no object, or it has no text. Blank lines are left out. Works on a table and on a stream of lines.
    """

    def text(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
        return F.when(~kind.rlike("^(OBJECT|ARRAY)"), F.try_variant_get("_v", path, "string"))

    parsed = lines.where(F.trim(line) != "").withColumn("_v", F.try_parse_json(line))
    retweet = F.try_variant_get("_v", "$.retweeted_status", "variant")
    fields = parsed.select(
        text("$.created_at").alias("created_at"),
        text("$.text").alias("text"),
        text("$.lang").alias("lang"),
        text("$.extended_tweet.full_text").alias("full_text"),
        (retweet.isNotNull() & ~F.coalesce(F.is_variant_null(retweet), F.lit(True))).alias("is_retweet"),
        F.col("_v").isNull().alias("_broken"),
        F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)).alias("_object"),
        F.col(line).alias("record"),
    )
    problem = (
        F.when(F.col("_broken"), "no JSON")
        .when(~F.col("_object"), "no object")
        .when(F.coalesce("full_text", "text").isNull(), "no text")
    )
    return fields.select("created_at", "text", "lang", "full_text", "is_retweet", problem.alias("problem"), "record")

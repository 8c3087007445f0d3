"""Joins of a large table with a side whose size, and keys whose shares, are measured first."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 16

HOT_SHARE = 0.01
"""A key with more than this share of the rows is split; at most 1 / HOT_SHARE keys are."""

_SALT, _SALTS = "_salt", "_salts"


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``df`` with one aggregate; True when it is small enough to send to every executor."""
    widths = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns]
    width = reduce(lambda a, b: a + b, widths, F.lit(8 * len(widths)))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def lookup_join(
    big: DataFrame,
    side: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    bound: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``big`` to ``side`` without depending on how the keys of ``big`` are spread.

    A measured small side is broadcast. Any other side is copied once per salt and
    the rows of ``big`` are salted by the partition they come from, so the rows of
    one hot key meet in ``salts`` partitions instead of one. The partition number does
    not depend on the order of rows, so a task that runs again salts the same way.
    Both sides are shuffled right below the join, so adaptive execution can split
    what is still too large.

    ``bound`` is a table no smaller than ``side`` that is cheaper to measure, such as
    the one ``side`` was grouped from.

    ``how`` is any join that keeps rows of ``big`` only: inner, left, left_semi, left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted {how} join would repeat rows of the side")
    if fits_broadcast(side if bound is None else bound, max_rows):
        return big.join(F.broadcast(side), on, how)
    salted = big.withColumn(_SALT, F.pmod(F.spark_partition_id(), F.lit(salts)))
    copies = side.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, _SALT], how).drop(_SALT)


def hot_keys(big: DataFrame, on: list[str], share: float = HOT_SHARE) -> list[tuple]:
    """Keys of more than ``share`` of the rows, each with its share: one aggregate over the key columns.

    Equal keys collapse before the shuffle, and fewer than ``1 / share`` come back.
    """
    keys = big.select(on)
    total = keys.agg(F.count("*")).scalar()
    counted = keys.groupBy(on).agg(F.count("*").alias("_rows"))
    hot = counted.where(F.col("_rows") > total * share).withColumn("_share", F.col("_rows") / total)
    return [tuple(row) for row in hot.select(*on, "_share").collect()]


def spread_join(
    big: DataFrame,
    side: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    bound: DataFrame | None = None,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Join ``big`` to ``side`` without depending on how the keys of ``big`` are spread.

    A measured small side is broadcast. For any other the hot keys of ``big`` are measured. Their rows are dealt
    to as many partitions as their share is worth, by the number of the partition they come from, which does
    not depend on the order of rows, so a task that runs again deals alike; the side's rows of these keys are copied
    for each. All other keys join plainly, and without a hot key all do. Both sides are shuffled right below the join, so adaptive
    execution can split what is still too large.

    ``bound`` is a table no smaller than ``side`` that is cheaper to measure, such as the one ``side`` was grouped from. ``how`` is
    any join that keeps rows of ``big`` only: inner, left, left_semi, left_anti. A NULL key joins nothing, and its rows
    are spread like those of a hot key.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a split {how} join would repeat rows of the side")
    if fits_broadcast(side if bound is None else bound, max_rows):
        return big.join(F.broadcast(side), on, how)
    spark = big.sparkSession
    hot = hot_keys(big, on, share)
    if not hot:
        return big.join(side, on, how)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = big.select(on).schema.add(_SALTS, T.IntegerType())
    salts = spark.createDataFrame([(*key, max(2, math.ceil(part * partitions))) for *key, part in hot], schema)
    renamed = F.broadcast(salts.withColumnsRenamed({c: f"_hot_{c}" for c in on}))  # fewer rows than 1 / share

    def with_salts(df: DataFrame) -> DataFrame:
        same = [df[c].eqNullSafe(F.col(f"_hot_{c}")) for c in on]
        return df.join(renamed, same, "left").drop(*[f"_hot_{c}" for c in on])

    of = F.coalesce(F.col(_SALTS), F.lit(1))
    dealt = with_salts(big).withColumn(_SALT, F.pmod(F.spark_partition_id(), of)).drop(_SALTS)
    copies = with_salts(side).withColumn(_SALT, F.explode(F.sequence(F.lit(0), of - 1))).drop(_SALTS)
    return dealt.join(copies, [*on, _SALT], how).drop(_SALT)

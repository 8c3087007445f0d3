"""Unions, differences, head and rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchmart.operators.joins import spread_join
from dispatchmart.operators.ordered import sortable_columns
from dispatchmart.session import checkpoint_dir


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All rows of all feeds, columns matched by name."""
    return reduce(lambda left, right: left.unionByName(right), feeds)


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` does not have; NULL equals NULL.

    One grouped count over both tables: equal rows collapse before the shuffle, so a
    mass of copies costs one row per task.
    """
    columns = left.columns
    tagged = left.withColumn("_in_right", F.lit(False)).unionByName(
        right.select(columns).withColumn("_in_right", F.lit(True))
    )
    return tagged.groupBy(columns).agg(F.max("_in_right").alias("_in_right")).where(~F.col("_in_right")).drop("_in_right")


def first_rows(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first ``n`` rows; ties are broken by all other columns."""
    return df.orderBy(*sortable_columns(df, order_by)).limit(n)


def mark_head(df: DataFrame, n: int, order_by: list[str], flag: str = "is_head") -> DataFrame:
    """Flag the first ``n`` rows and leave the rest, in one pass over the table.

    The flag compares each row with the ``n``-th one, found by a top-n, so the table
    is neither shuffled nor sorted. Ties are broken by all other columns; exact
    copies of the ``n``-th row are the same row here and share its flag.
    """
    order = F.struct(*sortable_columns(df, order_by))
    last = df.select(order.alias("o")).orderBy("o").limit(n).agg(F.max("o"))
    return df.withColumn(flag, F.coalesce(order <= last.scalar(), F.lit(False)))


def insert_missing_sources(target: DataFrame, rows: DataFrame, column: str = "source") -> DataFrame:
    """Rows of ``rows`` whose ``column`` is NOT IN that column of ``target``.

    With SQL's meaning of NULL: a NULL in the target admits nothing, and a NULL in
    ``rows`` is admitted only when the target is empty. The target is read once: its
    distinct values are written, and they alone tell whether it is empty or holds a NULL.
    """
    checkpoint_dir(target.sparkSession)
    present = target.groupBy(column).agg(F.lit(1).alias("_one")).select(column).checkpoint()
    has_null = present.agg(F.coalesce(F.max(F.col(column).isNull()), F.lit(False))).scalar()
    is_empty = present.agg(F.count("*") == 0).scalar()
    new = spread_join(rows, present.where(F.col(column).isNotNull()), [column], "left_anti")
    return new.where(~has_null & (F.col(column).isNotNull() | is_empty)).select(rows.columns)

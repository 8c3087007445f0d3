"""Work that needs one order over a whole table, without one task seeing the whole table.

The table is range-shuffled on the order columns, sorted inside each range and
written with each row's range and its place in the range. Totals of earlier ranges
(one row per range) are then all that has to be combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchmart.session import stored

RANGE = "_range"
PLACE = "_place"
_ROW = "_row"


def sortable_columns(df: DataFrame, first: list[str] = ()) -> list[str]:
    """``first``, then every other column that has an order (maps and variants have none)."""
    unordered = (T.MapType, T.VariantType)
    rest = [f.name for f in df.schema.fields if f.name not in first and not isinstance(f.dataType, unordered)]
    return [*first, *rest]


def in_order(df: DataFrame, order_by: list[str], rows_differ: bool = False) -> DataFrame:
    """``df`` in order, with the number of the range and the place in it.

    Ties are broken by all other columns. ``rows_differ=True`` promises that no two
    rows are equal; otherwise the table is written first and each row gets an
    identity, so that even a mass of equal rows is cut into ranges.
    """
    keys = sortable_columns(df, order_by)
    if not rows_differ:
        df = stored(df.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
        keys = [*keys, _ROW]
    sorted_ranges = df.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(_ROW)
    position = F.monotonically_increasing_id()
    return stored(
        sorted_ranges.select(
            "*",
            F.shiftright(position, 33).cast("int").alias(RANGE),
            position.bitwiseAND(F.lit((1 << 33) - 1)).alias(PLACE),
        ),
        "ranges",
    )


def number_rows(
    df: DataFrame,
    key: str,
    order_by: list[str],
    after: int | Column = 0,
    rows_differ: bool = False,
    each: str | None = None,
) -> DataFrame:
    """Dense numbers ``after + 1, after + 2, ...`` in the given order, as column ``key``.

    ``after`` may be a scalar subquery. ``each`` is a column with how many numbers a row takes, of which it gets the first.
    """
    ordered = in_order(df, order_by, rows_differ)
    taken = F.count("*") if each is None else F.sum(each)
    if each is not None:
        before = Window.partitionBy(RANGE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
        ordered = ordered.withColumn(PLACE, F.coalesce(F.sum(each).over(before), F.lit(0)))
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy(RANGE)
        .agg(taken.alias("_rows"))
        .select(RANGE, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    after = after if isinstance(after, Column) else F.lit(after)
    number = (after + F.col("_offset") + F.col(PLACE) + 1).cast("long")
    return (
        ordered.join(F.broadcast(offsets), RANGE)  # one row per range
        .withColumn(key, number)
        .drop(RANGE, PLACE, "_offset")
    )


def next_and_latest(
    df: DataFrame,
    group: str,
    order_by: list[str],
    following: str,
    carried: str,
    rows_differ: bool = False,
) -> DataFrame:
    """Per group and in order: ``following`` of the next row and the latest non-null ``carried``.

    Adds ``next_<following>`` and replaces ``carried``. Groups are not brought
    together: each range is scanned on its own, and what crosses the edge of a range
    comes from one summary row per range. A group of any size is therefore shared by
    as many tasks as it has ranges.
    """
    ordered = in_order(df, [group, *order_by], rows_differ)
    inside = Window.partitionBy(RANGE).orderBy(PLACE)
    upto_here = inside.rowsBetween(Window.unboundedPreceding, 0)

    head = F.struct(F.col(group).alias("of"), F.col(following).alias("value"))
    tail = F.when(F.col(carried).isNotNull(), F.struct(F.col(group).alias("of"), F.col(carried).alias("value")))

    by_range = Window.orderBy(RANGE)
    edges = (
        ordered.groupBy(RANGE)
        .agg(
            F.min_by(head, PLACE).alias("_head"),
            F.max_by(tail, F.when(F.col(carried).isNotNull(), F.col(PLACE))).alias("_tail"),
        )
        .select(
            RANGE,
            F.lead("_head").over(by_range).alias("_next_head"),
            F.last("_tail", ignorenulls=True)
            .over(by_range.rowsBetween(Window.unboundedPreceding, -1))
            .alias("_prior_tail"),
        )
    )
    scanned = (
        ordered.withColumn("_next", F.lead(head).over(inside))
        .withColumn("_latest", F.last(tail, ignorenulls=True).over(upto_here))
        .join(F.broadcast(edges), RANGE)  # one row per range
    )
    successor = F.coalesce("_next", "_next_head")
    source = F.coalesce(F.when(F.col("_latest.of") == F.col(group), F.col("_latest")), F.col("_prior_tail"))
    return scanned.select(
        *[F.col(c) for c in df.columns if c != carried],
        F.when(source["of"] == F.col(group), source["value"]).alias(carried),
        F.when(successor["of"] == F.col(group), successor["value"]).alias(f"next_{following}"),
    )

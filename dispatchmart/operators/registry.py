"""Numbers that natural keys keep: a persisted map, grown in blocks.

The map is a table of a store, cut into buckets by a hash of the natural key. New keys are counted per bucket, every bucket gets a
block of numbers behind the last one given, and each task numbers the keys of its bucket inside the block. So no
table is sorted as a whole, a feed reads and writes only the buckets its keys fall into, and a key that comes again, late or
in a repeated run, has the number it had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchmart.session import checkpoint_dir
from dispatchmart.sources.commits import Commit

BUCKET = "_bucket"
BUCKETS = 32


def bucket_of(columns: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(buckets)).cast("int")


def buckets_in(df: DataFrame) -> list[str]:
    """The buckets that rows with a bucket fall into: never more than there are."""
    return sorted(str(row[0]) for row in df.select(BUCKET).distinct().collect())


def number_in_blocks(
    df: DataFrame, number: str, order_by: list[str], after: int, each: str | None = None
) -> tuple[DataFrame, int]:
    """Dense numbers from ``after + 1`` on, one block per bucket; gives the last number, too.

    ``df`` has a bucket, is the same however often it is read, and ``order_by`` tells its rows apart. ``each`` is a column with
    how many numbers a row takes, of which it gets the first.
    """
    blocks, last = [], after
    taken = F.count("*") if each is None else F.sum(each)
    for bucket, rows in sorted(map(tuple, df.groupBy(BUCKET).agg(taken).collect())):
        blocks.append((bucket, last))
        last += rows
    starts = df.sparkSession.createDataFrame(blocks, f"{BUCKET} int, _start long")  # one row per bucket
    in_bucket = Window.partitionBy(BUCKET).orderBy(*order_by)
    if each is None:
        place = F.row_number().over(in_bucket)
    else:
        place = F.coalesce(F.sum(each).over(in_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return df.join(F.broadcast(starts), BUCKET).withColumn(number, F.col("_start") + place).drop("_start"), last


def register(commit: Commit, registry: str, keys: DataFrame, buckets: int = BUCKETS, after: int = 0) -> DataFrame:
    """The columns of ``keys``, which are the natural key, with their ``number`` and ``block``.

    Keys that the registry lacks get the next numbers, the first one after ``after`` if it is new. Repeated keys
    count once, and NULL is a value of a key like any other.
    """
    checkpoint_dir(keys.sparkSession)
    columns = keys.columns
    wanted = keys.distinct().withColumn(BUCKET, bucket_of(columns, buckets)).checkpoint()
    touched = buckets_in(wanted)
    if not commit.knows(registry):
        fresh, known = wanted, None
    else:
        known = commit.read(registry, touched).withColumn(BUCKET, bucket_of(columns, buckets))
        same = [F.col(BUCKET) == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]]
        there = known.select(F.col(BUCKET).alias("_of"), *[F.col(c).alias(f"_{c}") for c in columns])
        fresh = wanted.join(there, same, "left_anti").checkpoint()
    mark = f"{registry}.last"
    numbered, last = number_in_blocks(fresh, "number", columns, commit.mark_of(mark, after))
    # The block is named by its first number, which no other block has.
    block = F.min("number").over(Window.partitionBy(BUCKET))
    numbered = numbered.withColumn("block", block).select(*columns, "number", "block", BUCKET)
    if last > commit.mark_of(mark, after) or known is None:
        rows = numbered if known is None else known.unionByName(numbered)
        commit.replace_parts(registry, rows, BUCKET, touched)
        commit.mark(mark, last)
    return commit.read(registry, touched)

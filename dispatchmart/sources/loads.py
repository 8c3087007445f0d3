"""Writes: files, full refresh, append, load with an error budget, second source.

A target that contains a slash is a folder, kept by the manifests of the folder above it (``commits``), any
other a table name; with JDBC options it is a table of that database.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchmart.functions import fixed_values as V
from dispatchmart.operators.sets import insert_missing_sources
from dispatchmart.session import checkpoint_dir
from dispatchmart.sources.commits import Commit, store_of

_RECORD, _REJECTED = "record", "_rejected"


@dataclass(frozen=True)
class LoadResult:
    loaded: DataFrame
    rejected: DataFrame


@dataclass(frozen=True)
class LoadCounts:
    """Rows of a load, counted while they were written."""

    loaded: int = 0
    rejected: int = 0

    def __add__(self, other: LoadCounts) -> LoadCounts:
        return LoadCounts(self.loaded + other.loaded, self.rejected + other.rejected)


class LoadRejected(RuntimeError):
    """The input holds as many bad rows as fail a load, or more."""

    def __init__(self, message: str, counts: LoadCounts):
        super().__init__(message)
        self.counts = counts


def read_target(spark: SparkSession, target: str) -> DataFrame:
    """A table, or the latest published content of a folder."""
    if "/" not in target:
        return spark.table(target)
    store, table = store_of(spark, target)
    return store.read(table)


def _write(writer: DataFrameWriter, target: str, jdbc: dict[str, str] | None) -> None:
    if jdbc is not None:
        writer.format("jdbc").options(**jdbc, dbtable=target, truncate=True).save()
    elif "/" in target:
        writer.parquet(target)
    else:
        writer.format("parquet").saveAsTable(target)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    """Delimited part files, written by all tasks at once; spaces around values are kept."""
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=header, sep=sep, escape='"', **spaces).csv(path)


def full_refresh(
    df: DataFrame, target: str, partition_by: tuple[str, ...] = (), jdbc: dict[str, str] | None = None
) -> None:
    """Replace everything the target holds; a database table is truncated, not dropped.

    The rows of a folder target are written once, to a folder of their own, and then published (``commits``); until
    then, and if the load fails, readers have the old content. Tables are computed into a checkpoint first. Either
    way ``df`` may read the target.
    """
    if jdbc is None and "/" in target:
        store, table = store_of(df.sparkSession, target)
        commit = store.begin()
        commit.replace(table, df, partition_by)
        commit.publish()
    else:
        checkpoint_dir(df.sparkSession)
        _write(df.checkpoint().write.mode("overwrite").partitionBy(*partition_by), target, jdbc)


def append_load(
    df: DataFrame, target: str, partition_by: tuple[str, ...] = (), jdbc: dict[str, str] | None = None
) -> None:
    """Add to what the target holds."""
    if jdbc is None and "/" in target:
        store, table = store_of(df.sparkSession, target)
        commit = store.begin()
        commit.append(table, df, partition_by)
        commit.publish()
    else:
        _write(df.write.mode("append").partitionBy(*partition_by), target, jdbc)


def _parsed(spark: SparkSession, path: str, schema: T.StructType, sep: str, header: bool) -> DataFrame:
    """A delimited file with the flag ``_rejected`` and, of bad rows, the whole ``record``. It is parsed once.

    A malformed row has the parser's record beside it; all columns are parsed, so every reader sees the same rows as bad.
    """
    marked = T.StructType([*schema.fields, T.StructField(_RECORD, T.StringType())])
    rows = (
        spark.read.schema(marked)
        .options(
            header=header,
            sep=sep,
            escape='"',
            mode="PERMISSIVE",
            columnNameOfCorruptRecord=_RECORD,
            columnPruning=False,
            enforceSchema=not header,
        )
        .csv(path)
    )
    return rows.withColumn(_REJECTED, F.col(_RECORD).isNotNull())


def load_in_commit(
    commit: Commit,
    path: str,
    schema: T.StructType,
    table: str,
    quarantine: str,
    max_errors: int = V.MAX_LOAD_ERRORS,
    sep: str = ",",
    header: bool = True,
) -> LoadCounts:
    """Load a delimited file into two tables of a commit: its good rows, and its bad ones with the text of the record.

    One pass writes both and counts them. With ``max_errors`` bad rows or more only the quarantine stays in the commit
    and ``LoadRejected`` is raised; the caller publishes.
    """
    rows = _parsed(commit.store.spark, path, schema, sep, header)
    columns = {True: [*schema.names, _RECORD], False: schema.names}
    found = commit.split(rows, _REJECTED, {True: quarantine, False: table}, columns)
    if found[True] >= max_errors:
        commit.withdraw(table)
        message = f"{found[True]} bad rows in {path}, fewer than {max_errors} are allowed"
        raise LoadRejected(message, LoadCounts(0, found[True]))
    return LoadCounts(found[False], found[True])


def load_with_error_budget(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    target: str,
    quarantine: str,
    max_errors: int = V.MAX_LOAD_ERRORS,
    sep: str = ",",
    header: bool = True,
) -> LoadResult:
    """Load a delimited file; bad rows are set aside while there are fewer than ``max_errors``.

    The target and the quarantine are folders beside each other and change together. When the load fails, the
    target is as it was and the quarantine holds all bad rows.
    """
    (store, table), (beside, bad) = store_of(spark, target), store_of(spark, quarantine)
    if store.root != beside.root:
        raise ValueError("target and quarantine are folders beside each other")
    commit = store.begin()
    try:
        load_in_commit(commit, path, schema, table, bad, max_errors, sep, header)
    except LoadRejected:
        commit.publish()  # the quarantine alone is left in it
        raise
    commit.publish()
    return LoadResult(read_target(spark, target), read_target(spark, quarantine))


def with_second_source(second: DataFrame, pickups: DataFrame) -> DataFrame:
    """A second source, and the pickups whose source it lacks."""
    return second.unionByName(insert_missing_sources(second, pickups))


def merge_second_source(second: DataFrame, pickups: DataFrame, target: str) -> DataFrame:
    """``with_second_source`` as the whole content of ``target``: one write, which a repeated run replaces."""
    full_refresh(with_second_source(second, pickups), target)
    return read_target(second.sparkSession, target)

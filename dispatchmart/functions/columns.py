"""Whole-table column work, one projection each."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lower_names(df: DataFrame) -> DataFrame:
    """Canonical column names: lower case, words joined by underscores."""
    return df.toDF(*["_".join(name.strip().lower().split()) for name in df.columns])


def upper_values(df: DataFrame) -> DataFrame:
    """Every value in upper case; every column becomes text."""
    return df.select([F.upper(F.col(f"`{name}`")).alias(name) for name in df.columns])


def trim_values(df: DataFrame) -> DataFrame:
    """Every value without leading and trailing spaces (no other white space)."""
    return df.select([F.trim(F.col(f"`{name}`")).alias(name) for name in df.columns])


def dashed_date(text: Column) -> Column:
    return F.replace(text, F.lit("/"), F.lit("-"))


def merge_date_time(df: DataFrame) -> DataFrame:
    """``date`` and ``time`` become ``datetime`` when the table has both; else it stays as it is."""
    if not {"date", "time"} <= set(df.columns):
        return df
    merged = F.concat(F.col("date"), F.lit(" "), F.col("time"))
    return df.withColumn("datetime", merged).drop("date", "time")


def _literal(value: str | int) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def recode(value: Column, table: dict[Any, Any], otherwise: Column | None = None) -> Column:
    """Look ``value`` up in a fixed table; ``otherwise`` (NULL when not given) for the rest.

    A map literal, so that ``value`` is computed once whatever the size of the table.
    """
    entries = ", ".join(_literal(item) for pair in table.items() for item in pair)
    found = F.expr(f"map({entries})")[value]
    return found if otherwise is None else F.coalesce(found, otherwise)


def replace_all(text: Column, table: dict[str, str]) -> Column:
    """Replace each key by its value wherever it occurs, one key after the other."""
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), table.items(), text)

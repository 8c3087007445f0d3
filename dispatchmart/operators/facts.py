"""Pickup facts with the keys of their shift, coverage, company and drivers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchmart.functions import fixed_values as V
from dispatchmart.functions.clock import minute_of_day, shift_key
from dispatchmart.functions.columns import recode
from dispatchmart.operators.joins import BROADCAST_ROWS, spread_join

PICKUP = ["datetime", "street_address", "city", "state", "source", "latitude", "longitude"]
FACT = ["driverrecordkey", "driverkey", *PICKUP]
KEYS = ["shifttimekey", "coveragekey", "companykey"]


def add_pickup_keys(
    pickups: DataFrame,
    coverages: DataFrame | None = None,
    companies: DataFrame | None = None,
    compat: bool = False,
) -> DataFrame:
    """Reduce ``datetime`` to HH:mm and look up the three keys.

    Without lookup tables the fixed ones apply. An unknown city has key -1, an
    unknown company none.
    """
    texts = {c: F.trim(F.col(c)) for c in PICKUP if c not in ("datetime", "latitude", "longitude")}
    keyed = pickups.select(PICKUP).withColumns(
        {**texts, "datetime": minute_of_day(F.trim(F.col("datetime").cast("string")), compat)}
    )
    keyed = keyed.withColumn("shifttimekey", shift_key(F.col("datetime"), compat))
    if coverages is None:
        keyed = keyed.withColumn("coveragekey", recode(F.col("city"), V.COVERAGE_KEYS, F.lit(V.UNKNOWN_KEY)))
    else:
        keyed = spread_join(keyed, coverages.select(F.col("coverage").alias("city"), "coveragekey"), ["city"], "left")
        keyed = keyed.withColumn("coveragekey", F.coalesce("coveragekey", F.lit(V.UNKNOWN_KEY)))
    if companies is None:
        keyed = keyed.withColumn("companykey", recode(F.col("source"), V.COMPANY_KEYS))
    else:
        keyed = spread_join(keyed, companies.select(F.col("company").alias("source"), "companykey"), ["source"], "left")
    return keyed.select(*PICKUP, *KEYS)


def current_drivers(dim: DataFrame) -> DataFrame:
    return dim.where(F.col("current_record") == 1).select(*KEYS, "driverrecordkey", "driverkey")


def driver_bridge(dim: DataFrame) -> DataFrame:
    """The current drivers of each shift, coverage and company.

    Pickups that carry these three keys find their drivers through it, so a fact table holds each
    pickup once.
    """
    return current_drivers(dim).where(F.col("shifttimekey").isNotNull() & F.col("coveragekey").isNotNull() & F.col("companykey").isNotNull())


def facts_with_keys(keyed: DataFrame, dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every pickup with every current driver of its shift, coverage and company, for those who ask for all pairs.

    The few key combinations hold very many pickups each; ``spread_join`` keeps them
    from meeting in one task.
    """
    return spread_join(keyed, current_drivers(dim), KEYS, "inner", max_rows).select(FACT)


def pickups_without_driver(keyed: DataFrame, dim: DataFrame) -> DataFrame:
    """Pickups that no current driver serves."""
    served = current_drivers(dim).select(KEYS).distinct()
    return spread_join(keyed, served, KEYS, "left_anti").select(*PICKUP, *KEYS)


def drivers_per_pickup_key(keyed: DataFrame, dim: DataFrame) -> DataFrame:
    """Quality check of the fan-out: pickups, drivers and fact rows per key combination."""
    pickups = keyed.groupBy(KEYS).agg(F.count("*").alias("pickups"))
    drivers = current_drivers(dim).groupBy(KEYS).agg(F.count("*").alias("drivers"))
    return pickups.join(drivers, KEYS).withColumn("fact_rows", F.col("pickups") * F.col("drivers"))

"""Type-2 driver dimension from a hire / change / fire feed.

Dates are DateType, an open end is 9999-12-31. Every version of a driver except the
last has ``current_record = 0`` and ends the day before the next one starts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchmart.functions import fixed_values as V
from dispatchmart.functions.clock import date_text, day_before
from dispatchmart.operators.joins import spread_join
from dispatchmart.operators.ordered import next_and_latest, number_rows
from dispatchmart.session import stored

DIMENSION = [
    "driverrecordkey",
    "driverkey",
    "drivername",
    "shifttimekey",
    "coveragekey",
    "companykey",
    "hiredate",
    "firedate",
    "effectivedate",
    "loaddate",
    "expireddate",
    "current_record",
]
FEED = ["drivername", "action", "beginshift", "endshift", "coverage", "source", "effdt", "filedt"]
LOOKUP_KEYS = ["shifttimekey", "coveragekey", "companykey"]
RECORD_ORDER = ["driverkey", "effectivedate", "expireddate"]

# Versions not numbered yet carry this record key until the dimension is assembled.
UNNUMBERED = -1


@dataclass(frozen=True)
class Lookups:
    """The shift, coverage and company dimensions a feed row refers to."""

    shifts: DataFrame
    coverages: DataFrame
    companies: DataFrame


@dataclass(frozen=True)
class DimensionUpdate:
    dimension: DataFrame
    rejects: DataFrame


def _open_end() -> Column:
    return F.lit(V.OPEN_END_ISO).cast("date")


def _is_current() -> Column:
    return F.coalesce(F.col("current_record") == 1, F.lit(False))


def resolve_feed(feed: DataFrame, lookups: Lookups) -> DataFrame:
    """Feed rows with the keys of their shift, coverage and company; NULL where there is none.

    A row delivered twice is one event. Several steps read the result, so it is
    written.
    """
    shifts = lookups.shifts.select(
        F.col("starttime").alias("beginshift"), F.col("endtime").alias("endshift"), "shifttimekey"
    )
    companies = lookups.companies.select(F.col("company").alias("source"), "companykey")
    rows = feed.select(FEED).distinct()
    rows = spread_join(rows, shifts, ["beginshift", "endshift"], "left")
    rows = spread_join(rows, lookups.coverages.select("coverage", "coveragekey"), ["coverage"], "left")
    rows = spread_join(rows, companies, ["source"], "left")
    return stored(rows.select(*FEED, *LOOKUP_KEYS), "resolved")


def _keys_found() -> Column:
    return F.col("shifttimekey").isNotNull() & F.col("coveragekey").isNotNull() & F.col("companykey").isNotNull()


def _applicable(resolved: DataFrame) -> DataFrame:
    """FIRED and CHANGE rows that say all they have to say."""
    complete = (F.col("action") == "FIRED") | ((F.col("action") == "CHANGE") & _keys_found())
    return resolved.where(complete & F.col("effdt").isNotNull())


def _names(df: DataFrame) -> DataFrame:
    return df.select("drivername").where(F.col("drivername").isNotNull()).distinct()


def _event() -> Column:
    """What an event says; of several events of one driver and day the greatest is the one that counts."""
    keys = F.when(F.col("action") == "CHANGE", F.struct(*LOOKUP_KEYS)).alias("keys")
    return F.struct("filedt", "action", keys)


def day_events(dim: DataFrame, resolved: DataFrame) -> DataFrame:
    """``driverkey, effdt, event``: the one event of each day after the start of a driver's current version.

    The last event of a day (by file date, then action, then keys) makes that day's version. Several steps read
    the result, so it is written.
    """
    current = dim.where(_is_current()).select("drivername", "driverkey", F.col("effectivedate").alias("_since"))
    events = _applicable(resolved).select("drivername", "effdt", _event().alias("event"))
    later = spread_join(events, current, ["drivername"]).where(F.col("effdt") > F.col("_since"))
    return stored(later.groupBy("driverkey", "effdt").agg(F.max("event").alias("event")), "events")


def unchanged(dim: DataFrame, events: DataFrame) -> DataFrame:
    """Closed versions, and current ones that no event follows; ``events`` as ``day_events`` gives them."""
    touched = events.select("driverkey").distinct()
    current = spread_join(dim.where(_is_current()), touched, ["driverkey"], "left_anti")
    return dim.where(~_is_current()).select(DIMENSION).unionByName(current.select(DIMENSION)).distinct()


def applied_versions(dim: DataFrame, events: DataFrame) -> DataFrame:
    """Versions of the drivers that FIRED and CHANGE rows touch; ``events`` as ``day_events`` gives them.

    The driver's current version and the events after it form one chain in the order of
    their dates, which all differ. FIRED keeps the keys in force before it.
    """
    touched = events.select("driverkey").distinct()
    base_rows = stored(spread_join(dim.where(_is_current()), touched, ["driverkey"], "left_semi").select(DIMENSION), "bases")
    base = base_rows.select(
        *DIMENSION,
        F.lit(0).alias("step"),
        F.col("effectivedate").alias("effdt"),
        F.col("loaddate").alias("filedt"),
        F.lit("BASE").alias("action"),
        F.struct(*LOOKUP_KEYS).alias("keys"),
    )
    steps = spread_join(
        events.select("driverkey", F.lit(1).alias("step"), "effdt", "event.*"), base_rows, ["driverkey"]
    ).select(base.columns)
    chain = base.unionByName(steps).withColumnsRenamed({name: f"base_{name}" for name in DIMENSION})
    chained = next_and_latest(
        chain, "base_driverkey", ["step", "effdt"], following="effdt", carried="keys", rows_differ=True
    )
    first = F.col("step") == 0
    last = F.col("next_effdt").isNull()
    return chained.select(
        F.when(first, F.col("base_driverrecordkey")).otherwise(F.lit(UNNUMBERED)).alias("driverrecordkey"),
        F.col("base_driverkey").alias("driverkey"),
        F.col("base_drivername").alias("drivername"),
        *[F.col(f"keys.{key}").alias(key) for key in LOOKUP_KEYS],
        F.col("base_hiredate").alias("hiredate"),
        F.when(first, F.col("base_firedate"))
        .when(F.col("action") == "FIRED", F.col("effdt"))
        .otherwise(_open_end())
        .alias("firedate"),
        F.col("effdt").alias("effectivedate"),
        F.col("filedt").alias("loaddate"),
        F.coalesce(day_before(F.col("next_effdt")), _open_end()).alias("expireddate"),
        last.cast("int").alias("current_record"),
    )


def name_chains(resolved: DataFrame) -> DataFrame:
    """``drivername, chain``: what the events of a name say, one entry for each of their days, in order.

    The last event of a day makes that day's version. An entry holds the day of the next one and the latest CHANGE up to
    its own. Drivers of one name share its events, however many they are: a chain is held once, as long as the days it has.
    """
    events = _applicable(resolved).where(F.col("drivername").isNotNull())
    events = events.groupBy("drivername", "effdt").agg(F.max(_event()).alias("event"))
    in_time = Window.partitionBy("drivername").orderBy("effdt")
    change = F.when(F.col("event.keys").isNotNull(), F.struct(F.col("effdt").alias("day"), F.col("event.keys").alias("keys")))
    entry = F.struct(
        "effdt",
        "event.filedt",
        "event.action",
        F.lead("effdt").over(in_time).alias("next"),
        F.last(change, ignorenulls=True).over(in_time.rowsBetween(Window.unboundedPreceding, 0)).alias("change"),
    )
    entries = events.select("drivername", entry.alias("entry"))
    return stored(entries.groupBy("drivername").agg(F.array_sort(F.collect_list("entry")).alias("chain")), "chains")


def _later() -> Column:
    """The entries of a name's chain that follow the start of a driver's version."""
    since = F.col("effectivedate")
    return F.filter("chain", lambda entry: entry["effdt"] > since)


@dataclass(frozen=True)
class Versions:
    """The versions of a dimension that a feed is applied to.

    ``rows`` has the dimension's columns and ``later``: how many versions follow the row. The driver's chain
    gives them (``expanded``), so that no step before holds every event once for each driver of its name.
    """

    rows: DataFrame
    chains: DataFrame


def versions_of(dim: DataFrame, resolved: DataFrame) -> Versions:
    """Closed versions, current ones, and how many versions the FIRED and CHANGE rows add behind each.

    A driver key with several current versions, or a closed one that does not start before the current one, has no
    chain of its own behind one row: its versions are made by ``applied_versions``.
    """
    current, closed = dim.where(_is_current()).select(DIMENSION), dim.where(~_is_current()).select(DIMENSION)
    starts = F.col("effectivedate")
    keys = dim.where(F.col("driverkey").isNotNull()).groupBy("driverkey").agg(
        F.count_if(_is_current()).alias("_current"),
        F.max(F.when(_is_current(), starts)).alias("_since"),
        F.max(F.when(~_is_current(), starts)).alias("_closed"),
    )
    mixed = (F.col("_current") > 1) | ((F.col("_current") == 1) & (F.col("_closed") >= F.col("_since")))
    mixed = stored(keys.where(mixed).select("driverkey"), "mixed")

    chains = name_chains(resolved)
    plain = spread_join(current, mixed, ["driverkey"], "left_anti")
    known = F.col("driverkey").isNotNull()
    plain = spread_join(plain, chains, ["drivername"], "left").select(
        *DIMENSION, F.when(known, F.coalesce(F.size(_later()), F.lit(0))).otherwise(0).alias("later")
    )
    none = F.lit(0).alias("later")
    rows = closed.select(*DIMENSION, none).unionByName(plain).distinct()
    if not mixed.isEmpty():
        several = stored(spread_join(current, mixed, ["driverkey"], "left_semi").select(DIMENSION), "several")
        events = day_events(several, resolved)
        several = unchanged(several, events).unionByName(applied_versions(several, events))
        rows = rows.unionByName(several.select(*DIMENSION, none))
    return Versions(rows, chains)


def expanded(rows: DataFrame, chains: DataFrame, first: Column, following: Column) -> DataFrame:
    """All versions: of each row of ``Versions.rows`` its own and those that follow it.

    A row's own version has ``first`` as its record key, the n-th that follows it ``following + n``. FIRED keeps the
    keys in force before it.
    """
    alone = rows.where("later = 0").withColumn("driverrecordkey", first).select(DIMENSION)
    behind = rows.where("later > 0").withColumns({"_first": first, "_following": following})
    behind = spread_join(behind, chains, ["drivername"]).withColumn("_later", _later())
    types = chains.schema["chain"].dataType.elementType
    own = F.struct(
        F.col("effectivedate").alias("effdt"),
        F.col("loaddate").alias("filedt"),
        F.lit("BASE").alias("action"),
        F.col("_later")[0]["effdt"].alias("next"),
        F.lit(None).cast(types["change"].dataType).alias("change"),
    )
    steps = behind.select(
        *DIMENSION[1:], "_first", "_following",
        F.posexplode(F.concat(F.array(own), F.col("_later"))).alias("_step", "_at"),
    )
    is_first = F.col("_step") == 0
    changed = F.col("_at.change.day") > F.col("effectivedate")
    made = steps.select(
        F.when(is_first, F.col("_first")).otherwise(F.col("_following") + F.col("_step")).alias("driverrecordkey"),
        "driverkey",
        "drivername",
        *[F.when(changed, F.col(f"_at.change.keys.{key}")).otherwise(F.col(key)).alias(key) for key in LOOKUP_KEYS],
        "hiredate",
        F.when(is_first, F.col("firedate"))
        .when(F.col("_at.action") == "FIRED", F.col("_at.effdt"))
        .otherwise(_open_end())
        .alias("firedate"),
        F.col("_at.effdt").alias("effectivedate"),
        F.col("_at.filedt").alias("loaddate"),
        F.coalesce(day_before(F.col("_at.next")), _open_end()).alias("expireddate"),
        F.col("_at.next").isNull().cast("int").alias("current_record"),
    )
    return alone.unionByName(made)


def hired_rows(resolved: DataFrame) -> DataFrame:
    """The first version of each driver that the feed hires, without a driver key."""
    complete = (F.col("action") == "HIRED") & _keys_found() & F.col("effdt").isNotNull()
    return resolved.where(complete).select(
        F.lit(UNNUMBERED).alias("driverrecordkey"),
        "drivername",
        *LOOKUP_KEYS,
        F.col("effdt").alias("hiredate"),
        _open_end().alias("firedate"),
        F.col("effdt").alias("effectivedate"),
        F.col("filedt").alias("loaddate"),
        _open_end().alias("expireddate"),
        F.lit(1).alias("current_record"),
    )


def hired_versions(dim: DataFrame, resolved: DataFrame) -> DataFrame:
    """One new driver per HIRED row, keyed on from the largest driver key."""
    largest = dim.agg(F.coalesce(F.max("driverkey"), F.lit(0))).scalar()
    return number_rows(
        hired_rows(resolved),
        "driverkey",
        ["effectivedate", "loaddate", "drivername"],
        after=largest,
        rows_differ=True,
    ).select(DIMENSION)


def rejected_rows(dim: DataFrame, resolved: DataFrame) -> DataFrame:
    """Feed rows that make no version, with the reason; ``dim`` includes the drivers the feed hires."""
    current = dim.where(_is_current()).groupBy("drivername").agg(F.min("effectivedate").alias("_since"))
    checked = spread_join(resolved, current.withColumn("_current", F.lit(True)), ["drivername"], "left")
    days = (
        _applicable(resolved)
        .groupBy("drivername", "effdt")
        .agg(F.max(_event()).alias("_last"))
        .where(F.col("drivername").isNotNull())
    )
    checked = spread_join(checked, days, ["drivername", "effdt"], "left")
    action = F.col("action")
    follows = action.isin("CHANGE", "FIRED")
    reason = (
        F.when(~F.coalesce(action.isin("HIRED", "CHANGE", "FIRED"), F.lit(False)), "unknown action")
        .when(action.isin("HIRED", "CHANGE") & ~_keys_found(), "unknown shift, coverage or company")
        .when(F.col("effdt").isNull(), "no effective date")
        .when(follows & F.col("_current").isNull(), "no current driver")
        .when(follows & (F.col("effdt") <= F.col("_since")), "not after the current version")
        .when(follows & (_event() < F.col("_last")), "superseded on the same day")
    )
    return checked.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*FEED, "reason")


def number_records(versions: Versions) -> DataFrame:
    """All versions with record keys 1..N over the whole dimension.

    Rows are put in order and numbered with those that follow them, which stand right behind: a driver's closed
    versions start before. So only drivers are sorted, not the versions that a chain adds to each.
    """
    rows = versions.rows.drop("driverrecordkey").withColumn("_each", F.col("later") + 1)
    numbered = number_rows(rows, "_number", RECORD_ORDER, rows_differ=True, each="_each")
    return expanded(numbered, versions.chains, F.col("_number"), F.col("_number"))


def with_hired(dim: DataFrame, resolved: DataFrame) -> DataFrame:
    """The dimension and the drivers that the feed hires, so that later events of the feed find them."""
    return dim.select(DIMENSION).unionByName(hired_versions(dim, resolved))


def update_dimension(dim: DataFrame, feed: DataFrame, lookups: Lookups) -> DimensionUpdate:
    """Apply a feed to the dimension; what makes no version comes back as rejects."""
    resolved = resolve_feed(feed, lookups)
    known = with_hired(dim, resolved)
    return DimensionUpdate(number_records(versions_of(known, resolved)), rejected_rows(known, resolved))


# The same steps with the results older loads were made with: every version of a
# driver is versioned again, firing keeps only the closing version, and both versions
# of a change carry the new keys.


def compat_unchanged(dim: DataFrame, feed: DataFrame) -> DataFrame:
    return spread_join(dim, _names(feed), ["drivername"], "left_anti").select(DIMENSION).distinct()


def _compat_matches(dim: DataFrame, resolved: DataFrame, action: str) -> DataFrame:
    """Every version of a driver with every feed row of that action for the driver."""
    rows = resolved.where(F.col("action") == action)
    touched = spread_join(dim, _names(rows), ["drivername"], "left_semi").select(
        *[F.col(c).alias(c if c == "drivername" else f"dim_{c}") for c in DIMENSION]
    )
    return spread_join(touched, rows.drop(*[c for c in FEED if c not in ("drivername", "effdt", "filedt")]), ["drivername"])


def compat_fired(dim: DataFrame, resolved: DataFrame) -> DataFrame:
    return _compat_matches(dim, resolved, "FIRED").select(
        F.lit(UNNUMBERED).alias("driverrecordkey"),
        F.col("dim_driverkey").alias("driverkey"),
        "drivername",
        *[F.col(f"dim_{key}").alias(key) for key in LOOKUP_KEYS],
        F.col("dim_hiredate").alias("hiredate"),
        F.col("effdt").alias("firedate"),
        F.col("effdt").alias("effectivedate"),
        F.col("filedt").alias("loaddate"),
        _open_end().alias("expireddate"),
        F.lit(1).alias("current_record"),
    )


def compat_changed(dim: DataFrame, resolved: DataFrame) -> DataFrame:
    matched = _compat_matches(dim, resolved.where(_keys_found()), "CHANGE")
    flag = F.when(F.col("dim_current_record") == 1, F.lit(0))
    fields = ["firedate", "effectivedate", "loaddate", "expireddate", "current_record"]

    def version(*values: Column) -> Column:
        return F.struct(*[value.alias(name) for name, value in zip(fields, values)])

    old = version(
        F.col("dim_firedate"), F.col("dim_effectivedate"), F.col("dim_loaddate"), day_before(F.col("effdt")), flag
    )
    new = version(_open_end(), F.col("effdt"), F.col("filedt"), _open_end(), F.lit(1))
    return matched.select(
        F.col("dim_driverrecordkey").alias("driverrecordkey"),
        F.col("dim_driverkey").alias("driverkey"),
        "drivername",
        *LOOKUP_KEYS,
        F.col("dim_hiredate").alias("hiredate"),
        F.explode(F.array(old, new)).alias("version"),
    ).select(*DIMENSION[:7], "version.*")


def compat_update_dimension(dim: DataFrame, feed: DataFrame, lookups: Lookups) -> DataFrame:
    resolved = resolve_feed(feed, lookups)
    versions = (
        compat_unchanged(dim, feed)
        .unionByName(compat_fired(dim, resolved))
        .unionByName(compat_changed(dim, resolved))
        .unionByName(hired_versions(dim, resolved))
    )
    return number_rows(versions.drop("driverrecordkey"), "driverrecordkey", RECORD_ORDER).select(DIMENSION)


def dimension_as_text(dim: DataFrame) -> DataFrame:
    """The dimension with its dates as MM/dd/yyyy, for export."""
    dates = {field.name for field in dim.schema.fields if field.dataType.typeName() == "date"}
    return dim.select([date_text(F.col(c)).alias(c) if c in dates else F.col(c) for c in dim.columns])

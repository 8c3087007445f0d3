"""Coordinates from a gazetteer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchmart.functions import fixed_values as V
from dispatchmart.operators.joins import BROADCAST_ROWS, spread_join
from dispatchmart.operators.sets import mark_head, union_feeds

PLACE_KEY = ["street_address", "city", "state"]


def add_coordinates(pickups: DataFrame, gazetteer: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``latitude`` and ``longitude`` of each pickup's place, NULL when it is not listed.

    A place listed more than once counts once, with its smallest coordinates, so no
    pickup is doubled. Airports may hold most pickups; ``spread_join`` spreads them.
    """
    places = gazetteer.groupBy(PLACE_KEY).agg(
        F.min(F.struct(*[F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")])).alias("geo")
    )
    located = spread_join(pickups, places, PLACE_KEY, "left", max_rows, bound=gazetteer)
    return located.select(*pickups.columns, "geo.*")


def _moment(text: str) -> Column:
    """The time that a pickup's text tells, NULL when it tells none."""
    return F.coalesce(*[F.try_to_timestamp(F.col(text), F.lit(layout)) for layout in V.PICKUP_TIMES])


def geocode_feeds(
    feeds: list[DataFrame],
    gazetteer: DataFrame,
    budget: int | None = None,
    at: str = "datetime",
) -> DataFrame:
    """All feeds in one table with coordinates; under a ``budget`` only the first so many pickups of each get them.

    The first pickups are those of the earliest time in ``at``; ones without a readable time come before all others. The
    feeds are united before the join, so the gazetteer is read and sent out once. Pickups beyond a budget take no
    part in it.
    """
    if budget is None:
        return add_coordinates(union_feeds(*feeds), gazetteer)
    marked = union_feeds(*[mark_head(feed.withColumn("_at", _moment(at)), budget, ["_at", at]) for feed in feeds]).drop("_at")
    located = add_coordinates(marked.where("is_head").drop("is_head"), gazetteer)
    nowhere = {c: F.lit(None).cast("double") for c in ("latitude", "longitude")}
    return located.unionByName(marked.where("NOT is_head").drop("is_head").withColumns(nowhere))

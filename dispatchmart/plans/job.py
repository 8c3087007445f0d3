"""The whole job: pickups, messages, drivers and facts, second source.

Each stage is audited. A stage that fails does not load; later stages run on what
their tables hold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dispatchmart import schemas
from dispatchmart.operators.dimension import Lookups, dimension_as_text, update_dimension
from dispatchmart.operators.facts import add_pickup_keys, driver_bridge, facts_with_keys, pickups_without_driver
from dispatchmart.plans.messages import score_messages
from dispatchmart.plans.standardize import standard_pickups
from dispatchmart.sources.audit import run_committed_stage
from dispatchmart.sources.commits import Commit, Store
from dispatchmart.sources.loads import LoadCounts, load_in_commit, read_target, with_second_source, write_csv
from dispatchmart.sources.readers import read_messages


@dataclass(frozen=True)
class Inputs:
    """Paths of the arriving files."""

    location_feed: str
    free_text_feed: str
    split_field_feed: str
    messages: str
    second_source: str


@dataclass(frozen=True)
class Targets:
    """Where tables live: one folder with all of them, kept by its manifests."""

    root: str

    def __getitem__(self, table: str) -> str:
        return f"{self.root}/{table}"


FEEDS = ("location_feed", "free_text_feed", "split_field_feed", "second_source")


def read_feed(commit: Commit, path: str, schema: T.StructType, name: str) -> tuple[DataFrame, LoadCounts]:
    """An arriving file under the error budget of a load: its good rows, and how many were good and bad.

    Both kinds become tables of the commit. ``LoadRejected`` when there are too many bad ones.
    """
    counts = load_in_commit(commit, path, schema, f"accepted_{name}", f"quarantine_{name}")
    return commit.read(f"accepted_{name}"), counts


def load_pickups(commit: Commit, inputs: Inputs, budget: int | None = None) -> LoadCounts:
    location, first = read_feed(commit, inputs.location_feed, schemas.LOCATION_FEED, "location_feed")
    free_text, second = read_feed(commit, inputs.free_text_feed, schemas.FREE_TEXT_FEED, "free_text_feed")
    split, third = read_feed(commit, inputs.split_field_feed, schemas.SPLIT_FIELD_FEED, "split_field_feed")
    commit.replace("pickup_data", standard_pickups(location, free_text, split, commit.read("gazetteer"), budget))
    return first + second + third


def load_messages(commit: Commit, inputs: Inputs) -> LoadCounts:
    messages = read_messages(commit.store.spark, inputs.messages)
    return LoadCounts(commit.replace("tweet_analysis", score_messages(messages, commit.read("lexicon"))))


def load_drivers(commit: Commit, expand_facts: bool = False) -> LoadCounts:
    """New dimension next to the old one, its rejects, the pickups with their keys and the bridge to the drivers.

    ``expand_facts`` also writes every pickup with every driver, which grows as pickups times drivers.
    """
    lookups = Lookups(commit.read("shifttime_dim"), commit.read("coverage_dim"), commit.read("company_dim"))
    update = update_dimension(commit.read("driver_dim"), commit.read("driver_feed"), lookups)
    versions = commit.replace("driver_dim_updated", update.dimension)
    rejected = commit.replace("driver_feed_rejects", update.rejects)
    dimension = commit.read("driver_dim_updated")
    commit.replace("pickup_data_keyed", add_pickup_keys(commit.read("pickup_data")))
    keyed = commit.read("pickup_data_keyed")
    commit.replace("driver_bridge", driver_bridge(dimension))
    if expand_facts:
        commit.replace("pickup_data_withkeys", facts_with_keys(keyed, dimension))
    commit.replace("pickup_data_unserved", pickups_without_driver(keyed, dimension))
    return LoadCounts(versions, rejected)


def load_second_source(commit: Commit, inputs: Inputs) -> LoadCounts:
    second, counts = read_feed(commit, inputs.second_source, schemas.PICKUP, "second_source")
    commit.replace("pickupdata_with_anothersource", with_second_source(second, commit.read("pickup_data")))
    return counts


def export_dimension(spark: SparkSession, targets: Targets, path: str) -> None:
    """The dimension as CSV with a header and MM/dd/yyyy dates."""
    write_csv(dimension_as_text(read_target(spark, targets["driver_dim_updated"])), path)


def run_job(
    spark: SparkSession,
    inputs: Inputs,
    targets: Targets,
    budget: int | None = None,
    expand_facts: bool = False,
    run_id: str | None = None,
) -> DataFrame:
    """All stages in order, each with its audit row in one commit; returns the audit table.

    A job that broke off and is run again under its ``run_id`` passes over the stages that were published and finishes
    the one that was not.
    """
    store = Store(spark, targets.root)
    stages: list[tuple[str, Callable[[Commit], LoadCounts]]] = [
        ("Standardization", lambda commit: load_pickups(commit, inputs, budget)),
        ("Tweet", lambda commit: load_messages(commit, inputs)),
        ("SCD", lambda commit: load_drivers(commit, expand_facts)),
        ("Second source", lambda commit: load_second_source(commit, inputs)),
    ]
    evidence = tuple(f"quarantine_{name}" for name in FEEDS)
    for job_id, (stage, work) in enumerate(stages, start=1):
        commit_id = f"{run_id}-stage{job_id}" if run_id else None
        run_committed_stage(store, "audit", job_id, stage, work, commit_id, evidence)
    return read_target(spark, targets["audit"])

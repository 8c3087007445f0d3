"""Audit trail: one row per stage with start, end and outcome."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchmart.functions import fixed_values as V
from dispatchmart.schemas import AUDIT
from dispatchmart.sources.commits import Commit, Store
from dispatchmart.sources.loads import LoadCounts, LoadRejected, append_load

log = logging.getLogger(__name__)


def run_stage(spark: SparkSession, audit: str, job_id: int, stage: str, work: Callable[[], None]) -> bool:
    """Run a stage, its load included, and append its audit row; True when it succeeded.

    A stage that fails raises before it loads, so a target never receives the output
    of a failed stage. The failure is logged and recorded; whether later stages run
    is the caller's choice.
    """
    start = datetime.now(timezone.utc)
    try:
        work()
        outcome = "TRUE"
    except Exception:
        log.exception("stage %s failed", stage)
        outcome = f"FALSE ({stage})"
    end = datetime.now(timezone.utc)
    append_load(_row(spark, job_id, start, end, outcome), audit)
    return outcome == "TRUE"


def _row(
    spark: SparkSession, job_id: int, start: datetime, end: datetime, outcome: str, counts: LoadCounts | None = None
) -> DataFrame:
    loaded, rejected = (counts.loaded, counts.rejected) if counts else (None, None)
    return spark.createDataFrame([(job_id, start, end, outcome, loaded, rejected)], AUDIT)


def run_committed_stage(
    store: Store,
    audit: str,
    job_id: int,
    stage: str,
    work: Callable[[Commit], LoadCounts | None],
    commit_id: str | None = None,
    evidence: tuple[str, ...] = (),
) -> bool:
    """Run a stage whose loads and audit row become visible in one commit; True when it succeeded.

    ``work`` puts its loads into the commit and gives the rows its feeds had, as counted while they were written. A
    stage that fails changes no table but those named as ``evidence`` (a quarantine) and the audit. A
    stage that breaks off before the commit leaves nothing to be seen; run again under the same ``commit_id`` it
    goes on from the loads that were complete, and does nothing if it had been published.
    """
    start = datetime.now(timezone.utc)
    commit, counts = store.begin(commit_id), None
    if commit.already_published:
        return True
    try:
        counts = work(commit)
        outcome = "TRUE"
    except Exception as error:
        log.exception("stage %s failed", stage)
        outcome = f"FALSE ({stage})"
        counts = error.counts if isinstance(error, LoadRejected) else None
        failed, commit = commit, store.begin()
        commit.adopt(failed, list(evidence))
    end = datetime.now(timezone.utc)
    commit.append(audit, _row(store.spark, job_id, start, end, outcome, counts))
    commit.publish()
    return outcome == "TRUE"


def stage_durations(audit: DataFrame, counts: bool = False) -> DataFrame:
    """Audit rows with the time each stage took and the times as text; with the ``counts`` of its rows on request."""
    seconds = F.col("job_end_time").cast("double") - F.col("job_start_time").cast("double")
    return audit.select(
        "job_id",
        F.date_format("job_start_time", V.AUDIT_TIME_TEXT).alias("job_start_time"),
        F.date_format("job_end_time", V.AUDIT_TIME_TEXT).alias("job_end_time"),
        "job_completed",
        seconds.alias("seconds"),
        *(["rows_loaded", "rows_rejected"] if counts else []),
    )

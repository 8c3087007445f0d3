"""Leading terms of a message stream, from a summary of bounded size that is merged batch by batch.

The summary holds at most so many terms, each with the least and the greatest count it can have had so far, and a
bound for every term that it does not hold. A batch is counted exactly and merged: counts are added, a term new to the
summary may have occurred up to the bound before, and when there are too many terms those of the least possible counts go and
raise the bound. Whatever term may be among the leading ones is therefore in the summary. Where its counts do not tell
the order, the few candidates are counted in the stored messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchmart.functions import fixed_values as V
from dispatchmart.operators.terms import term_counts
from dispatchmart.sources.commits import Commit, Store

COUNTERS = 10_000
MESSAGES, SUMMARY, _BATCH, _BOUND = "messages", "leading_terms", "batch", "bound"
_SCHEMA = "term string, low long, high long"


def merge_batch(commit: Commit, messages: DataFrame, batch: int, counters: int = COUNTERS, text: str = "tweet") -> bool:
    """Store a batch of messages and bring the summary up to date in one commit; False if that was done before."""
    if batch <= commit.mark_of(_BATCH, -1):
        return False
    spark, bound = commit.store.spark, commit.mark_of(_BOUND, 0)
    commit.append(MESSAGES, messages)
    known = commit.read(SUMMARY) if commit.knows(SUMMARY) else spark.createDataFrame([], _SCHEMA)
    counted = term_counts(messages, text)
    merged = known.join(counted, "term", "full").select(
        "term",
        (F.coalesce("low", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("low"),
        (F.coalesce("high", F.lit(bound)) + F.coalesce("n", F.lit(0))).alias("high"),
    )
    # The first one left out has the greatest count of all that are: one top-n, no sort of the table.
    leading = merged.orderBy(F.desc("high"), "term").limit(counters + 1).checkpoint()
    kept = leading.orderBy(F.desc("high"), "term").limit(counters)
    dropped = leading.orderBy(F.desc("high"), "term").offset(counters).agg(F.max("high")).first()[0]
    commit.replace(SUMMARY, kept)
    commit.mark(_BOUND, max(bound, dropped or 0))
    commit.mark(_BATCH, batch)
    return True


def leading_terms(store: Store, k: int = V.LISTED_TERMS, text: str = "tweet") -> DataFrame:
    """The ``k`` most frequent terms of all batches with their exact counts; equal counts in alphabetical order."""
    summary, bound = store.read(SUMMARY), store.snapshot().marks.get(_BOUND, 0)
    least = summary.orderBy(F.desc("low")).limit(k).agg(F.count("*"), F.min("low")).first()
    if least[0] == k and least[1] <= bound or least[0] < k and bound:
        raise ValueError(f"a summary of so few terms does not tell the {k} leading ones")
    candidates = summary.where(F.col("high") >= (least[1] or 0)) if least[0] == k else summary
    if candidates.where("low <> high").isEmpty():
        exact = candidates.select("term", F.col("low").alias("n"))
    else:
        counts = term_counts(store.read(MESSAGES), text)
        exact = counts.join(F.broadcast(candidates.select("term")), "term")  # no more than the summary holds
    return exact.orderBy(F.desc("n"), "term").limit(k).select("term", "n")


def follow_terms(
    messages: DataFrame, store: Store, checkpoint: str, counters: int = COUNTERS, text: str = "tweet"
) -> None:
    """Merge what has arrived and stop; the next run goes on from the checkpoint."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        commit = store.begin()
        batch.persist()
        if merge_batch(commit, batch, batch_id, counters, text):
            commit.publish()
        batch.unpersist()

    query = messages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

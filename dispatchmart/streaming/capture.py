"""Capture of messages about taxis from a record stream."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dispatchmart.functions import fixed_values as V
from dispatchmart.functions.messages import mentions
from dispatchmart.sources.commits import Store

_TABLE, _BATCH, _TOTAL = "messages", "batch", "captured"


def captured_messages(
    records: DataFrame,
    keywords: tuple[str, ...] = V.CAPTURE_WORDS,
    languages: tuple[str, ...] = V.CAPTURE_LANGUAGES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``created_at`` and the full text of records that mention a keyword in a language.

    Works on a stream and on a table alike. ``keep`` names further columns, such as
    ``is_retweet``.
    """
    text = F.coalesce(F.col("extended_tweet.full_text"), F.col("text"))
    messages = records.withColumns({"tweet": text, "is_retweet": F.col("retweeted_status").isNotNull()})
    chosen = messages.where(F.col("lang").isin(*languages) & mentions(F.col("tweet"), keywords))
    return chosen.select("created_at", "tweet", *keep)


def start_capture(messages: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append what has arrived to ``path`` and stop; the next run goes on from the checkpoint.

    ``csv`` writes one ``created_at~text`` line per message, so line breaks inside a
    text become spaces there.
    """
    if fmt == "csv":
        messages = messages.withColumn("tweet", F.regexp_replace("tweet", r"[\r\n]+", " "))
    writer = messages.writeStream.format(fmt).outputMode("append").trigger(availableNow=True)
    if fmt == "csv":
        spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer = writer.options(sep="~", escape='"', **spaces)
    return writer.option("checkpointLocation", checkpoint).start(path)


def run_bounded_capture(messages: DataFrame, path: str, checkpoint: str, limit: int) -> DataFrame:
    """Capture at most ``limit`` messages in all, over any number of runs; the stream ends when there are so many.

    The running total is published with the rows of each micro-batch, beside the number of the batch (``commits``). So a
    batch reads nothing that was captured before, and one that is repeated after a failure neither doubles nor drops
    a message.
    """
    spark = messages.sparkSession
    store, full = Store(spark, path), threading.Event()
    if not store.has(_TABLE):
        first = store.begin()
        first.replace(_TABLE, spark.createDataFrame([], messages.schema))
        first.publish()

    def keep_first(batch: DataFrame, batch_id: int) -> None:
        commit = store.begin()
        total = commit.mark_of(_TOTAL, 0)
        if batch_id > commit.mark_of(_BATCH, -1) and total < limit:
            total += commit.append(_TABLE, batch.orderBy("created_at", "tweet").limit(limit - total))
            commit.mark(_TOTAL, total)
            commit.mark(_BATCH, batch_id)
            commit.publish()
        if total >= limit:
            full.set()

    query = (
        messages.writeStream.foreachBatch(keep_first)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    while not query.awaitTermination(1):
        if full.is_set():
            query.stop()
    return store.read(_TABLE)

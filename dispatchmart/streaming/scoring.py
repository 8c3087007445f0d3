"""Scoring of captured messages, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchmart.functions import fixed_values as V
from dispatchmart.operators.sentiment import fits_in_row, message_facts
from dispatchmart.operators.terms import add_tag, top_terms


def fit_leading_terms(messages: DataFrame, k: int = V.TAG_TERMS, text: str = "tweet") -> list[str]:
    """The ``k`` leading terms of messages at hand, to tag a stream with."""
    return [row.term for row in top_terms(messages, k, text).collect()]


def run_scoring(
    messages: DataFrame, leading: list[str], lexicon: DataFrame, path: str, checkpoint: str, key: str | None = None
) -> DataFrame:
    """Tag and score a message stream with fitted terms, one folder per micro-batch.

    A repeated batch replaces its own folder. The lexicon is measured once, before the
    stream starts, and a batch is read from the stream once.
    """
    spark = messages.sparkSession
    small = fits_in_row(lexicon)
    terms = F.array(*[F.lit(term) for term in leading]).cast("array<string>")

    def score(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        facts = message_facts(add_tag(batch, terms), lexicon, key=key, small=small)
        facts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    query = (
        messages.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.option("basePath", path).parquet(path).drop("batch")

"""Small helpers that several operators share."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import dispatchmart
from dispatchmart.session import scratch_path

WORD_GAPS = "[\\x20\\x09-\\x0D]+"
"""What separates words: blanks and the five ASCII control characters from tab to carriage return."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to the Python workers, wherever they run; once for each application.

    The archive is made where the driver runs and is sent from there; executors read no folder of the driver.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(dispatchmart.__file__).parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/dispatchmart", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text becomes an empty one.

    All other columns are left behind before any work, so their names cannot clash.
    """
    ship_package(docs.sparkSession)
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


ROWS_PER_TASK = 50_000


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` short rows, in no more tasks than these are worth; large tables stay as they are."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def saved(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read back: the lineage is cut.

    ``rows`` is about how many rows it has, if that is known.
    """
    path = scratch_path(df.sparkSession, "saved")
    (df if rows is None else in_few_tasks(df, rows)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_texts(rows: DataFrame, per_batch: Callable[[list, Iterator[str]], dict], schema: str) -> DataFrame:
    """Apply ``per_batch(ids, texts)`` to Arrow batches of a ``doc_id, text`` table.

    It returns one list or array for each column of ``schema``. Texts are handed over one by one, so a
    batch of very long texts is never held a second time.
    """
    fields = [part.split() for part in schema.split(", ")]
    kinds = {
        "long": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "string": pa.string(),
        "boolean": pa.bool_(),
        "binary": pa.binary(),
        "array<int>": pa.list_(pa.int32()),
        "array<long>": pa.list_(pa.int64()),
        "array<float>": pa.list_(pa.float32()),
    }

    def run(batches):
        for batch in batches:
            texts = (value.as_py() for value in batch.column("text"))
            columns = per_batch(batch.column("doc_id").to_pylist(), texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[name], kinds[kind]) for name, kind in fields], [name for name, _ in fields]
            )

    return rows.select("doc_id", "text").mapInArrow(run, schema)

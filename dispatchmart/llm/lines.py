"""Lines that many documents share are dropped everywhere but in one of them.

Texts are split at ``\\n``. A line's key is the line without blanks at its ends and with A-Z lower-cased; keys
of fewer code points than ``min_chars`` are left alone. Keys travel as 128-bit hashes. Of each key a task keeps the
``min_docs`` largest document identifiers only: that tells whether so many documents hold it and which is the last
of them, and it makes a line of every document a handful of rows before the one shuffle. The keys decided on
meet the lines again, and each document gets the set of what it loses; both joins are left to Spark, which broadcasts
the side of measured small size and shuffles otherwise. The text is then reassembled by position.

Defined results: a null or empty text is one empty line; a text of any length is one value, its lines are looked at
one by one; rows that repeat a ``doc_id`` are one document with several texts, each returned with what is left of it; rows
without an identifier are together one document below all others (that of -2^63); a key's lines stay, all of them,
in the largest document that holds it; an empty table gives an empty one; columns besides the identifier and
the text are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchmart.llm.common import id_and_text, saved

MIN_CHARS = 20
MIN_DOCS = 3
KEYS_AT_ONCE = 100_000
"""Keys whose documents a task remembers before it hands them on. Bounds memory, not results."""

_BLANKS = b" \t\n\x0b\x0c\r"
_NO_ID = -(2**63)


def hashed_lines(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line of a text the hash of its key, or None if the key is too short."""
    import xxhash

    digest, hashes = xxhash.xxh3_128_digest, []
    for line in text.lower().split(b"\n"):  # bytes: A-Z only
        key = line.strip(_BLANKS)
        long_enough = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        hashes.append(digest(key) if long_enough else None)
    return hashes


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def _texts(batch: pa.RecordBatch):
    return (value.as_py() for value in batch.column("text").cast(pa.binary()))


def last_documents(docs: DataFrame, min_chars: int, min_docs: int, keys_at_once: int = KEYS_AT_ONCE) -> DataFrame:
    """``key, owner``: for each key and task the largest documents that hold it, ``min_docs`` at most."""

    def emit(held):
        rows = [(key, owner) for key, owners in held.items() for owner in owners]
        keys, owners = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owners, pa.int64())], ["key", "owner"])

    def run(batches):
        held: dict[bytes, tuple] = {}
        for batch in batches:
            for owner, text in zip(_column(batch, "owner"), _texts(batch)):
                for key in set(hashed_lines(text, min_chars)) - {None}:
                    owners = held.get(key, ())
                    if owner not in owners:
                        held[key] = tuple(sorted((*owners, owner))[-min_docs:])
                if len(held) >= keys_at_once:
                    yield emit(held)
                    held = {}
        yield emit(held)

    return docs.select("owner", "text").mapInArrow(run, "key binary, owner long")


def shared_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``key, keeper``: keys that at least ``min_docs`` documents hold, and the largest of these."""
    held = last_documents(docs, min_chars, min_docs).repartition("key")
    counted = held.groupBy("key").agg(F.count_distinct("owner").alias("_docs"), F.max("owner").alias("keeper"))
    return counted.where(F.col("_docs") >= min_docs).select("key", "keeper")


def _losses(docs: DataFrame, shared: DataFrame, min_chars: int) -> DataFrame:
    """``owner, print, lost``: the keys each text loses."""

    def run(batches):
        for batch in batches:
            keys, owners, prints = [], [], []
            for owner, mark, text in zip(_column(batch, "owner"), _column(batch, "print"), _texts(batch)):
                own = set(hashed_lines(text, min_chars)) - {None}
                keys += own
                owners += [owner] * len(own)
                prints += [mark] * len(own)
            columns = [pa.array(keys, pa.binary()), pa.array(owners, pa.int64()), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "owner", "print"])

    held = docs.mapInArrow(run, "key binary, owner long, print long")
    lost = held.join(shared, "key").where("owner <> keeper")
    return lost.groupBy("owner", "print").agg(F.collect_set("key").alias("lost"))


def drop_shared_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: each text without the lines it loses."""
    rows = id_and_text(docs, id_col, text_col)
    # What a document loses depends on its identifier and keys alone, so texts of equal print may share a set.
    rows = rows.withColumn("owner", F.coalesce("doc_id", F.lit(_NO_ID))).withColumn("print", F.xxhash64("text"))
    shared = saved(shared_lines(rows, min_chars, min_docs))
    losses = saved(_losses(rows, shared, min_chars))

    def run(batches):
        for batch in batches:
            sizes, dropped, kept = [], [], []
            for text, lost in zip(_texts(batch), _column(batch, "lost")):
                lines = text.split(b"\n")
                sizes.append(len(lines))
                if lost:
                    gone = set(lost)
                    lines = [line for line, key in zip(lines, hashed_lines(text, min_chars)) if key not in gone]
                dropped.append(sizes[-1] - len(lines))
                kept.append(b"\n".join(lines).decode("utf-8", "replace"))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "text"])

    marked = rows.join(losses, ["owner", "print"], "left").select("doc_id", "text", "lost")
    return marked.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text string")

"""The driver dimension kept up to date feed by feed, without rewriting what a feed does not touch.

The dimension is cut into buckets by the driver's natural key, the name, which is what a feed knows. A batch reads and writes only the
buckets of its names. Buckets hold the current versions; the versions that a batch closes are appended, once and for all, so
history is neither read nor written again. Driver keys come from a registry and record keys from number blocks, so a version keeps
both for good. The batch number is published with the rows: a batch that is applied again, or that a restarted stream sends again,
changes nothing. Batches are to follow each other in time for each driver, as late events are rejected.

Names are not unique: a HIRED row is a new driver even when a current one has its name, and later events of the name apply to
all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dispatchmart.operators import dimension as D
from dispatchmart.operators.registry import BUCKET, BUCKETS, bucket_of, buckets_in, number_in_blocks, register
from dispatchmart.session import stored
from dispatchmart.sources.commits import Commit, Store

DIMENSION, REJECTS, DRIVERS, FEED = "driver_dim", "driver_feed_rejects", "driver_keys", "driver_feed"
_RECORDS = f"{DIMENSION}.records"
_HIRE = ["drivername", *D.LOOKUP_KEYS, "effectivedate", "loaddate"]


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, bucket_of(["drivername"], buckets))


def create_dimension(store: Store, dim: DataFrame, buckets: int = BUCKETS) -> None:
    """The dimension as it is, cut into buckets; numbers go on behind its largest keys."""
    commit = store.begin()
    rows = _bucketed(dim.select(D.DIMENSION), buckets).repartition(BUCKET)
    commit.replace_parts(DIMENSION, rows, BUCKET, [str(bucket) for bucket in range(buckets)])
    keys = commit.read(DIMENSION).agg(F.max("driverkey"), F.max("driverrecordkey")).first()
    commit.mark(f"{DRIVERS}.last", keys[0] or 0)
    commit.mark(_RECORDS, keys[1] or 0)
    commit.publish()


def _hired(commit: Commit, resolved: DataFrame, buckets: int) -> DataFrame:
    rows = D.hired_rows(resolved)
    numbers = register(commit, DRIVERS, rows.select(_HIRE), buckets)
    same = [rows[c].eqNullSafe(numbers[c]) for c in _HIRE]
    return rows.join(numbers, same).select(numbers["number"].alias("driverkey"), rows["*"]).select(D.DIMENSION)


def apply_batch(store: Store, feed: DataFrame, lookups: D.Lookups, batch: int, buckets: int = BUCKETS) -> bool:
    """Apply a batch of the feed; False if it had been applied before."""
    commit = store.begin(f"{FEED}-{batch}")
    if commit.already_published or batch <= commit.mark_of(FEED, -1):
        return False
    resolved = D.resolve_feed(feed, lookups)
    touched = buckets_in(_bucketed(resolved, buckets))
    dim = commit.read(DIMENSION, touched)
    known = dim.unionByName(_hired(commit, resolved, buckets))
    versions = D.versions_of(known, resolved)
    unnumbered = F.coalesce(F.col("driverrecordkey") == D.UNNUMBERED, F.lit(False))
    rows = stored(_bucketed(versions.rows, buckets).withColumn("_new", F.col("later") + unnumbered.cast("int")), "versions")
    order = ["driverkey", "effectivedate", *[c for c in D.DIMENSION if c not in ("driverkey", "effectivedate")]]
    numbered, last = number_in_blocks(rows.where("_new > 0"), "_number", order, commit.mark_of(_RECORDS, 0), each="_new")
    first = F.when(unnumbered, F.col("_number")).otherwise(F.col("driverrecordkey"))
    grown = D.expanded(numbered, versions.chains, first, F.col("_number") - F.when(unnumbered, 0).otherwise(1))
    grown = rows.where("_new = 0").select(D.DIMENSION).unionByName(grown)
    current = F.coalesce(F.col("current_record") == 1, F.lit(False))
    commit.replace_parts(DIMENSION, _bucketed(grown.where(current), buckets).repartition(BUCKET), BUCKET, touched)
    commit.append(DIMENSION, grown.where(~current))
    commit.append(REJECTS, D.rejected_rows(known, resolved).withColumn("batch", F.lit(batch).cast("long")))
    commit.mark(_RECORDS, last)
    commit.mark(FEED, batch)
    commit.publish()
    return True


def follow_feed(
    events: DataFrame, store: Store, lookups: D.Lookups, state: str, buckets: int = BUCKETS
) -> StreamingQuery:
    """Apply a streaming feed batch by batch until it is used up; ``state`` is the stream's checkpoint folder."""

    def apply(batch_rows: DataFrame, batch: int) -> None:
        apply_batch(store, batch_rows, lookups, batch, buckets)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start()

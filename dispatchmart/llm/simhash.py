"""SimHash near-duplicates, found by a grid join of segment bit counts.

A fingerprint of 64 bits is cut into segments of two bits, and each segment is replaced by the number of its set
bits. The Manhattan distance of two such count vectors is never above the number of differing bits, so pairs beyond
the allowed number in the one are beyond it in the other. Of the two halves of a vector at least one differs by half
the allowed number at most (by 1 for 3 bits). Each half is a point of a grid of unit cells: a point with an even sum
visits all cells at distance 1, the others stay, so any two points at distance 0 or 1 meet in one cell, once. Those
that meet are compared exactly.

Equal fingerprints are one before any of this. Within a cell only a spanning forest of the links is emitted, not
every pair. A cell with many points is divided into blocks of bounded size that meet block by block.

Defined results: a null or empty text, or one without words, has the fingerprint zero and is linked like any other; fewer words than
a shingle has make one shingle; equal texts share a fingerprint and thus a group; rows without an identifier have a
fingerprint and no group, and link nothing; an empty table gives an empty one; ``link`` reads the identifier and the
text only, ``one_of_each`` keeps every column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchmart.llm.common import id_and_text, in_few_tasks, map_texts, saved
from dispatchmart.llm.components import connected_components
from dispatchmart.operators.joins import fits_broadcast, lookup_join

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
BLOCK = 4096
"""Points of one cell that a task compares with each other at a time."""

_SMALL_CELL = 16
_ODD_BITS = 0x5555555555555555
_HALF = (1 << 32) - 1


def shingle_hashes(text: str, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The hash of every shingle of a text in order, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        starts, ends = [0], [len(joined)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-shingle_words] + 1]).tolist()
        ends = ends[shingle_words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), "<u8", len(starts))


def majority_bits(hashes: np.ndarray) -> int:
    """64 bits, each set if it is in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64 majority bits of the hashes of a text's shingles, repeats included."""
    return majority_bits(shingle_hashes(text, shingle_words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, bits``: the fingerprint of every whole text, as a signed number."""

    def per_batch(doc_ids, texts):
        return {"doc_id": doc_ids, "bits": np.array([fingerprint(text) for text in texts], np.uint64).view(np.int64)}

    return map_texts(id_and_text(docs, id_col, text_col), per_batch, "doc_id long, bits long")


def _segment_counts(bits: Column) -> Column:
    """32 counts of two bits each, side by side in one number."""
    odd = F.lit(_ODD_BITS)
    low, high = bits.bitwiseAND(odd), F.shiftrightunsigned(bits, 1).bitwiseAND(odd)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # no sum: it might overflow


def _grid_rows(points: DataFrame) -> DataFrame:
    """``cell, visitor, bits, rep``: each point in its own cell of either half, and as a visitor around it."""
    counts = points.withColumn("_counts", _segment_counts(F.col("bits")))
    halves = F.array(
        *[
            F.struct(F.lit(half).alias("half"), F.shiftrightunsigned("_counts", 32 * half).bitwiseAND(F.lit(_HALF)).alias("at"))
            for half in (0, 1)
        ]
    )
    placed = counts.select("bits", "rep", F.explode(halves).alias("_h")).select("bits", "rep", "_h.*")
    # A count of two bits is 0, 1 or 2: it goes up unless its high bit is set and down unless both are clear.
    moves = []
    for segment in range(16):
        count = F.shiftrightunsigned("at", 2 * segment).bitwiseAND(F.lit(3))
        moves.append(F.when(count < 2, F.col("at") + (1 << (2 * segment))))
        moves.append(F.when(count > 0, F.col("at") - (1 << (2 * segment))))
    total = F.bit_count(F.col("at").bitwiseAND(F.lit(_ODD_BITS & _HALF)))  # parity of the sum: twos do not matter
    around = F.when(total % 2 == 0, F.array_compact(F.array(*moves))).otherwise(F.array().cast("array<bigint>"))
    cells = F.concat(F.array(F.col("at")), around)
    rows = placed.select("bits", "rep", "half", F.posexplode(cells).alias("_i", "_cell"))
    cell = F.shiftleft(F.col("half").cast("long"), 32).bitwiseOR(F.col("_cell"))
    return rows.select(cell.alias("cell"), (F.col("_i") > 0).cast("int").alias("visitor"), "bits", "rep")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows with a ``block``: crowded cells are divided, and what a block must meet is copied to it.

    Only own points count; they are few per cell unless texts are alike. A point of block i meets those of later
    blocks as a visitor there, and a visitor meets every block.
    """
    own = rows.where("visitor = 0").groupBy("cell").agg(F.count("*").alias("_n"))
    crowded = saved(own.where(F.col("_n") > block).select("cell", F.ceil(F.col("_n") / block).cast("int").alias("_of")))
    calm = lookup_join(rows, crowded, ["cell"], "left_anti").withColumn("block", F.lit(0))
    busy = lookup_join(rows, crowded, ["cell"])
    home = F.pmod(F.xxhash64("bits"), F.col("_of")).cast("int")
    first = F.when(F.col("visitor") == 1, F.lit(0)).otherwise(home)
    busy = busy.withColumn("block", F.explode(F.sequence(first, F.col("_of") - 1)))
    visits = F.greatest(F.col("visitor"), (F.col("block") != home).cast("int"))
    return calm.unionByName(busy.withColumn("visitor", visits).drop("_of"))


def _pairs_of_small(cell, visitor, bits, rep, max_bits):
    """Links in cells of few points: point i against point i + 1, i + 2, ... of the same cell, all cells at once."""
    for step in range(1, _SMALL_CELL):
        if step >= len(cell):
            return
        near = cell[:-step] == cell[step:]
        if not near.any():
            return
        near &= (visitor[:-step] == 0) | (visitor[step:] == 0)
        at = np.flatnonzero(near)
        at = at[np.bitwise_count(bits[at] ^ bits[at + step]) <= max_bits]
        yield rep[at], rep[at + step]


def _forest(visitor, bits, rep, max_bits):
    """A spanning forest of the links of one cell: each point found is not looked for again.

    Visitors are compared with own points only; they meet each other elsewhere.
    """
    order = np.argsort(visitor, kind="stable")
    bits, rep, owners = bits[order], rep[order], int((visitor == 0).sum())
    waiting_own, waiting_all = np.arange(owners), np.arange(owners, len(bits))
    found_a, found_b = [], []
    while len(waiting_own):
        stack, waiting_own = [int(waiting_own[0])], waiting_own[1:]
        while stack:
            point = stack.pop()
            near = np.bitwise_count(bits[waiting_own] ^ bits[point]) <= max_bits
            linked, waiting_own = waiting_own[near], waiting_own[~near]
            if point < owners:
                near = np.bitwise_count(bits[waiting_all] ^ bits[point]) <= max_bits
                linked, waiting_all = np.concatenate([linked, waiting_all[near]]), waiting_all[~near]
            stack += linked.tolist()
            found_a.append(np.full(len(linked), rep[point]))
            found_b.append(rep[linked])
    return np.concatenate(found_a or [rep[:0]]), np.concatenate(found_b or [rep[:0]])


def _links_of(cell, visitor, bits, rep, max_bits):
    """Links in complete cells; the arrays are sorted by cell."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, len(cell)))
    small = np.repeat(sizes <= _SMALL_CELL, sizes)
    yield from _pairs_of_small(cell[small], visitor[small], bits[small], rep[small], max_bits)
    for i in np.flatnonzero(sizes > _SMALL_CELL):
        part = slice(starts[i], starts[i] + sizes[i])
        yield _forest(visitor[part], bits[part], rep[part], max_bits)


def _link_cells(max_bits: int, block: int):
    """Links of a partition sorted by cell: a cell may go on in the next batch, where its rows are carried to."""

    def run(batches):
        carried = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("cell", "block", "visitor", "bits", "rep")]
            if carried is not None:
                rows = [np.concatenate(both) for both in zip(carried, rows)]
            if not len(rows[0]):
                continue
            _, _, visitor, bits, rep = rows
            name = (rows[0] << 25) | rows[1]  # a cell has 33 bits
            other = np.flatnonzero(name != name[-1])
            last = int(other[-1]) + 1 if len(other) else 0
            ready = slice(0, last)
            if last:
                for a, b in _links_of(name[ready], visitor[ready], bits[ready].view(np.uint64), rep[ready], max_bits):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            carried = [column[last:] for column in rows]
            if len(carried[0]) > 4 * block:
                # A long cell: its visitors so far are done with, its own points stay for those to come.
                a, b = _forest(carried[2], carried[3].view(np.uint64), carried[4], max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                carried = [column[carried[2] == 0] for column in carried]
        if carried is not None and len(carried[0]):
            name = (carried[0] << 25) | carried[1]
            for a, b in _links_of(name, carried[2], carried[3].view(np.uint64), carried[4], max_bits):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def near_links(points: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``a, b``: enough links between points ``bits, rep`` to connect all that differ in at most ``max_bits`` bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("halves of the count vectors are joined within distance 1: at most 3 bits")
    rows = _blocks(_grid_rows(points), block)
    sorted_cells = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "visitor")
    return sorted_cells.select("cell", "block", "visitor", "bits", "rep").mapInArrow(
        _link_cells(max_bits, block), "a long, b long"
    )


def link(
    docs: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, bits, component_id``: the smallest identifier that links lead to, its own included."""
    prints = saved(fingerprints(docs, id_col, text_col))
    n = prints.count()
    points = saved(prints.where("doc_id IS NOT NULL").groupBy("bits").agg(F.min("doc_id").alias("rep")), rows=n)
    groups = connected_components(near_links(points, max_bits, block))
    named = points.join(groups, points["rep"] == groups["node"], "left").select(
        "bits", F.coalesce("component", "rep").alias("component_id")
    )
    joined = prints.join(named, "bits", "left").select(
        "doc_id", "bits", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
    return in_few_tasks(joined, n)


def as_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None
) -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of its group, with all their columns.

    ``groups`` has ``doc_id, component_id``; without it they are those of ``link``. Of several rows with one identifier
    one stays; rows without an identifier stay.
    """
    groups = link(docs, id_col=id_col, text_col=text_col) if groups is None else groups
    ids = saved(
        groups.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("component_id").alias("_first"), F.count("*").alias("_rows"))
        .where(F.col("doc_id") == F.col("_first"))
        .select(F.col("doc_id").alias("_kept"), "_rows")
    )
    # Identifiers are few bytes each: sent to every task if measured small, else joined by their hash.
    once, repeated = ids.where("_rows = 1"), ids.where("_rows > 1")
    small = fits_broadcast(ids)

    def rows_of(wanted: DataFrame) -> DataFrame:
        # Both sides are named by their table: columns of docs may have any name.
        same = docs[f"`{id_col}`"].cast("long") == wanted["_kept"]
        return docs.join(F.broadcast(wanted) if small else wanted, same, "left_semi")

    kept = rows_of(once)
    if not repeated.isEmpty():
        kept = kept.unionByName(rows_of(repeated).dropDuplicates([id_col]))
    return kept.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))

"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, in groups.

At that similarity two fingerprints of 64 bits differ in ten bits on average, too many for a grid of bit counts alone:
its cells would have to be so wide that most texts meet. So links are looked for in three passes, each of which
compares what the passes before have not connected:

1. the grid of segment bit counts (``simhash.near_links``), for fingerprints that differ in three bits at most;
2. cells named by the smallest hashes of the shingles (``BANDS`` cells of ``ROWS`` hashes each): every text against
   the first text of each of its cells;
3. in cells that still hold several groups, every text against those of other groups: pair by pair in cells of up to
   ``CROWD`` texts, in larger ones block by block inside a task, from which only links that join groups come.

Pairs that sizes or fingerprints rule out are not made (``FAR_BITS``). All others are verified exactly, on the
shingles of the whole texts. Two texts of similarity s share a cell with probability 1 - (1 - s^ROWS)^BANDS: 0.998 at
0.8, and more above. Texts with the same set of shingles are one before any of this, so copies are never paired. A large
group of near copies is connected by the first two passes, where a text is paired once with the first of a cell. Texts
of a large cell that are alike but below the similarity are still all compared: the time for a cell grows with its texts
times those outside its largest group, the rows made do not.

Defined results: a null or empty text, or one without words, is grouped with its like; fewer words than a shingle has
make one shingle; rows of one identifier are one document, linked if any text of it is; rows without an identifier
are in no group; an empty table gives an empty one; texts are read whole, however long; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchmart.llm.common import id_and_text, in_few_tasks, map_texts, saved
from dispatchmart.llm.components import connected_components
from dispatchmart.llm.simhash import BLOCK, majority_bits, near_links, one_of_each, shingle_hashes
from dispatchmart.operators.joins import BROADCAST_BYTES, lookup_join, spread_join

SHINGLE_WORDS = 5
SIMILARITY = 0.8

BANDS, ROWS = 12, 4

FAR_BITS = 24
"""Fingerprints that differ in more bits are not compared: five deviations above the mean at a similarity of 0.8."""

PAIRS_PER_TASK = 256

CROWD = 32
"""A cell with more texts is compared block by block."""

BLOCK_SHINGLES, MOST_SHINGLES = 1 << 15, 1 << 20
"""A block has about so many shingles, and up to the second number where a cell would have over ``CELL_BLOCKS`` blocks."""

CELL_BLOCKS = 64
MEETINGS_PER_TASK = 4

_CHUNK = 4096
_MULTIPLIERS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _cells(shingles: np.ndarray) -> list[int]:
    """The names of a text's cells, from the smallest of its shingle hashes in ``BANDS * ROWS`` orders."""
    import xxhash

    if not len(shingles):
        return []
    least = np.full(len(_MULTIPLIERS), ~np.uint64(0))
    for at in range(0, len(shingles), _CHUNK):
        np.minimum(least, np.multiply.outer(_MULTIPLIERS, shingles[at : at + _CHUNK]).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(band.tobytes(), number) - (1 << 63) for number, band in enumerate(bands)]


def sketches(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, shape, n, bits, cells`` of every whole text.

    ``shape`` is a 128-bit hash of the set of shingles, ``n`` the size of that set.
    """

    def per_batch(doc_ids, texts):
        import xxhash

        columns = {"doc_id": doc_ids, "shape": [], "n": [], "bits": [], "cells": []}
        for text in texts:
            hashes = shingle_hashes(text, shingle_words)
            shingles = np.unique(hashes)
            columns["shape"].append(xxhash.xxh128_digest(shingles.tobytes()))
            columns["n"].append(len(shingles))
            columns["bits"].append(majority_bits(hashes))
            columns["cells"].append(_cells(shingles))
        columns["bits"] = np.array(columns["bits"], np.uint64).view(np.int64)
        return columns

    schema = "doc_id long, shape binary, n long, bits long, cells array<long>"
    return map_texts(id_and_text(docs, id_col, text_col), per_batch, schema)


def _similar(similarity: float, shingle_words: int):
    """Pairs of texts whose sets of shingles are similar; of equal neighbours ``a`` is cut into shingles once."""

    def run(batches):
        last, shingles = None, None
        for batch in batches:
            links = []
            columns = [batch.column(c) for c in ("a", "b", "text_a", "text_b")]
            for a, b, text_a, text_b in zip(*columns):
                text = text_a.as_py()
                if text != last:
                    last, shingles = text, np.unique(shingle_hashes(text, shingle_words))
                others = np.unique(shingle_hashes(text_b.as_py(), shingle_words))
                both = len(np.intersect1d(shingles, others, assume_unique=True))
                if both >= similarity * (len(shingles) + len(others) - both):
                    links.append((a.as_py(), b.as_py()))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    return run


def verified(pairs: DataFrame, rows: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """The ``a, b`` whose texts are similar, written as a table; only texts of a pair are shuffled, never all."""
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = saved(lookup_join(rows.where("doc_id IS NOT NULL"), ids, ["doc_id"], "left_semi"))
    # Pairs are a few bytes each, but their texts are not: they are dealt by number. One text may be in very many pairs.
    dealt = pairs.repartition(max(1, -(-pairs.count() // PAIRS_PER_TASK)), "a", "b")
    with_b = spread_join(dealt, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), ["b"])
    both = spread_join(with_b, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), ["a"])
    compared = both.select("a", "b", "text_a", "text_b").mapInArrow(_similar(similarity, shingle_words), "a long, b long")
    return saved(compared)


def _may_be_similar(of: str, other: str, similarity: float):
    """What the sizes and the fingerprints of two texts allow."""
    n, m = F.col(f"{of}.n"), F.col(f"{other}.n")
    sizes = F.least(n, m) >= similarity * F.greatest(n, m)
    return sizes & (F.bit_count(F.col(f"{of}.bits").bitwiseXOR(F.col(f"{other}.bits"))) <= FAR_BITS)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _firsts(members: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: every member of a cell with the first of its cell."""
    first = members.groupBy("cell").agg(F.min(F.struct("rep", "n", "bits")).alias("first"), F.count("*").alias("size"))
    first = first.where("size > 1").select("cell", "first.*").alias("first")
    meeting = members.alias("other").join(first, F.col("first.cell") == F.col("other.cell"))
    meeting = meeting.where(_may_be_similar("first", "other", similarity))
    return _ordered(meeting.select(F.col("first.rep").alias("a"), F.col("other.rep").alias("b")))


def _across(members: DataFrame, groups: DataFrame, similarity: float, crowd: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left to compare in cells that hold several groups.

    ``a, b``: members of one cell that are in different groups, in cells of at most ``crowd`` members, which make no more
    than ``crowd`` pairs for each of them; ``cell, block, rep, component``: the members of all larger cells; ``cell, x, y``:
    their blocks that hold more than the largest group of the cell, each with itself and all before it.
    """
    named = lookup_join(members, groups.select(F.col("node").alias("rep"), "component"), ["rep"], "left")
    named = saved(named.withColumn("component", F.coalesce("component", "rep")))
    weights = named.groupBy("cell", "component").agg(F.sum("n").alias("_n"), F.count("*").alias("_size"))
    cells = weights.groupBy("cell").agg(
        F.count("*").alias("_groups"),
        F.sum("_size").alias("_size"),
        F.sum("_n").alias("_n"),
        F.max(F.struct("_n", "component")).alias("_giant"),
    )
    open_cells = saved(cells.where("_groups > 1").select("cell", "_size", "_n", "_giant"))

    calm = lookup_join(named, open_cells.where(F.col("_size") <= crowd).select("cell"), ["cell"])
    own, any_ = calm.alias("own"), calm.alias("any")
    once = (F.col("own.cell") == F.col("any.cell")) & (F.col("own.rep") < F.col("any.rep"))
    apart = F.col("own.component") != F.col("any.component")
    pairs = own.join(any_, once & apart & _may_be_similar("own", "any", similarity))
    pairs = _ordered(pairs.select(F.col("own.rep").alias("a"), F.col("any.rep").alias("b")))

    def blocks_of(n):
        return F.least(F.ceil(n / BLOCK_SHINGLES), F.greatest(F.lit(CELL_BLOCKS), F.ceil(n / MOST_SHINGLES))).cast("int")

    crowded = open_cells.where(F.col("_size") > crowd).select(
        "cell",
        F.col("_giant.component").alias("_giant"),
        blocks_of(F.col("_giant._n")).alias("_low"),
        blocks_of(F.col("_n") - F.col("_giant._n")).alias("_of"),
    )
    crowded = saved(crowded)
    # Members of the largest group are in the first blocks, which do not meet each other.
    name = F.xxhash64("rep")
    block = F.when(F.col("component") == F.col("_giant"), F.pmod(name, F.col("_low"))).otherwise(
        F.col("_low") + F.pmod(name, F.col("_of"))
    )
    placed = lookup_join(named, crowded, ["cell"]).select("cell", block.cast("int").alias("block"), "rep", "component", "n")
    meeting = crowded.select("cell", F.explode(F.sequence(F.col("_low"), F.col("_low") + F.col("_of") - 1)).alias("x"))
    meeting = meeting.select("cell", "x", F.explode(F.sequence(F.lit(0), "x")).alias("y"))
    return pairs, placed, meeting


def _links_of_blocks(similarity: float):
    """A spanning forest of the links that join groups of two blocks; equal blocks meet themselves."""

    def unpacked(texts):
        rows = texts.values  # of one list: its rows from first to last
        shingles = [np.frombuffer(blob.as_buffer(), np.uint64) for blob in rows.field("shingles")]
        return *(rows.field(c).to_numpy() for c in ("rep", "component")), np.array([len(s) for s in shingles]), np.concatenate(shingles)

    def joining(x, y, same):
        (reps, groups, sizes, shingles), (other_reps, other_groups, other_sizes, others) = x, y
        labels = groups.copy() if same else np.concatenate([groups, other_groups])
        mine, theirs = labels[: len(reps)], labels[0 if same else len(reps) :]  # views: a label changes in both
        owner = np.repeat(np.arange(len(other_reps)), other_sizes)
        order = np.argsort(others, kind="stable")
        owner, others = owner[order], others[order]
        starts, ends = np.searchsorted(others, shingles, "left"), np.searchsorted(others, shingles, "right")
        at = np.concatenate([[0], np.cumsum(sizes)])
        for i in range(len(reps)):
            if (theirs == mine[i]).all():
                continue
            part = slice(at[i], at[i + 1])
            counts = ends[part] - starts[part]
            total = np.cumsum(counts)
            places = np.arange(total[-1]) + np.repeat(starts[part] - total + counts, counts)
            both = np.bincount(owner[places], minlength=len(other_reps))
            near = both >= similarity * (sizes[i] + other_sizes - both)
            near &= theirs != mine[i]
            while near.any():
                j = int(near.argmax())
                yield int(reps[i]), int(other_reps[j])
                labels[labels == theirs[j]] = mine[i]
                near &= theirs != mine[i]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (unpacked(batch.column(c)[row]) for c in ("texts_x", "texts_y"))
                links = list(joining(x, y, batch.column("x")[row].equals(batch.column("y")[row])))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    return run


def _block_links(placed: DataFrame, meeting: DataFrame, rows: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """``a, b``: links between the members of blocks that meet, enough to join all their groups; written as a table.

    Shingles are packed by block and blocks are joined, so no row is made for a pair of texts.
    """

    def per_batch(doc_ids, texts):
        return {"doc_id": doc_ids, "shingles": [np.unique(shingle_hashes(text, shingle_words)).tobytes() for text in texts]}

    placed, meeting = saved(placed), saved(meeting)
    ids = saved(placed.select(F.col("rep").alias("doc_id")).distinct())
    texts = lookup_join(rows.where("doc_id IS NOT NULL"), ids, ["doc_id"], "left_semi")
    cut = map_texts(texts, per_batch, "doc_id long, shingles binary").where("octet_length(shingles) > 0").distinct()
    filled = spread_join(placed, saved(cut).withColumnRenamed("doc_id", "rep"), ["rep"])
    blocks = saved(
        filled.groupBy("cell", "block").agg(F.collect_list(F.struct("rep", "component", "shingles")).alias("texts"))
    )
    size = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    small = 8 * size <= BROADCAST_BYTES
    both = meeting.repartition(max(1, -(-meeting.count() // MEETINGS_PER_TASK)), "cell", "x", "y")
    for c in ("x", "y"):
        side = blocks.select("cell", F.col("block").alias(c), F.col("texts").alias(f"texts_{c}"))
        both = both.join(F.broadcast(side) if small else side, ["cell", c])
    return saved(both.select("x", "y", "texts_x", "texts_y").mapInArrow(_links_of_blocks(similarity), "a long, b long"))


def link(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    block: int = BLOCK,
    crowd: int = CROWD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, component_id`` of every row: the smallest identifier that links between near copies lead to."""
    rows = id_and_text(docs, id_col, text_col)
    known = saved(sketches(docs, shingle_words, id_col, text_col).where("doc_id IS NOT NULL"))
    n = known.count()
    # Equal sets have equal fingerprints and cells.
    points = saved(
        known.groupBy("shape").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("cells").alias("cells")
        )
    )
    members = points.where("n > 0").select("rep", "n", "bits", F.explode("cells").alias("cell"))

    # An identifier with several texts is one node. Most have one, and copies of a text are found by its shape.
    named = saved(spread_join(known.select("doc_id", "shape"), points.select("shape", "rep"), ["shape"]).select("doc_id", "rep"), rows=n)
    lowest = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_high")).where("a < _high")
    several = lookup_join(named, saved(lowest), ["doc_id"]).select("a", F.col("rep").alias("b"))

    by_bits = points.where("n > 0").groupBy("bits").agg(F.min("rep").alias("rep"))
    pairs = saved(_ordered(near_links(by_bits, block=block)))
    links = several.unionByName(verified(pairs, rows, similarity, shingle_words))

    tried = pairs
    pairs = saved(_firsts(members, similarity).join(tried, ["a", "b"], "left_anti"))
    links = links.unionByName(verified(pairs, rows, similarity, shingle_words))

    tried = tried.unionByName(pairs)
    groups = connected_components(links)
    pairs, placed, meeting = _across(members, saved(groups), similarity, crowd)
    pairs = saved(pairs.join(tried, ["a", "b"], "left_anti"))
    links = links.unionByName(verified(pairs, rows, similarity, shingle_words))
    links = links.unionByName(_block_links(placed, meeting, rows, similarity, shingle_words))

    groups = saved(connected_components(links)).select(F.col("node").alias("rep"), "component")
    joined = spread_join(named, groups, ["rep"], "left")
    return in_few_tasks(joined.select("doc_id", F.coalesce("component", "rep").alias("component_id")), n)


def one_near_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of its group of near copies, with all their columns."""
    return one_of_each(docs, id_col, text_col, groups=link(docs, id_col=id_col, text_col=text_col, **options))

"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Pieces are dealt at random into groups of a bounded size, whatever their identifiers, so no key can make a group
large. Within a group every piece goes, longest first, to the fullest bin it fits into. Then underfull bins trade:
a piece moves, one is exchanged for one, two for one or one for two, whenever that raises the sum of the
squared fills; free space gathers in few bins until bins empty. Bins that still have room for more than a small part
go, with the pieces in them, into another round of fewer groups, until one group is left or rounds stop paying.

A document longer than the capacity is cut into pieces of exactly that length; its first piece may be
shorter. Pieces of full length are sequences of their own and take part in nothing.

Defined results: a null or empty text is one piece that holds the end mark alone; equal documents and repeated
identifiers are packed row by row; an empty table gives an empty one; columns besides the identifier and the text
are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchmart.llm.bpe import Codec
from dispatchmart.llm.common import id_and_text, in_few_tasks, saved

CAPACITY = 1024
GROUP = 1 << 16
"""Pieces in one group on average; bounds what a task holds."""

ROOM = 1 / 64
"""Bins with more than this part free enter another round."""


class Bins:
    """Pieces in bins of one capacity, with an index of what underfull bins hold."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []  # of each bin: (length, number of the piece)
        self.fill: list[int] = []

    def best_fit(self, lengths: list[int]) -> None:
        """Put each piece, longest first, into the fullest bin that has room."""
        free: dict[int, list[int]] = defaultdict(list)  # bins by free space
        present = 0  # bit f is set when some bin has f free
        for number in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            length = lengths[number]
            fitting = present >> length
            if fitting:
                space = length + (fitting & -fitting).bit_length() - 1
                bin_ = free[space].pop()
                if not free[space]:
                    present &= ~(1 << space)
            else:
                bin_, space = len(self.items), self.capacity
                self.items.append([])
                self.fill.append(0)
            self.items[bin_].append((length, number))
            self.fill[bin_] += length
            space -= length
            if space:
                free[space].append(bin_)
                present |= 1 << space

    def improve(self) -> None:
        """Trade between underfull bins until no trade raises the sum of squared fills."""
        self._holders = {1: defaultdict(set), 2: defaultdict(set)}  # bins by the length of one piece, of two
        self._masks = {1: 0, 2: 0}  # which lengths these are, as bits
        waiting = sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: self.fill[b])
        for bin_ in waiting:
            self._index(bin_, True)
        while waiting:
            bin_ = waiting.pop()  # the fullest first: its gap is the easiest to close
            while 0 < self.fill[bin_] < self.capacity:
                other = self._trade(bin_)
                if other is None:
                    break
                if 0 < self.fill[other] < self.capacity:
                    waiting.append(other)

    def _sums(self, bin_: int) -> dict[int, dict[int, tuple]]:
        """Lengths that one or two pieces of a bin have together, with the pieces."""
        by_length = defaultdict(list)
        for piece in self.items[bin_]:
            by_length[piece[0]].append(piece)
        single = {length: (held[0],) for length, held in by_length.items()}
        double, lengths = {}, sorted(by_length)
        for i, x in enumerate(lengths):
            if len(by_length[x]) > 1:
                double[2 * x] = tuple(by_length[x][:2])
            for y in lengths[i + 1 :]:
                double.setdefault(x + y, (by_length[x][0], by_length[y][0]))
        return {1: single, 2: double}

    def _index(self, bin_: int, add: bool) -> None:
        for size, sums in self._sums(bin_).items():
            holders = self._holders[size]
            for length in sums:
                if add:
                    holders[length].add(bin_)
                    self._masks[size] |= 1 << length
                else:
                    holders[length].discard(bin_)
                    if not holders[length]:
                        self._masks[size] &= ~(1 << length)

    def _giver(self, size: int, bin_: int, length: int, gain: int) -> int | None:
        """A bin that may give ``size`` pieces of ``length`` together, so that ``bin_`` gains: the emptiest of those looked at."""
        limit = self.fill[bin_] + gain  # fuller bins would lose more than is won
        best = None
        for i, other in enumerate(self._holders[size][length]):
            if other != bin_ and self.fill[other] < limit and (best is None or self.fill[other] < self.fill[best]):
                best = other
            if i >= 16 and best is not None:
                break
        return best

    def _trade(self, bin_: int) -> int | None:
        """Carry out the trade that fills ``bin_`` most; the bin it traded with."""
        gap = self.capacity - self.fill[bin_]
        own = self._sums(bin_)
        gives = [((), 0, 1)]  # what goes out, its length, how many pieces may come in
        gives += [(out, length, 1) for length, out in own[1].items()]
        gives += [(out, length, 2) for length, out in own[1].items()]
        gives += [(out, length, 1) for length, out in own[2].items()]
        found = None
        for out, length, size in gives:
            least = 0 if found is None else found[0]
            window = (self._masks[size] >> (length + least + 1)) & ((1 << (gap - least)) - 1)
            while window:
                gain = least + window.bit_length()
                other = self._giver(size, bin_, length + gain, gain)
                if other is not None:
                    found = (gain, out, other, size, length + gain)
                    break
                window &= ~(1 << (window.bit_length() - 1))
            if found and found[0] == gap:
                break
        if found is None:
            return None
        gain, out, other, size, length = found
        self._index(bin_, False)
        self._index(other, False)
        come = self._sums(other)[size][length]
        for piece in come:
            self.items[other].remove(piece)
        for piece in out:
            self.items[bin_].remove(piece)
        self.items[bin_] += come
        self.items[other] += out
        self.fill[bin_] += gain
        self.fill[other] -= gain
        for b in (bin_, other):
            if 0 < self.fill[b] < self.capacity:
                self._index(b, True)
        return other


def _pack_group(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].tolist()
        bins = Bins(capacity)
        bins.best_fit(lengths)
        bins.improve()
        bin_of, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for number, held in enumerate(bins.items):
            at = 0
            for length, piece in held:
                bin_of[piece], offset[piece], fill[piece] = number, at, bins.fill[number]
                at += length
        return frame.assign(_bin=bin_of, offset=offset, _fill=fill)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs a column ``length`` of 1 to ``capacity``.

    A row number is written with each row, so equal rows stay apart and no later read can number them anew.
    """
    kept = pieces.columns
    rows = saved(pieces.withColumn("_row", F.monotonically_increasing_id()))
    full = rows.where(F.col("length") >= capacity)
    # Sequences of one piece are named by its row, those of bins from 2^62 on.
    done = [full.select(*kept, F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    short = rows.where(F.col("length") < capacity)
    packed, names, total = [], 0, rows.count()
    work, n = short.select("_row", F.col("length").cast("long").alias("length")), short.count()
    while n:
        groups = -(-n // group)
        dealt = work.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(names)), F.lit(groups)))
        placed = saved(
            dealt.groupBy("_group").applyInPandas(
                _pack_group(capacity), "_row long, length long, _group long, _bin long, offset long, _fill long"
            ),
            rows=n,
        )
        name = F.lit((1 << 62) + (names << 56)) + (F.col("_group") * (1 << 24)) + F.col("_bin")
        again = F.lit(groups > 1) & (F.col("_fill") < capacity - int(capacity * ROOM))
        left = placed.where(again).count() if groups > 1 else 0
        last = not left or 2 * left > n  # a round that leaves most bins with room would change little
        ready = placed if last else placed.where(~again)
        packed.append(ready.select("_row", name.alias("sequence_id"), "offset"))
        if last:
            break
        work, n, names = placed.where(again).select("_row", "length"), left, names + 1
    if packed:
        places = reduce(DataFrame.unionByName, packed)
        done.append(short.join(places, "_row").select(*kept, "sequence_id", "offset"))
    return in_few_tasks(reduce(DataFrame.unionByName, done), total)


@lru_cache(maxsize=2)
def json_codec(path: str) -> Codec:
    """A codec with the vocabulary, merges and special tokens of a byte-level BPE file of the tokenizers library.

    In such a vocabulary identifiers rise in the order of the merges, which is what ranks are.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    split, added = model["pre_tokenizer"], model["added_tokens"]
    if split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or model["normalizer"]:
        raise ValueError(f"{path} is no byte-level model without normalisation")
    # The file writes bytes as printable characters: those that are printable as they are, the rest from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {token["content"]: token["id"] for token in added}
    ranks = {
        bytes(byte_of[c] for c in token): id_ for token, id_ in model["model"]["vocab"].items() if token not in special
    }
    merged = [ranks[bytes(byte_of[c] for c in "".join(pair.split() if isinstance(pair, str) else pair))]
              for pair in model["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"{path}: identifiers do not follow the merges")
    return Codec(ranks, PATTERN, special)


# The pattern that byte-level models of the tokenizers library split text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens; only the first may be shorter than ``capacity``."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))] if n else []


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end: int,
    capacity: int = CAPACITY,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every whole document, and ``ids`` on request.

    The packing needs lengths only. Identifiers are several times as large as the texts, so they are left in
    their task unless asked for. ``tokenizer`` is a file each executor has.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        one = json_codec(tokenizer)
        for batch in batches:
            columns = defaultdict(list)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*one.encode_with_special(text.as_py()), end], "<u4")
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    columns["doc_id"].append(doc_id)
                    columns["piece"].append(number)
                    columns["start"].append(start)
                    columns["length"].append(length)
                    columns["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        columns["ids"].append(part.astype(np.int32))
            kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.int64())) for c in names], names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema + ", ids array<int>" * with_ids)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end: int = 2,
    capacity: int = CAPACITY,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every piece of every document with the sequence it is in and its place there."""
    return pack(token_pieces(docs, tokenizer, end, capacity, with_ids, id_col, text_col), capacity)

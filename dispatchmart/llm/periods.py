"""Periodic runs of words: maximal stretches that repeat themselves, found by block convolution.

A run of period q and length >= max(12, 2 q) holds a stretch of at least max(12 - q, q) words each of which equals
the word q places on. Words are cut into blocks of 2, 4, 8 ... words. Every stretch of 2 B - 1 words holds a whole block of B, so blocks of 2 find
the periods from 1 to 6, and blocks of B >= 4 those from 2 B - 1 to 4 B - 2. For each block the sums of squared
differences to all places of the window that follows are made by a transform over whole numbers (``transform``); where
the sum is zero the block occurs, and the distance is a seed. A seed is extended by comparing words, both ways, as far
as the period holds.

Two things spare work and lose nothing. A block can occur in its window only if each of its words does, so blocks with a
word that next occurs beyond the window, or never, are not transformed. And a seed, or a whole block with its window, inside
a known run whose period divides the distance is explained by that run: shorter periods are found first, so what is
left has its smallest period at the distance.

Defined results: a null or empty text, or one of blanks only, has no words and no runs; a row without an
identifier keeps its words as they are (``altered``); equal rows are judged each on its own; a text is one value of
a task however long it is, blocks of more than 2^18 words are located by their first 2^18 words, window piece by window
piece, and the extension compares all of them; an empty table gives an empty one; columns besides the identifier and the text
are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dispatchmart.llm.common import id_and_text
from dispatchmart.llm.transform import zero_differences

MIN_LENGTH = 12
WORDS_AT_ONCE = 1 << 17
"""Words of short texts that are looked at together; a longer text is looked at alone."""
CELLS_AT_ONCE = 1 << 20
"""Entries of blocks and windows that are transformed together."""
LONGEST_BLOCK = 1 << 18

_FAR = np.iinfo(np.int64).max

Run = tuple[int, int, int]
"""Start, length, period."""


def altered(doc_id: int | None, words: list) -> list:
    """The words of some documents, by a hash of the identifier, with a tail that repeats itself."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


def _next_distances(ids: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
    """How far on each word occurs again in its own document."""
    order = np.argsort(doc_of * (int(ids.max()) + 1) + ids, kind="stable")
    same = (ids[order[1:]] == ids[order[:-1]]) & (doc_of[order[1:]] == doc_of[order[:-1]])
    after = np.full(len(ids), _FAR)
    after[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return after


def _seeds(ids: np.ndarray, starts: np.ndarray, width: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    """``place, distance`` of the blocks at ``starts`` that occur again ``first`` to ``last`` words on."""
    used = min(width, LONGEST_BLOCK)
    for low in range(first, last + 1, 2 * LONGEST_BLOCK):
        lags = min(2 * LONGEST_BLOCK, last + 1 - low)
        rows = max(1, CELLS_AT_ONCE // (4 * used))
        for at in range(0, len(starts), rows):
            part = starts[at : at + rows]
            blocks = ids[part[:, None] + np.arange(used)]
            places = part[:, None] + low + np.arange(used + lags - 1)
            # Beyond the end stands 0, which is no word.
            windows = np.where(places < len(ids), ids[np.minimum(places, len(ids) - 1)], 0)
            hits, lag = zero_differences(blocks, windows, int(ids.max()))
            yield from zip(part[hits].tolist(), (low + lag).tolist())


def _same_ahead(ids: np.ndarray, here: int, there: int, end: int) -> int:
    """How many words from ``here`` on equal those from ``there`` on, which stops at ``end``."""
    size, done = 16, 0
    while there + done < end:
        step = min(size, end - there - done)
        differ = ids[here + done : here + done + step] != ids[there + done : there + done + step]
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + step, size * 2
    return done


def _same_behind(ids: np.ndarray, here: int, there: int, begin: int) -> int:
    """How many words right before ``here`` equal those right before ``there``; ``here`` stops at ``begin``."""
    size, done = 16, 0
    while here - done > begin:
        step = min(size, here - done - begin)
        differ = ids[here - done - step : here - done] != ids[there - done - step : there - done]
        if differ.any():
            return done + int(differ[::-1].argmax())
        done, size = done + step, size * 2
    return done


class _Known:
    """Runs found so far, to tell which stretches they explain."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = {}  # by period: start and end, ascending

    def add(self, start: int, end: int, period: int) -> None:
        spans = self.runs.setdefault(period, [])
        spans.insert(bisect_right(spans, (start, end)), (start, end))

    def within(self, period: int, start: int, end: int) -> bool:
        spans = self.runs.get(period, ())
        at = bisect_right(spans, (start, _FAR)) - 1
        return at >= 0 and spans[at][1] >= end

    def explained(self, distance: int, start: int, end: int) -> bool:
        """Whether a run with a period that divides the distance holds the stretch."""
        return any(distance % period == 0 and self.within(period, start, end) for period in self.runs)

    def quiet(self, starts: np.ndarray, width: int, reach: int) -> np.ndarray:
        """Which blocks lie, window and all, in a run whose period they are long enough to show."""
        calm = np.zeros(len(starts), bool)
        for period, spans in self.runs.items():
            if period <= width:
                begins, ends = np.array(spans).T
                at = np.searchsorted(begins, starts, "right") - 1
                calm |= (at >= 0) & (ends[np.maximum(at, 0)] >= starts + reach)
        return calm


def find_runs(ids: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH) -> list[Run]:
    """All runs of one or more documents laid end to end; document i holds the places ``bounds[i]`` to ``bounds[i + 1]``.

    ``ids`` are numbers from 1, equal for equal words. Starts count from the first document.
    """
    if min_length < MIN_LENGTH:
        raise ValueError("blocks of two words do not find shorter runs")
    if len(ids) < min_length:
        return []
    longest = int(np.diff(bounds).max())
    doc_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    reach = _next_distances(ids, doc_of)
    known, found = _Known(), []
    width = 2
    while (width == 2 or 2 * (2 * width - 1) <= longest) and width <= len(ids):
        first, last = (1, 6) if width == 2 else (2 * width - 1, 4 * width - 2)
        whole = len(ids) // width * width
        farthest = reach[:whole].reshape(-1, width).max(axis=1) if width == 2 else _pairs(farthest)[: len(ids) // width]
        starts = np.nonzero(farthest <= last)[0] * width
        starts = starts[~known.quiet(starts, width, last + width)]
        seeds = sorted(_seeds(ids, starts, width, first, last), key=lambda seed: (seed[1], seed[0]))
        passed, of = -1, 0  # how far the stretches of this distance have been compared
        for place, distance in seeds:
            if of != distance:
                of, passed = distance, -1
            begin, end = bounds[doc_of[place]], bounds[doc_of[place] + 1]
            if place < passed or place + distance + 1 > end or known.explained(distance, place, place + distance + width):
                continue
            start = place - _same_behind(ids, place, place + distance, begin)
            same = _same_ahead(ids, place, place + distance, end)
            passed = place + max(same, 1)
            stop = place + distance + same
            if stop - start >= max(min_length, 2 * distance):
                known.add(start, stop, distance)
                found.append((int(start), int(stop - start), distance))
        width *= 2
    return sorted(found, key=lambda run: (run[0], run[2]))


def _pairs(values: np.ndarray) -> np.ndarray:
    """The larger of each two neighbours."""
    return values[: len(values) // 2 * 2].reshape(-1, 2).max(axis=1)


def kept_places(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay: those of no run, and the first period of a run unless another run drops them."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def _judge(texts: list[list[bytes]]) -> list[tuple]:
    """The digest columns of some documents' words."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(word, len(numbers) + 1) for words in texts for word in words], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
    owned: list[list[Run]] = [[] for _ in texts]
    if len(ids):
        runs = find_runs(ids, bounds)
        for (start, length, period), doc in zip(runs, np.searchsorted(bounds, [r[0] for r in runs], "right") - 1):
            owned[doc].append((start - int(bounds[doc]), length, period))
    out = []
    for words, runs in zip(texts, owned):
        best = min(runs, key=lambda run: (-run[1], run[0], run[2]), default=None)
        start, length, period = best or (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        if runs:
            words = [words[i] for i in np.nonzero(kept_places(len(words), runs))[0]]
        digests = hashlib.sha256(listed.encode()).hexdigest(), b" ".join(words)
        out.append((len(runs), start, length, period, best and 1000 * length // period, *digests, listed))
    return out


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed string, runs string"
)
_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def collapse_runs(docs: DataFrame, alter=altered, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its runs, the greatest of them, and the words left when every run is cut to one period.

    ``runs`` lists ``start,length,period`` line by line. ``alter(doc_id, words)`` may change the words first.
    """

    def output(doc_ids, texts):
        columns = list(zip(*_judge(texts)))
        kinds = [pa.int64()] * 5 + [pa.string()] * 3
        columns[6] = [words.decode("utf-8", "replace") for words in columns[6]]
        arrays = [pa.array(doc_ids, pa.int64()), *[pa.array(c, kind) for c, kind in zip(columns, kinds)]]
        return pa.RecordBatch.from_arrays(arrays, _NAMES)

    def run(batches):
        for batch in batches:
            doc_ids, texts, size = [], [], 0
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                words = value.as_py().split()  # bytes: ASCII blanks only
                if doc_ids and size + len(words) > WORDS_AT_ONCE:
                    yield output(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
                doc_ids.append(doc_id)
                texts.append(alter(doc_id, words))
                size += len(words)
            if doc_ids:
                yield output(doc_ids, texts)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)

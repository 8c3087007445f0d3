"""Cross-entropy difference: how much better a target model predicts a document than a background model.

Both are bigram models with one vocabulary and one smoothing, of every word and every pair of words of the corpus, however
large it is: a pair seen once counts, so no mass but the smoothing backs off. A document's score is the mean over its words
of the target's loss less the background's; documents rank by it, the lower the closer to the target. The models hold the counts
of the scored documents themselves, so the sign of a score says more about membership than about likeness.

    p(w | v) = (c(v, w) + K p(w)) / (c(v) + K),   p(w) = (c(w) + K / |V|) / (N + K)

No model is held anywhere. Each occurrence of a pair goes to the bucket of its second word, where the counts of
that word, of its pairs and of the word as a context are all known, and what the occurrence adds to its document
is sent back. The factor of a context is the same for all pairs it begins, so it is added where the context itself is
the second word; the start and the last word of a text make the difference up. Words of more than
1 in 2,000 occurrences, at most 2,000, have their counts sent to all tasks, and their pairs are dealt by both words.

The target's identifiers go to all tasks packed, in at most 64 MB; if there are more the texts are joined with them. No other
table goes through the driver: sums meet the names of documents by shuffles.

An occurrence names its document by a place of two bytes in a chunk of documents; the names of a chunk travel once, and meet the
sums of their places in the end. Documents are named by the hash of their text: copies of a text add up and are divided by their number.

Defined results: a null or empty text has no words and the score 0; equal texts have equal scores, each row of them is
kept; an empty table gives an empty one; an empty target leaves a uniform model for it; columns besides
the identifier and the text are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchmart.llm.classifier import shape
from dispatchmart.llm.common import id_and_text, saved
from dispatchmart.operators.joins import spread_join

SMOOTHING = 64.0
HOT_SHARE = 1 / 2000
_CACHED_WORDS = 400_000
_PORTION = 500_000  # distinct words that a task holds before it sends their counts
_CHUNK = 1 << 21  # words that a task deals out at a time
_CHUNK_DOCS = 1 << 15  # documents at most: place and target make up two bytes
_BLOCK = 1 << 10  # documents of a chunk whose sums are added up together
_SENT_IDS = 1 << 23  # identifiers of the target that are sent to all tasks, in eight bytes each at most
_JOINED_ROWS = 20_000  # rows of a side of a join that are sent to all tasks
_START, _LAST = 0, 1  # in place of the word before: the start of a text; the mark of a text's last word
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PACKED = "bucket int, chunk long, words binary, sizes binary, contexts binary, at binary, docs binary"
_ADDED = "bucket int, block long, places binary, sums binary, keys binary, sizes binary"


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)
        return value


@dataclass
class Totals:
    """What all tasks know: sums over the corpus (background, target), and the counts of hot words in the order of hashes."""

    size: int
    words: tuple[int, int]
    texts: tuple[int, int]
    hot: np.ndarray
    counts: np.ndarray  # background, target, background as the last word, target as the last word


class Target:
    """Identifiers, in order and packed: the first, and what each adds to the one before in as few bytes as the largest needs."""

    def __init__(self, ids: np.ndarray):
        ids = np.unique(ids)
        # Over the whole range of identifiers a difference needs all 64 bits.
        steps = np.diff(ids.view(np.uint64))
        width = np.min_scalar_type(int(steps.max())) if len(steps) else np.uint8
        self.first, self.steps = ids[:1], steps.astype(width)

    def ids(self) -> np.ndarray:
        steps = np.concatenate([self.first.view(np.uint64), self.steps.astype(np.uint64)])
        return np.cumsum(steps, dtype=np.uint64).view(np.int64)

    @classmethod
    def of(cls, ids: DataFrame, at_most: int) -> Target | None:
        """Those of ``doc_id``, or None if there are more than ``at_most``; nothing is collected then."""
        if ids.agg(F.count("*")).first()[0] > at_most:
            return None
        return cls(ids.toArrow().column("doc_id").to_numpy())


def _flags(batch, ids: np.ndarray | None) -> list[bool]:
    """Which rows belong to the target: by the column that says so, or by their identifier."""
    if ids is None:
        return batch.column("target").to_pylist()
    if not len(ids):
        return [False] * batch.num_rows
    column = batch.column("doc_id")
    names = column.fill_null(0).to_numpy()
    found = ids[np.minimum(np.searchsorted(ids, names), len(ids) - 1)] == names
    return (found & column.is_valid().to_numpy(zero_copy_only=False)).tolist()


def _count_words(batches, ids: np.ndarray | None):
    """Counts of words and of shapes; portions of bounded size."""

    def portion():
        shapes = Counter()
        for word, n in every.items():
            shapes[shape(word)] += n
        columns = [[c[w] for w in every] + [0] * len(shapes) for c in (good, last, good_last)]
        names = ["is_shape", "word", "n", "good", "last", "good_last"]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([False] * len(every) + [True] * len(shapes)),
                pa.array([*every, *shapes], pa.string()),
                pa.array([*every.values(), *shapes.values()], pa.int64()),
                *(pa.array(c, pa.int64()) for c in columns),
            ],
            names,
        )

    every, good, last, good_last = Counter(), Counter(), Counter(), Counter()
    for batch in batches:
        for text, target in zip(batch.column("text"), _flags(batch, ids)):
            words = text.as_py().split()
            if not words:
                continue
            every.update(words)
            last[words[-1]] += 1
            if target:
                good.update(words)
                good_last[words[-1]] += 1
            if len(every) >= _PORTION:
                yield portion()
                every, good, last, good_last = Counter(), Counter(), Counter(), Counter()
    yield portion()


def totals(rows: DataFrame, target=None) -> Totals:
    """Sums over ``text, target``; of single words only the hot ones, a bounded number, come to the driver.

    ``target`` is a sent ``Target``; then the rows have a ``doc_id`` instead.
    """
    names = ("n", "good", "last", "good_last")

    def run(batches):
        yield from _count_words(batches, target and target.value.ids())

    seen = rows.select("text", "doc_id" if target else "target").mapInArrow(
        run, "is_shape boolean, word string, n long, good long, last long, good_last long"
    )
    counts = saved(seen.groupBy("is_shape", "word").agg(*[F.sum(c).alias(c) for c in names]))
    size, *sums = counts.agg(
        F.count("*"), *[F.coalesce(F.sum(F.when(~F.col("is_shape"), F.col(c))), F.lit(0)) for c in names]
    ).first()
    hot = counts.where(~F.col("is_shape") & (F.col("n") > HOT_SHARE * sums[0])).select("word", *names).collect()
    hashes = _Hashes()
    hot = sorted((hashes[word], *n) for word, *n in hot)
    table = np.array(hot, np.int64).reshape(-1, 5)
    return Totals(2 + size, (sums[0], sums[1]), (sums[2], sums[3]), table[:, 0], table[:, 1:].astype(float))


def _is_hot(known: Totals, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known.hot, words), max(len(known.hot) - 1, 0))
    return (known.hot[at] == words if len(known.hot) else np.zeros(len(words), bool)), at


def _as_bytes(places: np.ndarray) -> np.ndarray:
    """Places in a list, in two bytes each where the list is short enough."""
    return places.astype(np.uint16 if places.max() < 1 << 16 else np.uint32).view(np.uint8)


def _places(raw: np.ndarray, count: int) -> np.ndarray:
    return raw.view(np.uint16 if len(raw) == 2 * count else np.uint32)


def _bucket_of(names: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((names.view(np.uint64) * _MIX >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int32)


def _rows(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _deal(sent, n_buckets: int, target=None):
    """Occurrences of pairs, packed: a row for each bucket and chunk of texts, and the names of the chunk, a row for each block."""

    def run(batches):
        import xxhash

        known, hashes, ids = sent.value, _Hashes(), target and target.value.ids()
        task, number = TaskContext.get().partitionId(), 0
        parts, docs, targets, size = [], [], [], 0

        def packed():
            keys, sizes = np.array(docs, np.int64), np.array([len(part) for part in parts], np.int32)
            chunk = xxhash.xxh64_intdigest(np.array([task, number, *docs], np.int64).tobytes()) - (1 << 63)
            blocks = _blocks(chunk, np.arange(0, len(docs), _BLOCK))
            for at, block, bucket in zip(range(0, len(docs), _BLOCK), blocks.tolist(), _bucket_of(blocks, n_buckets).tolist()):
                part = slice(at, at + _BLOCK)
                yield _rows(_PACKED, [bucket], [block], [keys[part].tobytes()], [sizes[part].tobytes()], [None], [None], [None])
            after = np.concatenate([p for part in parts for p in (part, part[-1:])])
            before = np.concatenate([p for part in parts for p in ([_START], part[:-1], [_LAST])]).astype(np.int64)
            doc = np.repeat((2 * np.arange(len(docs)) + np.array(targets, bool)).astype(np.uint16), sizes + 1)
            hot, _ = _is_hot(known, after)
            name = after.view(np.uint64) * _MIX
            name[hot] = (name[hot] ^ before[hot].view(np.uint64)) * _MIX
            bucket = ((name >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((after, bucket))
            after, before, doc, bucket = after[order], before[order], doc[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                words, sizes = np.unique(after[start:end], return_counts=True)
                contexts, at = np.unique(before[start:end], return_inverse=True)
                columns = (words, _as_bytes(sizes), contexts, _as_bytes(at), doc[start:end])
                yield _rows(_PACKED, [int(bucket[start])], [chunk], *([c.tobytes()] for c in columns))

        for batch in batches:
            for text, flag, key in zip(batch.column("text"), _flags(batch, ids), batch.column("key").to_pylist()):
                words = text.as_py().split()
                if not words:
                    continue
                parts.append(np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)))
                docs.append(key)
                targets.append(flag)
                size += len(words)
                if size >= _CHUNK or len(docs) >= _CHUNK_DOCS:
                    yield from packed()
                    parts, docs, targets, size, number = [], [], [], 0, number + 1
        if parts:
            yield from packed()

    return run


def _blocks(chunk, places: np.ndarray) -> np.ndarray:
    """Names of the blocks that places of a chunk, or of one chunk each, are in."""
    return (np.asarray(chunk, np.int64).view(np.uint64) + (places // _BLOCK).astype(np.uint64)).view(np.int64)


def _weigh(known: Totals, word, before, doc, good):
    """What the occurrences of a complete bucket add to their documents: document, sum."""
    order = np.lexsort((before, word))
    word, before, doc, good = word[order], before[order], doc[order], good[order].astype(np.int64)
    last = (before == _LAST).astype(np.int64)
    new = np.concatenate([[True], word[1:] != word[:-1]])
    starts, of = np.flatnonzero(new), np.cumsum(new) - 1
    own = np.stack([np.add.reduceat(c, starts) for c in (1 - last, good * (1 - last), last, good * last)], axis=1).astype(float)
    hot, at = _is_hot(known, word[starts])
    own[hot] = known.counts[at[hot]]
    new_pair = new | np.concatenate([[True], before[1:] != before[:-1]])
    pairs, pair_of = np.flatnonzero(new_pair), np.cumsum(new_pair) - 1
    n, n_good = np.diff(np.append(pairs, len(word))), np.add.reduceat(good, pairs)
    k = SMOOTHING
    context = np.log(own[:, 1] - own[:, 3] + k) - np.log(own[:, 0] - own[:, 2] + k)
    share = [(own[:, i] + k / known.size) / (known.words[i] + k) for i in (0, 1)]
    first = np.log(known.texts[1] + k) - np.log(known.texts[0] + k)
    pair_word = of[pairs]
    value = np.log(n + k * share[0][pair_word]) - np.log(n_good + k * share[1][pair_word]) + context[pair_word]
    value = np.where(last[pairs] == 1, first - context[pair_word], value)
    docs, of_doc = np.unique(doc, return_inverse=True)
    return docs, np.bincount(of_doc, value[pair_of])


def _by_bucket(work):
    """``work`` on the rows of each bucket of a partition, which arrive in the order of buckets; blobs as arrays of bytes."""

    def run(batches):
        bucket, waiting = None, []
        for batch in batches:
            columns = [batch.column(i) for i in range(2, batch.num_columns)]
            for i, (name, of) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if name != bucket and waiting:
                    yield from work(waiting)
                    waiting = []
                bucket = name
                blobs = (c[i].as_py() for c in columns)
                waiting.append((of, *(None if blob is None else np.frombuffer(blob, np.uint8) for blob in blobs)))
        if waiting:
            yield from work(waiting)

    return run


def _weigh_buckets(sent, n_buckets: int):
    """What occurrences add to documents, packed again: a row for each block of documents. Rows of names are passed on."""

    def work(waiting):
        chunks, firsts, rows, end = [], [], [], 0
        for chunk, words, sizes, contexts, at, docs in waiting:
            if contexts is None:
                yield _rows(_ADDED, _bucket_of(np.array([chunk]), n_buckets), [chunk], [None], [None], [words.tobytes()], [sizes.tobytes()])
                continue
            words, docs = words.view(np.int64), docs.view(np.uint16)
            word = np.repeat(words, _places(sizes, len(words)))
            place = (docs >> 1).astype(np.int64)
            rows.append((word, contexts.view(np.int64)[_places(at, len(word))], place + end, docs % 2))
            chunks.append(chunk)
            firsts.append(end)
            end += int(place.max()) + 1
        waiting.clear()
        if not rows:
            return
        docs, sums = _weigh(sent.value, *(np.concatenate(c) for c in zip(*rows)))
        of = np.searchsorted(firsts, docs, "right") - 1
        place = docs - np.array(firsts)[of]
        block = _blocks(np.array(chunks)[of], place)
        place = (place % _BLOCK).astype(np.uint16)
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        places, blobs = ([c[start:end].tobytes() for start, end in zip(cuts[:-1], cuts[1:])] for c in (place, sums))
        block, none = block[cuts[:-1]], [None] * len(places)
        yield _rows(_ADDED, _bucket_of(block, n_buckets), block, places, blobs, none, none)

    return _by_bucket(work)


def _add_up(waiting):
    """The sums of each document of complete blocks."""
    named = {block: (keys.view(np.int64), sizes.view(np.int32)) for block, _, _, keys, sizes in waiting if keys is not None}
    totals = {block: np.zeros(len(keys)) for block, (keys, _) in named.items()}
    for block, places, sums, keys, _ in waiting:
        if keys is None:
            # Without its names a block comes from a task that ran twice, over rows in another order: better no result than a wrong one.
            totals[block][places.view(np.uint16)] += sums.view(np.float64)
    keys, words = (np.concatenate(c) for c in zip(*named.values()))
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(np.concatenate(list(totals.values()))), pa.array(words.astype(np.int64))], ["key", "total", "words"]
    )


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, difference`` of every whole text."""
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    ids = target_ids.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
    target = Target.of(ids, _SENT_IDS)
    if target is None:
        flagged = spread_join(texts, ids.withColumn("target", F.lit(True)), ["doc_id"], "left", _JOINED_ROWS)
        rows = saved(flagged.select("text", "key", F.coalesce("target", F.lit(False)).alias("target")))
    else:
        target, rows = spark.sparkContext.broadcast(target), texts
    sent = spark.sparkContext.broadcast(totals(rows, target))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(packed, work, schema):
        return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, schema)

    packed = rows.mapInArrow(_deal(sent, buckets, target), _PACKED)
    added = dealt(packed, _weigh_buckets(sent, buckets), _ADDED)
    sums = dealt(added, _by_bucket(_add_up), "key long, total double, words long")
    found = saved(
        sums.groupBy("key")
        .agg(F.sum("total").alias("total"), F.sum("words").alias("words"), F.count("*").alias("copies"))
        .select("key", (F.col("words") / F.col("copies")).cast("long").alias("n_words"), (F.col("total") / F.col("words")).alias("difference"))
    )
    # Every text has its key here, and the keys of many texts are not sent to all tasks through the driver.
    named = saved(texts.select("doc_id", "key"))
    return spread_join(named, found, ["key"], "left", _JOINED_ROWS).select(
        "doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("difference", F.lit(0.0)).alias("difference")
    )

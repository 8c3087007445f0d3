"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates.

A document becomes a sparse vector of hashed n-grams (one and two words) of its lower-cased words and of the
words' shapes, where a shape keeps punctuation and replaces runs of letters and digits by one sign each. Each of the four
kinds has length 1, so long and short documents weigh alike. Training sees the vectors one by one and updates
the weights of the n-grams present; a score is the sigmoid of one sparse dot product.

Labels come from a table of their own and never enter a vector; nor do language, source or identifiers.
At most ``MAX_ROWS`` labelled rows are fitted, chosen by a hash of the identifier, so the weights (a fixed number of
them) are fitted in one task however large the corpus is. All rows are scored.

Defined results: a null or empty text has an empty vector and the score of the bias alone; equal texts have equal
scores, each row of them is kept; an empty table gives an empty one; without any labels every score is 0.5; an
identifier with several labels gives one example per label; null labels or identifiers are not learned from; columns
besides the identifier and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchmart.llm.common import id_and_text, map_texts

MAX_ROWS = 20_000
DIMENSIONS = 1 << 18
EPOCHS = 3

_MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier that spreads bits
_SAME = 0x5A4D  # stands for a word equal to the one before it
_CACHED_WORDS = 400_000
_RUNS = ((re.compile("[A-Z]+"), "X"), (re.compile("[^\\W\\d_A-Z]+"), "x"), (re.compile("\\d+"), "9"))


def shape(word: str) -> str:
    """``word`` with capital, other letters and digits replaced by one sign per run, cut to its last eight signs."""
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word[-8:]


class _Hashes(dict):
    """Two 32-bit hashes of each word, of its letters and its shape, in one integer."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = (zlib.crc32(word.lower().encode()) << 32) | zlib.crc32(shape(word).encode())
        self[word] = value
        return value


_hashes = _Hashes()


def _spread(values: np.ndarray, kind: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices of one kind of n-gram and their weights, of length 1 together."""
    mixed = (values + np.uint64(kind)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    index, counts = np.unique((mixed * _MIX) >> np.uint64(64 - dimensions.bit_length() + 1), return_counts=True)
    return index.astype(np.int32), np.sqrt(counts / len(values)).astype(np.float32)


def vector(text: str, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's n-grams; an index that two kinds share appears twice and adds up."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    both = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    letters, shapes = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    same = np.zeros(len(words), bool)
    same[1:] = letters[1:] == letters[:-1]
    shapes = np.where(same, np.uint64(_SAME), shapes)
    kinds = [letters, shapes]
    if len(words) > 1:
        kinds += [(k[:-1] * np.uint64(0x100000001B3)) ^ (k[1:] + _MIX) for k in (letters, shapes)]
    parts = [_spread(values, kind, dimensions) for kind, values in enumerate(kinds)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


@dataclass
class Ftrl:
    """Follow-the-regularised-leader (proximal) updates of a logistic regression."""

    dimensions: int = DIMENSIONS
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1

    def __post_init__(self):
        # The last weight is the bias.
        self.z = np.zeros(self.dimensions + 1)
        self.n = np.zeros(self.dimensions + 1)

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        index, where = np.unique(np.append(index, self.dimensions), return_inverse=True)
        value = np.bincount(where, np.append(value, 1.0), len(index))
        weight = self.weights(index)
        gradient = (sigmoid(weight @ value) - label) * value
        squares = gradient * gradient
        step = (np.sqrt(self.n[index] + squares) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += gradient - step * weight
        self.n[index] += squares

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 7) -> None:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                self.update(*rows[i])


def training_rows(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, label, index, value`` of at most ``max_rows`` labelled rows.

    ``labels`` has ``doc_id, label``. Only identifiers are ranked to choose them; texts are read once and
    leave their task as vectors.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("label").cast("int").alias("label"))
        .where(F.col("_id").isNotNull() & F.col("label").isNotNull())
        .orderBy(F.xxhash64("_id"), "_id", "label")
        .limit(max_rows)  # bounds the broadcast below
    )
    texts = id_and_text(docs, id_col, text_col)
    wanted = texts.join(F.broadcast(chosen.select(F.col("_id").alias("doc_id")).distinct()), "doc_id", "left_semi")

    def per_batch(doc_ids, texts):
        vectors = [vector(text) for text in texts]
        return {"doc_id": doc_ids, "index": [v[0] for v in vectors], "value": [v[1] for v in vectors]}

    vectors = map_texts(wanted, per_batch, "doc_id long, index array<int>, value array<float>")
    # Copies of an identifier would come back once per copy; its smallest vector stands for them.
    one = vectors.groupBy("doc_id").agg(F.min(F.struct("index", "value")).alias("v"))
    return one.join(F.broadcast(chosen), one["doc_id"] == chosen["_id"]).select("doc_id", "label", "v.index", "v.value")


def train(rows: DataFrame, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights fitted in one task to ``training_rows``; only they come to the driver, a fixed number."""

    def run(batches):
        examples = []
        for batch in batches:
            for doc_id, label, index, value in zip(*(batch.column(c) for c in ("doc_id", "label", "index", "value"))):
                # The array of one row is a view: no list of Python numbers is made.
                examples.append(
                    (doc_id.as_py(), label.as_py(), index.values.to_numpy(), value.values.to_numpy().astype(np.float64))
                )
        examples.sort(key=lambda e: (e[0], e[1]))
        model = Ftrl()
        model.fit([(index, value, label) for _, label, index, value in examples], epochs, seed)
        weights = model.weights(slice(None)).astype("<f4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([weights], pa.binary())], ["weights"])

    # One task sees at most the chosen rows, each of at most 4 x DIMENSIONS entries.
    fitted = rows.coalesce(1).mapInArrow(run, "weights binary").first()
    return np.frombuffer(fitted["weights"], "<f4") if fitted else np.zeros(DIMENSIONS + 1, "<f4")


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text; the weights, a fixed number, are broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def per_batch(doc_ids, texts):
        w = sent.value
        bias = float(w[-1])
        scores = []
        for text in texts:
            index, value = vector(text)
            scores.append(float(sigmoid(bias + float(w[index] @ value))))
        return {"doc_id": doc_ids, "score": scores}

    return map_texts(id_and_text(docs, id_col, text_col), per_batch, "doc_id long, score double")


def score_column(spark: SparkSession, weights: np.ndarray) -> Callable[[str], Column]:
    """The score as a column of a text column, for filters that keep whole rows."""
    sent = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        w = sent.value
        vectors = map(vector, texts.fillna(""))
        return pd.Series([float(sigmoid(float(w[-1]) + float(w[i] @ v))) for i, v in vectors], dtype="float64")

    return scores


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS
) -> DataFrame:
    """``doc_id, score, predicted``: fitted to ``labels`` (``doc_id, label``), applied to every row of ``docs``."""
    weights = train(training_rows(docs, labels, max_rows, id_col, text_col))
    return score(docs, weights, id_col, text_col).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str = "doc_id"):
    """True for the third of the identifiers that is kept from training: CRC-32 of the number as text, modulo 3, is 1."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1

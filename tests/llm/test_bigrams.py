"""All words and pairs against models made from plain dictionaries."""

import math
from collections import Counter

import numpy as np
import pytest
from edge_rows import documents, edge_rows, empty_rows, texts_of
from pyspark.sql import functions as F

from dispatchmart.llm import bigrams, queries
from dispatchmart.llm.classifier import shape


def brute_scores(texts, target):
    """Both models from plain dictionaries."""
    words, shapes = Counter(), Counter()
    for _, text in texts:
        words.update(text.split())
        shapes.update(map(shape, text.split()))
    size = 2 + len(words) + len(shapes)

    def tokens(text):
        return list(zip([None] + text.split(), text.split()))

    pairs = {name: Counter() for name in ("target", "background")}
    for doc_id, text in texts:
        pairs["background"].update(tokens(text))
        if doc_id in target:
            pairs["target"].update(tokens(text))
    loss = {}
    for name, counts in pairs.items():
        alone, context = Counter(), Counter()
        for (v, w), n in counts.items():
            alone[w] += n
            context[v] += n
        total, k = sum(alone.values()), bigrams.SMOOTHING

        def value(v, w, counts=counts, alone=alone, context=context, total=total):
            p = (alone[w] + k / size) / (total + k)
            return -math.log((counts[v, w] + k * p) / (context[v] + k))

        loss[name] = value
    scores = []
    for doc_id, text in texts:
        each = [loss["target"](v, w) - loss["background"](v, w) for v, w in tokens(text)]
        scores.append((str(doc_id), len(each), sum(each) / len(each) if each else 0.0))
    return sorted(scores)


def compare(rows, got, target):
    got = sorted((str(r[0]), r[1], r[2]) for r in got.collect())
    want = brute_scores(texts_of(rows), target)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9)


@pytest.mark.parametrize("share", [bigrams.HOT_SHARE, 0.01, 1.0])
def test_every_word_and_pair_counts(spark, sf_dir, share, monkeypatch):
    monkeypatch.setattr(bigrams, "HOT_SHARE", share)
    monkeypatch.setattr(bigrams, "_PORTION", 300)
    monkeypatch.setattr(bigrams, "_CHUNK", 2000)
    rows, target = documents(spark, sf_dir).where("doc_id < 60"), list(range(0, 60, 3))
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    compare(rows, bigrams.cross_entropy_difference(rows, ids), set(target))


@pytest.mark.parametrize("target", [[], [5, 5, None, 3, 400]])
def test_edge_rows(spark, target):
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    compare(edge_rows(spark), bigrams.cross_entropy_difference(edge_rows(spark), ids), {i for i in target if i is not None})


def test_no_rows(spark):
    assert bigrams.cross_entropy_difference(empty_rows(spark), spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_the_query_leaves_nothing_out(spark, sf_dir):
    got = queries.op6_lm_scoring(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()
    compare(documents(spark, sf_dir), got, {r["doc_id"] for r in labels})


def test_target_documents_score_lower(spark):
    """Good documents the target never saw rank before bad ones."""
    docs = documents(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = bigrams.cross_entropy_difference(docs, labels.where("quality = 1 AND doc_id % 2 = 0").select("doc_id"))
    rest = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good, bad = rest[rest.quality == 1].difference, rest[rest.quality == 0].difference
    assert np.mean([(good < s).mean() for s in bad]) > 0.85


def test_places_take_two_bytes_or_four():
    for largest in (0, 65_535, 65_536):
        places = np.array([0, largest, 7])
        raw = bigrams._as_bytes(places)
        assert len(raw) == (6 if largest < 65_536 else 12)
        assert (bigrams._places(np.frombuffer(raw.tobytes(), np.uint8), 3) == places).all()


def test_documents_are_not_named_in_every_bucket(spark, sf_dir, monkeypatch):
    """What is dealt, in bytes for each occurrence, if a bucket holds a few words of a document only."""
    rows = documents(spark, sf_dir)
    dealt, kind = [], type(rows)
    dealing = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: dealt.append(self) or dealing(self, *a))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        ids = spark.createDataFrame([(i,) for i in range(0, 500, 2)], "doc_id long")
        n_words = bigrams.cross_entropy_difference(rows, ids).agg(F.sum("n_words")).first()[0]
        sent = []
        for packed in (d for d in dealt if "bucket" in d.columns):
            blobs = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in packed.dtypes if t == "binary"]
            sent.append(packed.agg(F.sum(sum(blobs, F.lit(0)))).first()[0] / n_words)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(sent) == 2
    assert sum(sent) < 18.5


def test_a_chunk_of_many_short_texts(spark, monkeypatch):
    """More texts than a block and a chunk hold, most of them copies, over several chunks of a task."""
    monkeypatch.setattr(bigrams, "_CHUNK_DOCS", 1500)
    rows = spark.createDataFrame([(i, f"a{i % 7} b c{i % 3} a{i % 5}" if i % 11 else None) for i in range(4000)], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 4000, 4)], "doc_id long")
    compare(rows.coalesce(1), bigrams.cross_entropy_difference(rows.coalesce(1), ids), set(range(0, 4000, 4)))


def test_tables_that_grow_are_not_sent_through_the_driver(spark, monkeypatch):
    """Neither the target's identifiers nor the sums of texts are the broadcast side of a join."""
    rows = spark.range(25_000).selectExpr("id AS doc_id", "concat('a b ', id % 24000) AS text")
    plans, saved = [], bigrams.saved

    def seen(df, *more):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return saved(df, *more)

    monkeypatch.setattr(bigrams, "saved", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = bigrams.cross_entropy_difference(rows, rows.where("doc_id % 24 > 1").select("doc_id"))
        plans.append(got._jdf.queryExecution().optimizedPlan().toString())
        assert not any("strategy=broadcast" in plan for plan in plans)
        assert got.where("n_words = 3").count() == 25_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_identifiers_of_the_target_are_packed():
    for ids, width in (([], 1), ([7], 1), ([5, 3, 3, 300], 2), ([0, 70_000], 4), ([-(1 << 63), 0, (1 << 63) - 1], 8)):
        packed = bigrams.Target(np.array(ids, np.int64))
        assert packed.ids().tolist() == sorted(set(ids))
        assert packed.steps.itemsize == width


@pytest.mark.parametrize("target", [[], [5, 5, None, 3, 400, -7, 0]])
def test_more_identifiers_than_are_sent(spark, target, monkeypatch):
    monkeypatch.setattr(bigrams, "_SENT_IDS", -1)
    monkeypatch.setattr(bigrams, "_JOINED_ROWS", 0)
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    compare(edge_rows(spark), bigrams.cross_entropy_difference(edge_rows(spark), ids), {i for i in target if i is not None})

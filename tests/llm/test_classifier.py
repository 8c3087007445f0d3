import numpy as np
import pytest
from edge_rows import documents, edge_rows, empty_rows
from pyspark.sql import functions as F

from dispatchmart.llm import classifier


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))


def test_updates_follow_the_definition():
    """Against the update written out weight by weight."""
    draw = np.random.default_rng(1)
    model = classifier.Ftrl(dimensions=20, alpha=0.3, beta=1.0, l1=0.05, l2=0.2)
    z, n = [0.0] * 21, [0.0] * 21
    for _ in range(200):
        index = draw.choice(20, 5)  # may repeat
        value, label = draw.random(5), int(draw.integers(0, 2))
        model.update(index.astype(np.int32), value, label)
        x = dict.fromkeys([*index.tolist(), 20], 0.0)
        for i, v in zip(index.tolist(), value.tolist()):
            x[i] += v
        x[20] = 1.0
        w = {}
        for i in x:
            w[i] = 0.0 if abs(z[i]) <= 0.05 else -(z[i] - np.sign(z[i]) * 0.05) / ((1.0 + n[i] ** 0.5) / 0.3 + 0.2)
        p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
        for i in x:
            g = (p - label) * x[i]
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.3
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_held_out_accuracy(spark, labels):
    docs = documents(spark, "/root/testdata/sf0.01")
    known = labels.where(~classifier.held_out())
    scored = classifier.classify(docs, known).join(labels.where(classifier.held_out()), "doc_id").toPandas()
    assert len(scored) > 100
    good, bad = scored[scored.label == 1].score, scored[scored.label == 0].score
    assert np.mean([(good > s).mean() + 0.5 * (good == s).mean() for s in bad]) > 0.97
    assert (scored.predicted == scored.label).mean() > 0.93
    assert scored.score.between(0, 1).all()


def test_only_the_text_and_the_label_count(spark, labels):
    """Other columns, and labels of held-out rows, change no score."""
    docs = documents(spark, "/root/testdata/sf0.001")
    known = labels.where(~classifier.held_out())
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "label": F.lit(1), "score": F.lit(0.1)})
    one = classifier.classify(docs, known).orderBy("doc_id").collect()
    assert one == classifier.classify(other, known).orderBy("doc_id").collect()


def test_edge_rows(spark):
    rows = edge_rows(spark)
    given = [(5, 1), (6, 1), (3, 0), (3, 1), (13, 0), (None, 1), (4, None), (99, 1)]
    labels = spark.createDataFrame(given, "doc_id long, label int")
    got = classifier.classify(rows, labels).toPandas()
    assert len(got) == rows.count() and got.score.between(0, 1).all()
    assert got[got.doc_id == 5].score.item() == got[got.doc_id == 6].score.item() == got[got.doc_id == -7].score.item()
    assert got[got.doc_id == 0].score.item() == got[got.doc_id == 1].score.item() == got[got.doc_id == 2].score.item()
    assert got[got.doc_id == 3].score.nunique() == 1


def test_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert classifier.classify(empty_rows(spark), none).count() == 0
    assert set(classifier.classify(edge_rows(spark), none).toPandas().score) == {0.5}


def test_sample_is_bounded_and_stays(spark, labels):
    docs = documents(spark, "/root/testdata/sf0.01")
    few = classifier.training_rows(docs, labels, max_rows=30)
    assert sorted(r[0] for r in few.collect()) == sorted(r[0] for r in few.collect())
    assert few.count() == 30


def test_column_and_table_give_the_same_scores(spark, labels):
    docs = documents(spark, "/root/testdata/sf0.001")
    weights = classifier.train(classifier.training_rows(docs, labels))
    column = docs.select("doc_id", classifier.score_column(spark, weights)("text").alias("score"))
    assert sorted(map(tuple, column.collect())) == sorted(map(tuple, classifier.score(docs, weights).collect()))

"""Records of changing shape, running totals and leading terms of a stream."""

import random
from collections import Counter

import pytest

from dispatchmart.operators.terms import top_terms
from dispatchmart.sources.commits import Store
from dispatchmart.sources.readers import flexible_records
from dispatchmart.streaming import capture
from dispatchmart.streaming.leading import MESSAGES, SUMMARY, follow_terms, leading_terms, merge_batch


def test_each_field_of_a_record_is_taken_on_its_own(spark):
    lines = [
        '{"created_at": "1", "text": "a", "lang": "en", "new": {"x": [1]}}',
        '{"text": "b"}',
        '{"created_at": {"day": 1}, "text": "c", "lang": ["en"], "retweeted_status": {}}',
        '{"created_at": 5, "text": 6.5, "lang": null, "retweeted_status": null}',
        '{"text": "short", "extended_tweet": {"full_text": "long"}}',
        '{"text": "kept", "extended_tweet": {"full_text": [1]}}',
        '{"text": "kept too", "extended_tweet": 3}',
        '{"text": {"a": 1}}', '{}', "null", "[1]", '"text"', '{"text": "cut', "  ", "", None, '{"text": ""}',
    ]
    df = spark.createDataFrame([(line, "clash") for line in lines], "value string, text string")
    got = [tuple(r) for r in flexible_records(df).select("created_at", "text", "lang", "full_text", "is_retweet", "problem").collect()]
    assert got == [
        ("1", "a", "en", None, False, None),
        (None, "b", None, None, False, None),
        (None, "c", None, None, True, None),
        ("5", "6.5", None, None, False, None),
        (None, "short", None, "long", False, None),
        (None, "kept", None, None, False, None),
        (None, "kept too", None, None, False, None),
        (None, None, None, None, False, "no text"),
        (None, None, None, None, False, "no text"),
        (None, None, None, None, False, "no object"),
        (None, None, None, None, False, "no object"),
        (None, None, None, None, False, "no object"),
        (None, None, None, None, False, "no JSON"),
        (None, "", None, None, False, None),
    ]


def test_a_batch_of_a_bounded_capture_reads_nothing_captured(spark, tmp_path, monkeypatch):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "created_at string, tweet string"
    for n in range(4):
        spark.createDataFrame([(f"{n}-{i}", "taxi") for i in range(5)], schema).coalesce(1).write.mode("append").parquet(source)
    reads = []
    monkeypatch.setattr(Store, "read_version", lambda self, version, parts=None: reads.append(version) or _read(self, version, parts))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = capture.run_bounded_capture(stream, out, state, 12)
    assert len(reads) == 1 and got.count() == 12  # only the result is read
    store = Store(spark, out)
    assert store.snapshot().marks == {"batch": 2, "captured": 12}
    assert len(store.snapshot().tables["messages"].parts) == 1 + 3


_read = Store.read_version


def messages(spark, texts):
    return spark.createDataFrame([(text,) for text in texts], "tweet string")


def drawn(seed, count):
    draw = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}" for i in range(400)]
    return [" ".join(draw.choices(words, weights=[1 / (i + 1) for i in range(400)], k=12)) for _ in range(count)]


@pytest.mark.parametrize("counters", [60, 5_000])
def test_leading_terms_of_batches_are_those_of_the_table(spark, tmp_path, counters):
    store, texts = Store(spark, str(tmp_path / "mart")), []
    for batch in range(4):
        part = drawn(batch, 150)
        for _ in range(2):  # a batch that comes again is not merged again
            commit = store.begin()
            merged = merge_batch(commit, messages(spark, part), batch, counters)
            if merged:
                commit.publish()
        assert not merged
        texts += part
        want = [tuple(r) for r in top_terms(messages(spark, texts), 10).collect()]
        assert [tuple(r) for r in leading_terms(store, 10).collect()] == want
    summary = store.read(SUMMARY)
    counts = Counter(word for text in texts for word in text.split())
    assert summary.count() <= counters
    assert all(r.low <= counts[r.term] <= r.high for r in summary.collect())
    held = {r.term for r in summary.collect()}
    bound = store.snapshot().marks["bound"]
    assert all(n <= bound for term, n in counts.items() if term not in held)
    assert (summary.where("low <> high").count() > 0) == (counters == 60)


def test_a_summary_that_is_too_small_says_so(spark, tmp_path):
    store = Store(spark, str(tmp_path / "mart"))
    for batch in range(3):
        commit = store.begin()
        merge_batch(commit, messages(spark, [f"a{'xyz'[batch]}b c{'xyz'[batch]}d"] * 3), batch, counters=2)
        commit.publish()
    with pytest.raises(ValueError):
        leading_terms(store, 5)


def test_leading_terms_of_a_stream_restart_from_the_checkpoint(spark, tmp_path):
    store, source, state = Store(spark, str(tmp_path / "mart")), str(tmp_path / "in"), str(tmp_path / "state")
    texts = []
    for run in range(2):
        for _ in range(2):
            texts += drawn(len(texts), 50)
            messages(spark, texts[-50:]).coalesce(1).write.mode("append").parquet(source)
        follow_terms(spark.readStream.schema("tweet string").option("maxFilesPerTrigger", 1).parquet(source), store, state, 80)
        assert store.read(MESSAGES).count() == len(texts)
        want = [tuple(r) for r in top_terms(messages(spark, texts), 5).collect()]
        assert [tuple(r) for r in leading_terms(store, 5).collect()] == want


@pytest.mark.parametrize("files", [1, 3])
def test_scored_stream_reads_a_table_of_any_number_of_files(spark, tmp_path, files):
    from dispatchmart.catalog.queries import QUERIES

    turns = [(i // 4, i % 4, "user", f"taxi good number {'x' * i}") for i in range(12)]
    tables = {
        "conversations": spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"),
        "documents": spark.createDataFrame([(1, "taxi good taxi number")], "doc_id long, text string"),
        "benchmark": spark.createDataFrame([(1, "good number")], "item_id long, text string"),
    }
    for name, rows in tables.items():
        rows.repartition(files).write.parquet(str(tmp_path / f"{name}.parquet"))
    scored = QUERIES["stream_scored"](spark, str(tmp_path))
    assert sorted(r.created_at for r in scored.collect()) == sorted(f"{i // 4}-{i % 4}" for i in range(12))

import random

import pytest
from edge_rows import edge_rows

from dispatchmart.llm import urls

RULES = [
    urls.Rule("allow", "org/"),
    urls.Rule("block", "example.org/es/"),
    urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"),
    urls.Rule("block", "com/de/"),
]


def brute_address(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def brute_rule(host, path):
    fits = [
        r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.address), default=None)


URLS = [
    None, "", "no scheme", "http://", "http://ORG/x", "https://a.Example.ORG/es/1", "http://example.org/en/12?x#y",
    "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de/1#z", "http://x.com/fr", "http://com/de/",
    "a://b://c/d", "http://ÄÖ.net/ü", "http://x.net?q=/a", "http://x.net#/es/", "http://example.org", "HTTP://Spam.net/a",
    "http://x.com/de/1#z", "http://www.example.org/en/1", "http://example.org/en/2", "://", "x://?", "http://a\nb.org/es/\n1",
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")


def test_rules_and_list(spark, pages):
    addressed = urls.with_address(pages)
    listed = spark.createDataFrame([("spam.net/a",), ("x.com/fr",), ("x.com/de/1",), ("elsewhere/",), (None,)], "key string")
    got = urls.judge(addressed, RULES, urls.build_cascade(listed, addressed.select("key"))).collect()
    on_list = {r[0] for r in listed.collect()}
    for row in got:
        host, path = brute_address(row["url"])
        rule = brute_rule(host, path)
        assert (row["host"], row["path"]) == (host, path)
        assert row["rule"] == (rule.address if rule else None)
        assert row["listed"] == (host + path in on_list)
        assert row["verdict"] == (rule.verdict if rule else "block" if host + path in on_list else "allow")
    assert len(got) == len(URLS)


@pytest.mark.parametrize("max_bits", [1 << 25, 2048])
def test_membership_is_exact_for_the_whole_corpus(spark, max_bits):
    draw = random.Random(1)
    keys = [f"host{i % 7}.example/{i}" for i in range(6000)]
    listed = set(draw.sample(keys, 900))
    corpus = spark.createDataFrame([(k,) for k in keys + keys[:500]], "key string")
    cascade = urls.build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), corpus, max_bits)
    assert (cascade.parts > 1) == (max_bits == 2048)
    rows = corpus.withColumns({"host": urls.F.lit("h"), "path": urls.F.lit("p")})
    got = {(r["key"], r["listed"]) for r in urls.judge(rows, [], cascade).collect()}
    assert got == {(k, k in listed) for k in keys}
    assert len(cascade._sizes) > 1  # false positives were there and needed further levels


def test_first_level_alone_would_be_wrong(spark):
    keys = [f"k{i}" for i in range(6000)]
    corpus = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = urls.build_cascade(corpus.where("key LIKE '%7'"), corpus)
    alone = urls.Cascade(cascade._filters, cascade._sizes[:1], 1)
    wrong = corpus.where(alone.listed(urls.F.col("key")) != urls.F.col("key").like("%7")).count()
    assert 0 < wrong < 600


def test_empty_list_and_empty_table(spark, pages):
    addressed = urls.with_address(pages)
    none = addressed.select("key").limit(0)
    got = urls.judge(addressed, [], urls.build_cascade(none, addressed.select("key"))).collect()
    assert {r["verdict"] for r in got} == {"allow"} and {r["listed"] for r in got} == {False}
    nothing = urls.with_address(pages.limit(0))
    assert urls.judge(nothing, RULES, urls.build_cascade(none, nothing.select("key"))).count() == 0


def test_other_columns_stay(spark):
    rows = urls.with_address(edge_rows(spark), "text")
    got = urls.judge(rows, RULES, urls.build_cascade(rows.select("key"), rows.select("key")))
    assert got.count() == rows.count()
    assert set(got.columns) == {*rows.columns, "listed", "rule", "verdict"}


def test_no_python_and_no_join(spark, pages):
    addressed = urls.with_address(pages)
    cascade = urls.build_cascade(addressed.select("key").where("key LIKE 'x%'"), addressed.select("key"))
    plan = urls.judge(addressed, RULES, cascade)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan

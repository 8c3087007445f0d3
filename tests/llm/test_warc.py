import datetime

import pytest

from dispatchmart.llm import warc

SCHEMA = "record_id long, kind string, url string, date timestamp, status int, headers map<string,string>, canonical string, _range int"
DAY = datetime.datetime(2024, 1, 1)


def day(n):
    return None if n is None else DAY + datetime.timedelta(days=n)


RECORDS = [
    (1, "response", "http://www.A.net:80/x/?b=2&utm_source=q&a=1#f", 1, 200, {"ETag": '"1"', "Content-Length": "9", "X": "old"}),
    (2, "revisit", "https://a.net/x?a=1&b=2", 2, 304, {"etag": 'W/"1"', "Content-Length": "0", "Cache-Control": "no-store", "X": "new"}),
    (3, "response", "https://a.net/x?a=1&b=2", 3, 200, {"ETag": '"2"', "Last-Modified": "m"}),
    (4, "revisit", "http://a.net/x?a=1&b=2", 4, 304, {"ETag": '"1"'}),
    (5, "revisit", "http://a.net/x?a=1&b=2", 5, 304, {"Last-Modified": "m", "Expires": "soon", "Date": None}),
    (6, "revisit", "http://a.net/x?a=1&b=2", 3, 304, {"ETag": '"2"'}),
    (7, "revisit", "http://a.net/x?a=1&b=2", 0, 304, {"ETag": '"1"'}),
    (8, "revisit", "http://a.net/x?a=1&b=2", 6, 304, None),
    (9, "revisit", None, 6, 304, {"ETag": '"1"'}),
    (10, "revisit", "http://a.net/x?a=1&b=2", None, 304, {"ETag": '"1"'}),
    (11, "response", "http://a.net/x?a=1&b=2", 5, 404, {"ETag": '"2"'}),
    (12, "response", "http://a.net/x?a=1&b=2", None, 200, {"ETag": '"9"'}),
    (13, "request", "http://a.net/x?a=1&b=2", 5, 200, {"ETag": '"9"'}),
    (14, "revisit", "http://b.net/", 5, 304, {"ETag": '"9"'}),
    (15, "response", None, 1, 200, {"ETag": '"1"'}),
    (2, "revisit", "https://a.net/x?a=1&b=2", 2, 304, {"etag": 'W/"1"', "Content-Length": "0", "Cache-Control": "no-store", "X": "new"}),
]


def table(spark, records):
    return spark.createDataFrame([(i, k, u, day(d), s, h, "clash", 0) for i, k, u, d, s, h in records], SCHEMA)


def test_outcomes(spark):
    got = sorted((r["record_id"], r["outcome"], r["refers_to"]) for r in warc.resolve_revisits(table(spark, RECORDS)).collect())
    assert got == [
        (2, "resolved", 1),
        (2, "resolved", 1),
        (4, "validator_mismatch", None),
        (5, "resolved", 3),
        (6, "resolved", 3),
        (7, "no_earlier_response", None),
        (8, "no_validator", None),
        (9, "no_url", None),
        (10, "no_date", None),
        (14, "no_earlier_response", None),
    ]


def test_headers(spark):
    got = {r["record_id"]: r["headers"] for r in warc.resolve_revisits(table(spark, RECORDS)).collect()}
    assert got[2] == {"etag": 'W/"1"', "content-length": "9", "x": "old", "cache-control": "no-store"}
    assert got[5] == {"etag": '"2"', "last-modified": "m", "expires": "soon"}
    assert got[4] is None


def test_no_rows(spark):
    assert warc.resolve_revisits(table(spark, [])).count() == 0


@pytest.mark.parametrize("sites", [1, 40])
def test_one_address_may_fill_many_ranges(spark, sites):
    """Against a scan over all records in order."""
    records = [
        (i, "response" if i % 97 == 0 else "revisit", f"http://s{i % sites}.net/", i * 31 % 1009, 200, {"ETag": f'"{i * 31 % 1009 // 300}"'})
        for i in range(2000)
    ]
    want, latest = [], {}
    for i, kind, url, n, _, headers in sorted(records, key=lambda r: (r[3], r[0])):
        if kind == "response":
            latest[url] = (i, headers["ETag"])
        elif url not in latest:
            want.append((i, "no_earlier_response", None))
        else:
            same = latest[url][1] == headers["ETag"]
            want.append((i, "resolved", latest[url][0]) if same else (i, "validator_mismatch", None))
    got = [(r["record_id"], r["outcome"], r["refers_to"]) for r in warc.resolve_revisits(table(spark, records)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_payload(spark):
    resolved = warc.resolve_revisits(table(spark, RECORDS))
    bodies = spark.createDataFrame([(1, "one"), (3, "three")], "record_id long, body string")
    got = {r["record_id"]: r["body"] for r in warc.with_payload(resolved, bodies).collect()}
    assert got[2] == "one" and got[5] == "three" and got[4] is None

import numpy as np
import pytest
import xxhash
from edge_rows import documents, edge_rows, empty_rows, texts_of

from dispatchmart.llm import simhash
from dispatchmart.llm.components import connected_components


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for gap in "\t\n\x0b\x0c\r":
        words = words.replace(gap, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(bits):
    """Smallest index reachable over links of at most three bits, from every pair."""
    root = list(range(len(bits)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(bits)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(bits))]


def check_link(rows):
    got = simhash.link(rows).collect()
    known = [(i, t) for i, t in texts_of(rows) if i is not None]
    known.sort(key=lambda r: r[0])
    bits = [brute_fingerprint(t) for _, t in known]
    want = [(i, b, known[c][0]) for (i, _), b, c in zip(known, bits, brute_components(bits))]
    assert sorted((r[0], r[1] & (1 << 64) - 1, r[2]) for r in got if r[0] is not None) == sorted(want)
    return got


def test_documents(spark, sf_dir):
    got = check_link(documents(spark, sf_dir).where("doc_id < 300"))
    assert len({r["component_id"] for r in got}) < len(got)


@pytest.mark.parametrize("given", [edge_rows, empty_rows])
def test_edge_rows(spark, given):
    got = check_link(given(spark))
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


@pytest.mark.parametrize("block", [4, 50, 4096])
def test_links_in_crowded_cells(spark, block):
    """Clusters of many near points, for which cells are divided into blocks."""
    draw = np.random.default_rng(0)
    points = set()
    for base in draw.integers(-(2**63), 2**63 - 1, 25, dtype=np.int64).tolist():
        for _ in range(80):
            flips = draw.integers(0, 64, draw.integers(0, 6)).tolist()
            point = base & (1 << 64) - 1
            for b in flips:
                point ^= 1 << b
            points.add(point)
    points = sorted(points)
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(points)]
    links = simhash.near_links(spark.createDataFrame(rows, "bits long, rep long"), block=block)
    pairs = [tuple(r) for r in links.collect()]
    assert all((points[a] ^ points[b]).bit_count() <= 3 for a, b in pairs)
    assert len(pairs) < 60 * len(points)
    groups = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert [groups.get(i, i) for i in range(len(points))] == brute_components(points)


def test_bound_is_below_the_distance(spark):
    draw = np.random.default_rng(4)
    pairs = draw.integers(-(2**63), 2**63 - 1, (300, 2), dtype=np.int64).tolist()
    pairs += [(a, a ^ (1 << int(k))) for (a, _), k in zip(pairs, draw.integers(0, 63, 300))]
    df = spark.createDataFrame(pairs, "a long, b long")
    counts = df.select("a", "b", *[simhash._segment_counts(df[c]).alias(f"n{c}") for c in "ab"]).collect()
    for row in counts:
        segments = lambda x: [(x & (1 << 64) - 1) >> (2 * i) & 3 for i in range(32)]
        of = {c: segments(row[c]) for c in "ab"}
        assert segments(row["na"]) == [s.bit_count() for s in of["a"]]
        distance = sum(abs(x - y) for x, y in zip(segments(row["na"]), segments(row["nb"])))
        assert distance <= ((row["a"] ^ row["b"]) & (1 << 64) - 1).bit_count()


def test_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(500)]
    got = dict(map(tuple, connected_components(spark.createDataFrame([*chain, *star, (7, 7)], "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1501)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    rows = edge_rows(spark)
    kept = simhash.one_of_each(rows)
    assert kept.columns == rows.columns
    groups = {r["doc_id"]: r["component_id"] for r in simhash.link(rows).collect() if r["doc_id"] is not None}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(set(groups.values()))
    assert got.count(None) == 2
    assert simhash.one_of_each(empty_rows(spark)).count() == 0


def test_near_copies_go_and_others_stay(spark):
    words = [f"w{i * 7919 % 1009}" for i in range(400)]
    other = [f"v{i * 104729 % 997}" for i in range(400)]
    near = [*words[:-1], "changed"]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(near)), (4, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == [1, 4]

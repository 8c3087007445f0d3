"""Groups of near copies against the Jaccard similarity of all pairs that share a shingle."""

import random

import pytest
from edge_rows import documents, edge_rows, empty_rows, texts_of

from dispatchmart.llm import near_copies


def brute_shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for gap in "\t\n\x0b\x0c\r":
        words = words.replace(gap, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_links(texts, similarity=0.8):
    """Pairs of rows, by their place, whose shingle sets are that similar."""
    sets = [brute_shingles(t) for _, t in texts]
    holders, links = {}, set()
    for i, shingles in enumerate(sets):
        shared = {}
        for s in shingles or [None]:
            for j in holders.get(s, []):
                shared[j] = shared.get(j, 0) + 1
            holders.setdefault(s, []).append(i)
        for j, both in shared.items():
            if not shingles or both >= similarity * (len(shingles) + len(sets[j]) - both):
                links.add((j, i))
    return links


def brute_groups(texts, links):
    root = {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = sorted((find(texts[i][0]), find(texts[j][0])))
        root[b] = a
    return {i: find(i) for i in root}


def groups_of(rows, **options):
    found = near_copies.link(rows, **options).collect()
    assert len(found) == rows.where("doc_id IS NOT NULL").count()
    groups = {r["doc_id"]: r["component_id"] for r in found}
    assert len(groups) == len({tuple(r) for r in found})
    return groups


def known_texts(rows):
    return [(i, t) for i, t in texts_of(rows) if i is not None]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_documents(spark, size):
    rows = documents(spark, f"/root/testdata/{size}")
    texts = known_texts(rows)
    links = brute_links(texts)
    got, want = groups_of(rows), brute_groups(texts, links)
    together = [got[texts[i][0]] == got[texts[j][0]] for i, j in links]
    assert sum(together) >= 0.99 * len(together)
    assert all(want[i] == want[component] for i, component in got.items())  # no false group


def test_many_near_copies_of_one_text(spark):
    """A chain of drifting texts and a crowd around one; cells are divided into small blocks."""
    draw = random.Random(3)
    base = [f"w{draw.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(draw.randrange(1, 4)):
            words[draw.randrange(300)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    drifting = [f"d{i}" for i in range(300)]
    for i in range(200, 240):
        drifting[draw.randrange(300)] = f"y{i}"
        rows.append((i, " ".join(drifting)))
    rows += [(1000 + i, " ".join(f"z{draw.randrange(10**6)}" for _ in range(100))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows, brute_links(rows))
    assert len(set(want.values())) < 60
    assert groups_of(df, block=16) == want


def test_a_crowd_of_texts_below_the_similarity_makes_no_pairs(spark, monkeypatch):
    """Most of a crowd share cells without being similar; pairs made grow with the texts, links are all found."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(draw.randrange(1, 6)):
            words[draw.randrange(150)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(7, rows[300][1]), (900, rows[301][1]), (900, "alone")]  # an identifier of two texts, a copy
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made, verified = [], near_copies.verified

    def counting(pairs, *rest):
        made.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "verified", counting)
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 1 << 12)
    links = brute_links(rows)
    want = brute_groups(rows, links)
    got = groups_of(df)
    assert made[-1] < 20 * len(rows)  # 400 texts have 79,800 pairs
    together = [got[rows[i][0]] == got[rows[j][0]] for i, j in links]
    assert len(set(want.values())) > 50 and sum(together) >= 0.99 * len(together)
    assert all(want[i] == want[component] for i, component in got.items())
    assert groups_of(df, crowd=10**6) == got  # pair by pair


@pytest.mark.parametrize("given", [edge_rows, empty_rows])
def test_edge_rows(spark, given):
    rows = given(spark)
    texts = known_texts(rows)
    want = brute_groups(texts, brute_links(texts))
    assert groups_of(rows) == want
    kept = near_copies.one_near_copy(rows)
    assert kept.columns == rows.columns
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(set(want.values()))
    assert got.count(None) == sum(i is None for i, _ in texts_of(rows))


def test_rows_of_one_identifier_are_one_document(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, one), (5, other), (6, one + " end"), (7, other + " end"), (8, "nothing like it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert groups_of(df) == {5: 5, 6: 5, 7: 5, 8: 8}


def test_very_long_text(spark):
    words = " ".join(f"w{i * 7919 % 100003}" for i in range(150_000))
    df = spark.createDataFrame([(1, words), (2, words + " more"), (3, words[: len(words) // 2])], "doc_id long, text string")
    assert groups_of(df) == {1: 1, 2: 1, 3: 3}

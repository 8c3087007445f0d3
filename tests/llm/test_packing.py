import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from edge_rows import documents, edge_rows, empty_rows, texts_of
from tokenizers import Tokenizer

from dispatchmart.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


def check_layout(rows, capacity):
    """No sequence is overfull; its pieces lie one after the other from 0."""
    sequences = {}
    for row in rows:
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def expected_pieces(rows, capacity=1024):
    library = Tokenizer.from_file(FILE)
    for doc_id, text in texts_of(rows):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity or min(len(ids), capacity)
        starts = [0, *range(first, len(ids), capacity)]
        for piece, (start, end) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            yield str(doc_id), piece, start, end - start, zlib.crc32(ids[start:end].tobytes())


@pytest.mark.parametrize("given", [edge_rows, empty_rows])
def test_pieces_of_edge_rows(spark, given):
    rows = given(spark)
    got = packing.pack_documents(rows, FILE).collect()
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(expected_pieces(rows))
    check_layout(got, 1024)


def test_documents_fit_into_nearly_as_few_sequences_as_their_tokens_need(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = packing.pack_documents(docs, FILE).collect()
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(expected_pieces(docs))
    assert check_layout(got, 1024) <= -(-sum(r["length"] for r in got) // 1024) + 2


def test_identifiers_of_pieces_make_up_the_document(spark):
    rows = edge_rows(spark).where("doc_id = 11")
    got = sorted(packing.token_pieces(rows, FILE, 2, 1024, with_ids=True).collect(), key=lambda r: r["piece"])
    library = Tokenizer.from_file(FILE)
    text = rows.first()["text"]
    assert [i for r in got for i in r["ids"]] == [*library.encode(text, add_special_tokens=False).ids, 2]


def optimum(lengths, capacity):
    """Fewest bins, by trying all ways."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                bins[b] += lengths[i]
                place(i + 1, bins)
                bins[b] -= lengths[i]
        bins.append(lengths[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best


def test_local_search_raises_squared_fill_and_loses_nothing():
    draw = random.Random(2)
    above = 0
    for _ in range(150):
        lengths = [draw.randint(1, 19) for _ in range(9)]
        bins = packing.Bins(20)
        bins.best_fit(lengths)
        before, squares = sum(f > 0 for f in bins.fill), sum(f * f for f in bins.fill)
        bins.improve()
        after = sum(f > 0 for f in bins.fill)
        assert sum(f * f for f in bins.fill) >= squares and after <= before
        assert sorted(i for held in bins.items for _, i in held) == list(range(9))
        assert all(sum(n for n, _ in held) == f <= 20 for held, f in zip(bins.items, bins.fill))
        above += after - optimum(lengths, 20)
    assert above <= 3


def test_exchanges_empty_bins_that_best_fit_leaves():
    # Longest first pairs 342 with 342; only an exchange makes room for a third piece.
    bins = packing.Bins(1024)
    bins.best_fit([341, 342] * 300)
    assert sum(f > 0 for f in bins.fill) == 250
    bins.improve()
    assert sum(f > 0 for f in bins.fill) == 225  # 150 of 341 + 341 + 342, 75 of 342 + 342


def test_groups_and_rounds_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, i % 90 + 1, "x") for i in range(3000)], "doc_id long, length long, note string")
    got = packing.pack(rows, capacity=100, group=200).collect()
    assert len(got) == 3000
    assert sorted(r["length"] for r in got) == sorted(i % 90 + 1 for i in range(3000))
    assert check_layout(got, 100) <= 1.02 * sum(r["length"] for r in got) / 100 + 1


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from edge_rows import documents, edge_rows, empty_rows, texts_of

from dispatchmart.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def digests(library, text):
    ids = library.encode_ordinary(text)
    raw = library.decode_bytes(ids)
    assert raw == text.encode()
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()


@pytest.mark.parametrize("given", [edge_rows, empty_rows])
def test_round_trip_agrees_with_the_library(spark, library, given):
    rows = given(spark)
    got = bpe.round_trip(rows, RANKS, PATTERN).collect()
    want = [(doc_id, *digests(library, text)) for doc_id, text in texts_of(rows)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_round_trip_over_documents(spark, library, sf_dir):
    docs = documents(spark, sf_dir)
    got = {row[0]: tuple(row)[1:] for row in bpe.round_trip(docs, RANKS, PATTERN).collect()}
    assert got == {doc_id: digests(library, text) for doc_id, text in texts_of(docs)}


def test_encode_then_decode_gives_the_bytes_back(spark):
    rows = edge_rows(spark)
    encoded = bpe.encode(rows, RANKS, PATTERN)
    got = bpe.decode(encoded, RANKS, PATTERN).collect()
    assert sorted((str(r["doc_id"]), bytes(r["bytes"])) for r in got) == sorted(
        (str(i), text.encode()) for i, text in texts_of(rows)
    )


def test_cuts_do_not_change_identifiers(library):
    codec, draw = bpe.Codec(bpe.read_ranks(RANKS), PATTERN), random.Random(3)
    for _ in range(2000):
        text = "".join(draw.choice("ab 1's\n\t    \x1c\x85.!é日") for _ in range(draw.randint(0, 80)))
        assert codec.encode(text, chars=7) == library.encode_ordinary(text)


def test_very_long_runs_of_white_space():
    codec = bpe.Codec(bpe.read_ranks(RANKS), PATTERN)
    for text in ("x" + " " * 2_000_000 + "y z", "\n" * 300_000, "a" * 300_000, " " * 100_000 + "\n" * 50_000 + "b"):
        assert codec.decode(codec.encode(text)) == text.encode()
    # Long runs are encoded on their own; where the library can do them itself, it agrees.
    for gap in (" " * 20_000, "\n" * 20_001, " \n" * 10_000):
        for text in (f"x{gap}", f"x{gap}y", f"{gap}y", f"{gap}1 {gap}"):
            padded = text + " z" * (bpe.PIECE_CHARS // 2)
            assert codec.encode(padded) == codec._encoding.encode_ordinary(padded)

import random

import public_tokenizers
import pytest
import sentencepiece
from edge_rows import documents, edge_rows, empty_rows, texts_of

from dispatchmart.llm import counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def expected(library, rows):
    sizes = [(i, len(text.encode()), len(library.encode(text))) for i, text in texts_of(rows)]
    return sorted((str(i), b, n, n > 4096) for i, b, n in sizes)


@pytest.mark.parametrize("given", [edge_rows, empty_rows])
def test_counts_agree_with_the_library(spark, library, given):
    rows = given(spark)
    got = counts.count_tokens(rows, MODEL).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == expected(library, rows)


def test_counts_over_documents(spark, library, sf_dir):
    docs = documents(spark, sf_dir)
    got = counts.count_tokens(docs, MODEL).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == expected(library, docs)


def test_random_texts(library):
    counter, draw = counts.PairCounter(MODEL, remembered=50), random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice(["a", "b", " ", " ", "\n", "the", "ing", "日", "é", "▁", "<s>", "/", "🎉"]) for _ in range(draw.randint(0, 50)))
        assert counter.count(text) == len(library.encode(text)), text


def test_ties_merge_the_leftmost_pair(library):
    counter = counts.PairCounter(MODEL)
    for n in range(40):
        assert counter.count("a" * n) == len(library.encode("a" * n))
        assert counter.count(" " * n + "x") == len(library.encode(" " * n + "x"))


def test_other_models_are_refused():
    with pytest.raises(Exception):
        counts.PairCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"))

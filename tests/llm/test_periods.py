import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from edge_rows import documents, edge_rows, empty_rows, texts_of

from dispatchmart.llm import periods
from dispatchmart.llm.transform import PRIMES, transform, zero_differences


def slow_runs(words):
    """Every maximal stretch with its smallest period, straight from the definition."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            stop = at
            while stop + q < n and words[stop] == words[stop + q]:
                stop += 1
            piece = words[at : stop + q]
            if len(piece) >= max(12, 2 * q) and not any(piece[p:] == piece[:-p] for p in range(1, q)):
                out.append((at, len(piece), q))
            at = stop
    return sorted(out, key=lambda run: (run[0], run[2]))


def slow_altered(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def slow_row(doc_id, text):
    words = slow_altered(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text))
    runs = slow_runs(words)
    best = sorted(runs, key=lambda run: (-run[1], run[0], run[2]))[:1]
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    start, length, period = best[0] if best else (None, None, None)
    milli = 1000 * length // period if best else None
    digest = hashlib.sha256(listed.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), start, length, period, milli, digest, kept, listed


def as_sorted(rows):
    return sorted((tuple(row) for row in rows), key=repr)


def test_transform_is_the_sum_by_definition():
    draw = np.random.default_rng(1)
    for prime, generator in PRIMES:
        for length in (1, 2, 8, 32):
            rows = draw.integers(0, prime, (3, length)).astype(np.uint64)
            root = pow(generator, (prime - 1) // length, prime)
            want = [[sum(int(x) * pow(root, i * k, prime) for i, x in enumerate(r)) % prime for k in range(length)] for r in rows]
            got = transform(rows, prime, generator)
            assert got.tolist() == want
            assert (transform(got, prime, generator, inverse=True) == rows).all()


def test_zero_differences_are_exact():
    draw = np.random.default_rng(2)
    blocks = draw.integers(1, 3, (40, 4))
    windows = draw.integers(0, 3, (40, 11))
    got = set(zip(*(x.tolist() for x in zero_differences(blocks, windows, 2))))
    assert got == {(r, k) for r in range(40) for k in range(8) if (blocks[r] == windows[r, k : k + 4]).all()}
    # A sum of squares that is a multiple of one prime is no zero.
    prime = PRIMES[0][0]
    side = next(b for b in range(1, 30_000) if int((prime - b * b) ** 0.5) ** 2 == prime - b * b)
    other = int((prime - side * side) ** 0.5)
    assert len(zero_differences(np.array([[1, 1]]), np.array([[1 + side, 1 + other]]), 1 + max(side, other))[0]) == 0
    with pytest.raises(ValueError):
        zero_differences(np.array([[1, 1]]), np.array([[1, 1]]), 1 << 50)


def words_of(text):
    return [w.encode() for w in text.split()]


def runs_of(words):
    numbers = {}
    ids = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64)
    return periods.find_runs(ids, np.array([0, len(ids)]))


def test_random_words():
    draw = random.Random(3)
    for trial in range(400):
        letters = "ab" if trial % 3 == 0 else "abcdefgh"
        words = draw.choices(letters, k=draw.randint(0, 120))
        for _ in range(draw.randint(0, 3)):  # insert powers, with a fault now and then
            unit = draw.choices(letters, k=draw.randint(1, 40))
            power = (unit * 6)[: draw.randint(len(unit), 6 * len(unit))]
            if draw.random() < 0.3:
                power[draw.randrange(len(power))] = "x"
            at = draw.randint(0, len(words))
            words[at:at] = power
        assert runs_of(words) == slow_runs(words), words


def test_every_period_and_place():
    """A lone run is found wherever it stands and whatever its period, just long enough."""
    for q in range(1, 40):
        for shift in range(0, 70, 3):
            unit = [f"u{i}" for i in range(q)]
            run = (unit * 12)[: max(12, 2 * q)]
            words = [f"x{i}" for i in range(shift)] + run + [f"y{i}" for i in range(5)]
            assert runs_of(words) == [(shift, len(run), q)], (q, shift)
            assert runs_of(words[: shift + len(run) - 1]) == []


def test_documents_laid_end_to_end_do_not_touch():
    """The tail of one text and the head of the next would make a run."""
    texts = ["a b c d e f g", "a b c d e f g", "a b c d e f g a b c d e f g", "g a b c"]
    digests = periods._judge([words_of(t) for t in texts])
    assert [d[:4] for d in digests] == [(0, None, None, None), (0, None, None, None), (1, 0, 14, 7), (0, None, None, None)]


@pytest.mark.parametrize("given", [edge_rows, empty_rows])
def test_edge_rows(spark, given):
    rows = [(i, t) for i, t in texts_of(given(spark)) if len(t) < 15_000]
    got = [r for r in periods.collapse_runs(given(spark)).collect() if r["length"] != 3000]
    assert as_sorted(got) == as_sorted(slow_row(*row) for row in rows)


def test_documents(spark, sf_dir):
    rows = documents(spark, sf_dir).where("length(text) < 4000")
    assert as_sorted(periods.collapse_runs(rows).collect()) == as_sorted(slow_row(*row) for row in texts_of(rows))


def test_small_groups_and_short_blocks(monkeypatch):
    """Blocks located by their first words, windows in pieces and small portions give the same runs."""
    draw = random.Random(4)
    monkeypatch.setattr(periods, "LONGEST_BLOCK", 4)
    monkeypatch.setattr(periods, "CELLS_AT_ONCE", 64)
    for _ in range(60):
        unit = draw.choices("abcdefghijk", k=draw.randint(1, 70))
        words = draw.choices("abcdefghijk", k=20) + (unit * 4)[: draw.randint(len(unit), 4 * len(unit))]
        assert runs_of(words) == slow_runs(words)


def test_very_long_texts(spark):
    """A million characters: one word over and over, and one long period."""
    unit = " ".join(f"w{i * 7919 % 1_000_003}" for i in range(60_000))
    texts = ["word " * 200_000, f"{unit} {unit} {unit}"]
    ids = [i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 10][:2]
    assert min(map(len, texts)) >= 1_000_000
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in periods.collapse_runs(df).collect()}
    assert (got[ids[0]]["runs"], got[ids[0]]["collapsed"]) == ("0,200000,1\n", "word")
    assert (got[ids[1]]["runs"], got[ids[1]]["collapsed"]) == ("0,180000,60000\n", unit)

"""Byte-level BPE: whole texts to identifiers of a local rank file and back to bytes.

The merges are those of the tiktoken library. A very long text is cut before it gets there, only at places
no match of the splitting pattern can span, so the identifiers are those of the whole text.

Defined results: a null or empty text has no identifiers and decodes to no bytes; equal texts have equal
identifiers, each row of them is kept; an empty table gives an empty one; columns besides the id and the
text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchmart.llm.common import id_and_text, map_texts

PIECE_CHARS = 1 << 16
"""Texts beyond this many characters are encoded in pieces of about this length."""

LONG_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")
"""Runs of white space that the library's pattern engine may run out of stack on."""


def safe_cut(text: str, at: int) -> int:
    """The first place from ``at`` on where ``text`` may be cut, or its length.

    A match of the pattern has white space at its start only, or is a run of white space. No match therefore
    spans the place between a character that is none and the blank or line feed after it; nor does the end
    of the text there change the match before it, and a run of white space is never cut.
    ``str.isspace`` knows every character that the pattern takes for white space, and a few more, so some
    safe places are passed over, but no other is taken.
    """
    size = len(text)
    while at < size:
        blank = min((p for p in (text.find(" ", at), text.find("\n", at)) if p >= 0), default=size)
        if blank >= size or (blank > 0 and not text[blank - 1].isspace()):
            return blank
        at = blank + 1
    return size


def pieces(text: str, chars: int = PIECE_CHARS) -> Iterator[str]:
    start = 0
    while len(text) - start > chars:
        end = safe_cut(text, start + chars)
        yield text[start:end]
        start = end
    if start < len(text):
        yield text[start:]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Codec:
    """Identifiers of whole texts and the bytes they stand for."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, special: dict[str, int] | None = None):
        import tiktoken

        self._ids = special or {}
        strings = sorted(self._ids, key=len, reverse=True)
        self._special = re.compile(f"({'|'.join(map(re.escape, strings))})") if strings else None
        self._encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self._ids)

    def encode(self, text: str, chars: int = PIECE_CHARS) -> list[int]:
        """Identifiers of ``text``; strings of special tokens are ordinary text."""
        if len(text) <= chars:
            return self._encoding.encode_ordinary(text)
        ids, start = [], 0
        for gap in LONG_GAP.finditer(text):
            # The pattern takes the run as one match, but leaves its last character to what follows.
            end = gap.end() - (gap.end() < len(text))
            ids += self._pieces(text[start : gap.start()], chars)
            ids += self._encoding._encode_single_piece(text[gap.start() : end])
            start = end
        return ids + self._pieces(text[start:], chars)

    def _pieces(self, text: str, chars: int) -> list[int]:
        return [i for piece in pieces(text, chars) for i in self._encoding.encode_ordinary(piece)]

    def encode_with_special(self, text: str) -> list[int]:
        """Identifiers of ``text``; strings of special tokens become those tokens."""
        if self._special is None or not self._special.search(text):
            return self.encode(text)
        # The capturing split leaves the special strings at odd places.
        parts = enumerate(self._special.split(text))
        return [i for at, part in parts for i in ([self._ids[part]] if at % 2 else self.encode(part))]

    def decode(self, ids: list[int]) -> bytes:
        return self._encoding.decode_bytes(ids)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, made once in each worker."""
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the identifiers of every whole text. ``ranks`` is a file each executor has."""

    def per_batch(doc_ids, texts):
        one = codec(ranks, pattern)
        return {"doc_id": doc_ids, "ids": [np.array(one.encode(text), np.int32) for text in texts]}

    return map_texts(id_and_text(docs, id_col, text_col), per_batch, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` of rows ``doc_id, ids``; bytes, as a part of the identifiers need not be text."""
    import pyarrow as pa

    def run(batches):
        one = codec(ranks, pattern)
        for batch in batches:
            raw = [one.decode(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the identifiers and of what they decode to, in one pass and without moving either.

    ``doc_id, n_tokens, ids_sha256`` (little-endian unsigned 32-bit) and ``decoded_sha256``.
    """

    def per_batch(doc_ids, texts):
        one = codec(ranks, pattern)
        counts, of_ids, of_bytes = [], [], []
        for text in texts:
            ids = one.encode(text)
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            of_bytes.append(hashlib.sha256(one.decode(ids)).hexdigest())
        return {"doc_id": doc_ids, "n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_bytes}

    return map_texts(
        id_and_text(docs, id_col, text_col),
        per_batch,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )

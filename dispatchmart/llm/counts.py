"""Token counts by byte-pair merging on a heap and a linked list; identifiers are never made.

A text starts as a linked list of characters. The adjacent pair of lowest rank, the leftmost of equals, is
popped from a heap and merged, again and again; the count is the number of initial symbols less the
number of merges. A character the vocabulary lacks counts as its UTF-8 bytes and takes part in no merge.

Ranks come from a piece model of the sentencepiece library (kind BPE, with byte fallback, without
normalisation), read as data. The library's blank sign stands at the start of a piece or alone, so no merge
crosses the place before a blank that follows another character. Texts are cut there, and the counts of
frequent words are remembered in a worker up to a fixed number of words.

Defined results: null or empty text: 0 tokens and 0 bytes; each row of equal ones is kept; an empty table gives an
empty one; columns besides the id and the text are not read. Strings that look like special tokens are
ordinary text, as the library has it.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from dispatchmart.llm.common import id_and_text, map_texts

REMEMBERED_WORDS = 600_000
"""Words whose count a worker remembers at a time; it then starts anew. Bounds memory, not results."""

_BLANK = "▁"
_NORMAL, _USER_DEFINED, _UNUSED, _BPE = 1, 4, 5, 2


class PairCounter:
    """Counts tokens by the ranks of a BPE piece model."""

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal, kind = model.normalizer_spec, model.trainer_spec
        odd = normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces
        if odd or kind.model_type != _BPE or not kind.byte_fallback or kind.treat_whitespace_as_suffix:
            raise ValueError(f"{path} is no BPE model with byte fallback and without normalisation")
        if any(piece.type in (_USER_DEFINED, _UNUSED) for piece in model.pieces):
            raise ValueError(f"{path} has user-defined or unused pieces, which are not supported")
        self.ranks = {p.piece: -p.score for p in model.pieces if p.type == _NORMAL}
        if any(_BLANK in piece.lstrip(_BLANK) for piece in self.ranks):
            raise ValueError(f"{path} has pieces with a blank after other characters")
        self._prefix = normal.add_dummy_prefix
        self._lone_feed = not any("\n" in piece for piece in self.ranks)
        self._remembered = remembered
        self._words: dict[str, int] = {}

    def merge(self, symbols: str) -> int:
        """Tokens of one stretch of text, with blanks as the model writes them."""
        ranks = self.ranks
        at = list(symbols)
        count = sum(1 if c in ranks else len(c.encode("utf-8", "surrogatepass")) for c in at)
        size = len(at)
        if size < 2:
            return count
        before, after = list(range(-1, size - 1)), [*range(1, size), -1]
        heap = []
        for i in range(size - 1):
            rank = ranks.get(at[i] + at[i + 1])
            if rank is not None:
                heap.append((rank, i, at[i] + at[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, left, piece = heapq.heappop(heap)
            right = after[left] if at[left] else -1
            if right < 0 or len(at[left]) + len(at[right]) != len(piece) or at[left] + at[right] != piece:
                continue  # one of the two has gone into another merge since
            at[left], at[right] = piece, ""
            count -= 1
            follows = after[left] = after[right]
            if follows >= 0:
                before[follows] = left
                rank = ranks.get(piece + at[follows])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, piece + at[follows]))
            earlier = before[left]
            if earlier >= 0:
                rank = ranks.get(at[earlier] + piece)
                if rank is not None:
                    heapq.heappush(heap, (rank, earlier, at[earlier] + piece))
        return count

    def _stretch(self, symbols: str) -> int:
        if self._lone_feed and "\n" in symbols:  # a line feed is in no piece: one token for its byte, and a safe cut
            parts = symbols.split("\n")
            return len(parts) - 1 + sum(map(self.merge, parts))
        return self.merge(symbols)

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        text = text.replace(_BLANK, " ")  # the library takes the sign itself for a blank
        if "  " in text or text[0] == " " or text[-1] == " " or not self._prefix:
            stretches = re.findall(" *[^ ]+| +", " " + text if self._prefix else text)
            return sum(self._stretch(s.replace(" ", _BLANK)) for s in stretches)
        words, total = self._words, 0
        for word in text.split(" "):
            n = words.get(word)
            if n is None:
                n = self._stretch(_BLANK + word)
                if len(word) <= 64:
                    if len(words) >= self._remembered:
                        words.clear()
                    words[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> PairCounter:
    """The counter of a model file, made once in each worker."""
    return PairCounter(path)


def count_tokens(
    docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text. ``model`` is a file each executor has."""

    def per_batch(doc_ids, texts):
        one = counter(model)
        sizes, counts = [], []
        for text in texts:
            sizes.append(len(text.encode()))
            counts.append(one.count(text))
        return {"doc_id": doc_ids, "n_bytes": sizes, "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return map_texts(
        id_and_text(docs, id_col, text_col), per_batch, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )

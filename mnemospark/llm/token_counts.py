"""Token counts by overlap resynchronisation.

A text longer than ``chunk_chars`` is encoded in overlapping chunks.  Each chunk's tokens are laid on the text by
their character widths.  Two neighbouring chunks are spliced at a boundary that is proven stable: a space after
something else, where no piece of the vocabulary can reach across, so what stands left of it and right of it is
encoded independently.  Both encodings must show a token boundary there.  If the overlap holds no such place it is
doubled, in the limit to the whole text.

Defined results: a null or empty text has 0 bytes and 0 tokens; every input row gives one row, repeated rows too.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts_of

SPACE = "▁"
_STABLE = re.compile(rf"(?<=[^ {SPACE}])[ {SPACE}]")


class ChunkedCounter:
    """Counts the tokens of a text with one SentencePiece model."""

    def __init__(self, model_path: str, chunk_chars: int = 16_384, overlap_chars: int = 256):
        import sentencepiece

        if not 0 < overlap_chars < chunk_chars:
            raise ValueError("overlap_chars must be between 0 and chunk_chars")
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        n = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        is_byte = np.array([self.sp.is_byte(i) for i in range(n)])
        value = np.array([int(p[3:5], 16) if b else 0 for p, b in zip(pieces, is_byte, strict=True)])
        #: A continuation byte belongs to the character that its lead byte began.
        self.inside = is_byte & (value >= 0x80) & (value < 0xC0)
        self.width = np.where(is_byte, np.where(self.inside, 0, 1), [len(p) for p in pieces])
        self.separable = not any(re.search(rf"[^{SPACE}]{SPACE}", p) for p in pieces)

    def starts(self, chunk: str) -> np.ndarray:
        """Where each of the chunk's tokens starts; -1 for one that starts inside a character."""
        ids = np.array(self.sp.encode(chunk, num_threads=1), dtype=np.int64)
        at = np.concatenate(([0], np.cumsum(self.width[ids])))[:-1] - 1  # the dummy prefix stands before the text
        return np.where(self.inside[ids], -1, np.maximum(at, 0))

    def count(self, text: str) -> int:
        n = len(text)
        if n <= self.chunk or not self.separable:
            return len(self.sp.encode(text, num_threads=1))
        total, begin, owned, overlap = 0, 0, 0, self.overlap
        end = self.chunk
        left = self.starts(text[:end])
        while end < n:
            # ``left`` lies on text[begin:end]; its tokens from ``owned`` on are not yet counted
            low = max(owned + 1, end - overlap)
            to = min(n, low + self.chunk)
            right = self.starts(text[low:to]) if to > end else None
            splice = None
            if right is not None:
                for p in sorted((m.start() for m in _STABLE.finditer(text, low, end)), reverse=True):
                    if p > low and (left == p - begin).any() and (right == p - low).any():
                        splice = p
                        break
            if splice is None:  # no stable place in common: widen
                overlap *= 2
                end = min(n, end + overlap)
                left = self.starts(text[begin:end])
                continue
            total += self._between(left, owned - begin, splice - begin)
            begin, left, owned, end, overlap = low, right, splice, to, self.overlap
        return total + self._between(left, owned - begin, n + 1 - begin)

    @staticmethod
    def _between(starts: np.ndarray, a: int, b: int) -> int:
        """Tokens that start in [a, b); those inside a character go with the token before them."""
        own = (starts >= a) & (starts < b)
        if a <= 0:
            own[: 1] |= b > 0
        inside = np.flatnonzero(starts < 0)
        if inside.size:
            lead = np.maximum.accumulate(np.where(starts >= 0, np.arange(starts.size), 0))
            own[inside] = own[lead[inside]]
        return int(own.sum())


@functools.lru_cache(4)
def _counter(model_path: str, chunk_chars: int, overlap_chars: int) -> ChunkedCounter:
    return ChunkedCounter(model_path, chunk_chars, overlap_chars)


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk_chars: int = 16_384, overlap_chars: int = 256) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; no shuffle, memory bounded by the longest text."""
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _counter(model_path, chunk_chars, overlap_chars)
        texts = texts_of(batch, text_col)
        counts = [counter.count(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
            names=[id_col, "n_bytes", "n_tokens", "over_limit"],
        )

    return map_arrow(docs, [id_col, text_col], run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

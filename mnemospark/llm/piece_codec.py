"""SentencePiece encoding and decoding for merge-type (BPE) models, by backtracking.

The text is normalised as the model asks (spaces become U+2581, one in front) and cut where a space follows
something else, where no piece can reach across.  A segment is encoded without replaying its merges: an Aho-Corasick
automaton gives every piece that matches at each place, the longest is tried first, and a token may follow another
only if the two are compatible, that is if merging their joined characters again ends in exactly these two.  Places
from which nothing leads to the end are kept in a bitfield, so each is left at most once.  Characters outside the
vocabulary never merge and become their UTF-8 bytes' pieces.

Defined results: a null text is empty; an empty text has the begin and end ids only; every input row gives one row.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts_of

SPACE = "▁"


class PieceCodec:
    """Exact encoder and decoder of one BPE SentencePiece model; its caches are bounded."""

    def __init__(self, model_path: str, cache_segments: int = 100_000, cache_pairs: int = 300_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("a BPE model with identity normalisation is needed")
        self.dummy_prefix = norm.add_dummy_prefix
        kinds = type(proto.pieces[0])
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.surface: list[bytes] = []
        self.bos = self.eos = -1
        for i, p in enumerate(proto.pieces):
            surface = p.piece.replace(SPACE, " ").encode()
            if p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.rank[p.piece], self.id[p.piece] = p.score, i
            elif p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                surface = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.CONTROL:
                surface = b""
            else:
                surface = (proto.trainer_spec.unk_surface or " ⁇ ").encode()
            self.bos = i if p.piece == proto.trainer_spec.bos_piece else self.bos
            self.eos = i if p.piece == proto.trainer_spec.eos_piece else self.eos
            self.surface.append(surface)
        self.separable = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.separable else re.compile(r".+", re.S)
        # only pieces that merging can reach take part
        self.reached = {p for p in self.id if len(p) == 1 or self.merge(p) == [p]}
        self.words = ahocorasick.Automaton()
        for p in self.reached:
            self.words.add_word(p, (self.id[p], len(p)))
        self.words.make_automaton()
        self.cache_segments, self.cache_pairs = cache_segments, cache_pairs
        #: Segments met lately and before; an old one that is met again is taken over, so frequent ones stay.
        self.segments: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.piece = [p.piece for p in proto.pieces]
        self.packed = [np.array([i], "<u4").tobytes() for i in range(len(self.piece))]
        self.packed_bytes = [np.array([self.byte_id[b]], "<u4").tobytes() for b in range(256)] if len(self.byte_id) == 256 else []
        self.alphabet = frozenset(p for p in self.id if len(p) == 1)
        #: Whether the second token may follow the first, by (first id * vocabulary + second id).
        self.pairs: dict[int, bool] = {}
        self.prefix = np.array([self.bos], "<u4").tobytes()
        self.suffix = np.array([self.eos], "<u4").tobytes()

    def merge(self, text: str) -> list[str]:
        """The definition: join the best-ranked neighbours, leftmost first, until none can be joined."""
        parts = list(text)
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a * len(self.piece) + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.cache_pairs:
                self.pairs.clear()
            x, y = self.piece[a], self.piece[b]
            known = self.pairs[key] = self.merge(x + y) == [x, y]
        return known

    def backtrack(self, s: str) -> list[int]:
        """The ids of the pieces of a run of known characters."""
        quick, last, pairs, size = [], -1, self.pairs, len(self.piece)
        for _, (i, _) in self.words.iter_long(s):  # longest matches one after another are often right
            if last >= 0 and not (pairs.get(last * size + i) or self.compatible(last, i)):
                break
            quick.append(i)
            last = i
        else:
            return quick  # every character is a piece, so the matches leave no gap
        longest: list[list[tuple[int, int]]] = [[] for _ in s]
        for end, (i, n) in self.words.iter(s):
            longest[end - n + 1].append((n, i))
        for x in longest:
            x.sort()
        failed, out, pos, n = 0, [], 0, len(s)
        choice = len(longest[0]) - 1
        tried: list[tuple[int, int]] = []
        while pos < n:
            options = longest[pos]
            while choice >= 0:
                wide, i = options[choice]
                if not failed >> (pos + wide) & 1 and (not out or self.compatible(out[-1], i)):
                    break
                choice -= 1
            if choice >= 0:
                out.append(i)
                tried.append((choice, wide))
                pos += wide
                choice = len(longest[pos]) - 1 if pos < n else -1
            else:
                if not out:
                    raise ValueError("no encoding")
                failed |= 1 << pos
                out.pop()
                choice, wide = tried.pop()
                pos -= wide
                choice -= 1
        return out

    def encode_segment(self, s: str) -> bytes:
        packed = self.packed
        if self.alphabet.issuperset(s):
            return b"".join([packed[i] for i in self.backtrack(s)])
        out: list[bytes] = []
        run = ""
        for c in s:
            if c in self.alphabet:
                run += c
                continue
            if run:
                out += [packed[i] for i in self.backtrack(run)]
                run = ""
            out += [self.packed_bytes[b] for b in c.encode()]
        if run:
            out += [packed[i] for i in self.backtrack(run)]
        return b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        segments = self.cut.findall(text)
        out = list(map(self.segments.get, segments))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    out[i] = self._learn(segments[i])
        return b"".join(out)

    def _learn(self, s: str) -> bytes:
        x = self.segments.get(s)
        if x is None:
            x = self.older.get(s)
            if x is None:
                x = self.encode_segment(s)
            if len(s) <= 48:
                if len(self.segments) >= self.cache_segments:
                    self.older, self.segments = self.segments, {}
                self.segments[s] = x
        return x

    def encode(self, text: str, add_bos: bool = False, add_eos: bool = False) -> list[int]:
        ids = np.frombuffer(self.encode_bytes(text), "<u4").tolist()
        return [self.bos] * add_bos + ids + [self.eos] * add_eos

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy_prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


@functools.lru_cache(2)
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


def encode_decode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids as bytes and the decoded text (``keep``) or their SHA-256 digests."""
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model_path)
        n, first, second = [], [], []
        for t in texts_of(batch, text_col):
            ids = c.prefix + c.encode_bytes(t) + c.suffix
            n.append(len(ids) // 4)
            decoded = c.decode(np.frombuffer(ids, "<u4").tolist())
            first.append(ids if keep else hashlib.sha256(ids).hexdigest())
            second.append(decoded if keep else hashlib.sha256(decoded.encode()).hexdigest())
        names = ["ids", "decoded"] if keep else ["ids_sha256", "decoded_sha256"]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.binary() if keep else pa.string()), pa.array(second, pa.string())], names=[id_col, "n_tokens", *names])

    tail = "ids binary, decoded string" if keep else "ids_sha256 string, decoded_sha256 string"
    return map_arrow(docs, [id_col, text_col], run, f"`{id_col}` {kind}, n_tokens long, {tail}")

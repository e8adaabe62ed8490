"""Media columns kept as content-defined chunks.

A payload is stored as 8-bit mono samples in a RIFF/WAVE file.  The file is cut where a rolling gear hash over the last
32 bytes has its top bits zero, so equal stretches are cut alike wherever they stand.  The store holds every distinct
chunk once, and for every file the ordered list of its chunks' digests; files are read back from these alone.

1. Chunk digests (no bytes) are counted over all documents.  Those that occur more than once are marked in a Bloom filter
   of fixed size, which is broadcast.
2. What the filter doesn't know occurs once: such chunks are stored where their file's list is written, as one compressed
   pack beside it.  Texts don't move for this.
3. The other chunks are deduplicated by digest in a shuffle and stored in a table of their own.  A chunk that the filter
   takes for repeated by mistake is stored there as well; a filter that is too full costs shuffled bytes, nothing else.
4. Files whose chunks all lie beside their list are read in place.  The others ask for their chunks by digest; files
   that are equal are read once, and their columns go to all of their rows.

Every chunk read back must have the digest that the list names, and the file its length and SHA-256 digest, before
anything is computed from it.  Digests asked for by very many files, and files of very many rows, are dealt over salts.

Defined results: a null text is empty, its payload is 192 spaces; repeated rows are returned each; null ids are kept,
and tell nothing apart: files are named by the 128-bit digest of their text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, deal, heavy_keys, map_batches, mix, over_salts, salted_join, slices, texts_of

UNIT, RATE = 192, 8000
LEAST, MOST, MEAN_BITS = 256, 8192, 10
DIGEST = 20
#: Bits of the filter of repeated chunks (8 MB, whatever the table's size) and bits set for each of them.
FILTER_BITS, FILTER_MARKS = 1 << 26, 3
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def payload(text: str) -> bytes:
    """UTF-8 padded with spaces to a positive multiple of 192 bytes."""
    raw = text.encode()
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def to_wave(samples: bytes) -> bytes:
    """8-bit unsigned mono samples as a RIFF/WAVE file (the payload's length is even, so no pad byte)."""
    n = len(samples)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + samples


def from_wave(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or struct.unpack("<HHIIHH", media[20:36])[:2] != (1, 1):
        raise ValueError("not an 8-bit mono wave")
    n = struct.unpack("<I", media[40:44])[0]
    if len(media) != 44 + n:
        raise ValueError("the wave's length is wrong")
    return media[44:]


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks: a gear-hash cut after at least 256 bytes, at most 8192 bytes, about 1 KB more on average."""
    h = GEAR[np.frombuffer(media, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # h[i] = sum of gear[b[i-j]] << j for j < 32
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out, start, n, at = [], 0, len(media), 0
    while n - start > LEAST:
        at = int(np.searchsorted(marks, start + LEAST))
        end = min(int(marks[at]) if at < marks.size else n, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:DIGEST]


def features(samples: bytes) -> str:
    """Mean, deviation, crossings of the mean and entropy of the samples, as text."""
    x = np.frombuffer(samples, np.uint8)
    count = np.bincount(x, minlength=256)
    n = x.size
    total = int((count * np.arange(256)).sum())
    squares = int((count * np.arange(256, dtype=np.int64) ** 2).sum())
    above = x.astype(np.int64) * n >= total
    p = count[count > 0] / n
    return f"mean={total / n:.3f};dev={max(squares / n - (total / n) ** 2, 0) ** 0.5:.3f};cross={int((above[1:] != above[:-1]).sum())};entropy={float(-(p * np.log2(p)).sum()):.4f}"


def file_name(text: str) -> bytes:
    """The name of a text's file."""
    return xxhash.xxh3_128_digest(text.encode())


def marks(digests: list[bytes], bits: int) -> np.ndarray:
    """Which of a filter's bits (row by digest) stand for the digests."""
    h = np.ascontiguousarray(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIGEST)[:, :16]).view("<u8")
    return np.stack([(h[:, 0] + np.uint64(k) * (h[:, 1] | np.uint64(1))) & np.uint64(bits - 1) for k in range(FILTER_MARKS)], axis=1).astype(np.int64)


def files(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{text_col}`").alias("text"))


def repeated_filter(docs: DataFrame, text_col: str, filter_bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of ``filter_bits`` (a power of two, 64 at least), as 64-bit words, with the digests of all chunks that occur more than once."""

    def count(batches):
        for b in slices(batches):
            seen: dict[bytes, int] = {}
            for t in texts_of(b):
                for c in chunks(to_wave(payload(t))):
                    d = digest(c)
                    seen[d] = seen.get(d, 0) + 1
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array(seen.values(), pa.int64())], names=["digest", "c"])

    def bits(batches):
        own: dict[int, int] = {}
        for b in batches:
            if b.num_rows:
                for i in np.unique(marks(b.column(0).to_pylist(), filter_bits)).tolist():
                    own[i >> 6] = own.get(i >> 6, 0) | 1 << (i & 63)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array(np.array(list(own.values()), np.uint64).view(np.int64))], names=["at", "bits"])

    counted = map_batches(files(docs, text_col), count, "digest binary, c long").groupBy("digest").agg(F.sum("c").alias("c")).where("c > 1").select("digest")
    got = map_batches(counted, bits, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # filter_bits / 64 rows at most
    out = np.zeros(filter_bits // 64, np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out


def maybe_repeated(known: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """Whether the filter holds the digests; never false for one that occurs twice."""
    at = marks(digests, known.size * 64)
    return ((known[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def store_files(docs: DataFrame, known, *, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, file, n_bytes, the file's length, SHA-256 and ordered digests, which of its chunks lie in
    the shared table (their positions), and its other chunks as a compressed pack with their lengths."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=6)
        names = ["id", "file", "n_bytes", "size", "sha", "digests", "shared", "pack", "lengths"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32())]
        for b in slices(batches):
            if b.num_rows:
                columns: list[list] = [[] for _ in kinds]
                for t in texts_of(b):
                    media = to_wave(payload(t))
                    parts = chunks(media)
                    listed = [digest(c) for c in parts]
                    common = maybe_repeated(known.value, listed)
                    own = [c for c, s in zip(parts, common.tolist(), strict=True) if not s]
                    row = (file_name(t), len(t.encode()), len(media), hashlib.sha256(media).digest(), b"".join(listed), np.flatnonzero(common).tolist(), z.compress(b"".join(own)) if own else None, [len(c) for c in own])
                    for column, v in zip(columns, row, strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    schema = f"id {kind}, file binary, n_bytes long, size long, sha binary, digests binary, shared array<int>, pack binary, lengths array<int>"
    return map_batches(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text")), run, schema)


def shared_chunks(docs: DataFrame, known, *, text_col: str) -> DataFrame:
    """(digest, bytes): each chunk that the filter knows, once; bytes are compressed."""

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            found: dict[bytes, bytes] = {}
            for t in texts_of(b):
                parts = chunks(to_wave(payload(t)))
                listed = [digest(c) for c in parts]
                for i in np.flatnonzero(maybe_repeated(known.value, listed)).tolist():
                    if listed[i] not in found:
                        found[listed[i]] = z.compress(parts[i])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "bytes"])

    return map_batches(files(docs, text_col), run, "digest binary, bytes binary").dropDuplicates(["digest"])


_COLUMNS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def rebuilt(size: int, sha: bytes, digests: bytes, shared: list[int], pack: bytes | None, lengths: list[int], fetched: dict[int, bytes]) -> bytes:
    """A file from its list, its pack and its shared chunks by position; raises where anything stored is not what the list says."""
    import zstandard

    own = zstandard.ZstdDecompressor().decompress(pack, max_output_size=sum(lengths)) if pack else b""
    ends = np.cumsum(lengths).tolist()
    mine = iter([own[a:b] for a, b in zip([0, *ends], ends, strict=False)])
    taken = set(shared)
    parts = []
    for i in range(len(digests) // DIGEST):
        part = fetched.get(i, b"") if i in taken else next(mine)
        if digest(part) != digests[i * DIGEST : (i + 1) * DIGEST]:
            raise ValueError("a stored chunk does not have its digest")
        parts.append(part)
    media = b"".join(parts)
    if len(media) != size or hashlib.sha256(media).digest() != sha:
        raise ValueError("stored media do not match their list")
    return media


def _computed(media: bytes, n_chunks: int) -> tuple:
    p = from_wave(media)
    return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(p), n_chunks


def _read(batches, first: int, fetched: bool):
    """Columns computed from files read back; ``first`` columns in front pass through, fetched chunks come last."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    for b in slices(batches):
        if b.num_rows:
            columns: list[list] = [[] for _ in _KINDS]
            for row in zip(*(b.column(first + k).to_pylist() for k in range(6 + fetched)), strict=True):
                got = {x["pos"]: z.decompress(x["bytes"]) for x in row[6] or ()} if fetched else {}
                for column, v in zip(columns, _computed(rebuilt(*row[:6], got), len(row[2]) // DIGEST), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(first)), *(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True))], names=[*b.schema.names[:first], *(x.split()[0] for x in _COLUMNS.split(", "))])


def media_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """Store every text as media in chunks, read each back, verify it and compute its columns."""
    kind = dict(docs.dtypes)[id_col]
    known = docs.sparkSession.sparkContext.broadcast(repeated_filter(docs, text_col, filter_bits))
    lists = cut(store_files(docs, known, id_col=id_col, text_col=text_col), "media")
    store = cut(shared_chunks(docs, known, text_col=text_col), "chunks")
    known.unpersist()
    stored = ["size", "sha", "digests", "shared", "pack", "lengths"]

    alone = lists.where(F.size("shared") == 0).select("id", "n_bytes", *stored)
    in_place = map_batches(alone, lambda batches: _read(batches, 2, False), f"id {kind}, n_bytes long, {_COLUMNS}")

    sharing = lists.where(F.size("shared") > 0)
    places = sharing.select("file", F.posexplode(F.expr(f"transform(shared, p -> named_struct('pos', p, 'digest', substring(digests, p * {DIGEST} + 1, {DIGEST})))")).alias("_", "x")).select("file", "x.pos", "x.digest").distinct()
    # a file is named by its text, so equal texts are one file, whose list is any of the equal ones
    asked = cut(places, "asked")
    uses = asked.groupBy("digest").agg(F.count("*").alias("c"))
    fetched = salted_join(asked, store.join(uses, "digest"), ["digest"], "file").groupBy("file").agg(F.collect_list(F.struct("pos", "bytes")).alias("fetched"))
    once = sharing.select("file", *stored).dropDuplicates(["file"]).join(fetched, "file", "left").select("file", *stored, "fetched")
    read = cut(map_batches(once, lambda batches: _read(batches, 1, True), f"file binary, {_COLUMNS}"), "read")
    rows = sharing.select("id", "n_bytes", "file")
    heavy = heavy_keys(rows.groupBy("file").agg(F.count("*").alias("c")), "file")
    others = deal(rows, "file", heavy, F.struct("id", F.spark_partition_id())).join(over_salts(read, "file", heavy), ["file", "salt"]).drop("file", "salt")
    return in_place.unionByName(others).withColumnRenamed("id", id_col)

"""Media are read back from the stored chunks and lists alone."""

import hashlib

import numpy as np
import pytest

from mnemospark.llm import media_chunks as m

from .test_operators import prose


def test_rows_whose_id_and_text_read_alike(spark):
    rows = [("5", None), ("6", None), ("7", None), (None, "5"), (None, None), (None, "5")]
    got = sorted(m.media_features(spark.createDataFrame(rows, "doc_id string, text string").repartition(2)).collect(), key=str)
    assert len(got) == 6 and {r.n_bytes for r in got} == {0, 1} and {r.payload_bytes for r in got} == {192}


@pytest.mark.parametrize("bits", [1 << 6, 1 << 16, 1 << 26])
def test_a_full_filter_changes_nothing(spark, bits):
    shared = prose(900, 1)
    rows = [(i, shared[: 800 + 400 * (i % 5)] + prose(600, 10 + i)) for i in range(25)] + [(100 + i, shared) for i in range(6)] + [(200, None), (200, ""), (None, shared), (200, None)]
    got = m.media_features(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), filter_bits=bits).collect()
    want = []
    for i, t in rows:
        p = m.payload(t or "")
        want.append((i, len((t or "").encode()), hashlib.sha256(p).hexdigest(), hashlib.sha256(m.to_wave(p)).hexdigest(), m.features(p)))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_sha256, r.media_sha256, r.feature) for r in got), key=str) == sorted(want, key=str)


def test_each_chunk_is_stored_once(spark):
    shared = prose(900, 1)
    rows = [(i, shared + prose(600, 10 + i % 20)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = spark.sparkContext.broadcast(m.repeated_filter(docs, "text"))
    lists = m.store_files(docs, known, id_col="doc_id", text_col="text").collect()
    store = [r.digest for r in m.shared_chunks(docs, known, text_col="text").collect()]
    own = [r.digests[m.DIGEST * k : m.DIGEST * (k + 1)] for r in lists for k in range(len(r.digests) // m.DIGEST) if k not in r.shared]
    every = {r.digests[k : k + m.DIGEST] for r in lists for k in range(0, len(r.digests), m.DIGEST)}
    assert len(own) + len(store) == len({bytes(x) for x in own} | {bytes(x) for x in store}) == len(every)


def test_damage_is_told():
    media = m.to_wave(m.payload(prose(800, 3)))
    parts = m.chunks(media)
    digests = b"".join(map(m.digest, parts))
    import zstandard

    pack, lengths = zstandard.ZstdCompressor().compress(b"".join(parts[1:])), [len(c) for c in parts[1:]]
    sha = hashlib.sha256(media).digest()
    assert m.rebuilt(len(media), sha, digests, [0], pack, lengths, {0: parts[0]}) == media
    with pytest.raises(ValueError):
        m.rebuilt(len(media), sha, digests, [0], pack, lengths, {})
    with pytest.raises(ValueError):
        m.rebuilt(len(media), np.random.default_rng(1).bytes(32), digests, [0], pack, lengths, {0: parts[0]})

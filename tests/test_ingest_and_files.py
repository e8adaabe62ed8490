"""Write events, version changes, resumable imports, receipts and node checks."""

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import evaluation, ingest, log, proofs
from mnemospark.sources import files


def test_written_events_fold_into_state(spark):
    rows = [(7, 0, [1], "a", 1), (7, 1, [2], "b", 1), (3, 0, [3], None, 0), (9, 4, [4], "d", 2)]
    c = spark.createDataFrame(rows, "doc_id long, idx int, fx array<int>, metadata string, namespace_id int")
    e = ingest.events(c, 10, 20, 30, 40).orderBy("log_index").collect()
    assert [x.log_index for x in e] == list(range(40, 40 + 3 + 4 * 4))
    assert [x.event_type for x in e[:6]] == ["CreateNode", "InsertRecord", "CreateNode", "CreateEdge", "SetMeta", "CreateNode"]
    full = spark.createDataFrame([], log.COLUMNS).unionByName(spark.createDataFrame(e, ingest.events(c).schema), allowMissingColumns=True)
    state = log.fold(full)
    assert {(r.id, r.namespace_id, tuple(r.fx)) for r in state.records.collect()} == {(10, 0, (3,)), (11, 1, (1,)), (12, 1, (2,)), (13, 2, (4,))}
    nodes = {r.id: (r.kind, r.record_id) for r in state.nodes.collect()}
    assert sorted(nodes) == list(range(20, 27)) and {(nodes[r.src][0], nodes[r.dst][1]) for r in state.edges.collect()} == {(5, 10), (5, 11), (5, 12), (5, 13)}
    assert {r.key: r.value for r in state.meta.collect()} == {"record:10": None, "record:11": "a", "record:12": "b", "record:13": "d"}
    assert log.node_rejects(full).where("reason = 'record'").count() == 0


def test_changes_are_multisets(spark):
    old = spark.createDataFrame([(1, "a", 0, 5), (1, "a", 1, 6), (1, "b", 2, 7), (2, "a", 0, 8)], "doc_id long, content_hash string, idx int, record_id long")
    new = spark.createDataFrame([(1, "a", 0), (1, "c", 1), (2, "a", 0), (2, "a", 1)], "doc_id long, content_hash string, idx int")
    got = ingest.changes(old, new)
    assert {(r.doc_id, r.content_hash, r.action, r.record_id, r.idx) for r in got.collect()} == {(1, "a", "keep", 5, 0), (1, "a", "remove", 6, None), (1, "b", "remove", 7, None), (1, "c", "add", None, 1), (2, "a", "keep", 8, 0), (2, "a", "add", None, 1)}
    assert [(r.log_index, r.record_id) for r in ingest.removal_events(got, 90).orderBy("log_index").collect()] == [(90, 6), (91, 7)]


def test_import_goes_on_where_it_was_cut_off(spark, tmp_path):
    asked = []

    def page(cursor):
        k = int(cursor or 0)
        asked.append(k)
        if k == 2 and asked.count(2) == 1:
            raise ConnectionError
        return [{"id": 2 * k + j, "vector": [k, j], "payload": {"k": k}} for j in range(2)], str(k + 1) if k < 3 else None

    path = f"file://{tmp_path}/pages"
    with pytest.raises(ConnectionError):
        files.import_paged(spark, page, path)
    for _ in range(2):
        got = files.import_paged(spark, page, path)
        assert sorted(int(r.source_id) for r in got.collect()) == list(range(8))
    assert asked == [0, 1, 2, 2, 3]


def test_vector_files_of_several_parts(spark, tmp_path):
    rows = [(i, [i, -i, i * i]) for i in range(25)]
    assert files.write_vectors(spark.createDataFrame(rows, "pos long, vec array<int>"), f"file://{tmp_path}/v", "ivecs", 10) == 3
    got = files.read_ivecs(spark, f"file://{tmp_path}/v").select((F.regexp_extract("path", r"(\d+)\.ivecs$", 1).cast("long") + F.col("pos")).alias("i"), "vec").collect()
    assert sorted((r.i, list(r.vec)) for r in got) == rows


def test_insert_receipts(spark):
    e = [(0, 0, "InsertRecord", 0, [1, 2], "m"), (1, 3, "InsertRecord", 1, None, None), (2, 3, "CreateNode", 1, None, None), (3, 0, "CreateNode", 1, None, None), (4, 0, "CreateNode", 9, None, None), (5, 0, "HardDelete", 0, None, None), (6, 0, "CreateNode", 0, None, None)]
    l = spark.createDataFrame(e, "log_index long, namespace_id int, event_type string, record_id long, fx array<int>, metadata string")
    r = proofs.insert_receipts(l)
    assert r.count() == 2 and proofs.broken_insert_receipts(r).count() == 0
    assert [x.record_id for x in proofs.broken_insert_receipts(r.withColumn("metadata_hash", F.when(F.col("record_id") == 1, "x").otherwise(F.col("metadata_hash")))).collect()] == [1]
    assert {x.log_index: x.reason for x in log.node_rejects(l).collect()} == {3: "namespace", 4: "record", 6: "record"}


def test_citations(spark):
    a = spark.createDataFrame([(1, [1, 2]), (2, [3, 9]), (3, [])], "qid long, cited array<long>")
    r = evaluation.citations(a, spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(1,), (3,), (None,)], "record_id long")).first()
    assert (r.existence, round(r.provenance, 6), r.citations) == (0.75, 0.666667, 4)

"""The ways beyond broadcast bounds, and slicing of batches."""

import pyarrow as pa

from stacklore.llm import common, jaccard_join, stages


def test_salted_join(spark, monkeypatch):
    big = spark.createDataFrame([(i, "hot" if i % 3 else "cold", i % 5) for i in range(300)], "doc_id long, k string, v int")
    small = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, w int")
    whole = sorted(common.keyed_join(big, small, ["k"]).select("doc_id", "w").collect())
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
    assert sorted(common.keyed_join(big, small, ["k"]).select("doc_id", "w").collect()) == whole


def test_shuffled_filter(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    monkeypatch.setattr(stages, "MAX_IDS", 0)
    assert sorted(r["text"] for r in stages.without(docs, docs.where("doc_id = 1").select(stages.row_key().alias("key"))).collect()) == ["b", "c"]


def test_shuffled_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MAX_IDS", 0)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "SIGNATURE_BLOCK", 2)
    words = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(i, f"{words} x{i}") for i in range(11)], "doc_id long, text string")
    got = jaccard_join.jaccard_join(docs).collect()
    assert {r["class_id"] for r in got} == {0} and {r["n_links"] for r in got} == {10}


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["aaaa", None, "bb", "c" * 9])], ["i", "t"])
    got = list(common.slices(iter([batch, batch.slice(0, 0)]), 1, 5))
    assert [b.column(0).to_pylist() for b in got] == [[1, 2], [3], [4]]

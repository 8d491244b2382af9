import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import common, decontaminate, quality, substring_dedup


def test_carried_columns_come_back_as_they_were(spark):
    rows = [(1, "a b", 2, "x", None), (None, None, 0, "y", 3.5), (1, "a b", 2, "z", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_words int, rest string, score double").select("score", "text", "rest", "doc_id", "n_words")
    want = sorted(map(tuple, docs.collect()), key=str)
    none = spark.createDataFrame([], "item_id int, text string")
    model = quality.Model()
    model.constant = 0.7
    for found in (quality.score(docs, model, carry=True), decontaminate.find_windows(docs, none, carry=True), substring_dedup.remove_repeats(docs, carry=True)):
        back = common.restored(found, docs)
        assert back.dtypes == docs.dtypes and sorted(map(tuple, back.collect()), key=str) == want


def test_halved_groups_are_the_same(spark):
    frame = spark.range(100).select((F.col("id") % 7).alias("k"))
    got = {r.k: r.n for r in frame.groupBy("k", common.halved("k")).agg(F.count("k").alias("n")).collect()}
    assert got == {r.k: r.n for r in frame.groupBy("k").agg(F.count("k").alias("n")).collect()}


def test_folders(spark):
    a, b = common.shared_folder(spark, "x"), common.shared_folder(spark, "x")
    assert a != b and a.startswith(common.checkpoint_folder(spark))


def test_portions_are_bounded():
    batch = pa.record_batch({"text": ["a" * 10, None, "b" * 3, "", "c" * 50, "d"] + ["e"] * 9, "k": list(range(15))})
    parts = list(common.portions(batch, most_rows=4, most_bytes=12))
    assert [r for p in parts for r in p.column("k").to_pylist()] == list(range(15))
    assert all(p.num_rows <= 4 and (p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 12) for p in parts)
    assert list(common.portions(batch.slice(0, 0))) == []


def test_shared_folder_is_asked_for_off_a_local_master(monkeypatch):
    class Context:
        def __init__(self, master):
            self.master, self.dir = master, None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, path):
            self.dir = path

    class Session:
        def __init__(self, master, named=None):
            self.sparkContext, self.conf = Context(master), {"spark.checkpoint.dir": named} if named else {}

    assert common.checkpoint_folder(Session("local[4]")) and common.checkpoint_folder(Session("local"))
    assert common.checkpoint_folder(Session("yarn", "hdfs:///x")) == "hdfs:///x"
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            common.checkpoint_folder(Session(master))


def test_matched_either_way(spark):
    rows = [(1, "a"), (2, "b"), (2, "c"), (None, "d"), (5, "e")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = spark.createDataFrame([(2,), (5,), (9,)], "doc_id bigint")
    for most in (0, 100):
        assert sorted(r.text for r in common.matched(frame, ids, "left_semi", most=most).collect()) == ["b", "c", "e"]
        assert sorted(r.text for r in common.matched(frame, ids, "left_anti", most=most).collect()) == ["a", "d"]
        assert common.matched(frame, ids, "left_anti", most=most).columns == frame.columns

"""The exchange loop: guarded reading, uploads, restarts and windows."""

import json

from pyspark.sql import functions as F

from strandline.session import scratch_path
from strandline.streaming import exchange as E


def test_a_failing_document_comes_out_empty(spark):
    def read(doc, text):
        if "poison" in text:
            raise ValueError("no")
        return [{"word": w, "n": len(w)} for w in text.split()]

    docs = spark.createDataFrame([("a", "one two"), ("b", "poison"), ("c", None), ("d", "")], "doc_id string, text string")
    got = {r.doc_id: (len(r.found), r.error is None) for r in E.guarded(docs, read, "word string, n int").collect()}
    assert got == {"a": (2, True), "b": (0, False), "c": (0, False), "d": (0, True)}


def test_uploads_are_logged_and_not_repeated(spark):
    def send(path, payload):
        if payload == "bad":
            raise OSError
        return "key-" + path

    sink = E.Uploads(spark, scratch_path(spark, "uploads"), send)
    df = spark.createDataFrame([("p", "x"), ("q", "bad"), ("p", "x")], "path string, payload string")
    sink(df, 0)
    sink(df.union(spark.createDataFrame([("r", "y")], "path string, payload string")), 1)
    log = sorted((r.batch, r.path, r.storage_key) for r in sink.log().collect())
    assert log == [(0, "p", "key-p"), (0, "q", "<failed>"), (1, "q", "<failed>"), (1, "r", "key-r")]
    sink(df, 1)  # a retried batch replaces its part
    assert sorted(r.path for r in sink.log().where("batch = 1").collect()) == ["q"]


def test_restarts():
    class Query:
        left = 2

        def awaitTermination(self):
            if Query.left:
                Query.left -= 1
                raise RuntimeError

    assert E.restarted(Query, pause=0) == 2


def test_vocabularies_are_loaded_once():
    calls = []
    v = E.Vocabularies(lambda name: calls.append(name) or name, size=2)
    assert [v["a"], v["a"], v["b"], v["c"], v["a"]] == ["a", "a", "b", "c", "a"] and calls == ["a", "b", "c", "a"]


def test_file_notices(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"document_id": f"d{i}"}))
    out = scratch_path(spark, "notices")
    E.file_notices(spark, str(tmp_path), 1).writeStream.format("parquet").option("checkpointLocation", out + "-c").option("path", out).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.document_id for r in spark.read.parquet(out).collect()) == ["d0", "d1", "d2"]


def test_late_rows_of_closed_windows_are_left_out(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("2024-01-01 00:10:00", "a", 1.0)], [("2024-01-01 05:00:00", "a", 2.0)], [("2024-01-01 00:20:00", "a", 4.0), ("2024-01-01 04:50:00", "a", 8.0)], [("2024-01-01 12:00:00", "a", 16.0)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        E.windowed_counts(stream).select("window.start", "event_type", "total").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(str(r.start), r.total) for r in spark.read.parquet(out).collect()}
    assert got == {("2024-01-01 00:00:00", 1.0), ("2024-01-01 04:00:00", 8.0), ("2024-01-01 05:00:00", 2.0)}

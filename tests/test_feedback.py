import datetime
import json

from pyspark.sql import functions as F

from scriptorium.streaming import feedback

NOW = datetime.datetime(2024, 1, 2, 12)
ISSUES = "id bigint, ts timestamp_ntz, pushed boolean, corrected boolean, image_crop_path string, corrected_value string, field_name string"


def hours(n):
    return NOW - datetime.timedelta(hours=n)


def test_push_and_corrections(spark):
    rows = [(1, hours(2), False, False, "crops/d1/x.jpg", "v", "f"), (2, hours(1), False, False, "y.jpg", "v", "f"), (3, hours(3), True, False, "y.jpg", "v", "f"), (4, hours(3), False, True, "y.jpg", "v", "f")]
    issues = spark.createDataFrame(rows, ISSUES)
    (due,) = feedback.pending_push(issues, NOW).collect()
    payload = json.loads(due.payload)
    assert (due.id, due.task_id) == (1, 10_001) and payload["data"] == {"image": "/data/local-files/?d=crops/d1", "predicted_text": "v", "field": "f"}
    assert payload["annotations"][0]["result"][0]["value"] == {"text": ["v"]}
    human = spark.createDataFrame([(1, "early"), (3, "v_FIXED"), (4, "twice")], "id bigint, human_value string")
    got = {r.id: (r.human_value, r.corrected) for r in feedback.apply_corrections(issues, human).collect()}
    assert got == {1: (None, False), 2: (None, False), 3: ("v_FIXED", True), 4: (None, True)}


def test_latest_state(spark):
    rows = [(1, hours(3), "new"), (1, hours(2), "pushed"), (2, hours(2), "corrected"), (2, hours(2), "pushed"), (3, hours(1), "new")]
    got = {r.id: r.state for r in feedback.latest_state(spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, state string")).collect()}
    assert got == {1: "pushed", 2: "corrected", 3: "new"}


def test_mined_rules(spark):
    rows = [("O1", "01")] * 40 + [("O", "Q")] * 3 + [("OA", "8A")] * 5 + [("S", "5")] * 2 + [("5x", "Sx")] * 4 + [("short", "longer")] * 9 + [("O", "Z")] * 3
    frame = spark.createDataFrame(rows, "raw string, human string")
    got = {(r.kind, r.raw_char): (r.human_char, r.n) for r in feedback.mined_rules(frame).collect()}
    assert got == {("digit", "O"): ("8", 5), ("alpha", "O"): ("Z", 3), ("alpha", "5"): ("S", 4)}
    assert feedback.mined_rules(frame.limit(49)).count() == 0


def test_stream_of_issues(spark, tmp_path):
    schema = "id bigint, ts timestamp_ntz, status string, extraction_method string, value string"
    source, ocr, text, mark = (str(tmp_path / n) for n in ("in", "ocr", "text", "mark"))
    rows = [(1, hours(1), "flag", "ocr", "a"), (2, hours(30), "escalate", "text_layer", "b"), (3, hours(1), "accept", "ocr", "c")]
    spark.createDataFrame(rows, schema).write.json(source)
    feedback.stream_issues(spark, source, schema, ocr, text, mark).awaitTermination()
    spark.createDataFrame([(4, hours(1), "flag", "ocr", "d")], schema).write.mode("append").json(source)
    for _ in range(2):  # the second time there is nothing new
        feedback.stream_issues(spark, source, schema, ocr, text, mark).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(ocr).collect()) == [1, 4]
    assert [(r.id, str(r.date)) for r in spark.read.parquet(text).collect()] == [(2, "2024-01-01")]


def test_states_once_within_the_watermark(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "new"), (1, "2024-01-01 00:00:05", "new"), (1, "2024-01-01 00:01:00", "pushed")]
    spark.createDataFrame(rows, "id bigint, ts string, state string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, ts timestamp, state string").json(str(tmp_path / "in"))
    running = feedback.stream_states(stream).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    running.awaitTermination()
    assert sorted((r.id, r.state) for r in spark.table("states").select("id", "state").orderBy(F.col("state")).collect()) == [(1, "new"), (1, "pushed")]

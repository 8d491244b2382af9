import json

from pyspark.sql import functions as F

from scriptorium.sources import documents, files, records

from .test_pixels import HEADER, JPEG, png


def test_binary_documents(spark, tmp_path):
    contents = {"a.jpg": JPEG, "b.png": png(HEADER, (b"IDAT", b"x"), (b"IEND", b"")), "i.png": b"\x89PNG\r\n\x1a\nx", "c.pdf": b"%PDF-1.4 ... %%EOF\n", "d.pdf": b"%PDF-1.4", "e.pdf": b"%PDF" + b"x" * 2000 + b"%%Eof", "f.bmp": b"BM1234", "g.jpg": b"\xff\xd8", "h.bin": b"z" * 5000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    out = documents.checked(documents.read_documents(spark, str(tmp_path), 3000), 3000)
    got = {r.path.rsplit("/", 1)[1]: (r.mime, r.reject_reason) for r in out.collect()}
    assert got == {
        "a.jpg": ("image/jpeg", None), "b.png": ("image/png", None), "c.pdf": ("application/pdf", None), "d.pdf": ("application/pdf", "corrupt_file"), "e.pdf": ("application/pdf", None),
        "f.bmp": (None, "unsupported_format"), "g.jpg": ("image/jpeg", "corrupt_file"), "i.png": ("image/png", "corrupt_file"), "h.bin": (None, "file_size"),
    }
    taken = documents.checked(documents.read_documents(spark, str(tmp_path), 3000), 3000, F.lit(True))  # a decoder's own verdict
    assert {r.path.rsplit("/", 1)[1] for r in taken.where("reject_reason is null").collect()} == {"a.jpg", "b.png", "c.pdf", "e.pdf", "g.jpg", "i.png"}
    frame = spark.createDataFrame([(b"x" * 10,), (b"x" * 11,), (None,)], "content binary")
    assert [r.reject_reason for r in documents.checked(frame, 10).collect()] == ["unsupported_format", "file_size", "ingest"]
    assert frame.limit(1).select(documents.described_magic(F.lit(b"BM\x00\xff"))).first()[0] == "424d00ff (BM..)"


def test_record_files(spark, tmp_path):
    lines = ['{"id": "1", "fields": {"a": "x"}}', "", "not json", '{"id": "1", "fields": {"a": "y", "b": null}, "raw_fields": {"a": "z"}}', '{"fields": {}}', '{"id": "2", "fields": {}}']
    (tmp_path / "p.jsonl").write_text("\n".join(lines))
    good, bad = records.read_records(spark, str(tmp_path))
    assert [r.line for r in bad.collect()] == ["not json"]
    last = {r.id: r for r in records.last_by_id(good).collect()}
    assert set(last) == {"1", "2"} and last["1"].fields["a"] == "y" and last["1"].raw_fields == {"a": "z"}
    assert sorted(map(tuple, records.long_form(records.last_by_id(good)).collect())) == [("1", 0, "a", "y"), ("1", 1, "b", None)]


def test_coordinates(spark, tmp_path):
    (tmp_path / "c.yaml").write_text('# head\none_v1:\n  name:   [1, 2,  3, 4]   # x\n\n  __anchor_y__: 50\n  none: [0, 0, 0, 0]\n\n\ntwo:\n  # c\n  dob: [-5, 6, 7, 8]\n  __box__: [1, 1, 1, 1]\n')
    got = sorted(map(tuple, records.read_coordinates(spark, str(tmp_path / "c.yaml")).collect()))
    assert got == [("one_v1", "name", 1, 2, 3, 4), ("one_v1", "none", 0, 0, 0, 0), ("two", "dob", -5, 6, 7, 8)]


def test_annotations(spark, tmp_path):
    label = lambda i, name, x: {"id": i, "type": "rectanglelabels", "value": {"rectanglelabels": [name] if name else [], "x": x, "y": 1.0, "width": 2.0, "height": 3.0}}
    text = lambda i, *t: {"id": i, "type": "textarea", "value": {"text": list(t)}}
    tasks = [
        {"data": {"image": "/data/local-files/?d=a/b.jpg"}, "annotations": [{"result": [label("1", "name", 10.0), text("1", "ANN", "no"), label("2", "", 5.0), text("3", "unlabelled"), {"type": "textarea"}]}, {"result": [label("9", "late", 1.0)]}]},
        {"data": {"image": "plain.jpg"}, "annotations": [{"result": [text("1", "before"), label("1", "dob", 50.0)]}]},
        {"data": {"image": "none.jpg"}, "annotations": []},
    ]
    (tmp_path / "t.json").write_text(json.dumps(tasks))
    got = sorted(map(tuple, records.flatten_annotations(records.read_annotations(spark, str(tmp_path / "t.json"))).collect()))
    assert got == [("a/b.jpg", "name", [0.1, 0.01, 0.02, 0.03], "ANN", "ocr"), ("plain.jpg", "dob", [0.5, 0.01, 0.02, 0.03], "before", "ocr")]


def test_sinks(spark, tmp_path):
    row = {"field_name": "f", "value": "v", "confidence": 0.5, "flag_reason": None, "raw_ocr_value": "r", "was_corrected": True, "attempts": 1, "extraction_method": "ocr"}
    frame = spark.createDataFrame([row | {"status": s} for s in ("accept", "flag")], "field_name string, value string, confidence double, status string, flag_reason string, raw_ocr_value string, was_corrected boolean, attempts int, extraction_method string")
    for _ in range(2):
        records.write_decisions(frame, str(tmp_path / "log"))
    logged = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert len(logged) == 2 and set(logged[0]) == set(records.DECISION) and logged[0]["status"] == "flag"
    rules = spark.createDataFrame([("digit", "O", "0", 5), ("alpha", "5", "S", 3)], "kind string, raw_char string, human_char string, n int")
    assert json.loads(records.rules_json(rules, 60)) == {"total_records_analyzed": 60, "suggested_digit_subs": {"O": "0"}, "suggested_alpha_subs": {"5": "S"}}


def test_settings(spark, tmp_path):
    text = """# a comment
confidence_high: 0.92   # accept
name: "a # b"  # not a comment inside
empty_section:
preprocess:
  # a comment
  enable_deskew: false
  tile: [8, 8]    # two numbers
  ratio:    -1.5e-2
  url: ''
api:
  port: 8000
last: plain words
"""
    want = {"confidence_high": 0.92, "name": "a # b", "empty_section": {}, "preprocess": {"enable_deskew": False, "tile": [8, 8], "ratio": -0.015, "url": ""}, "api": {"port": 8000}, "last": "plain words"}
    assert files.parse_settings(text) == want
    path = files.write_file(spark, str(tmp_path / "s.yaml"), text)
    assert files.read_settings(spark, path) == want and files.read_file(spark, path) == text
    files.remove(spark, path)
    assert not (tmp_path / "s.yaml").exists()


def test_reports(spark, tmp_path):
    import datetime

    accuracy = spark.createDataFrame([("uid", 10, 0.9, 0.1, 0.2, 0.0), ("dob", 4, 1.0, 0.0, 0.0, 0.25)], "field_name string, n int, exact_match_rate double, mean_cer double, mean_wer double, missing_rate double")
    delta = spark.createDataFrame([("uid", 10, 0.5, 0.9, 0.4, -0.2, 0.4, 0.0)], "field_name string, n int, pre_exact_rate double, post_exact_rate double, exact_delta double, mean_cer_delta double, improved_rate double, degraded_rate double")
    top = spark.createDataFrame([("O", "0", 7)], "pred string, gt string, n int")
    paths = records.write_reports(spark, str(tmp_path), "pan", datetime.datetime(2024, 5, 6, 7, 8, 9), accuracy, delta, top, {"samples": 10, "mean_cer": 0.1, "mean_wer": 0.2})
    assert [p.rsplit("/", 1)[1] for p in paths] == ["eval_pan_20240506_070809.json", "eval_pan_20240506_070809.md"]
    found = json.loads((tmp_path / "eval_pan_20240506_070809.json").read_text())
    assert found["samples"] == 10 and found["field_accuracy"]["dob"]["n"] == 4 and found["top_confusions"] == [{"pred": "O", "gt": "0", "count": 7}]
    assert "| uid | 10 | 90.0% |" in (tmp_path / "eval_pan_20240506_070809.md").read_text()
    table = records.console_table(accuracy, {"field_name": "Field", "n": "N", "mean_cer": "CER"})
    assert table.splitlines() == ["Field   N     CER", "-----  --  ------", "dob     4  0.0000", "uid    10  0.1000"]


def test_crops(spark, tmp_path):
    import numpy as np

    from scriptorium.streaming import feedback

    x = np.arange(20 * 30 * 3, dtype=np.uint16).astype(np.uint8).reshape(20, 30, 3)
    images = spark.createDataFrame([(1, x.tobytes(), 20, 30)], "image_id int, content binary, h int, w int")
    rows = [(7, 1, "a", 10, 8, 15, 12, "2024-01-02"), (8, 1, "b", 0, 0, 3, 3, "2024-01-02"), (9, 1, "c", 5, 5, 5, 9, "2024-01-03"), (10, 1, "d", 25, 15, 99, 99, "2024-01-03"), (11, 2, "e", 0, 0, 9, 9, "2024-01-03")]
    issues = spark.createDataFrame(rows, "id bigint, image_id int, field_name string, x1 int, y1 int, x2 int, y2 int, ts string").selectExpr("*", "cast(ts as timestamp) as ts_").drop("ts").withColumnRenamed("ts_", "ts")
    feedback.write_crops(images, issues, str(tmp_path / "crops"))
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "crops")).collect()}
    assert set(got) == {7, 8, 10} and (got[8].h, got[8].w, got[10].h, got[10].w) == (8, 8, 10, 10)
    assert bytes(got[7].crop) == x[3:17, 5:20].tobytes() and str(got[10].date) == "2024-01-03"

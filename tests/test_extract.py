from pyspark.sql import functions as F

from scriptorium.operators import documents, extract

CV = "\n  Ann Example \nData Analyst at Place\nann.x+y@mail.example.org / +91 98765-43210\nlinkedin.com/in/ann-x_1 \n\nTechnical Skills\nSQL, Spark | Python\nSkills again\n R ,, \nWork History\nJan 2015 - Mar 2019\nApril 2019 – Present\nEducation\neducation once more\nBSc Something\n"
CARD_A = "Government\nName: Ann B Example\nDOB: 15/08/1990\nGender: FEMALE\n1234 5678 9012\n"
CARD_B = "INCOME TAX DEPARTMENT\nName\nANN EXAMPLE\nFather's Name\nBOB EXAMPLE\nDate of Birth\n15/08/1990\nABCPE1234F\nname\nLAST WINS\nname"


def one(spark, run, text):
    return run(spark.createDataFrame([(1, text)], "id int, text string")).first()


def test_cv(spark):
    r = one(spark, extract.extract_cv, CV)
    assert tuple(r[f] for f in extract.CV_FIELDS) == (
        "Ann Example", "ann.x+y@mail.example.org", "+91 98765-43210", "linkedin.com/in/ann-x_1", "2", "Data Analyst at Place", "SQL, Spark, Python R", "BSc Something",
    )
    assert r.warnings == []


def test_empty_cv(spark):
    r = one(spark, extract.extract_cv, " \n ")
    assert [r[f] for f in extract.CV_FIELDS] == ["", "", "", "", "0", "", "", ""]
    assert r.warnings == [f"{f} missing" for f in extract.CV_FIELDS]


def test_cards(spark):
    a = one(spark, extract.extract_first_card, CARD_A)
    assert (a.name, a.dob, a.gender, a.uid, a.warnings) == ("Ann B Example", "15/08/1990", "FEMALE", "1234 5678 9012", [])
    b = one(spark, extract.extract_second_card, CARD_B)
    assert (b.pan_number, b.name, b.father_name, b.dob) == ("ABCPE1234F", "LAST WINS", "BOB EXAMPLE", "15/08/1990")
    assert one(spark, extract.extract_second_card, "x").warnings == ["pan_number missing", "name missing", "father_name missing", "dob missing"]


def test_long_form_by_kind(spark):
    rows = [("1", "cv", CV), ("2", "aadhaar", CARD_A), ("3", "pan", CARD_B), ("4", "unknown", "x")]
    got = extract.extract(spark.createDataFrame(rows, "id string, doc_type string, text string")).groupBy("id").agg(F.count("ord").alias("n")).collect()
    assert {r.id: r.n for r in got} == {"1": 8, "2": 4, "3": 4}


def test_text_route(spark):
    good = "\n".join(["a line of four words"] * 3) + "A" * 100
    rows = [(1, good), (2, ""), (3, "ab\ncd"), (4, None), (5, "é" * 200 + "\na b c d\na b c d\na b c d")]
    got = {r.id: (r.route, round(r.score, 4), r.reason) for r in documents.text_route(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got[1] == ("text", 1.0, "all_checks_passed")
    assert got[2] == ("image", 0.0, "failed_checks: ['min_chars', 'printable_ratio', 'min_text_lines']")
    assert got[3] == ("image", 0.3333, "failed_checks: ['min_chars', 'min_text_lines']")
    assert got[4][0] == "image" and got[5][2] == "failed_checks: ['printable_ratio']"
    image = documents.text_route(spark.createDataFrame(rows[:1], "id int, text string"), is_pdf=F.lit(False)).first()
    assert (image.route, image.score, image.reason) == ("image", 0.0, "image_input")


def test_text_type(spark):
    rows = [("Experience and SKILLS", "cv"), ("experience", "unknown"), ("x abcpe1234f", "pan"), ("Income Tax Department", "pan"), ("my AADHAAR", "aadhaar"), ("Unique Identification", "aadhaar")]
    frame = spark.createDataFrame(rows, "text string, want string")
    assert frame.where(documents.text_type(F.col("text")) != F.col("want")).count() == 0


def test_first_pages(spark):
    rows = [(1, 0, "a"), (1, 2, "c"), (1, 1, ""), (1, 3, "d"), (2, 0, None)]
    got = documents.first_pages(spark.createDataFrame(rows, "doc_id int, page int, text string")).collect()
    assert {r.doc_id: (r.text, r.page_count) for r in got} == {1: ("a\nc", 4), 2: ("", 1)}


def test_templates(spark):
    cases = [
        (1012, 638, "ABCPE1234F", 0.0, 0.0, 0.0, False, "text_regex_pan"), (1012, 638, "1234 5678 9012", 0.0, 0.0, 0.0, False, "text_regex_aadhaar"),
        (638, 1012, "", 0.0, 0.0, 0.0, False, "aspect_ratio_portrait"), (780, 1000, "", 0.0, 0.0, 0.0, False, "aspect_ratio_a4"), (770, 1000, "", 0.0, 0.0, 0.0, False, "aspect_ratio_portrait"),
        (100, 100, "", 0.9, 0.0, 0.0, False, "aspect_ratio_out_of_bounds"), (1012, 638, "", 0.06, 0.0, 0.0, True, "hsv_blue_with_qr"), (1012, 638, "", 0.06, 0.0, 0.0, False, "hsv_blue_no_qr"),
        (1012, 638, "", 0.05, 0.2, 0.0, True, "hsv_cream"), (1012, 638, "", 0.0, 0.1, 0.2, True, "hsv_white_with_qr"), (1012, 638, "", 0.0, 0.0, 0.2, False, "hsv_white_no_qr"),
        (1012, 638, "", 0.0, 0.0, 0.0, True, "absolute_fallback_guess"), (1012, 638, None, 0.0, 0.0, 0.0, True, "absolute_fallback_guess"),
    ]
    frame = spark.createDataFrame(cases, "w int, h int, text string, blue double, cream double, white double, qr boolean, want string")
    found = documents.template(*(F.col(c) for c in ("w", "h", "text", "blue", "cream", "white", "qr")))
    assert frame.where(found["detection_method"] != F.col("want")).count() == 0

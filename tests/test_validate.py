import datetime

from pyspark.sql import functions as F

from scriptorium.functions import validate
from scriptorium.functions.checksum import check_digit, is_checked
from scriptorium.plans import fixtures

TODAY = datetime.date(2024, 6, 1)
CASES = [
    ("uid", "0123 4567 8901", "UID cannot start with 0 or 1"),
    ("uid", "1234 5678", "UID must be exactly 12 digits (found 8)"),
    ("uid", "12345678901A", "UID contains non-numeric characters"),
    ("uid", "412345678901", "Verhoeff checksum failed"),
    ("aadhaar_number", "", "Field is empty"),
    ("pan_number", "ABCPE1234F", ""),
    ("pan", " abcpe1234f ", ""),
    ("pan_number", "ABCDE1234F", validate.PAN_ERROR),  # D isn't in the list of fourth letters
    ("pan_number", "ABCXE1234F", validate.PAN_ERROR),
    ("pan_number", "ABCDE1234", validate.PAN_ERROR),
    ("my_pan", "anything", ""),  # only pan_number or pan itself
    ("dob", "15/08/1990", ""),
    ("dob", "1990", ""),
    ("dob", "2031", "Date must be DD/MM/YYYY or YYYY"),
    ("dob", "15-08-1990", "Date must be DD/MM/YYYY or YYYY"),
    ("dob", "32/01/1990", "Invalid calendar date"),
    ("dob", "29/02/2021", "Invalid calendar date"),
    ("dob", "29/02/2020", ""),
    ("dob", "01/01/1899", "Year before 1900"),
    ("dob", "02/06/2024", "Date is in the future"),
    ("dob", "01/06/2024", ""),
    ("dob", "02/06/1903", ""),
    ("dob", "31/05/1903", "Age exceeds 120 years"),
    ("email", "user.name+tag@example.co.uk", ""),
    ("email", "userexample.com", validate.EMAIL_ERROR),
    ("email", "user@.com", validate.EMAIL_ERROR),
    ("phone", "9876543210", ""),
    ("mobile_no", "5123456789", ""),  # any ten to fifteen digits that don't begin with 0
    ("phone", "+12345678901", ""),
    ("phone", "987654321", validate.PHONE_ERROR),
    ("ifsc", "hdfc0123456", ""),
    ("ifsc", "HDFCO123456", validate.IFSC_ERROR),
    ("pincode", "110001", ""),
    ("pincode", "010001", validate.PIN_ERROR),
    ("pin_date", "11001", validate.PIN_ERROR),  # a pin before a date
    ("name", "x", ""),
]


def test_cases(spark):
    rows = spark.createDataFrame([(n, v) for n, v, _ in CASES], "field_name string, corrected string")
    got = {(r.field_name, r.corrected): (r.is_valid, r.error_message) for r in validate.validate_all(rows, TODAY).collect()}
    assert got == {(n, v): (e == "", e) for n, v, e in CASES}


def test_masters(spark):
    rows = spark.createDataFrame([("ifsc", " sbin0001234"), ("ifsc", "SBIN0009999"), ("pincode", "110001"), ("pincode", "999999"), ("pincode", "x")], "field_name string, corrected string")
    out = validate.validate_all(rows, TODAY, fixtures.master(spark, fixtures.IFSC_CODES * 2), fixtures.master(spark, fixtures.PIN_CODES))
    got = {r.corrected: r.error_message for r in out.collect()}
    assert got == {" sbin0001234": "", "SBIN0009999": validate.IFSC_UNKNOWN, "110001": "", "999999": validate.PIN_UNKNOWN, "x": validate.PIN_ERROR}


def test_checksum(spark):
    assert [tuple(r) for r in spark.createDataFrame([("2363",), ("2364",), ("12a",), ("",)], "d string").select(is_checked(F.col("d"))).collect()] == [(True,), (False,), (None,), (None,)]
    made = spark.range(200).select((F.col("id") * 7919 + 236).cast("string").alias("body")).withColumn("whole", F.concat("body", check_digit(F.col("body"))))
    assert made.where(~is_checked(F.col("whole"))).count() == 0
    # any other digit in any place fails
    place = F.explode(F.sequence(F.lit(1), F.length("whole"))).alias("at")
    spoiled = made.select("whole", place).select("whole", "at", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("by"))
    digit = (F.substring("whole", F.col("at"), F.lit(1)).cast("int") + F.col("by")) % 10
    wrong = F.concat(F.left("whole", F.col("at") - 1), digit.cast("string"), F.substring("whole", F.col("at") + 1, F.length("whole")))
    assert spoiled.where(is_checked(wrong)).count() == 0


def test_made_cards_are_valid(spark):
    k = F.col("id")
    made = spark.range(300).select(fixtures.uid(k).alias("u"), fixtures.pan(k).alias("p"))
    assert made.where((validate.uid_error(F.col("u")) != "") | (validate.pan_error(F.col("p")) != "")).count() == 0

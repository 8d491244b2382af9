"""Field tables derived from the driver's tables by formula, as no table holds card fields.

``k`` is a customer's key. Every value is computed, so none belongs to a person.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.checksum import check_digit

# Master codes.
IFSC_CODES = ("HDFC0000001", "SBIN0001234", "ICIC0000001", "PUNB0123456")
PIN_CODES = ("110001", "400001", "560001", "600001")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def master(spark: SparkSession, codes: tuple[str, ...]) -> DataFrame:
    """A master table; codes that are there already are left alone."""
    return spark.createDataFrame([(c,) for c in codes], "code string").dropDuplicates(["code"])


def letter(n: Column) -> Column:
    return F.char((65 + n % 26).cast("bigint"))


def uid(k: Column) -> Column:
    """A first digit from 2 to 9, ten more, the check digit; in groups of four."""
    body = ((2 + k % 8) * 10_000_000_000 + (k * 7919 + 1_234_567) % 10_000_000_000).cast("string")
    number = F.concat(body, check_digit(body))
    return F.concat_ws(" ", *(F.substring(number, at, 4) for at in (1, 5, 9)))


def pan(k: Column) -> Column:
    fourth = F.substring(F.lit("PCHFATBLGJ"), (1 + k % 10).cast("int"), F.lit(1))
    digits = F.lpad((1 + 37 * k % 9999).cast("string"), 4, "0")
    return F.concat(letter(k), letter(F.floor(k / 26)), letter(3 * k), fourth, letter(7 * k), digits, letter(11 * k))


def birth_date(k: Column) -> Column:
    return F.concat_ws("/", F.lpad((1 + k % 28).cast("string"), 2, "0"), F.lpad((1 + k % 12).cast("string"), 2, "0"), (1950 + k % 50).cast("string"))


def pincode(k: Column) -> Column:
    return F.substring(F.lit("".join(PIN_CODES) + "123456"), (1 + k % 5 * 6).cast("int"), F.lit(6))


def damaged(value: Column, k: Column) -> Column:
    """Recognition errors by k: none, digits as letters, the last character lost, lower case with spaces."""
    return (
        F.when(k % 4 == 0, value)
        .when(k % 4 == 1, F.translate(value, "0158", "OISB"))
        .when(k % 4 == 2, F.left(value, F.length(value) - 1))
        .otherwise(F.concat(F.lit(" "), F.lower(value), F.lit("  ")))
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))


def fields_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, id, ord, field_name, gt, raw, present, conf): five fields of every customer that has a part of its number."""
    k = F.col("k")
    named = customers(spark, sf_dir).join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name"), "k")
    values = (("uid", uid(k)), ("pan_number", pan(k)), ("dob", birth_date(k)), ("name", F.col("p_name")), ("pincode", pincode(k)))
    fields = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(name).alias("field_name"), value.alias("gt")) for i, (name, value) in enumerate(values, 1)))
    return (
        named.select("k", F.concat(F.lit("c"), k.cast("string")).alias("id"), F.explode(fields).alias("f"))
        .select("k", "id", "f.*")
        .withColumn("raw", damaged(F.col("gt"), k))
        .withColumn("present", (k % 13 != 0) & ~((F.col("field_name") == "pincode") & (k % 11 == 0)))
        .withColumn("conf", ((31 * k + 7 * F.col("ord")) % 100) / 100)
    )


def truth(fields: DataFrame) -> DataFrame:
    return fields.select("id", "ord", "field_name", F.col("gt").alias("value"))


def predictions(fields: DataFrame) -> DataFrame:
    """What was recognised, with some ids that have no truth."""
    own = fields.where("present").select("id", "ord", "field_name", F.col("raw").alias("value"))
    extra = fields.where("k % 17 = 0").select(F.concat(F.lit("x"), F.col("k").cast("string")).alias("id"), "ord", "field_name", F.col("raw").alias("value"))
    return own.union(extra)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised regions: an order is a document, its lines are regions with the part's name as text."""
    x0, y0 = (7 * F.col("l_suppkey") % 900).cast("int"), (40 * F.col("l_linenumber") + F.col("l_partkey") % 9).cast("int")
    corners = F.array(F.array(x0, y0), F.array(x0 + 100, y0), F.array(x0 + 100, y0 + 30), F.array(x0, y0 + 30))
    ord = F.col("l_linenumber") * F.lit(1_000_000_000).cast("long") + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000  # some orders have a line number twice
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("doc_id"), ord.alias("ord"), corners.alias("bbox"), F.col("p_name").alias("text"), (F.col("l_partkey") % 100 / 100).alias("confidence")
    )


def cv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): CVs whose parts come and go with the part's key."""
    k = F.col("p_partkey")
    text = F.concat_ws(
        "\n",
        F.when(k % 7 != 0, F.concat(F.lit("  "), F.initcap("p_name"))).otherwise(""),
        F.when(k % 3 != 0, F.concat(F.lit("Senior "), F.element_at(F.array(*map(F.lit, ("Engineer", "Data Analyst", "Clerk"))), (1 + k % 3).cast("int")))),
        F.when(k % 5 != 0, F.concat(F.lit("mail: user"), k.cast("string"), F.lit("@example.com"))),
        F.when(k % 4 != 0, F.concat(F.lit("+91 98765 "), F.lpad((k % 100000).cast("string"), 5, "0"))),
        F.when(k % 6 == 1, F.lit("https://www.LinkedIn.com/in/user-x_1")),
        F.lit("Technical Skills and tools"),
        F.concat(F.col("p_brand"), F.lit(", SQL | "), F.col("p_type")),
        F.when(k % 2 == 0, F.lit("skills more")),
        F.when(k % 2 == 0, F.lit("Spark,, Python |")),
        F.lit("EXPERIENCE"),
        F.when(k % 3 == 0, F.lit("Jan 2015 - Mar 2019")),
        F.when(k % 3 != 1, F.lit("April 2019 - present")),
        F.when(k % 8 != 0, F.lit("Education")),
        F.when(k % 8 == 2, F.lit("education again")),
        F.concat(F.lit("BSc "), F.col("p_name")),
    )
    return read(spark, sf_dir, "part").select(k.alias("id"), text.alias("text"))


def card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, doc_type, text): text layers of two kinds of cards."""
    k = F.col("k")
    named = customers(spark, sf_dir).join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name"), "k")
    first = F.concat_ws("\n", F.lit("Government of India"), F.concat(F.lit("Name: "), F.col("p_name")), F.concat(F.lit("DOB : "), birth_date(k)), F.when(k % 3 == 0, F.lit("Gender: Female")), F.when(k % 5 != 0, uid(k)))
    second = F.concat_ws(
        "\n", F.lit("INCOME TAX DEPARTMENT"), F.lit("Name"), F.initcap("p_name"), F.when(k % 2 == 0, F.lit("Father's Name")), F.concat(F.lit("Old "), F.col("p_name")),
        F.when(k % 3 == 0, F.lit("NAME again")), F.lit("Date of Birth"), birth_date(k), F.when(k % 7 != 0, pan(k)),
    )
    return named.select("k", F.when(k % 2 == 0, "aadhaar").otherwise("pan").alias("doc_type"), F.when(k % 2 == 0, first).otherwise(second).alias("text"))


def painted(table: DataFrame, key: str, paint) -> DataFrame:
    """(image_id, content, h, w): an image for each row, painted from its key alone."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            for k in batch["image_id"]:
                x = paint(int(k))
                yield pd.DataFrame([(k, x.tobytes(), x.shape[0], x.shape[1])], columns=["image_id", "content", "h", "w"])

    # a small table is one file: its keys are dealt out, as a picture costs far more than its key
    keys = table.select(F.col(key).cast("long").alias("image_id")).repartition(table.sparkSession.sparkContext.defaultParallelism, "image_id")
    return keys.mapInPandas(run, "image_id bigint, content binary, h int, w int")


def png(k: Column) -> Column:
    """A PNG of three chunks; by k whole, or with a wrong checksum, without an end, cut off, or of no width."""

    def chunk(kind: str, data: Column, spoiled: Column) -> Column:
        body = F.concat(F.hex(F.lit(kind.encode())), data)
        crc = F.crc32(F.unhex(body)) + F.when(spoiled, 1).otherwise(0)
        return F.concat(F.lpad(F.hex(F.length(data) / 2), 8, "0"), body, F.right(F.concat(F.lit("00000000"), F.hex(crc)), F.lit(8)))

    width = F.when(k % 5 == 4, F.lit("00000000")).otherwise(F.lpad(F.hex(1 + k % 9), 8, "0"))
    none = F.lit(False)
    whole = F.concat(
        F.lit("89504E470D0A1A0A"), chunk("IHDR", F.concat(width, F.lit("000000010802000000")), none), chunk("IDAT", F.hex(F.encode(k.cast("string"), "UTF-8")), k % 5 == 1),
        F.when(k % 5 == 2, F.lit("")).otherwise(chunk("IEND", F.lit(""), none)),
    )
    return F.unhex(F.when(k % 5 == 3, F.left(whole, F.length(whole) - 4)).otherwise(whole))

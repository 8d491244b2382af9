"""Documents as bytes: reading, size and type guards, integrity of PDFs.

Rejected documents carry a reason instead of an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import pixels

MAX_BYTES = 10 * 1024 * 1024
# Leading bytes in hex, the first match counts.
MAGIC = (("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("25504446", "application/pdf"), ("FFD8", "image/jpeg"))
PDF_HEAD, PDF_ENDS = "%PDF", ("%%EOF", "%%Eof")
#: Bytes at the end of a PDF in which its mark must be.
PDF_TAIL = 1024


def read_documents(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, content): the content of files beyond the limit isn't read. Spark's file sources leave empty files out."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= max_bytes).select("path", "length", "content")
    large = files.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.union(large)


def mime_type(content: Column) -> Column:
    """By the first 16 bytes; null if none is known."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for magic, mime in reversed(MAGIC):
        out = F.when(head.startswith(magic), mime).otherwise(out)
    return out


def described_magic(content: Column) -> Column:
    """The first eight bytes in hex, and as printable ASCII with dots for the rest."""
    head = F.substring(content, 1, 8)
    shown = F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[^\x20-\x7E]", ".")
    return F.concat(F.lower(F.hex(head)), F.lit(" ("), shown, F.lit(")"))


def is_whole_pdf(content: Column) -> Column:
    tail = F.decode(F.right(content, F.lit(PDF_TAIL)), "ISO-8859-1")
    return F.decode(F.substring(content, 1, 4), "ISO-8859-1").eqNullSafe(PDF_HEAD) & (tail.contains(PDF_ENDS[0]) | tail.contains(PDF_ENDS[1]))


def checked(docs: DataFrame, max_bytes: int = MAX_BYTES, is_whole_image: Column | None = None) -> DataFrame:
    """Add mime and reject_reason, null if the document is accepted: size first, then type, then integrity.

    is_whole_image: a verdict on images; without one PNG chunks and JPEG markers are walked.
    """
    size = F.coalesce(F.octet_length("content").cast("long"), F.col("length")) if "length" in docs.columns else F.octet_length("content").cast("long")
    out = docs.withColumn("mime", F.when(size <= max_bytes, mime_type(F.col("content"))))
    if is_whole_image is None:  # Python sees the bytes of images only
        out = out.withColumn("_image", F.when(F.col("mime").startswith("image/"), F.col("content")))
        image = F.coalesce(pixels.is_whole_image(F.col("_image")), F.lit(True))
    else:
        image = is_whole_image
    whole = F.when(F.col("mime") == "application/pdf", is_whole_pdf(F.col("content"))).otherwise(image)
    return out.withColumn("reject_reason", F.when(size.isNull(), "ingest").when(size > max_bytes, "file_size").when(F.col("mime").isNull(), "unsupported_format").when(~whole, "corrupt_file")).drop("_image")

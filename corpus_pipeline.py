"""A corpus pipeline of five of the operators, each stage over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's
result to the session's shared folder and reads it again as the next one's documents. All but
the last stage return the columns of ``docs`` as they came, extra ones too.

Cases: documents with a null or empty text pass through every stage that has no reason to drop
them, and may be dropped as copies of one another. Rows that share a doc_id are one document
to the near-duplicate stage, which keeps one row of it; other stages judge row by row. A row
without a doc_id is never dropped as a copy. Empty tables give empty results. Stages that judge by
row carry all columns along, so that texts aren't shuffled to drop or change some of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, decontaminate, quality, simhash, substring_dedup
from scriptorium.llm.common import checkpointed, matched, removed, restored, shared_folder, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; it learns from what docs has of the labelled ones."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return restored(quality.score(docs, model, carry=True).where("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the smallest doc_id. Groups come from SimHash fingerprints of five-word shingles, links of a Jaccard similarity of 0.8 or more.

    Of rows that share a doc_id the least one stays, by the text and then the other columns in order.
    """
    found = simhash.similar(docs)
    copies = checkpointed(found.where("component_id <> doc_id").select("doc_id").distinct())
    kept = matched(docs, copies, "left_anti")
    repeated = checkpointed(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("doc_id").alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():  # the usual case: no text has to move
        return kept
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    named = matched(kept, repeated, "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("_row"))
    first = named.select(*(F.col("doc_id") if c == "doc_id" else F.col("_row").getField(c).alias(c) for c in docs.columns))
    return matched(kept, repeated, "left_anti").unionByName(first)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages out that an earlier document has; a text that loses none stays as it is."""
    found = substring_dedup.remove_repeats(docs, carry=True)
    changed = F.col("n_removed") > 0
    if "n_chars" in docs.columns:
        size = F.when(changed, F.length("kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("rest.n_chars"))
        found = found.withColumn("rest", F.col("rest").withField("n_chars", size))
    return restored(found, docs, F.when(changed, F.col("kept")).otherwise(F.col("text")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents."""
    found = decontaminate.judged(decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark"), carry=True))
    return restored(found.where("not contaminated"), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every kept document and a digest of the text that they decode to."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]

#: No SQL: a fitted classifier, a similarity graph and a tokenizer. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)  # nothing reads a stage after the next one is written
        docs, before = spark.read.parquet(path), path
    return docs

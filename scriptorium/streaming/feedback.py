"""The feedback loop: logged problems, what is to be pushed for annotation, corrections, mined rules.

State is an append-only log of transitions; the latest one of each id is its state. Everything
that depends on the time takes ``now`` as a parameter.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Transitions of an issue, in their order.
STATES = ("new", "pushed", "corrected")
#: Ids of annotation tasks, until the annotation tool gives its own.
TASK_OFFSET = 10_000
LEAST_CORRECTIONS, LEAST_COUNT = 50, 3

#: Columns of an issue.
ISSUE = (
    "id bigint, ts timestamp_ntz, request_id string, doc_type string, field_name string, image_crop_path string, raw_ocr_value string, corrected_value string, was_corrected boolean, "
    "confidence double, flag_reason string, extraction_method string"
)


def split_issues(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Problems of recognised fields, and those of text layers."""
    bad = decisions.where("status <> 'accept'")
    return bad.where("extraction_method = 'ocr'"), bad.where("extraction_method = 'text_layer'")


def latest_state(transitions: DataFrame) -> DataFrame:
    """(id, ts, state, ...) of each issue's last transition; at the same time the further one counts."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    kept = [c for c in transitions.columns if c != "id"]
    last = transitions.groupBy("id").agg(F.max_by(F.struct(*kept), F.struct("ts", rank)).alias("_r"))
    return last.select("id", "_r.*")


def pending_push(issues: DataFrame, now: datetime.datetime, age: datetime.timedelta = datetime.timedelta(hours=1)) -> DataFrame:
    """Issues (with pushed and corrected flags) older than ``age`` that are neither; with their task id and payload."""
    due = issues.where(~F.col("pushed") & ~F.col("corrected") & (F.col("ts") < F.lit(now - age).cast("timestamp_ntz")))
    folder = F.regexp_replace("image_crop_path", "/[^/]*$", "") if "image_crop_path" in issues.columns else F.lit("")
    out = due.withColumn("task_id", F.col("id") + TASK_OFFSET)
    if "corrected_value" in issues.columns:
        data = F.struct(F.concat(F.lit("/data/local-files/?d="), folder).alias("image"), F.col("corrected_value").alias("predicted_text"), F.col("field_name").alias("field"))
        text = F.struct(F.array("corrected_value").alias("text"))
        result = F.struct(F.lit("transcription").alias("from_name"), F.lit("image").alias("to_name"), F.lit("textarea").alias("type"), text.alias("value"))
        out = out.withColumn("payload", F.to_json(F.struct(data.alias("data"), F.array(F.struct(F.array(result).alias("result"))).alias("annotations"))))
    return out


def apply_corrections(issues: DataFrame, corrections: DataFrame) -> DataFrame:
    """Pushed issues that people have corrected since (id, human_value); others are left as they are."""
    human = corrections.select("id", F.col("human_value").alias("_human"))
    fixed = F.col("_human").isNotNull() & F.col("pushed") & ~F.col("corrected")
    joined = issues.join(human, "id", "left")
    return joined.withColumn("human_value", F.when(fixed, F.col("_human"))).withColumn("corrected", F.col("corrected") | fixed).drop("_human")


def mined_rules(corrected: DataFrame, least: int = LEAST_CORRECTIONS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(kind, raw_char, human_char, n): substitutions that corrections suggest.

    corrected: (raw, human). Characters at one place of texts of one length are counted; those seen
    often enough are rules to digits or to letters. Of several rules for a character the rarest
    counts, and of equally rare ones the greatest. Fewer corrections than ``least`` give none.
    """
    from scriptorium.operators.metrics import aligned_pairs

    enough = corrected.limit(least).count() >= least
    counts = aligned_pairs(corrected if enough else corrected.limit(0), "raw", "human").where(F.col("n") >= least_count)
    kind = F.when(F.col("gt").rlike(r"^\p{Nd}$"), "digit").when(F.col("gt").rlike(r"^\p{L}$"), "alpha")
    named = counts.withColumn("kind", kind).where("kind is not null")
    rarest = named.groupBy("kind", F.col("pred").alias("raw_char")).agg(F.max_by(F.struct("gt", "n"), F.struct(-F.col("n"), F.col("gt"))).alias("r"))
    return rarest.select("kind", "raw_char", F.col("r.gt").alias("human_char"), F.col("r.n").alias("n"))


def stream_issues(spark, source: str, schema: str, ocr_path: str, text_path: str, checkpoint: str):
    """Append problems of decisions that arrive as JSON files to two tables by date; each batch once.

    Runs over what is there and stops; a later call goes on from its checkpoint.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.withColumn("date", F.to_date("ts"))
        for part, path in zip(split_issues(batch), (ocr_path, text_path), strict=True):
            # a batch that is run again overwrites what it wrote before
            part.write.mode("overwrite").partitionBy("date").parquet(f"{path}/batch={epoch}")

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_states(transitions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of transitions (id, ts timestamp, state), each one once within the watermark."""
    return transitions.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id", "state"])


def write_crops(images: DataFrame, issues: DataFrame, path: str, pad: int = 5) -> None:
    """Append the cut-out of each issue's box to a table by date: (id, field_name, h, w, crop) with raw pixels.

    images: (image_id, content, h, w); issues: (id, image_id, field_name, x1, y1, x2, y2, ts). Boxes are padded and clamped; an empty one has no crop.
    """
    import numpy as np
    import pandas as pd

    def cut(batches):
        for batch in batches:
            for row in batch.itertuples():
                x = np.frombuffer(row.content, np.uint8).reshape(row.h, row.w, 3)
                own = x[max(0, row.y1 - pad) : max(0, row.y2 + pad), max(0, row.x1 - pad) : max(0, row.x2 + pad)]
                if own.size and row.x2 > row.x1 and row.y2 > row.y1:
                    yield pd.DataFrame([(row.id, row.field_name, row.date, own.shape[0], own.shape[1], own.tobytes())], columns=["id", "field_name", "date", "h", "w", "crop"])

    joined = issues.withColumn("date", F.to_date("ts")).join(images.select("image_id", "content", "h", "w"), "image_id")
    made = joined.select("id", "field_name", "date", "x1", "y1", "x2", "y2", "content", "h", "w").mapInPandas(cut, "id bigint, field_name string, date date, h int, w int, crop binary")
    made.write.mode("append").partitionBy("date").parquet(path)

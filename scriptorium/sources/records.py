"""Record files: predictions and truth as JSON lines, coordinate tables, annotations, reports."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.metrics import arrow, band
from scriptorium.sources.files import write_file

RECORD = "id string, fields map<string,string>, raw_fields map<string,string>"
DECISION = ("field_name", "value", "confidence", "status", "flag_reason", "raw_ocr_value", "was_corrected", "attempts", "extraction_method")
ANNOTATIONS = "data struct<image:string>, annotations array<struct<result:array<struct<id:string,type:string,value:struct<rectanglelabels:array<string>,x:double,y:double,width:double,height:double,text:array<string>>>>>>"


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records with their place (line_no) in the files, and the lines that aren't JSON objects. Blank lines are skipped."""
    lines = spark.read.text(path).select(F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).alias("line_no"), F.trim("value").alias("line")).where("line <> ''")
    parsed = lines.withColumn("r", F.from_json("line", RECORD + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    is_bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~is_bad).select("line_no", "r.id", "r.fields", "r.raw_fields"), parsed.where(is_bad).select("line_no", "line")


def last_by_id(records: DataFrame, key: str = "id", order: str = "line_no") -> DataFrame:
    """The last record of each id; records without one are dropped. A partial maximum, no sort."""
    kept = [c for c in records.columns if c != key]
    last = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*kept), order).alias("_r"))
    return last.select(key, *(F.col(f"_r.{c}").alias(c) for c in kept))


def long_form(records: DataFrame, fields: str = "fields") -> DataFrame:
    """(id, ord, field_name, value) of a map of fields."""
    return records.select("id", F.posexplode(F.map_entries(fields)).alias("ord", "f")).select("id", "ord", F.col("f.key").alias("field_name"), F.col("f.value").alias("value"))


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(version, field_name, x1, y1, x2, y2) of a coordinate file: a version's name and a colon, then indented ``field: [x1, y1, x2, y2]``.

    A configuration file of a few kilobytes, read as one row.
    """
    text = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?ms)^(\w+):\s*?$(?:.*?)(?=^\w|\z)"), F.lit(0))).alias("block"))
    boxes = F.regexp_extract_all("block", F.lit(r"(?m)^\s+(\w+:\s*\[[^\]]*\])"), F.lit(1))
    rows = text.select(F.regexp_extract("block", r"^(\w+):", 1).alias("version"), F.explode(boxes).alias("box"))
    number = lambda k: F.regexp_extract("box", r"\[\s*" + r"-?\d+\s*,\s*" * k + r"(-?\d+)", 1).try_cast("int")
    return rows.select("version", F.regexp_extract("box", r"^(\w+):", 1).alias("field_name"), *(number(k).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2")))).where("not field_name like '!_!_%' escape '!' and y2 is not null")


def flatten_annotations(tasks: DataFrame) -> DataFrame:
    """One row for each labelled group of a task's first annotation: image path, field, box as shares of the image, text.

    Results are grouped by their id; the last box and the last text of a group count.
    """
    image = F.coalesce("data.image", F.lit(""))
    # the task's number before its results are taken apart: the next step would number those
    named = tasks.select(F.monotonically_increasing_id().alias("task"), F.element_at(F.split(image, r"\?d=", -1), -1).alias("image_path"), "annotations")
    own = named.select("task", "image_path", F.posexplode(F.get("annotations", F.lit(0))["result"]).alias("at", "r")).where("r.id <> ''")
    value = F.col("r.value")
    share = lambda c: F.coalesce(value[c], F.lit(0.0)) / 100
    box = F.when(F.col("r.type") == "rectanglelabels", F.array(share("x"), share("y"), share("width"), share("height")))
    label = F.when(F.col("r.type") == "rectanglelabels", F.get(value["rectanglelabels"], F.lit(0)))
    text = F.when(F.col("r.type") == "textarea", F.get(value["text"], F.lit(0)))
    flat = own.select("task", "image_path", F.col("r.id").alias("id"), "at", label.alias("label"), box.alias("box"), text.alias("text"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    groups = flat.groupBy("task", "image_path", "id").agg(last("label").alias("field_name"), last("box").alias("bbox"), F.coalesce(last("text"), F.lit("")).alias("text_value"))
    return groups.where("field_name <> ''").select("image_path", "field_name", "bbox", "text_value", F.lit("ocr").alias("extraction_method"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of an export: a JSON array, or one task a line."""
    return spark.read.schema(ANNOTATIONS).option("multiLine", True).json(path)


def write_decisions(decisions: DataFrame, path: str) -> None:
    """Append the decisions that weren't accepted as JSON lines."""
    decisions.where("status <> 'accept'").select(*DECISION).write.mode("append").option("ignoreNullFields", False).json(path)


def rules_json(rules: DataFrame, analysed: int) -> str:
    """Suggested substitutions (kind, raw, human) as JSON; a few dozen rows."""
    out: dict = {"total_records_analyzed": analysed, "suggested_digit_subs": {}, "suggested_alpha_subs": {}}
    for r in rules.collect():
        out[f"suggested_{r['kind']}_subs"][r["raw_char"]] = r["human_char"]
    return json.dumps(out, indent=4)


def markdown_report(accuracy: DataFrame, delta: DataFrame, top: DataFrame, rates: dict, title: str, shown: int = 30) -> str:
    """Summaries (a row per field name) and the most frequent confusions as Markdown."""
    lines = [f"# Evaluation report: {title}", "", f"**Samples**: {rates['samples']}  ", f"**Mean CER**: {rates['mean_cer']:.4f}  ", f"**Mean WER**: {rates['mean_wer']:.4f}  "]
    lines += ["", "## Per-field accuracy", "", "| Field | N | Exact% | Mean CER | Mean WER | Miss% | Band |", "|-|-|-|-|-|-|-|"]
    for r in accuracy.withColumn("band", band(F.col("exact_match_rate"))).orderBy("field_name").collect():
        lines.append(f"| {r.field_name} | {r.n} | {r.exact_match_rate:.1%} | {r.mean_cer:.4f} | {r.mean_wer:.4f} | {r.missing_rate:.1%} | {r.band} |")
    lines += ["", "## Post-correction delta", "", "| Field | N | Pre% | Post% | Δ Exact | Δ CER | Impr% | Degr% |", "|-|-|-|-|-|-|-|-|"]
    for r in delta.withColumn("arrow", arrow(F.col("exact_delta"))).orderBy("field_name").collect():
        lines.append(f"| {r.field_name} | {r.n} | {r.pre_exact_rate:.1%} | {r.post_exact_rate:.1%} | {r.arrow}{abs(r.exact_delta) * 100:.1f}pp | {r.mean_cer_delta:+.4f} | {r.improved_rate:.1%} | {r.degraded_rate:.1%} |")
    found = top.limit(shown).collect()
    if found:
        lines += ["", "## Top character confusions", "", "| Pred | GT | Count |", "|-|-|-|"]
        lines += [f"| `{r.pred}` | `{r.gt}` | {r.n} |" for r in found]
    return "\n".join(lines)


def report_json(accuracy: DataFrame, delta: DataFrame, top: DataFrame, rates: dict, title: str, shown: int = 30) -> str:
    """The same summaries as one JSON object, by field name."""
    by_field = lambda df: {r["field_name"]: {k: v for k, v in r.asDict().items() if k != "field_name"} for r in df.orderBy("field_name").collect()}
    found = [{"pred": r["pred"], "gt": r["gt"], "count": r["n"]} for r in top.limit(shown).collect()]
    return json.dumps({"doc_type": title, **rates, "field_accuracy": by_field(accuracy), "correction_delta": by_field(delta), "top_confusions": found}, indent=2, ensure_ascii=False)


def console_table(frame: DataFrame, columns: dict[str, str], order: str = "field_name") -> str:
    """A small table for a terminal: columns (name: heading), as wide as their widest value, numbers to the right."""
    rows = frame.orderBy(order).select(*columns).collect()
    shown = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    cells = [list(columns.values()), *([shown(v) for v in r] for r in rows)]
    wide = [max(len(c[k]) for c in cells) for k in range(len(columns))]
    right = [bool(rows) and isinstance(rows[0][k], int | float) for k in range(len(columns))]
    line = lambda c: "  ".join(x.rjust(w) if r else x.ljust(w) for x, w, r in zip(c, wide, right, strict=True)).rstrip()
    return "\n".join([line(cells[0]), "  ".join("-" * w for w in wide), *map(line, cells[1:])])


def write_reports(spark: SparkSession, folder: str, title: str, now: datetime.datetime, accuracy: DataFrame, delta: DataFrame, top: DataFrame, rates: dict) -> tuple[str, str]:
    """A JSON and a Markdown report whose names carry the kind of document and the time; their paths."""
    stem = f"{folder}/eval_{title}_{now:%Y%m%d_%H%M%S}"
    return (
        write_file(spark, f"{stem}.json", report_json(accuracy, delta, top, rates, title)),
        write_file(spark, f"{stem}.md", markdown_report(accuracy, delta, top, rates, title)),
    )


def write_truth(fields: DataFrame, path: str) -> None:
    """Append (id, field_name, gt) as one JSON record a line and id: what made-up cards hold."""
    pairs = F.array_sort(F.collect_list(F.struct("ord", "field_name", "gt")))
    entries = F.map_from_entries(F.transform("f", lambda f: F.struct(f["field_name"], f["gt"])))
    fields.groupBy("id").agg(pairs.alias("f")).select("id", entries.alias("fields")).write.mode("append").json(path)

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids that are broadcast at the most (some 50 MB on an executor); more of them meet their rows by a shuffle.
MOST_IDS = 1_000_000
#: Words of whole texts: runs of anything but ASCII white space. ``bytes.split()`` takes the same runs.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's folder for checkpoints. Where none is set, one of our own on a local master, as in tests; anywhere else that's an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[[^\[\]-]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the folder that all executors share."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables and files that a query writes and reads again."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own in the shared folder, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def portions(batch: pa.RecordBatch, name: str = "text", most_rows: int = 512, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many rows, and so many bytes of a column unless one row has more."""
    sizes = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = min(at + most_rows, max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right"))))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def with_long_id(docs: DataFrame, name: str = "doc_id") -> Column:
    """The id as a bigint. A cast that changes nothing would leave an alias, and keep equal exchanges from being shared."""
    return F.col(name) if dict(docs.dtypes)[name] == "bigint" else F.col(name).cast("bigint").alias(name)


def halved(key: str) -> Column:
    """To group by along with a key that a join with hot rows on the other side comes next for.

    The groups are the same, but they aren't dealt out by the key alone, so the join deals them
    out again (they are few by then) and reads both sides straight from an exchange. Only then
    can Spark split the hot partitions of the other side.
    """
    return F.pmod(F.hash(key), F.lit(2)).alias("_half")


def matched(frame: DataFrame, ids: DataFrame, how: str, key: str = "doc_id", most: int = MOST_IDS) -> DataFrame:
    """Rows of a frame whose key is (left_semi) or isn't (left_anti) among ids, a checkpointed column of distinct ones.

    They are counted, and broadcast only if there are at most so many; else both sides are shuffled by the key. The rows are the same.
    """
    own = ids.select(F.col(ids.columns[0]).alias("_matched"))
    return frame.join(F.broadcast(own) if own.count() <= most else own, frame[key] == own["_matched"], how)


def with_rest(docs: DataFrame, carry: bool) -> DataFrame:
    """(doc_id, text), and with carry the other columns as a struct ``rest``, whose names can't clash with an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(with_long_id(docs), "text", *([F.struct(*others).alias("rest")] if carry else []))


def restored(found: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of docs again from what was carried along; text: in place of the text as it came."""
    own = F.col("text") if text is None else text
    return found.select(*(own.alias(c) if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))


def carried_schema(ddl: str, frame: DataFrame) -> T.StructType:
    """An operator's own columns, then text and rest if the frame carries them."""
    own = T.StructType.fromDDL(ddl)
    return T.StructType([*own.fields, *(frame.schema[c] for c in ("text", "rest") if "rest" in frame.columns and c not in own.names)])


def with_carried(arrays: list[pa.Array], names: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of an operator's own columns, and what the input batch carries."""
    if "rest" in batch.schema.names:
        more = [c for c in ("text", "rest") if c not in names]
        arrays, names = [*arrays, *(column(batch, c) for c in more)], [*names, *more]
    return pa.RecordBatch.from_arrays(arrays, names=names)

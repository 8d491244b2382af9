"""A similarity cache: the best stored vector for each query, by cosine.

stored: (key, vector, confidence, ord); queries: (query_id, vector). Stored vectors go to the
workers in shards of at most ``SHARD_BYTES``, as one matrix each; every query meets all of a shard's by one matrix product,
and gives one row for each shard: its best there. No pair of vectors is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADMIT, LEAST, SIMILAR = 0.95, 50, 0.88
#: Bytes of stored vectors in one broadcast, and queries that meet them at a time.
SHARD_BYTES, BLOCK = 32 << 20, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda n, x: n + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def admitted(stored: DataFrame, least_confidence: float = ADMIT) -> DataFrame:
    return stored.where(F.col("confidence") >= least_confidence)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64) if len(column) else np.zeros((0, 1))


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and which ones have a length at all."""
    size = np.sqrt((vectors * vectors).sum(1))
    return vectors / np.where(size > 0, size, 1)[:, None], size > 0


def _meeting(shared, itself: bool):
    """A task that finds each query's best vector among those of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored, keys, ords, kind = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                asked, some = _unit(_matrix(part.column("vector")))
                ids = part.column("query_id").to_numpy(zero_copy_only=False)
                # rounded, so that equal vectors tie whatever way the product was computed
                found = np.round(asked @ stored.T, 12)
                if not itself:
                    found[ids[:, None] == keys[None]] = -np.inf
                best = found.argmax(1)  # the first of equals: stored vectors are in their order
                score = found[np.arange(len(best)), best]
                some &= score > -np.inf
                arrays = [part.column("query_id").filter(pa.array(some)), pa.array(keys[best[some]], kind), pa.array(ords[best[some]]), pa.array(score[some])]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "key", "ord", "s"])

    return run


def best_match(queries: DataFrame, stored: DataFrame, least: int = LEAST, threshold: float = SIMILAR, itself: bool = True, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """For each query that is looked up: best key, similarity, hit. Ties go to the one stored first.

    itself: whether a query may meet the stored vector that has its id as the key. Queries of no length, and all of them while fewer than ``least`` vectors are stored, are not looked up and have no row. Stored vectors of no length never match.
    """
    sc = queries.sparkSession.sparkContext
    sized = stored.select("key", F.col("ord").cast("long"), "vector").where(norm(F.col("vector")) > 0)
    many, width = stored.agg(F.count("key"), F.max(F.size("vector"))).first()
    shards = max(1, -(-many * (width or 1) * 8 // shard_bytes)) if many >= least else 0
    asked = queries.select("query_id", "vector")
    ddl = f"query_id {dict(queries.dtypes)['query_id']}, key {dict(stored.dtypes)['key']}, ord bigint, s double"
    found = None
    for k in range(shards):
        rows = sized.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == k).orderBy("ord", "key").toArrow()  # at most about shard_bytes
        matrix, _ = _unit(_matrix(rows.column("vector")))
        if not len(matrix):
            continue
        shared = sc.broadcast((matrix, rows.column("key").to_numpy(), rows.column("ord").to_numpy(), rows.schema.field("key").type))
        one = asked.mapInArrow(_meeting(shared, itself), ddl)
        found = one if found is None else found.union(one)
    if found is None:
        found = queries.sparkSession.createDataFrame([], ddl)
    best = F.max_by(F.struct("key", "s"), F.struct(F.col("s"), (-F.col("ord")).alias("o")))
    return found.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.key", F.col("b.s").alias("similarity"), (F.col("b.s") >= threshold).alias("hit"))


def cache_stats(matches: DataFrame) -> DataFrame:
    """Hits, misses and the hit rate (0 without any query)."""
    return matches.agg(F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("cache_misses"), F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(0.0)).alias("hit_rate"))


def cached_session(reads: DataFrame, least: int = LEAST, threshold: float = SIMILAR, least_confidence: float = ADMIT) -> DataFrame:
    """A cache that fills itself in order within each session and starts empty in the next one.

    reads: (session, ord, vector, text, confidence), where text is what the engine would read.
    Gives session, ord, text and hit in the order of each session. A session is a document, so
    it fits a task.
    """

    def run(pdf):
        stored, texts, out = np.zeros((64, 1)), [], []
        for row in pdf.sort_values("ord").itertuples():
            v = np.asarray(row.vector, float)
            size = np.sqrt(v @ v)
            hit = None
            if len(texts) >= least and size:
                sims = np.round(stored[: len(texts)] @ (v / size), 12)
                k = int(sims.argmax())
                hit = texts[k] if sims[k] >= threshold else None
            if hit is None and row.confidence >= least_confidence:
                if not texts:
                    stored = np.zeros((64, len(v)))
                elif len(texts) == len(stored):  # twice as large at a time, so that a session costs no copy for each vector
                    stored = np.concatenate((stored, np.zeros_like(stored)))
                stored[len(texts)] = v / size if size else v
                texts.append(row.text)
            out.append((row.session, row.ord, row.text if hit is None else hit, hit is not None))
        return type(pdf)(out, columns=["session", "ord", "text", "hit"])

    kinds = dict(reads.dtypes)
    return reads.groupBy("session").applyInPandas(run, f"session {kinds['session']}, ord {kinds['ord']}, text string, hit boolean")

"""Operator 5: quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes that cover its whole text. A passage is encoded
as the histogram of its bytes, of its hashed byte pairs and of bytes that repeat at short
distances, and a layer of tanh units. Gated
attention (Ilse et al., 2018) weighs passages, weights learnt from the document labels alone; the
weighted passage representation gives the score through a logistic unit.

The model is fitted on the driver to at most ``SAMPLE`` labelled documents, those with the
least hashes of doc_id and text among the rows whose crc32 of doc_id isn't divisible by 5. They are taken in that order, but for
those that would bring the sample beyond ``SAMPLE_PASSAGES`` passages (of 2 kB each, as halves of floats), so that its memory is
bounded too. Every passage of the sample trains; histograms are made on the executors. Scores use all passages of all documents, a block of
``BLOCK`` passages at a time with a running softmax, so that memory doesn't grow with a text. No shuffle but for the labels
(a row each) and the sample. The model is broadcast as plain arrays: its size is fixed.

Only the text is an input of a score. Training is seeded, so the same rows give the same model.

Cases: a null or empty text is a bag of one empty passage. Labels that are null or neither 0 nor
1, or whose document is missing, are left out; a document with several labels counts once, by
the least one. With labels of one class only, or none, every score is that class's share (0.5
without labels). Repeated rows get equal scores. Empty tables give no rows. Columns other
than doc_id, text and the label's are ignored. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried_schema, column, portions, utf8, with_carried, with_rest

PASSAGE = 512
#: Features of a passage: 256 bytes, byte pairs by a hash, and bytes equal to the one 1, 2, ... before (at its place 0 the largest of those from 3 on).
FEATURES, LAGS = 1024, 32
HIDDEN, GATE = 24, 12
#: Bounds of the sample that the model is fitted to: documents, and their passages.
SAMPLE, SAMPLE_PASSAGES = 4000, 65_536
#: Passages that are scored at a time.
BLOCK = 1024
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 64, 0.003, 1e-4, 17
THRESHOLD = 0.3


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether crc32 of the id as text leaves the remainder 0; a null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def passages(text: bytes | None, first: int = 0, after: int | None = None) -> np.ndarray:
    """A row of features for each passage, or each from ``first`` to ``after``: square roots of shares."""
    size = len(text or b"")
    n = max(1, -(-size // PASSAGE))
    after = n if after is None else min(after, n)
    start, stop = first * PASSAGE, min(after * PASSAGE, size)
    rows = np.zeros((after - first, FEATURES))
    if size:
        lead = min(start, LAGS)
        # with the bytes before, which lags look back to, and the one after, which the last pair ends with
        b = np.frombuffer(text, np.uint8, min(stop + 1, size) - (start - lead), start - lead).astype(np.int64)
        own = b[lead : lead + stop - start]
        at = np.arange(len(own)) // PASSAGE * FEATURES
        follow = b[lead + 1 : lead + 1 + len(own)]
        pair = 256 + (own[: len(follow)] * 167 + follow * 241) % (FEATURES - 256 - LAGS)
        flat = np.bincount(at + own, minlength=rows.size) + np.bincount(at[: len(follow)] + pair, minlength=rows.size)
        rows = flat.astype(np.float64).reshape(rows.shape)
        starts = np.arange(len(rows)) * PASSAGE
        for lag in range(1, LAGS):
            same = np.zeros(len(own), np.int32)
            skip = max(0, lag - lead)  # nothing lies before the text
            if skip < len(own):
                same[skip:] = own[skip:] == b[lead - lag + skip : lead - lag + len(own)]
            rows[:, FEATURES - LAGS + lag] = np.add.reduceat(same, starts)
        rows[:, FEATURES - LAGS] = rows[:, FEATURES - LAGS + 3 :].max(1)
        sizes = np.full(len(rows), PASSAGE)
        sizes[-1] = len(own) - starts[-1]
        rows /= sizes[:, None]
    return np.sqrt(rows).astype(np.float32)


def passage_blocks(text: bytes | None, size: int = BLOCK) -> Iterator[np.ndarray]:
    """The features of all passages, so many at a time."""
    n = max(1, -(-len(text or b"") // PASSAGE))
    for first in range(0, n, size):
        yield passages(text, first, first + size)


class Model:
    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {
            "encode": normal(FEATURES, HIDDEN), "shift": np.zeros(HIDDEN, np.float32), "v": normal(HIDDEN, GATE), "u": normal(HIDDEN, GATE),
            "attend": normal(GATE), "out": normal(HIDDEN), "bias": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def plain(self) -> tuple[dict[str, np.ndarray], float | None]:
        """What a broadcast carries: nothing that a worker would need this package to read."""
        return self.w, self.constant

    @classmethod
    def of(cls, plain: tuple[dict[str, np.ndarray], float | None]) -> Model:
        out = cls.__new__(cls)
        out.w, out.constant = plain
        return out

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Bags of rows that begin at starts."""
        w, sizes = self.w, np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ w["encode"] + w["shift"])
        t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (t * s) @ w["attend"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-(z @ w["out"] + w["bias"]))), "sizes": sizes}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(x, starts)
        d = ((f["p"] - y) / len(y)).astype(np.float32)
        dz = np.repeat(d[:, None] * w["out"], f["sizes"], axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["sizes"]))
        dts = de[:, None] * w["attend"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ w["v"].T + ds @ w["u"].T) * (1 - f["h"] ** 2)
        return {
            "encode": x.T @ dh, "shift": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ ds,
            "attend": (f["t"] * f["s"]).T @ de, "out": f["z"].T @ d, "bias": d.sum(keepdims=True),
        }

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return self
        rng, step = np.random.default_rng(seed), 0
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                sizes = np.array([len(bags[k]) for k in own])
                g = self.gradients(np.concatenate([bags[k] for k in own]).astype(np.float32), np.cumsum(sizes) - sizes, y[own])
                step += 1
                for k, w in self.w.items():
                    mean[k] += 0.1 * (g[k] - mean[k])
                    square[k] += 0.001 * (g[k] ** 2 - square[k])
                    w -= RATE * (mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8) + DECAY * w)
        return self

    def score(self, text: bytes | None) -> float:
        if self.constant is not None:
            return self.constant
        w, most, total, z = self.w, -np.inf, 0.0, np.zeros(HIDDEN)
        for x in passage_blocks(text):
            h = np.tanh(x @ w["encode"] + w["shift"])
            e = (np.tanh(h @ w["v"]) * (1 / (1 + np.exp(-(h @ w["u"]))))) @ w["attend"]
            now = max(most, float(e.max()))
            weights, before = np.exp(e - now), np.exp(most - now)
            total, z, most = total * before + float(weights.sum(dtype=np.float64)), z * before + weights.astype(np.float64) @ h, now
        return float(1 / (1 + np.exp(-(z / total @ w["out"] + w["bias"][0]))))


def usable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y): one label of 0 or 1 for each document."""
    own = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("double").alias("y"))
    return own.where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("y").cast("int").alias("y"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, sample: int = SAMPLE, sample_passages: int = SAMPLE_PASSAGES) -> Model:
    """Fit to at most ``sample`` labelled documents outside the held-out part, of at most ``sample_passages`` passages in all."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, most_rows=64, most_bytes=1 << 20):
                bags = [b"".join(x.astype(np.float16).tobytes() for x in passage_blocks(text)) for text in utf8(column(part, "text"))]
                yield pa.RecordBatch.from_arrays([column(part, "order"), column(part, "doc_id"), column(part, "y"), pa.array(bags, pa.binary())], names=["order", "doc_id", "y", "bag"])

    own = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE)).cast("long")
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(~held_out(F.col("doc_id"), parts)).withColumn("order", F.xxhash64("doc_id", "text"))
    known = texts.select("doc_id", "order", own.alias("n")).join(usable(labels, label), "doc_id").distinct()
    chosen, room = [], sample_passages
    for r in known.orderBy("order", "doc_id").limit(sample).collect():  # top-k in every task, then one of them: at most ``sample`` rows
        if r["n"] <= room:
            chosen.append((r["doc_id"], r["order"], r["y"]))
            room -= r["n"]
    if not chosen:
        return Model().fit([], np.zeros(0, np.float32))
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id bigint, order bigint, y int"))
    texts = texts.join(picked, ["doc_id", "order"]).select("order", "doc_id", "y", "text").dropDuplicates(["order", "doc_id"])
    rows = texts.mapInArrow(encode, "order bigint, doc_id bigint, y int, bag binary").collect()  # at most sample_passages passages
    rows.sort(key=lambda r: (r["order"], r["doc_id"]))
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, FEATURES) for r in rows]
    return Model().fit(bags, np.array([r["y"] for r in rows], np.float32))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """Per document: doc_id, score (the probability of label 1) and predicted, by the threshold.

    carry: take the text and the other columns along (see ``common.restored``), so that no join has to.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.of(shared.value)
        for batch in batches:
            for part in portions(batch):
                found = [own.score(t) for t in utf8(column(part, "text"))]
                yield with_carried([column(part, "doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"], part)

    texts = with_rest(docs, carry)
    scored = texts.mapInArrow(run, carried_schema("doc_id bigint, score double", texts))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

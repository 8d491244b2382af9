"""Connected components over links between integer ids, all in DataFrame operations.

Alternating large-star and small-star rounds (Kiveris et al., 2014): every round replaces a
node's links by links to its least neighbour, until nothing changes. Hubs cost one partial
minimum each; no neighbour list is ever gathered, and no links reach the driver. Each round
ends with a checkpoint in the shared folder. As soon as at most ``MOST_LINKS`` are left, one task
reads them from that checkpoint and joins them up: a round has some eight exchanges, whose files and
tasks take more disk and time than so few links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, halved

#: Links that one task joins up at the most (16 MB, and some copies of them); more of them take rounds of exchanges.
MOST_LINKS = 1_000_000


class Labels:
    """Union-find over whole arrays."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        of = self.of
        while len(a):
            a, b = of[a], of[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(of, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = of[of]
                if np.array_equal(up, of):
                    break
                of[:] = up


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b) at once to (a, b) with the least id of a's component."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    ids, at = np.unique(np.concatenate([batch.column(k).to_numpy() for k in (0, 1) for batch in held]), return_inverse=True)
    labels = Labels(len(ids))  # places in ascending ids, so that the least place is the least id
    labels.unite(*at.reshape(2, -1))
    apart = np.flatnonzero(labels.of != np.arange(len(ids)))
    for k in range(0, len(apart), 1 << 16):
        some = apart[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[labels.of[some]])], names=["a", "b"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: distinct (a, b) with a > b. Large: a node's greater neighbours; small: it and its lesser ones."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u", halved("u")).agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u")
    out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame, most_rounds: int = 60, most_links: int = MOST_LINKS) -> DataFrame:
    """links (a, b) of bigint: rows (id, component_id) for every linked id that isn't its component's least one.

    Links with a null or to themselves count for nothing; repeated ones count once.
    """
    state = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = lambda df: tuple(df.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = print_of(state)
    for _ in range(most_rounds):
        if before[0] <= most_links:
            state = checkpointed(state.coalesce(1).mapInArrow(_joined, "a bigint, b bigint")) if before[0] else state
            break
        # small stars first: where a node has several links, they become one of its own and few between those that it was linked to
        state = checkpointed(_star(_star(state, False), True))
        now = print_of(state)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return state.select(F.col("a").alias("id"), F.col("b").alias("component_id"))

"""Operator 8: removal of passages that an earlier document already has, by suffix automata.

The reference of each document is all documents with a smaller doc_id, so whole reference shards
have no bound on their size and can't be broadcast. The shards are cut by content instead, and
only text that may repeat travels to them:

0. Whole texts that an earlier document has, word for word, are settled by a digest: all their windows are
   covered, and the first of the equal texts stands for them as reference.
1. Every window (``window`` words) has an anchor: the least hash of its 4-word grams. Equal windows
   have equal anchors, wherever they stand. Anchors are counted by a partial aggregate.
2. Anchors of two or more documents go back to their documents (a sort-merge join, whose hot keys
   Spark can split), where runs of windows with one such anchor are cut out as fragments. Within a
   batch equal fragments travel once, for the least doc_id; the others are settled there.
3. A shard is the fragments of one anchor. They arrive in ascending doc_id, stream past the
   shard's automaton, which tells for every window the least doc_id that has it, and extend it.
   Anchors of more than ``hot`` documents, whose fragments differ around a common passage, send
   single windows to shards by the window's own hash, so that no shard grows with such a passage.
4. The covered windows return to their documents. Texts move once: all joins by doc_id share an exchange.

Hashes only choose where windows meet; words are compared as they are.

Cases: a null or empty text has no words. Rows that share a doc_id aren't earlier than one
another, so they keep what they share only with each other. A null doc_id is neither a reference nor
changed. Empty tables give no rows. Columns other than doc_id and text are ignored. Texts are
never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried_schema, checkpointed, column, halved, portions, utf8, with_carried, with_rest
from .suffix_automaton import SuffixAutomaton

WINDOW = 13
GRAM = 4
#: Documents of one anchor from which its windows are dealt out one by one.
HOT = 2000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def window_anchors(words: list[bytes], window: int) -> np.ndarray:
    """The anchor of the window that starts at each word; even numbers, signed."""
    gram = min(GRAM, window)
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    grams = len(words) - gram + 1
    g = h[:grams] * _ODD[0]
    for k in range(1, gram):
        g += h[k : k + grams] * _ODD[k]
    g = _mixed(g)
    # least of window - gram + 1 grams in a row, by doubling
    size, span = 1, window - gram + 1
    while size < span:
        step = min(size, span - size)
        g = np.minimum(g[:-step], g[step:])
        size += step
    return g.view(np.int64) & ~np.int64(1)


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id) for each anchor of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            found, ids, many = [], [], 0
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), utf8(column(batch, "text")), strict=True):
                own = np.unique(window_anchors(text.split() if text else [], window))
                if len(own):
                    found.append(own)
                    ids.append(np.full(len(own), doc_id))
                    many += len(own)
                if many > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(ids))], names=["anchor", "doc_id"])
                    found, ids, many = [], [], 0
            if many:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(ids))], names=["anchor", "doc_id"])

    return docs.mapInArrow(run, "anchor bigint, doc_id bigint")  # all columns: a narrower exchange would be another one


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal numbers."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cuts)), np.append(cuts, len(keys))


FRAGMENTS = pa.schema([("route", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int32()), ("many", pa.int32()), ("words", pa.binary())])
FRAGMENTS_DDL = "route bigint, doc_id bigint, text_hash bigint, first int, many int, words binary"
COVERED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int32()), ("many", pa.int32())])


def fragments(texts: DataFrame, window: int) -> DataFrame:
    """Fragments to be judged in the shard of their route; words is null for windows that are settled already.

    texts: doc_id, text, text_hash, repeated: the anchors that other documents may share, odd if they are hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut: list[tuple[int, int, int, int, int, bytes]] = []
            least: dict[tuple[int, bytes], int] = {}
            lists = column(batch, "repeated")
            for k, (doc_id, text, text_hash) in enumerate(zip(column(batch, "doc_id").to_pylist(), utf8(column(batch, "text")), column(batch, "text_hash").to_pylist(), strict=True)):
                words = text.split() if text else []
                own = window_anchors(words, window)
                if not len(own):
                    continue
                marks = np.sort(lists[k].values.to_numpy(zero_copy_only=False))
                plain = marks & ~np.int64(1)
                at = np.minimum(np.searchsorted(plain, own), len(plain) - 1)
                hit = plain[at] == own
                hot = hit & (marks[at] != own)
                # a key for runs: the anchor if it may repeat, else an odd number that no anchor has
                starts, ends = _runs(np.where(hit, own, 1))
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    if not hit[a]:
                        continue
                    anchor = int(own[a])
                    pieces = [(i, i + 1) for i in range(a, b)] if hot[a] else [(a, b)]
                    for x, y in pieces:
                        piece = b" ".join(words[x : y + window - 1])
                        route = xxhash.xxh64_intdigest(piece, 1) - (1 << 63) if hot[a] else anchor
                        cut.append((route, doc_id, text_hash, x, y - x, piece))
                        key = (route, piece)
                        if doc_id < least.get(key, doc_id + 1):
                            least[key] = doc_id
            out: list[tuple[int, int, int, int, int, bytes | None]] = []
            for route, doc_id, text_hash, first, many, piece in cut:
                if least[(route, piece)] == doc_id:
                    out.append((route, doc_id, text_hash, first, many, piece))
                elif out and out[-1][5] is None and out[-1][1:3] == (doc_id, text_hash) and out[-1][3] + out[-1][4] == first:
                    out[-1] = (*out[-1][:4], out[-1][4] + many, None)
                else:  # settled here: dealt out by a hash of its own
                    out.append((hash((doc_id, first)), doc_id, text_hash, first, many, None))
            for at in range(0, len(out), 50_000):
                columns = zip(*out[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FRAGMENTS, strict=True)], schema=FRAGMENTS)

    return texts.mapInArrow(run, FRAGMENTS_DDL)


class Shard:
    """The fragments of one route, in ascending doc_id."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.seen: dict[bytes, int] = {}
        self.waiting: list[tuple[bytes, int]] = []
        self.automaton: SuffixAutomaton | None = None

    def covered(self, piece: bytes, doc_id: int, many: int) -> list[tuple[int, int]]:
        """Runs of windows (first, after) that a smaller doc_id has; the fragment then joins the reference."""
        first = self.seen.get(piece)
        if first is not None and first < doc_id:
            return [(0, many)]
        out: list[tuple[int, int]] = []
        if first is None:
            self.seen[piece] = doc_id
        if len(self.seen) > 1:
            words = piece.split()
            if self.automaton is None:
                self.automaton = SuffixAutomaton()
            for old, tag in self.waiting:
                self.automaton.add(old.split(), tag)
            self.waiting.clear()
            out = self._query(words, doc_id)
        if first is None:
            self.waiting.append((piece, doc_id))
        return out

    def _query(self, words: list[bytes], doc_id: int) -> list[tuple[int, int]]:
        auto, window = self.automaton, self.window
        state = matched = 0
        out: list[tuple[int, int]] = []
        for end, word in enumerate(words):
            state, matched = auto.shorten(*auto.step(state, matched, word), window)
            if matched >= window and auto.first[state] < doc_id:
                at = end - window + 1
                if out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + 1)
                else:
                    out.append((at, at + 1))
        return out


def covered_windows(cut: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, first, many): runs of windows that an earlier document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, shard = None, Shard(window)
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for r, doc_id, text_hash, first, many, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece is None:
                    rows.append((doc_id, text_hash, first, many))
                    continue
                if r != route:
                    route, shard = r, Shard(window)
                rows += [(doc_id, text_hash, first + a, b - a) for a, b in shard.covered(piece, doc_id, many)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COVERED, strict=True)], schema=COVERED)

    ordered = cut.repartition("route").sortWithinPartitions("route", "doc_id").select("route", "doc_id", "text_hash", "first", "many", "words")
    return ordered.mapInArrow(run, "doc_id bigint, text_hash bigint, first int, many int")


SPANS = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<first:int,after:int>>"


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            lists, hashes, copies = column(batch, "covered"), column(batch, "text_hash").to_pylist(), column(batch, "copy").to_pylist()
            counts, removed, kept, spans = [], [], [], []
            for k, text in enumerate(utf8(column(batch, "text"))):
                words = text.split() if text else []
                runs: list[tuple[int, int]] = []
                if copies[k]:
                    runs = [(0, len(words))] if len(words) >= window else []
                elif lists[k].is_valid:
                    for row in sorted((x["first"], x["many"]) for x in lists[k].as_py() if x["text_hash"] == hashes[k]):
                        a, b = row[0], row[0] + row[1] + window - 1
                        if runs and a <= runs[-1][1]:
                            runs[-1] = (runs[-1][0], max(runs[-1][1], b))
                        else:
                            runs.append((a, b))
                left, at = [], 0
                for a, b in runs:
                    left += words[at:a]
                    at = b
                left += words[at:]
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
                spans.append([{"first": a, "after": b} for a, b in runs])
            columns = [column(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, SPANS)]
            yield with_carried(columns, ["doc_id", "n_words", "n_removed", "kept", "spans"], batch)

    return run


def copied_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, copied): hashes of the texts of a document that a smaller doc_id has as well; few rows, each small."""
    same = F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))
    digests = texts.where("text is not null").select("doc_id", "text_hash", same.alias("same"))
    first = digests.groupBy("same", halved("same")).agg(F.min("doc_id").alias("first"), F.count("same").alias("n")).where("n > 1").select("same", "first")
    return checkpointed(digests.join(first, "same").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("text_hash").alias("copied")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, carry: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (its other words, joined by a space), spans of removed words.

    carry: take the text and the other columns along (see ``common.restored``), so that no join has to.
    """
    whole = with_rest(docs, carry).withColumn("text_hash", F.xxhash64("text"))
    own = [c for c in whole.columns if c != "text_hash"]
    # the same rows and columns in all joins, or else they would not share their exchange
    texts = whole.where("doc_id is not null")
    texts = texts.join(copied_texts(texts), "doc_id", "left").select(*own, "text_hash", F.coalesce(F.array_contains("copied", F.col("text_hash")), F.lit(False)).alias("copy"))
    found = anchors(texts.where("not copy"), window)
    repeated = found.groupBy("anchor", halved("anchor")).agg(F.count("anchor").alias("n")).where("n > 1").select("anchor", "n")
    marks = (
        found.join(repeated, "anchor")
        .select("doc_id", F.when(F.col("n") > hot, F.col("anchor").bitwiseOR(F.lit(1).cast("long"))).otherwise(F.col("anchor")).alias("mark"))
        .groupBy("doc_id")
        .agg(F.collect_list("mark").alias("repeated"))
    )
    cut = fragments(texts.where("not copy").join(marks, "doc_id"), window)
    covered = covered_windows(cut, window).groupBy("doc_id").agg(F.collect_list(F.struct("text_hash", "first", "many")).alias("covered"))
    last = texts.join(covered, "doc_id", "left").select(*own, "text_hash", "copy", "covered")
    nothing = F.lit(None).cast("array<struct<text_hash:bigint,first:int,many:int>>")
    unnamed = whole.where("doc_id is null").select(*own, "text_hash", F.lit(False).alias("copy"), nothing.alias("covered"))
    return last.union(unnamed).mapInArrow(_kept(window), carried_schema(RESULT, whole))

"""Operator 10: byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is cut into words by the vocabulary's pattern. Each distinct word of a task is encoded
once: its bytes are merged in order of rank until no neighbours have one (long words with a
heap, so that a megabyte without a space takes n log n steps). Decoding concatenates the bytes
of the ids. No shuffle and no state beyond a bounded memo of words in each task.

``fold_words`` is the same fold as Spark higher-order functions over a literal rank map. It
can't carry the whole tables within the check's limits (see README), so ``encode`` folds in
Python workers.

Cases: a null or empty text has no ids and decodes to no bytes. Repeated rows give equal rows,
an empty table none. Columns other than doc_id and text are ignored. Texts are never cut.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, portions

#: Words kept in a task's memo before it starts again.
MEMO = 400_000
#: Above every rank: neighbours that don't merge.
NONE = 1 << 40
#: From so many bytes on, a word is merged with a heap.
LONG = 48
#: White space as the tiktoken library's pattern engine takes it (a fixed set of Unicode).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def compiled(pattern: str) -> regex.Pattern:
    """The word pattern with white space spelled out, as engines differ in it."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    scores = [get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while scores and (best := min(scores)) != NONE:
        i = scores.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = get(parts[i] + parts[i + 1], NONE)
        if i:
            scores[i - 1] = get(parts[i - 1] + parts[i], NONE)
    return parts


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The leftmost pair of least rank first, as above, in n log n steps."""
    n, get = len(word), ranks.get
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, mid, to = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or mid >= n or end[mid] != to:
            continue
        alive[mid], end[i], after[i] = False, to, after[mid]
        if to < n:
            before[to] = i
            if (r := get(word[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, to, end[to]))
        if (p := before[i]) >= 0 and (r := get(word[p:to])) is not None:
            heapq.heappush(heap, (r, p, i, to))
    return [word[i : end[i]] for i in range(n) if alive[i]]


class Encoder:
    """Texts to ids packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO) -> None:
        self.ranks, self.find, self.most = ranks, compiled(pattern).findall, memo
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.memo: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        raw = word.encode()
        whole = self.packed.get(raw)
        if whole is not None:
            return whole
        return b"".join(map(self.packed.__getitem__, (merge_short if len(raw) < LONG else merge_long)(raw, self.ranks)))

    def encode(self, text: str) -> bytes:
        memo, words = self.memo, self.find(text)
        for w in set(words).difference(memo):
            memo[w] = self.word(w)
        ids = b"".join(map(memo.__getitem__, words))
        if len(memo) > self.most:
            memo.clear()
        return ids


class Decoder:
    """Packed ids to the concatenation of their binary pieces."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.pieces = pieces

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _task(path: str, pattern: str, decode: bool):
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    schema = pa.schema([*fields, ("decoded", pa.binary())] if decode else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        encoder, decoder = Encoder(ranks, pattern), Decoder(ranks)
        for batch in batches:
            for part in portions(batch):  # few documents at a time bound the output
                ids = [encoder.encode(t) if t else b"" for t in column(part, "text").to_pylist()]
                columns = [column(part, "doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([decoder.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def encode(docs: DataFrame, path: str, pattern: str, decode: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and the bytes decoded from them.

    path: a file of base64 tokens and ranks, present on every executor.
    """
    ddl = "doc_id bigint, n_tokens bigint, ids binary" + ", decoded binary" * decode
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_task(path, pattern, decode), ddl)


def rank_map(ranks: dict[bytes, int], buckets: int = 4096) -> Column:
    """A literal rank map: an array of small maps, as a lookup in one Spark map reads all its keys."""
    import json
    import zlib

    table: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in ranks.items():
        table[zlib.crc32(token.hex().encode()) % buckets][token.hex()] = rank
    return F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")


def fold_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word", buckets: int = 4096) -> DataFrame:
    """Add ``ids array<int>`` to a table of distinct words, with higher-order functions only."""
    table = rank_map(ranks, buckets)

    def rank(token: Column) -> Column:
        return F.try_element_at(F.get(table, F.pmod(F.crc32(token.cast("binary")), F.lit(buckets)).cast("int")), token)

    raw = F.hex(F.encode(F.col(word), "UTF-8"))
    pieces = F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda i: F.lower(F.substring(raw, i, F.lit(2))))
    parts = F.when(F.length(raw) > 1, pieces).otherwise(F.array().cast("array<string>"))

    def merge(parts: Column, _: Column) -> Column:
        pairs = F.zip_with(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, F.lit(2), F.size(parts)), lambda a, b: rank(F.concat(a, b)))
        at = F.array_position(pairs, F.array_min(pairs)).cast("int")
        merged = F.concat(F.slice(parts, F.lit(1), at - 1), F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))), F.slice(parts, at + 2, F.size(parts)))
        return F.when((F.size(parts) < 2) | F.coalesce(at, F.lit(0)).eqNullSafe(0), parts).otherwise(merged)

    folded = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size("_parts"), F.lit(2))), F.col("_parts"), merge)
    return words.withColumn("_parts", parts).withColumn("ids", F.transform(folded, rank)).drop("_parts")

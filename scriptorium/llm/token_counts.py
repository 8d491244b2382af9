"""Operator 2: token counts of sections, attributed from one encoding of the whole document.

A document is encoded once. Token ends in bytes come from the tokens' own lengths, so nothing is
encoded again for a section; an interval join of sorted token spans and sorted section spans
(two binary searches per section) gives each section its tokens. A token that crosses a boundary
is given out by an explicit rule:

``start``     to the section that holds its first byte,
``majority``  to the section that holds most of its bytes, the earlier one of equals,
``split``     to each section by its share of the bytes.

By any rule the counts of a document's sections sum to the document's count. Sections here are
its lines, each with its line feed; other spans can be passed as a column. No shuffle.

Cases: a null or empty text has one empty section without tokens. Repeated rows give equal rows,
an empty table none. Columns other than doc_id and text are ignored. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, read_ranks
from .common import column, portions

RULES = ("start", "majority", "split")


def line_ends(raw: bytes) -> np.ndarray:
    """Where the lines end, in bytes; the last one at the end of the text."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary. Sections cover the text in order."""
    starts = np.concatenate(([0], token_ends[:-1])).astype(np.int64) if len(token_ends) else np.empty(0, np.int64)
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends, "left")
    crossing = np.flatnonzero(first != last)
    counts = np.bincount(first, minlength=len(section_ends)).astype(np.float64)
    if rule != "start":
        for t in crossing.tolist():
            a, b = int(first[t]), int(last[t])
            edges = np.concatenate(([starts[t]], section_ends[a:b], [token_ends[t]]))
            share = np.diff(edges)
            counts[a] -= 1
            if rule == "majority":
                counts[a + int(share.argmax())] += 1
            else:
                counts[a : b + 1] += share / share.sum()
    return counts, len(crossing)


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("section", pa.int32()), ("first_char", pa.int64()), ("after_char", pa.int64()), ("n_tokens", pa.float64()), ("doc_tokens", pa.int64()), ("crossing", pa.int64())]
)


def section_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "start") -> DataFrame:
    """A row for each line of each document: its span in code points, its tokens, the document's tokens and crossings."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        encoder = Encoder(ranks, pattern)
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        for batch in batches:
            for part in portions(batch, most_rows=256):
                parts: list[list[np.ndarray]] = [[] for _ in SCHEMA]
                missing: list[np.ndarray] = []
                for doc_id, text in zip(column(part, "doc_id").to_pylist(), column(part, "text").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    ids = np.frombuffer(encoder.encode(text) if text else b"", "<u4")
                    ends = line_ends(raw)
                    counts, crossing = attribute(np.cumsum(lengths[ids]), ends, rule)
                    # code points before each byte offset: bytes that don't continue a code point
                    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))[ends]
                    n = len(ends)
                    values = (np.full(n, doc_id or 0), np.arange(n), np.concatenate(([0], points[:-1])), points, counts, np.full(n, len(ids)), np.full(n, crossing))
                    for held, value in zip(parts, values, strict=True):
                        held.append(value)
                    missing.append(np.full(n, doc_id is None))
                columns = [pa.array(np.concatenate(held), field.type, mask=np.concatenate(missing) if k == 0 else None) for k, (held, field) in enumerate(zip(parts, SCHEMA, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=SCHEMA)

    ddl = "doc_id bigint, section int, first_char bigint, after_char bigint, n_tokens double, doc_tokens bigint, crossing bigint"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)

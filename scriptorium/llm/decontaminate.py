"""Operator 7: benchmark decontamination with a generalised suffix automaton.

The normalised items form automata of a bounded number of words each; documents stream past
every automaton, which tracks the longest match that ends at each word. A document word is hit
if it lies inside an occurrence of a window (``window`` consecutive words of one item, or a
whole item of fewer words). ``without_spans`` takes what is hit out of the texts.

Items of equal words are one sequence with several ids. The automata are built on the driver, one at a time, and broadcast as
flat arrays: a shard of ``SHARD_WORDS`` words has at most twice as many states and three times as many edges (Blumer et
al., 1985), about 100 bytes a word at the most, besides its vocabulary and ids (25 MB). A pass over the documents takes ``PASS_SHARDS``
of them; with a larger benchmark the documents pass again, with a checkpoint between. Documents aren't shuffled.

Cases: a null or empty text has no words, no hits and isn't contaminated. An item without
words has no windows. Items that share an item_id count once; a null item_id counts as the
empty string. Items of equal words are found together. Repeated documents are judged row by row. Empty tables give no rows, or no hits.
Columns other than doc_id, text and item_id are ignored. Texts are never cut.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried_schema, checkpointed, column, portions, utf8, with_carried, with_rest
from .suffix_automaton import SuffixAutomaton

WINDOW = 13
#: Words of items in one automaton, and automata that documents pass at a time.
SHARD_WORDS, PASS_SHARDS = 250_000, 4
#: A-Z to a-z; whatever isn't a digit, a letter or beyond ASCII to a space.
NORMAL = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whatever NORMAL makes a space of.
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def _lists(pairs: list[tuple[int, int]], states: int) -> tuple[np.ndarray, np.ndarray]:
    """Values by state: where each state's begin, and all values in order of their states."""
    own = np.array(sorted(set(pairs)), np.int32).reshape(-1, 2)
    return np.searchsorted(own[:, 0], np.arange(states + 1)).astype(np.int32), own[:, 1].copy()


def flat_windows(items: list[tuple[list[bytes], list[str]]], window: int = WINDOW) -> dict:
    """The windows of (words, ids of the items that have them) as plain arrays, to be broadcast."""
    vocabulary: dict[bytes, int] = {}
    auto, coded, least = SuffixAutomaton(), [], window
    for item, _ in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in item]
        coded.append(ids)
        auto.add(ids)
        least = min(least, len(ids))
    long, short = [], []
    for k, ids in enumerate(coded):
        state = matched = 0
        for x in ids:
            state, matched = auto.shorten(*auto.step(state, matched, x), window)
            if matched >= window:
                long.append((state, k))
        if len(ids) < window:
            short.append((state, k))
    states = len(auto.length)
    ends = {state for state, _ in short}
    # the nearest state on the way to the root that ends a short item
    nearest = np.zeros(states, np.int32)
    for state in sorted(range(1, states), key=auto.length.__getitem__):
        nearest[state] = state if state in ends else nearest[auto.link[state]]
    edges = np.array([(s << 32 | w, t) for s, out in enumerate(auto.next) for w, t in out.items()], np.int64).reshape(-1, 2)
    edges = edges[np.argsort(edges[:, 0])]
    # most states have one edge: it's held beside the state, the others are looked up
    source = edges[:, 0] >> 32
    single = np.bincount(source, minlength=states)[source] == 1
    word, to = np.full(states, -1, np.int32), np.zeros(states, np.int32)
    word[source[single]], to[source[single]] = edges[single, 0] & 0xFFFFFFFF, edges[single, 1]
    return {
        "window": window, "least": least, "vocabulary": vocabulary, "names": [names for _, names in items], "sizes": np.array([len(c) for c in coded], np.int32),
        "link": np.array(auto.link, np.int32), "length": np.array(auto.length, np.int32), "word": word, "to": to,
        "keys": edges[~single, 0].copy(), "targets": edges[~single, 1].astype(np.int32), "nearest": nearest, "long": _lists(long, states), "short": _lists(short, states),
    }


class Windows:
    """The windows of a set of items, found in documents through a suffix automaton."""

    def __init__(self, flat: dict) -> None:
        self.window, self.least, self.vocabulary, self.names = flat["window"], flat["least"], flat["vocabulary"], flat["names"]
        # Python's own arrays: the quickest to read one number at a time from
        self.link, self.length, self.word, self.to, self.targets, self.nearest, self.sizes = (array("i", flat[c].tobytes()) for c in ("link", "length", "word", "to", "targets", "nearest", "sizes"))
        self.keys = array("q", flat["keys"].tobytes())
        self.long, self.short = (tuple(array("i", x.tobytes()) for x in flat[c]) for c in ("long", "short"))

    def _step(self, state: int, matched: int, x: int) -> tuple[int, int]:
        """The state and the length of the longest match of at most ``window`` words that ends at this word."""
        while True:
            if self.word[state] == x:
                state, matched = self.to[state], matched + 1
                break
            if self.word[state] < 0:
                at = bisect_left(self.keys, key := state << 32 | x)
                if at < len(self.keys) and self.keys[at] == key:
                    state, matched = self.targets[at], matched + 1
                    break
            if not state:
                return 0, 0
            state = self.link[state]
            matched = self.length[state]
        while state and self.length[self.link[state]] >= self.window:
            state = self.link[state]
            matched = self.length[state]
        return state, matched

    def find(self, doc: list[bytes], spans: list[tuple[int, int]], items: set[str]) -> None:
        """Add the hit spans (first word, word after the last) and the items of one document."""
        if len(doc) < self.least:
            return
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in doc), np.int64, len(doc))
        # only runs of words that items have, as long as the shortest window, can hold one
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.least:
                self._run(ids[a:b].tolist(), a, spans, items)

    def _run(self, ids: list[int], at: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        window, names = self.window, self.names
        (starts, own), (short_starts, short) = self.long, self.short
        state = matched = 0
        for end, x in enumerate(ids, at + 1):
            state, matched = self._step(state, matched, x)
            hit = 0
            if matched >= window:
                hit = window
                for k in own[starts[state] : starts[state + 1]]:
                    items.update(names[k])
            near = self.nearest[state]
            while near:
                for k in short[short_starts[near] : short_starts[near + 1]]:
                    if self.sizes[k] <= matched:
                        hit = max(hit, self.sizes[k])
                        items.update(names[k])
                near = self.nearest[self.link[near]]
            if hit:
                start = end - hit
                while spans and spans[-1][1] >= start and spans[-1][1] <= end and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], end))
                else:
                    spans.append((start, end))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
DDL = "doc_id bigint, text string, n_words bigint, spans array<struct<first:int,after:int>>, items array<string>"


def scanner(shared: list, again: bool):
    """A task that adds the hits of some automata; again: to those of the automata before."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Windows(s.value) for s in shared]
        for batch in (part for whole in batches for part in portions(whole)):
            counts, all_spans, all_items = [], [], []
            before = zip(column(batch, "spans").to_pylist(), column(batch, "items").to_pylist(), strict=True) if again else None
            for text in utf8(column(batch, "text")):
                spans, items = [], set()
                if before:
                    old, names = next(before)
                    spans, items = [(s["first"], s["after"]) for s in old], set(names)
                doc = words(text)
                for windows in automata:
                    own: list[tuple[int, int]] = []
                    windows.find(doc, own, items)
                    spans += own
                counts.append(len(doc))
                all_spans.append([{"first": a, "after": b} for a, b in merged(spans)])
                all_items.append(sorted(items))
            columns = [column(batch, "doc_id"), column(batch, "text"), pa.array(counts, pa.int64()), pa.array(all_spans, SPANS), pa.array(all_items, pa.list_(pa.string()))]
            yield with_carried(columns, ["doc_id", "text", "n_words", "spans", "items"], batch)

    return scan


def _shards(items: DataFrame, window: int, shard_words: int) -> Iterator[dict]:
    """Automata of items of at most shard_words words each (or of one longer item), in flat arrays. Only one shard's texts are on the driver at a time."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.trim(F.regexp_replace(F.translate("text", _UPPER, _LOWER), _OTHER, " ")).alias("words"))
    named = named.where("words <> ''").groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("names"))  # an item's ids are as many as its copies
    held, size = [], 0
    for r in named.coalesce(8).toLocalIterator():
        own = r["words"].encode().split(b" ")
        if held and size + len(own) > shard_words:
            yield flat_windows(held, window)
            held, size = [], 0
        held.append((own, r["names"]))
        size += len(own)
    if held:
        yield flat_windows(held, window)


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, pass_shards: int = PASS_SHARDS, carry: bool = False) -> DataFrame:
    """Per document: doc_id, text, n_words, the hit spans of words, and the ids of items with occurring windows.

    carry: take the other columns along (see ``common.restored``), so that no join has to.
    """
    sc = docs.sparkSession.sparkContext
    out = with_rest(docs, carry)
    schema = carried_schema(DDL, out)
    shared, passes = [], 0
    for flat in _shards(items, window, shard_words):
        if len(shared) == pass_shards:
            out = checkpointed(out.mapInArrow(scanner(shared, passes > 0), schema))
            for s in shared:
                s.unpersist()
            shared, passes = [], passes + 1
        shared.append(sc.broadcast(flat))
    return out.mapInArrow(scanner(shared, passes > 0), schema)


def judged(found: DataFrame, percent: int = 5) -> DataFrame:
    """Count the hit words; a document is contaminated from ``percent`` of its words on."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    return found.withColumn("n_hit", hits).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))


def cut(text: bytes | None, spans: list[tuple[int, int]]) -> bytes | None:
    """A text without the bytes from the first to the last word of each span."""
    if not spans or text is None:
        return text
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]  # a byte for a byte
    keep, at = [], 0
    for a, b in spans:
        keep.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*keep, text[at:]])


def without_spans(found: DataFrame, least: int = 1, percent: int = 0) -> DataFrame:
    """Take the hit spans of at least ``least`` words out of the texts of find_windows, where hits cover at least ``percent`` of a document.

    Adds ``clean``: the text as it was outside the spans; null for a null text.
    """
    own = F.filter("spans", lambda s: s["after"] - s["first"] >= least)
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    out = found.withColumn("_cut", F.when(hits * 100 >= F.col("n_words") * percent, own).otherwise(F.array().cast("array<struct<first:int,after:int>>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [cut(t, [(s["first"], s["after"]) for s in spans]) for t, spans in zip(utf8(column(batch, "text")), column(batch, "_cut").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clean, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "clean"])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("clean", T.StringType())])).drop("_cut")

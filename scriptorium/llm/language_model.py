"""Operator 4: n-gram scores from a log-frequency Bloom filter.

1. Documents are dealt to blocks of about ``block_bytes`` by a hash of their content; texts move once. A
   block gives the distinct hashes of its tokens, of its pairs and of its triples of tokens, with their counts in
   training documents (0 for what only its held-out documents have), packed by ranges of the hash space.
2. Each range (about ``RANGE`` n-grams of all blocks) sums its counts. A pair's or triple's count is quantised to levels
   (each the next whole number, or BASE times the one before), and the range's bit array, in proportion to what it holds, takes
   (n-gram, level) for each level up to the count's. Tokens keep exact counts.
3. The levels that a block needs are found by membership probes at level 1, 2, ... up to the first miss,
   once for each distinct n-gram of a range. They go back to the block in the order in which it asked, a byte each, along
   with the exact counts of its tokens and the range's sums, which every block adds up.
4. With low and high as the bounds of a level's counts, S = 1 - n1 / n (the Good-Turing share of n-grams that were seen
   before) and D = n1 / (n1 + 2 n2) for pairs and for triples, n1 and n2 being the numbers of those seen once and twice:
   P1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),
   P2(w | v) = S (max(low(v w) - D, 0) + D P1(w)) / c(v) + (1 - S) P1(w),
   P3(w | u v) = S (max(low(u v w) - D, 0) + D P2(w | v)) / high(u v) + (1 - S) P2(w | v).
   The score sums log10 P3. As low never exceeds a count and high never falls short of one, the probabilities
   of all words after a context sum to at most 1 (but for chance hits of the filter, about 1 in 1,000 n-grams that were never seen).

The filter isn't broadcast: it grows with the corpus and has no bound to broadcast under. Its ranges stay
where they are built, and the documents' n-grams come to them, so that no pass over the corpus depends on the filter's size.
Nothing but the corpus' size in bytes reaches the driver. Blocks x ranges is the number of packets that
are exchanged; for corpora far beyond 10 TB raise ``block_bytes`` and ``range_grams`` as far as workers allow.

Tokens are told apart by 64-bit hashes, longer n-grams by hashes of 13 bits more than the corpus has tokens.
Tokens: words with A-Z lowered, then one end.

Cases: a null or empty text has the end as its only token. Rows that share a doc_id are scored one
by one. A null doc_id belongs to the training part. Without training text, N and V are 0, every
token is unknown, and both scores are those of P1. Empty tables give no rows. Columns other than
doc_id and text are ignored. Texts are never cut.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, utf8, with_long_id

ALPHA = 0.1
#: Base of the quantised logarithm: levels begin at 1, 2, 3, 4, 5, 6, 8, 10, 12, 15, ...
BASE = 1.2
LEVELS = 120
#: Bits and probes for each (n-gram, level).
BITS, PROBES = 16, 6
#: Bytes of text in a block, and n-grams of all blocks in a range of the hash space: what a task holds at a time.
BLOCK_BYTES = 6 << 20
RANGE = 2_000_000
END, START = (np.uint64(xxhash.xxh64_intdigest(t, 7)) for t in (b"\x00end", b"\x00start"))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: The sums of a range: tokens and kinds of them, then pairs, pairs seen once and twice, and triples likewise.
SUMS = 8


def held_out(doc_id: Column, parts: int = 10) -> Column:
    """Whether crc32 of the id as text leaves the remainder 0; a null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the tokens."""
    words = text.lower().split() if text else []
    h = np.empty(len(words) + 1, np.uint64)
    h[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h[-1] = END
    return h


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens of several documents, and where each document's begin."""
    held = [tokens(t) for t in texts]
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    return np.concatenate(held) if held else np.zeros(0, np.uint64), np.cumsum(sizes) - sizes


def ngrams(h: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each token with the one before it, and with the two before it, in its document; of so many bits.

    A document's first token follows the start, and has no triple of its own (its place holds one that counts for nothing).
    """
    shift = np.uint64(64 - bits)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = START
    x = before * _A + h * _B
    x = (x ^ (x >> np.uint64(32))) * _C
    two = x ^ (x >> np.uint64(29))
    y = np.empty_like(two)
    y[1:] = two[:-1]
    y[starts] = 0
    y = y * _B + h * _A
    y = (y ^ (y >> np.uint64(32))) * _C
    return two >> shift, (y ^ (y >> np.uint64(29))) >> shift


def level_edges() -> np.ndarray:
    """The least count of each level from 1 on: a whole number more than the one before, or BASE times it."""
    out = [1]
    while len(out) <= LEVELS:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * BASE))))
    return np.array(out, np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(level_edges(), counts, "right"), LEVELS)


def bounds() -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest count of each level; 0 for level 0, and no bound for the last one."""
    edges = level_edges().astype(np.float64)
    high = edges[1:] - 1
    high[-1] = np.inf
    return np.concatenate(([0.0], edges[:-1])), np.concatenate(([0.0], high))


def _probe(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's first probe at a level, and the step to the next ones; a probe is taken modulo the bits of the array."""
    x = (keys ^ np.uint64(level * 0x2545F4914F6CDD1D & (1 << 64) - 1)) * _A
    x = (x ^ (x >> np.uint64(31))) * _B
    x ^= x >> np.uint64(33)
    return x, (x * _C) | np.uint64(1)


class Filter:
    """The log-frequency Bloom filter of one range."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        levels = levels_of(counts) if len(keys) else np.zeros(0, np.int64)
        self.bits = np.uint64(max(64, -(-int(levels.sum()) * BITS // 64) * 64))
        array = np.zeros(int(self.bits), bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            x, step = _probe(keys[levels >= level], level)
            for _ in range(PROBES):
                array[x % self.bits] = True
                x = x + step
        self.array = np.packbits(array, bitorder="little")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which every probe finds its bit."""
        out = np.zeros(len(keys), np.int8)
        alive, level = np.arange(len(keys)), 0
        while len(alive) and level < LEVELS:
            level += 1
            x, step = _probe(keys[alive], level)
            for k in range(PROBES):
                at = (x + np.uint64(k) * step) % self.bits
                found = np.flatnonzero(self.array[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                if len(found) < len(alive):
                    alive, x, step = alive[found], x[found], step[found]
            out[alive] = level
        return out


# -- packets ------------------------------------------------------------------------------------


def planes(values: np.ndarray) -> bytes:
    """Whole numbers by the plane: all least bytes, then all next ones, as far as any has a byte that isn't 0."""
    most = int(values.max(initial=0))
    width = max(1, -(-most.bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def from_planes(data: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    """What ``planes`` packed, and where it ends."""
    width = data[at]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(width, n).T
    return out.view("<u8").reshape(n), at + 1 + n * width


def small(counts: np.ndarray) -> bytes:
    """Counts as bytes; 255 stands for one of those that follow."""
    large = counts[counts >= 255]
    return struct.pack("<I", len(large)) + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype("<i8").tobytes()


def from_small(data: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    (more,) = struct.unpack_from("<I", data, at)
    out = np.frombuffer(data, np.uint8, n, at + 4).astype(np.int64)
    at += 4 + n
    if more:
        out[out == 255] = np.frombuffer(data, "<i8", more, at)
    return out, at + 8 * more


def distinct(h: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct hashes, and how often each occurs where training holds."""
    keys, places = np.unique(h, return_inverse=True)
    return keys, np.bincount(places[training], minlength=len(keys))


def _cuts(keys: np.ndarray, bits: int, power: int) -> np.ndarray:
    """Where each range of the hash space begins among ascending hashes of so many bits."""
    edges = np.arange(1, 1 << power, dtype=np.uint64) << np.uint64(bits - power)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _asked(h: np.ndarray, starts: np.ndarray, training: np.ndarray, bits: int, power: int) -> Iterator[bytes]:
    """A block's packet for each range: its tokens, pairs and triples there, and their counts."""
    two, three = ngrams(h, starts, bits)
    inner = np.ones(len(h), bool)
    inner[starts] = False
    found = [distinct(h, training), distinct(two, training), distinct(three[inner], training[inner])]
    cuts = [_cuts(keys, width, power) for (keys, _), width in zip(found, (64, bits, bits), strict=True)]
    for k in range(1 << power):
        parts: list[bytes] = []
        for (keys, counts), cut in zip(found, cuts, strict=True):
            own = keys[cut[k] : cut[k + 1]]
            first = int(own[0]) if len(own) else 0
            parts += [struct.pack("<IQ", len(own), first), planes(np.diff(own, prepend=np.uint64(first))), small(counts[cut[k] : cut[k + 1]])]
        yield b"".join(parts)


def _read(packet: memoryview) -> list[tuple[np.ndarray, np.ndarray]]:
    """The (hashes, counts) of a packet's tokens, pairs and triples."""
    at, out = 0, []
    for _ in range(3):
        n, first = struct.unpack_from("<IQ", packet, at)
        gaps, at = from_planes(packet, at + 12, n)
        counts, at = from_small(packet, at, n)
        out.append((np.cumsum(gaps, dtype=np.uint64) + np.uint64(first), counts))
    return out


def _summed(packets: list[memoryview]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For tokens, pairs and triples: distinct hashes, their counts, and for all packets' hashes their places among the distinct ones and the packets' ends."""
    read = [_read(p) for p in packets]
    out = []
    for kind in range(3):
        every = np.concatenate([r[kind][0] for r in read])
        times = np.concatenate([r[kind][1] for r in read])
        keys, places = np.unique(every, return_inverse=True)
        counts = np.bincount(places, times, len(keys)).astype(np.int64)  # exact below 2^53
        out.append((keys, counts, places, np.cumsum([len(r[kind][0]) for r in read])))
    return out


def _answers(packets: list[memoryview]) -> Iterator[bytes]:
    """For each packet of one range the range's sums, the exact counts of its tokens, and the levels of its pairs and triples."""
    summed = _summed(packets)
    one = summed[0][1]
    sums = [int(one.sum()), int((one > 0).sum())]
    values = [one]
    for keys, counts, _, _ in summed[1:]:
        seen = counts > 0
        values.append(Filter(keys[seen], counts[seen]).levels(keys))
        sums += [int(counts.sum()), int((counts == 1).sum()), int((counts == 2).sum())]
    head = struct.pack(f"<{SUMS}q", *sums)
    for k in range(len(packets)):
        parts = [head]
        for (_, _, places, ends), value in zip(summed, values, strict=True):
            own = value[places[ends[k - 1] if k else 0 : ends[k]]]
            parts += [struct.pack("<I", len(own)), planes(own) if value is one else own.tobytes()]
        yield b"".join(parts)


def _known(answers: list[memoryview]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sums over all ranges; token counts, pair levels and triple levels of one block in ascending order of hashes. answers: in order of ranges."""
    sums, parts = np.zeros(SUMS, np.int64), ([], [], [])
    for data in answers:
        sums += np.frombuffer(data, "<i8", SUMS)
        at = 8 * SUMS
        for kind, held in enumerate(parts):
            (n,) = struct.unpack_from("<I", data, at)
            if kind:
                values, at = np.frombuffer(data, np.int8, n, at + 4), at + 4 + n
            else:
                values, at = from_planes(data, at + 4, n)
            held.append(values)
    return sums, [np.concatenate(p) for p in parts]


# -- scores -------------------------------------------------------------------------------------


def probabilities(sums: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P1 and P3 of each token, from its own count and the levels of its pair and triple."""
    low, high = bounds()
    total, kinds = int(sums[0]), int(sums[1])
    p1 = (one + ALPHA) / (total + ALPHA * (kinds + 1))

    def smoothed(n: int, once: int, twice: int, seen: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
        share = 1 - once / n if n else 0.0
        discount = once / (once + 2 * twice) if once else 0.0
        room = np.maximum(context, 1)
        own = (np.maximum(np.minimum(seen, room) - discount, 0) + discount * lower) / room
        return np.where(context > 0, share * own + (1 - share) * lower, lower)

    before = np.empty(len(one))
    before[1:] = one[:-1]
    last = np.append(starts[1:], len(one)) - 1
    # the start has been a context once for each document, which is as often as the end has been a token
    before[starts] = one[last]
    p2 = smoothed(*map(int, sums[2:5]), low[two], before, p1)
    context = np.zeros(len(one))
    context[1:] = high[two[:-1]]
    context[starts] = 0
    return p1, smoothed(*map(int, sums[5:8]), low[three], context, p2)


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
SCORE_FIELDS = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def _scores(bits: int):
    """Scores of one block's documents."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return SCORE_FIELDS.empty_table()
        order = np.argsort(answers.column("range").to_numpy())
        packets = answers.column("packet").combine_chunks()
        sums, values = _known([memoryview(packets[int(k)].as_buffer()) for k in order])
        h, starts = joined(docs.column("text").cast(pa.binary()).to_pylist())
        two, three = ngrams(h, starts, bits)
        inner = np.ones(len(h), bool)
        inner[starts] = False
        found = []
        for keys, value in zip((h, two, three[inner]), values, strict=True):
            own, places = np.unique(keys, return_inverse=True)
            if len(own) != len(value):  # a block has to be the same rows whenever it's computed
                raise RuntimeError(f"a block asked for {len(value)} n-grams and has {len(own)}")
            found.append(value[places])
        triple = np.zeros(len(h), np.int8)
        triple[inner] = found[2]
        p1, p3 = probabilities(sums, found[0].astype(np.float64), found[1], triple, starts)
        sizes = np.diff(np.append(starts, len(h)))
        arrays = [
            docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), pa.array(sizes), pa.array(np.add.reduceat((found[0] > 0).astype(np.int64), starts)),
            pa.array(np.full(len(starts), sums[0])), pa.array(np.add.reduceat(np.log10(p1), starts)), pa.array(np.add.reduceat(np.log10(p3), starts)),
        ]
        return pa.Table.from_arrays(arrays, schema=SCORE_FIELDS)

    return run


def _blocks(bits: int, power: int):
    """A task that gives the packets of whole blocks, whose rows come one block after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, texts, out = None, [], []

        def finish() -> Iterator[pa.RecordBatch]:
            h, starts = joined(texts)
            training = np.repeat(~np.array(out, bool), np.diff(np.append(starts, len(h))))
            held: list[bytes] = []
            first = 0
            for packet in _asked(h, starts, training, bits, power):
                held.append(packet)
                if len(held) == 512 or first + len(held) == 1 << power:
                    ranges = pa.array(np.arange(first, first + len(held), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([ranges, pa.array([own] * len(held), pa.int64()), pa.array(held, pa.binary())], names=["range", "block", "packet"])
                    first += len(held)
                    held = []

        for batch in batches:
            for block, text, held_out_ in zip(column(batch, "block").to_pylist(), utf8(column(batch, "text")), column(batch, "held_out").to_pylist(), strict=True):
                if block != own:
                    if texts:
                        yield from finish()
                    own, texts, out = block, [], []
                texts.append(text)
                out.append(held_out_)
        if texts:
            yield from finish()

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers for whole ranges, whose packets come one range after another."""
    own, blocks, packets = None, [], []

    def finish() -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        first = 0
        for answer in _answers([memoryview(p.as_buffer()) for p in packets]):
            held.append(answer)
            if len(held) == 512 or first + len(held) == len(packets):
                names = ["range", "block", "packet"]
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(held), pa.int64()), pa.array(blocks[first : first + len(held)], pa.int64()), pa.array(held, pa.binary())], names=names)
                first += len(held)
                held = []

    for batch in batches:
        packed = column(batch, "packet")
        for k, (number, block) in enumerate(zip(column(batch, "range").to_pylist(), column(batch, "block").to_pylist(), strict=True)):
            if number != own:
                if packets:
                    yield from finish()
                own, blocks, packets = number, [], []
            blocks.append(block)
            packets.append(packed[k])
    if packets:
        yield from finish()


def score(docs: DataFrame, parts: int = 10, block_bytes: int = BLOCK_BYTES, range_grams: int = RANGE) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32 of doc_id leaves a remainder by ``parts``.
    """
    docs = docs.select(with_long_id(docs), "text").withColumn("held_out", held_out(F.col("doc_id"), parts))
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    some = max(2, size // 6)  # tokens, or about as many
    power = max(0, (3 * some // 2 // range_grams).bit_length())
    bits = min(63, max(32, some.bit_length() + 13))
    # rows that are alike throughout are dealt by where they were read, so that not all of them meet
    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks))
    placed = docs.withColumn("block", block).repartition("block")
    packets = "range bigint, block bigint, packet binary"
    asked = placed.sortWithinPartitions("block").mapInArrow(_blocks(bits, power), packets)
    answers = asked.repartition("range").sortWithinPartitions("range").mapInArrow(_ranges, packets)
    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(bits), SCORES)

"""Operator 3: SimHash near-duplicates through a Gray-order hierarchical index.

1. Each text gets a 64-bit fingerprint of its word shingles (Arrow batches, no shuffle).
2. Distinct fingerprints are routed by band: two fingerprints that differ in at most 3 bits
   agree on one of four 16-bit bands, the index's topmost masked patterns. A band value with
   more than ``group_limit`` fingerprints is routed again by bands of its remaining bits, which
   is exact by the same argument, until at most 2^16 fingerprints can share a route.
3. In each partition the fingerprints of a group are sorted by Gray rank. Every ``FAN``
   neighbours share an upper node, which holds the bits on which all of them agree (mask and
   pattern). A descent over pairs of nodes adds up the differing bits level by level, looking
   only at bits that no level above has decided, and prunes whole groups beyond 3. Nodes whose
   fingerprints are already connected with each other are pruned too, so that a dense group
   doesn't cost all its pairs.
4. A group gives a spanning forest, not its pairs; ``components`` joins the forests.

Equal texts share a fingerprint and meet before any link is made. No fingerprints, links or
components of all documents reach the driver, and none are broadcast.

``similar`` links texts by the Jaccard similarity of their shingle sets instead. At a similarity of 0.8 fingerprints differ in 15 % of
their bits, which no exact index of 64 bits can tell from chance. So it takes 128 bits, in which each distinct shingle counts once,
and routes distinct sets by masks of some of the bits in place of four bands (the same tree below them, up to
``WIDE`` differing bits). A mask has as many bits as leave about 8 sets to a route, and there are as many masks as find a pair of
similarity 0.8 in all but 1 case in 100 (measured at 200,000 sets, 4 in 100 at 20 million; 1 in 1,000 and 1 in 100 at 0.85): see
``index_shape``. Their number grows as the 0.24th power of the
sets. Whatever the index connects is then confirmed by the shingle sets themselves (``confirmed``), so that no link is wrong.

Cases: a null, empty or blank text has the fingerprint zero and is linked like any other. Rows
that share a doc_id are rows of their own with one component between them. A null doc_id is
fingerprinted but links nothing, and its component_id is null where no doc_id has its
fingerprint. Empty tables give no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, halved, matched, portions, utf8
from .components import Labels, components

SEED = 42
DISTANCE = 3
#: Fingerprints under one upper node.
FAN = 8
#: Distinct fingerprints that one band value may bring into a task before it is split further.
GROUP_LIMIT = 20_000
#: Pairs of nodes that a descent expands at a time.
BLOCK = 1 << 12
#: Band widths: 4 x 16 of 64 bits, then 4 x 12 of the other 48, 4 x 9 of the other 36, 4 x 6 of 27, 4 x 5 of 21; at most 16 bits stay free.
WIDTHS = (16, 12, 9, 6, 5)
#: For ``similar``: words of a shingle, the least similarity of a link, and the index that finds candidates.
SHINGLE, SIMILARITY = 5, 0.8
WIDE = 32
#: One set in so many is looked at to find crowded routes; that only deals rows out and never changes a result.
SAMPLED = 64
#: Sets that are confirmed against one another in one task, and rounds in which larger groups of candidates are dealt anew.
CONFIRM, ROUNDS = 1000, 2


def fingerprint(text: bytes | None, shingle: int = 3, block: int = 1 << 15) -> int:
    """Bit i is set if it is set in over half the hashes of the shingles, repeats included."""
    words = text.lower().split() if text else []  # bytes: only A-Z are lowered
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    stops = ends[shingle - 1 :].tolist()
    for at in range(0, n, block):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + block], stops[at : at + block], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, bits): bits is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                bits = np.array([fingerprint(t, shingle) for t in utf8(column(part, "text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, bits bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    out = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


def _differing(a: np.ndarray, b: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
    """Differing bits of codes of several words, in the places that count."""
    x = a ^ b
    return np.bitwise_count(x if where is None else x & where).sum(1, dtype=np.int64)


def forest(keys: np.ndarray, codes: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For every code the place of the least one connected with it, by links within its key's group.

    keys: ascending; codes: of one word, or (n, words); distinct within a key and in Gray order there.
    """
    n = len(codes)
    codes = codes.reshape(n, -1)
    labels = Labels(n)
    near = (keys[1:] == keys[:-1]) & (_differing(codes[1:], codes[:-1]) <= distance)
    labels.of = np.maximum.accumulate(np.where(np.concatenate(([True], ~near)), np.arange(n), 0))[:n] if n else labels.of
    # levels[0]: the codes; above: every FAN nodes of a key. A node: pattern, mask of shared bits, first child, children
    pattern, mask, key = codes, np.full(codes.shape, ~np.uint64(0)), keys
    levels = [(pattern, mask, None, None)]
    spans = [(np.arange(n), np.arange(1, n + 1))]
    while n and not np.all(key[1:] != key[:-1]):
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        heads = np.flatnonzero((np.arange(len(key)) - first) % FAN == 0)
        counts = np.diff(np.append(heads, len(key)))
        every, some = np.bitwise_and.reduceat(pattern, heads), np.bitwise_or.reduceat(pattern, heads)
        # bits that are fixed in all children, and alike
        shared = np.bitwise_and.reduceat(mask, heads) & ~(every ^ some)
        pattern, mask, key = every & shared, shared, key[heads]
        levels.append((pattern, mask, heads, counts))
        spans.append((spans[-1][0][heads], spans[-1][1][heads + counts - 1]))
    if len(levels) == 1:
        return labels.of
    # a key with one code has nothing to compare
    roots = np.flatnonzero(spans[-1][1] - spans[-1][0] > 1)
    stack = [(len(levels) - 1, roots, roots, np.zeros(len(roots), np.int64), np.zeros((len(roots), codes.shape[1]), np.uint64))]
    while stack:
        level, a, b, differ, decided = stack.pop()
        if len(a) > BLOCK:
            stack += [(level, *(x[i : i + BLOCK] for x in (a, b, differ, decided))) for i in range(0, len(a), BLOCK)]
            continue
        if level == 0:
            labels.unite(a, b)
            continue
        # a node is settled if its codes already have one label; pairs of such nodes with the same label have nothing to add
        low, high = spans[level]
        settled = _uniform(labels.of, low[a], high[a]) & _uniform(labels.of, low[b], high[b]) & (labels.of[low[a]] == labels.of[low[b]])
        a, b, differ, decided = (x[~settled] for x in (a, b, differ, decided))
        _, _, heads, counts = levels[level]
        many = counts[a] * counts[b]
        pair = np.repeat(np.arange(len(a)), many)
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        x = heads[a][pair] + inner // counts[b][pair]
        y = heads[b][pair] + inner % counts[b][pair]
        keep = (x < y) | ((x == y) & (level > 1))
        pair, x, y = pair[keep], x[keep], y[keep]
        low_pattern, low_mask, _, _ = levels[level - 1]
        both = low_mask[x] & low_mask[y]
        total = differ[pair] + _differing(low_pattern[x], low_pattern[y], both & ~decided[pair])
        keep = total <= distance
        stack.append((level - 1, x[keep], y[keep], total[keep], both[keep]))
    return labels.of


def _uniform(labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether labels[low:high] are all alike."""
    changes = np.concatenate(([0], np.cumsum(labels[1:] != labels[:-1])))
    return changes[low] == changes[high - 1]


def _without(bits: Column, at: int, width: int) -> Column:
    """The other bits, closed up."""
    low = bits.bitwiseAND(F.lit((1 << at) - 1))
    return low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(bits, at + width), at)) if at + width < 64 else low


def _bands(frame: DataFrame, level: int) -> DataFrame:
    """Four rows for each: its route and a band of the rest of its bits."""
    width = WIDTHS[level]
    routes = F.array(
        *(
            F.struct(
                F.shiftleft(F.shiftleft(F.col("route"), 2) + k, width).bitwiseOR(F.shiftrightunsigned("rest", k * width).bitwiseAND(F.lit((1 << width) - 1))).alias("route"),
                _without(F.col("rest"), k * width, width).alias("rest"),
            )
            for k in range(4)
        )
    )
    return frame.select("bits", "first_id", F.explode(routes).alias("x")).select("bits", "first_id", "x.route", "x.rest")


def _linking(words: list[str], distance: int):
    """A task over ascending routes that gives links (a, b) of first_id, a spanning forest of each route's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def linked(table: pa.Table) -> pa.RecordBatch:
            route, first = (table.column(c).to_numpy() for c in ("route", "first_id"))
            bits = np.stack([table.column(c).to_numpy().view(np.uint64) for c in words], axis=1)
            order = np.lexsort((*(gray_rank(bits[:, k]) for k in reversed(range(len(words)))), route))
            to = forest(route[order], bits[order], distance)
            ids = first[order]
            # to the least id of what is connected: other routes link the same documents to the same one, which makes one link of theirs
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, to, ids)
            apart = ids != least[to]
            return pa.RecordBatch.from_arrays([pa.array(ids[apart]), pa.array(least[to[apart]])], names=["a", "b"])

        for batch in batches:  # ascending routes: all but the last one are complete
            held.append(batch)
            if sum(b.num_rows for b in held) < 50_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            route = table.column("route").to_numpy()
            done = int(np.searchsorted(route, route[-1]))
            if done:
                yield linked(table.slice(0, done))
                held = table.slice(done).to_batches()
        if held:
            yield linked(pa.Table.from_batches(held))

    return run


def links(distinct: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) between the first_id of fingerprints that connect all those within 3 bits.

    distinct: (bits, first_id), one row for each fingerprint.
    """
    level, parts = 0, []
    rest = distinct.select("bits", "first_id", F.lit(0).cast("long").alias("route"), F.col("bits").alias("rest"))
    while True:
        rest = _bands(rest, level)
        counts = rest.groupBy("route", halved("route")).agg(F.count("bits").alias("n"))
        large = checkpointed(counts.where(F.col("n") > group_limit).select("route")) if level + 1 < len(WIDTHS) else None
        if large is None or large.isEmpty():
            parts.append(rest)
            break
        parts.append(rest.join(large, "route", "left_anti"))
        rest = rest.join(large, "route", "left_semi").select("bits", "first_id", "route", "rest")
        level += 1

    out = None
    for k, part in enumerate(parts):
        one = part.select(F.shiftleft("route", 3).bitwiseOR(F.lit(k)).alias("route"), "bits", "first_id")
        out = one if out is None else out.union(one)
    return out.repartition("route").sortWithinPartitions("route").mapInArrow(_linking(["bits"], DISTANCE), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Per document: doc_id, bits (signed), component_id: the smallest doc_id reachable over links of 3 bits or fewer."""
    prints = checkpointed(fingerprints(docs, shingle))
    distinct = prints.groupBy("bits", halved("bits")).agg(F.min("doc_id").alias("first_id"))
    found = components(links(distinct.where("first_id is not null"), group_limit))
    least = distinct.join(found, distinct.first_id == found.id, "left").select("bits", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.join(least, "bits").select("doc_id", "bits", "component_id")


# -- links by the similarity of shingle sets ----------------------------------------------------


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles, ascending; of fewer words the whole sequence is one."""
    words = text.lower().split() if text else []  # bytes: only A-Z are lowered
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[size - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def set_digest(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def wide_fingerprint(own: np.ndarray, block: int = 1 << 15) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed words: bit i is set if it is set in over half the hashes."""
    out = []
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(own), block):
            h = own[at : at + block] * np.uint64(factor)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0]))
    return out[0], out[1]


def index_shape(sets: int) -> tuple[int, int]:
    """(masks, bits of a mask) for so many sets. A bit of two sets of similarity 0.8 agrees with a probability of 0.8485."""
    bits = min(40, max(12, max(1, sets - 1).bit_length() - 3))
    return int(np.ceil(9.5 / 0.8485**bits)), bits


def masks(many: int, bits: int) -> list[tuple[int, int]]:
    """So many choices of bits among 128, as two signed words each; always the same ones."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(many):
        chosen = np.zeros(128, np.uint8)
        chosen[rng.choice(128, bits, replace=False)] = 1
        out.append(tuple(np.packbits(chosen, bitorder="little").view("<i8").tolist()))
    return out


def set_sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, digest, hi, lo): the digest of the set of shingles and its 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                rows = [(set_digest(own), *wide_fingerprint(own)) for own in (shingle_set(t, shingle) for t in utf8(column(part, "text")))]
                arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), *arrays], names=["doc_id", "digest", "hi", "lo"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, digest bigint, hi bigint, lo bigint")


def _dealt(rows: DataFrame, counts: DataFrame, key: str, limit: int) -> DataFrame:
    """Add ``route``: rows of a key of more than ``limit`` are dealt out as pairs of blocks, in which each two of them meet.

    counts: (key, n). A key within the limit is one route.
    """
    blocks = counts.select(F.col(key).alias("_key"), F.ceil(F.col("n") / limit).cast("int").alias("_blocks"))
    own, other = F.pmod(F.hash("digest"), F.col("_blocks")), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = rows.join(blocks, rows[key] == blocks["_key"]).select(*rows.columns, own.alias("_own"), other.alias("_other"))
    return dealt.withColumn("route", F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_own", "_other")


def candidate_links(distinct: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) of first_id that connect sets whose fingerprints agree under some mask and differ in at most WIDE bits.

    distinct: (digest, hi, lo, first_id), one row for each set. A route that is estimated to have more than group_limit sets is dealt out
    as pairs of blocks, in which each two of its sets meet.
    """
    chosen = masks(*index_shape(distinct.count()))
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("hi").bitwiseAND(F.lit(hi)), F.col("lo").bitwiseAND(F.lit(lo))) for k, (hi, lo) in enumerate(chosen)))
    rows = distinct.select("digest", "hi", "lo", "first_id", F.explode(keys).alias("key"))
    some = distinct.where(F.pmod(F.xxhash64(F.col("digest"), F.lit(SEED)), F.lit(SAMPLED)) == 0).select(F.explode(keys).alias("key"))
    counts = some.groupBy("key").agg((F.count("key") * SAMPLED).alias("n"))
    large = checkpointed(counts.where(F.col("n") > group_limit / 2))
    routed = rows.select(F.col("key").alias("route"), "hi", "lo", "first_id")
    if not large.isEmpty():
        parted = _dealt(rows, large, "key", group_limit).select("route", "hi", "lo", "first_id")
        routed = routed.join(large.select(F.col("key").alias("route")), "route", "left_anti").union(parted)
    return routed.repartition("route").sortWithinPartitions("route").mapInArrow(_linking(["hi", "lo"], WIDE), "a bigint, b bigint")


def connected(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the place of the first one of its component, by links of at least the similarity."""
    label = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    values, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(len(values), bool)
    rest = np.arange(len(sets))
    while len(rest):
        first, rest = rest[0], rest[1:]
        queue = [first]
        while queue and len(rest):
            at = queue.pop()
            own = tokens[starts[at] : starts[at] + sizes[at]]
            some = rest[np.minimum(sizes[rest], sizes[at]) >= similarity * np.maximum(sizes[rest], sizes[at])]
            if not len(some):
                continue
            marked[own] = True
            ends = np.cumsum(sizes[some])
            places = np.arange(ends[-1]) + np.repeat(starts[some] - (ends - sizes[some]), sizes[some])
            shared = np.add.reduceat(marked[tokens[places]], ends - sizes[some], dtype=np.int64)
            marked[own] = False
            near = some[shared >= similarity * (sizes[some] + sizes[at] - shared)]
            label[near] = first
            queue += near.tolist()
            rest = rest[label[rest] == rest]
    return label


def _confirming(shingle: int, similarity: float):
    """A task over ascending routes that links the sets of a route's texts which are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, held = None, {}

        def linked() -> pa.RecordBatch:
            ids, sets = [i for i, _ in held.values()], [s for _, s in held.values()]
            pairs = [(ids[k], ids[t]) for k, t in enumerate(connected(sets, similarity).tolist()) if k != t]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for r, digest, first, text in zip(*(column(batch, c).to_pylist() for c in ("route", "digest", "first_id")), utf8(column(batch, "text")), strict=True):
                if r != route:
                    if len(held) > 1:
                        yield linked()
                    route, held = r, {}
                if digest not in held and set_digest(own := shingle_set(text, shingle)) == digest and len(own):  # a doc_id may have other texts too
                    held[digest] = (first, own)
        if len(held) > 1:
            yield linked()

    return run


def confirmed(docs: DataFrame, grouped: DataFrame, shingle: int, similarity: float, limit: int = CONFIRM, rounds: int = ROUNDS) -> DataFrame:
    """(id, component_id): components by similar sets, within groups of candidates.

    grouped: (digest, first_id, cluster). A cluster of at most ``limit`` sets is compared whole. Larger ones are dealt into parts at random,
    some rounds over, which makes one component of a cluster that is dense. What is left in several components after that is dealt out
    as pairs of blocks, in which each two of its sets meet.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    task = _confirming(shingle, similarity)

    def compared(routes: DataFrame) -> DataFrame:
        routes = checkpointed(routes.select("route", "digest", "first_id"))
        wanted = checkpointed(routes.select("first_id").distinct())
        found = matched(texts, wanted, "left_semi").join(routes, F.col("doc_id") == F.col("first_id"))
        found = found.select("route", "digest", "first_id", "text").repartition("route").sortWithinPartitions("route")
        return checkpointed(found.mapInArrow(task, "a bigint, b bigint"))

    counts = checkpointed(grouped.groupBy("cluster", halved("cluster")).agg(F.count("digest").alias("n")).select("cluster", "n"))
    sized = grouped.join(counts, "cluster")
    part = lambda r: F.xxhash64("cluster", F.when(F.col("n") <= limit, 0).otherwise(F.pmod(F.xxhash64("digest", F.lit(r)), F.ceil(F.col("n") / limit).cast("long"))))
    linked = compared(sized.withColumn("route", part(0)))
    rest = sized.where(F.col("n") > limit)
    if not counts.where(F.col("n") > limit).isEmpty():
        for r in range(1, rounds):
            linked = linked.union(compared(rest.withColumn("route", part(r))))
        found = components(linked)
        named = rest.join(found, rest["first_id"] == found["id"], "left").select("cluster", F.coalesce("component_id", "first_id").alias("c"))
        apart = checkpointed(named.groupBy("cluster").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("cluster"))
        left = grouped.join(apart, "cluster", "left_semi")
        if not left.isEmpty():
            linked = linked.union(compared(_dealt(left, counts.join(apart, "cluster", "left_semi"), "cluster", limit)))
    return components(linked)


def similar(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, group_limit: int = GROUP_LIMIT, limit: int = CONFIRM) -> DataFrame:
    """Per document: doc_id, component_id: the smallest doc_id reachable over links of shingle sets of at least the similarity.

    Cases: as above, but for a null, empty or blank text, whose empty set equals itself and nothing else. A null doc_id links nothing.
    """
    sketched = checkpointed(set_sketches(docs, shingle))
    distinct = checkpointed(sketched.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("hi").alias("hi"), F.first("lo").alias("lo")))
    near = components(candidate_links(distinct.where("first_id is not null"), group_limit))
    ids = checkpointed(near.union(near.select(F.col("component_id").alias("id"), "component_id").distinct()))
    firsts = distinct.select("digest", "first_id")
    grouped = checkpointed(firsts.join(ids, firsts["first_id"] == ids["id"]).select("digest", "first_id", F.col("component_id").alias("cluster")))
    found = confirmed(docs, grouped, shingle, similarity, limit)
    least = firsts.join(found, firsts["first_id"] == found["id"], "left").select("digest", F.coalesce("component_id", "first_id").alias("component_id"))
    return sketched.select("doc_id", "digest").join(least, "digest").select("doc_id", "component_id")

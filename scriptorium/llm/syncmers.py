"""Operator 1 [native]: document fingerprints from closed syncmers, in DataFrame functions only.

Pieces are runs of non-space characters, hashed. A run of more than ``PIECE`` characters (unspaced scripts,
encoded data, minified code) gives all its overlapping grams of ``GRAM`` code points in their place. A window of
``K`` pieces in a row is a k-mer (in a long run one of GRAM + K - 1 code points), its inner substrings are the pieces, and it is
a closed syncmer if the least of them lies at its first or last place. Whether it is one depends on the window alone, not on where
it lies in the text, so an edit changes the anchors of the windows that it touches and no others, and equal passages carry the
same anchors at a constant offset. A text without a closed syncmer (fewer than K pieces, or K with the least in the middle) has one
anchor of all its pieces.

``anchors`` gives all anchors with their positions; ``shared`` and ``in_place`` compare two texts by all of them, the latter by
position too. The fingerprint is a sketch of them: the sorted list of the ``SKETCH`` least distinct anchor hashes (their first 32
bits), in hex. The likeness of two fingerprints estimates the Jaccard similarity J of the anchor sets: of the
SKETCH least hashes of both together, the share that both have. Its standard error is sqrt(J (1 - J) / SKETCH), at most 0.044; texts
of fewer anchors than that are compared exactly. It doesn't see order, nor an edit that touches none of the least hashes;
``shared`` does.

Cases: null is taken as an empty text, and an empty or blank text has the empty fingerprint; two
empty fingerprints have likeness 1, an empty one and another 0. Equal texts have equal
fingerprints. Texts are never cut; a text's anchors are held in a task, which takes about 100 bytes of heap for each of its words, and
250 for each character of a run that gives grams. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, with_long_id

K = 3
PIECE = 16
GRAM = 8
SKETCH = 128
#: Hex digits of an anchor in a fingerprint.
WIDTH = 8
RUN, LONG = r"[^\x20\x09-\x0D]+", rf"[^\x20\x09-\x0D]{{{PIECE + 1}}}"
#: Documents of a range of doc_id in which a document looks for the next one by a window, and the ranges at the least.
RANGE, RANGES = 1_000_000, 512


def _grams(run: Column) -> Column:
    """The hashes of a run's overlapping grams."""
    # an array of one array: its lambda's variable stands for the characters, which are computed once
    each = lambda chars: F.transform(F.sequence(F.lit(0), F.size(chars) - GRAM), lambda i: F.xxhash64(*(F.get(chars, i + k) for k in range(GRAM))))
    return F.transform(F.array(F.split(run, "")), each)[0]


def piece_hashes(text: Column) -> Column:
    """The hash of every piece, in order."""
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    mixed = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > PIECE, _grams(r)).otherwise(F.array(F.xxhash64(r)))))
    return F.when(text.rlike(LONG), mixed).otherwise(F.transform(runs, lambda r: F.xxhash64(r)))


def _closed(a: Column, b: Column, c: Column) -> Column:
    """The middle isn't the only least: with ties the leftmost place counts, so a tie with the last leaves the middle."""
    return (a <= b) | (c < b)


def _unselected(hashes: Column) -> Column:
    """There are pieces but no syncmer: fewer than K, or K with the least in the middle (of two windows in a row one is closed)."""
    size = F.size(hashes)
    return size.between(1, K - 1) | ((size == K) & (F.get(hashes, F.lit(1)) < F.get(hashes, F.lit(0))) & (F.get(hashes, F.lit(1)) <= F.get(hashes, F.lit(2))))


def anchors(hashes: Column) -> Column:
    """array<struct<position, hash>> of the syncmers; positions count pieces from 0."""

    def anchor(i: Column) -> Column:
        own = [F.get(hashes, i + k) for k in range(K)]
        return F.when(_closed(*own), F.struct(i.alias("position"), F.xxhash64(*own).alias("hash")))

    count = F.size(hashes) - K + 1
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(hashes).alias("hash")))
    return F.when(_unselected(hashes), whole).otherwise(F.filter(F.transform(places, anchor), lambda a: a.isNotNull()))


def _hashes(found: Column) -> Column:
    return F.transform(found, lambda a: a["hash"])


def shared(x: Column, y: Column) -> Column:
    """The Jaccard similarity of all anchors of two texts; of two without any 1."""
    a, b = _hashes(x), _hashes(y)
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def in_place(x: Column, y: Column) -> Column:
    """How many anchors two texts have in common at the same positions."""
    placed = lambda found: F.transform(found, lambda a: F.xxhash64(a["position"], a["hash"]))
    return F.size(F.array_intersect(placed(x), placed(y))).cast("long")


def with_fingerprint(frame: DataFrame, text: str, name: str, found: str | None = None) -> DataFrame:
    """Add the fingerprint of a column as a string, and its anchors if a name is given for them. Steps are columns of their own, so that each is computed once."""
    step, all_of, least = f"_{name}_hashes", found or f"_{name}_found", f"_{name}_least"
    # not negative, so that hex forms sort as the numbers do
    short = lambda a: F.shiftrightunsigned(a["hash"], 32)
    return (
        frame.withColumn(step, piece_hashes(F.coalesce(F.col(text), F.lit(""))))
        .withColumn(all_of, anchors(F.col(step)))
        .withColumn(least, F.slice(F.array_sort(F.array_distinct(F.transform(all_of, short))), 1, SKETCH))
        .withColumn(name, F.array_join(F.transform(least, lambda h: F.lpad(F.lower(F.hex(h)), WIDTH, "0")), ""))
        .drop(step, least, *([] if found else [all_of]))
    )


def _codes(fingerprint: Column) -> Column:
    return F.regexp_extract_all(fingerprint, F.lit(f".{{{WIDTH}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Of the SKETCH least hashes of both, the share that both have; from 0 to 1."""
    x, y = _codes(a), _codes(b)
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect(x, y), union))
    return F.when(a == b, F.lit(1.0)).otherwise(shared / F.greatest(F.size(union), F.lit(1)))


def following(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, next_id, previous_id, previous_chars): neighbours by ascending doc_id, in a circle.

    Windows run inside ranges of doc_id between approximate quantiles; only the ends of the
    ranges (at most ``ranges`` + 1 rows; a range has about RANGE documents, whatever the size) meet in one task. Repeated ids count once, by their longest text.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    ranges = ranges or max(RANGES, docs.count() // RANGE)
    cuts = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    ids = ids.withColumn("part", part)
    ends = ids.groupBy("part").agg(F.min("doc_id").alias("low"), F.max(F.struct("doc_id", "chars")).alias("high"))
    around = W.orderBy("part")
    everywhere = W.partitionBy()
    ends = ends.select(
        "part",
        F.coalesce(F.lead("low").over(around), F.min("low").over(everywhere)).alias("after"),
        F.coalesce(F.lag("high").over(around), F.max("high").over(everywhere)).alias("before"),
    )
    inside = W.partitionBy("part").orderBy("doc_id")
    ids = ids.withColumn("in_next", F.lead("doc_id").over(inside)).withColumn("in_before", F.lag(F.struct("doc_id", "chars")).over(inside))
    return ids.join(F.broadcast(ends), "part").select(
        "doc_id",
        F.coalesce("in_next", "after").alias("next_id"),
        F.coalesce("in_before", "before")["doc_id"].alias("previous_id"),
        F.coalesce("in_before", "before")["chars"].alias("previous_chars"),
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts and of edited ones, with their likeness; shared_edited and kept_in_place by all anchors of both.

    The edited text: the last floor(n_chars / 4) code points give way to the first as many (or
    all) of the next document by ascending doc_id, the first one after the last. A row without
    a doc_id has no next document: nothing takes the place of its last code points, and near_next
    is its likeness to an empty text. Rows that share a doc_id follow one another as one
    document, whose text is the least of theirs.

    Texts move once, by doc_id; what the document before needs (the head of the text and the
    fingerprint) is taken from the same exchange and moves to the document before.
    """
    whole = docs.select(with_long_id(docs), F.coalesce("text", F.lit("")).alias("text"))
    # the same non-null rows on both sides, or else the two would not share their exchange
    prints = with_fingerprint(whole.where("doc_id is not null"), "text", "fingerprint")
    placed = prints.join(checkpointed(following(docs.select(with_long_id(docs), "text"))).hint("merge"), "doc_id")
    heads = (
        placed.select(F.col("previous_id").alias("to_id"), F.struct(F.expr("left(text, previous_chars div 4)").alias("head"), F.col("fingerprint").alias("print")).alias("x"))
        .groupBy("to_id")
        .agg(F.min("x").alias("x"))
    )
    joined = placed.join(heads, placed.doc_id == heads.to_id, "left").select("doc_id", "text", "fingerprint", "x.head", "x.print")
    unnamed = with_fingerprint(whole.where("doc_id is null"), "text", "fingerprint").select("*", F.lit("").alias("head"), F.lit("").alias("print"))
    edited = joined.union(unnamed).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.expr("concat(left(text, cast(length(text) - length(text) div 4 as int)), left(head, cast(length(text) div 4 as int)))").alias("edited"),
        "fingerprint",
        F.col("print").alias("next_fingerprint"),
        # made again from the text, as all anchors of a text are larger than the text to move
        piece_hashes(F.col("text")).alias("_hashes"),
    ).withColumn("anchors", anchors(F.col("_hashes"))).drop("_hashes")
    return (
        with_fingerprint(edited, "edited", "edited_fingerprint", "edited_anchors")
        .withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
        .withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint")))
        .withColumn("shared_edited", shared(F.col("anchors"), F.col("edited_anchors")))
        .withColumn("n_anchors", F.size("anchors").cast("long"))
        .withColumn("kept_in_place", in_place(F.col("anchors"), F.col("edited_anchors")))
        .drop("next_fingerprint", "anchors", "edited_anchors")
    )

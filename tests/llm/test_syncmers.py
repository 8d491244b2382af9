import hashlib
import random
import re

from pyspark.sql import functions as F

from scriptorium.llm import queries, syncmers

SF = "/root/testdata/sf0.001"


def test_query_against_plain_edits(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id)
    got = {r.doc_id: r for r in queries.op1_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, after in zip(docs, docs[1:] + docs[:1], strict=True):
        row, n = got[d.doc_id], len(d.text)
        edited = d.text[: n - n // 4] + after.text[: n // 4]
        assert (row.n_chars, row.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
        assert (row.fingerprint == row.edited_fingerprint) <= (row.near_edited == 1)
    near = [r.near_edited for r in got.values() if r.n_chars > 300]
    assert sum(near) / len(near) > 0.4 > 0.1 > sum(r.near_next for r in got.values()) / len(got)


def plain_pieces(text):
    """Words, and of long ones all their grams."""
    runs = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [p for r in runs for p in ([(r[i : i + 8], "gram") for i in range(len(r) - 7)] if len(r) > 16 else [(r, "word")])]


def plain_anchors(hashes):
    """Positions of closed syncmers: windows of three whose first least hash isn't in the middle; or the whole."""
    windows = [hashes[i : i + 3] for i in range(len(hashes) - 2)]
    found = [i for i, w in enumerate(windows) if w.index(min(w)) != 1]
    return [(i, tuple(windows[i])) for i in found] or ([(0, tuple(hashes))] if hashes else [])


def test_query_against_plain_anchors(spark):
    """The query's own fingerprints, likenesses and positions, from piece hashes on in plain Python."""
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id)
    got = {r.doc_id: r for r in queries.op1_fingerprints(spark, SF).collect()}
    texts = {d.doc_id: (d.text, d.text[: len(d.text) - len(d.text) // 4] + after.text[: len(d.text) // 4]) for d, after in zip(docs, docs[1:] + docs[:1], strict=True)}
    rows = [(i, k, t) for i, pair in texts.items() for k, t in enumerate(pair)]
    frame = spark.createDataFrame(rows, "i bigint, k int, t string").withColumn("h", syncmers.piece_hashes(F.col("t"))).select("i", "k", "h", syncmers.anchors(F.col("h")).alias("found"))
    found = {}
    hash_of = {}
    for r in frame.collect():
        plain = plain_anchors(r.h)
        assert [a.position for a in r.found] == [p for p, _ in plain] and len(r.h) == len(plain_pieces(texts[r.i][r.k]))
        for a, (_, w) in zip(r.found, plain, strict=True):
            assert hash_of.setdefault(w, a.hash) == a.hash  # an anchor's hash is its window's
        found[r.i, r.k] = [(a.position, a.hash) for a in r.found]
    assert len(set(hash_of.values())) == len(hash_of)

    def sketch(anchors):
        return sorted({(h % (1 << 64)) >> 32 for _, h in anchors})[:128]

    def near(x, y):
        union = sorted(set(x) | set(y))[:128]
        return len(set(x) & set(y) & set(union)) / len(union) if x != y else 1.0

    order = [d.doc_id for d in docs]
    for at, i in enumerate(order):
        own, edited, after, r = found[i, 0], found[i, 1], found[order[(at + 1) % len(order)], 0], got[i]
        hexed = lambda s: "".join(f"{h:08x}" for h in s)
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(sketch(own)), hexed(sketch(edited)))
        assert (r.near_edited, r.near_next) == (near(sketch(own), sketch(edited)), near(sketch(own), sketch(after)))
        x, y = {h for _, h in own}, {h for _, h in edited}
        assert r.shared_edited == (len(x & y) / len(x | y) if x | y else 1.0)
        assert (r.n_anchors, r.kept_in_place) == (len(own), len(set(own) & set(edited)))


def test_anchors_against_plain_windows(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefg") * rng.randint(1, 20) for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["", " ", "one", "one two", "x" * 40, "é" * 16, "中文" * 9]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("h", syncmers.piece_hashes(F.col("text")))
    pieces = {}
    for r in frame.select("text", "h", syncmers.anchors(F.col("h")).alias("found")).collect():
        own = plain_pieces(r.text)
        assert len(r.h) == len(own) and all(pieces.setdefault(p, h) == h for p, h in zip(own, r.h, strict=True))
        assert [a.position for a in r.found] == [i for i, _ in plain_anchors(r.h)]


def test_likeness_estimates_jaccard(spark):
    rng = random.Random(4)
    a = " ".join(str(rng.random()) for _ in range(900))
    words = a.split()
    b = " ".join(words[:600] + [str(rng.random()) for _ in range(300)])
    frame = syncmers.with_fingerprint(syncmers.with_fingerprint(spark.createDataFrame([(a, b)], "a string, b string"), "a", "fa"), "b", "fb")
    r = frame.select(syncmers.likeness(F.col("fa"), F.col("fb")), syncmers.likeness(F.col("fb"), F.col("fa"))).first()
    assert r[0] == r[1] and 0.3 < r[0] < 0.7


def test_rows(spark):
    rows = [(1, None), (4, "abcd efgh"), (4, "abcd efgh"), (9, ""), (None, "abcdefgh"), (7, "wxyz 123 q")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fingerprint string")
    got = sorted(((r.doc_id, r.n_chars, r.edited) for r in syncmers.edited_fingerprints(frame).collect()), key=str)
    assert got == sorted([(1, 0, ""), (4, 9, "abcd efwx"), (4, 9, "abcd efwx"), (9, 0, ""), (None, 8, "abcdef"), (7, 10, "wxyz 123")], key=str)
    assert syncmers.edited_fingerprints(frame.limit(0)).count() == 0


def test_neighbours_over_many_ranges(spark):
    rng = random.Random(8)
    ids = sorted(rng.sample(range(-5000, 5000), 700))
    frame = spark.createDataFrame([(i, "x" * (i % 7)) for i in ids], "doc_id bigint, text string")
    got = {r.doc_id: (r.next_id, r.previous_id, r.previous_chars) for r in syncmers.following(frame, 16).collect()}
    assert got == {i: (ids[(k + 1) % 700], ids[k - 1], ids[k - 1] % 7) for k, i in enumerate(ids)}


def test_three_pieces_always_have_an_anchor(spark):
    texts = [f"a{i} b{i} c{i}" for i in range(60)]
    frame = syncmers.with_fingerprint(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "print").withColumn("h", syncmers.piece_hashes(F.col("text")))
    rows = frame.select("print", "h", syncmers.anchors(F.col("h")).alias("found")).collect()
    assert any(r.h[1] == min(r.h) for r in rows)
    assert all(len(r.print) == syncmers.WIDTH and [a.position for a in r.found] == [0] for r in rows)
    assert len({r.print for r in rows}) == len(texts)


def test_an_insertion_into_unspaced_text(spark):
    rng = random.Random(6)
    kinds = {"cjk": [chr(c) for c in range(0x4E00, 0x5200)], "base64": list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), "dna": list("ACGT"), "wide": [chr(c) for c in range(0x20000, 0x20100)]}
    rows = []
    for kind, letters in kinds.items():
        text = "".join(rng.choices(letters, k=4000))
        rows += [(kind, at, text, text[:at] + rng.choice(letters) + text[at:]) for at in (0, 1, 1999, 4000)]
    frame = spark.createDataFrame(rows, "kind string, at int, a string, b string")
    frame = frame.withColumn("ha", syncmers.piece_hashes(F.col("a"))).withColumn("hb", syncmers.piece_hashes(F.col("b")))
    frame = syncmers.with_fingerprint(syncmers.with_fingerprint(frame, "a", "fa"), "b", "fb")
    found = frame.select("kind", "at", syncmers.anchors(F.col("ha")).alias("x"), syncmers.anchors(F.col("hb")).alias("y"), syncmers.likeness(F.col("fa"), F.col("fb")).alias("near")).collect()
    for r in found:
        x, y = ({a.hash for a in side} for side in (r.x, r.y))
        assert len(x) > 200 and len(x ^ y) <= 20 and r.near > 0.95, (r.kind, r.at, len(x), len(x ^ y), r.near)


def test_ties_and_long_texts(spark):
    """Equal pieces tie; long texts go through, spaced or not (in the 1 GB of heap that tests have)."""
    texts = {1: "a " * 1_000_000, 2: "x" * 300_000, 3: " " * 2_000_000, 4: " ".join(f"w{k}" for k in range(250_000)), 5: "".join(chr(0x4E00 + k * 7919 % 5000) for k in range(200_000))}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in syncmers.edited_fingerprints(frame).collect()}
    assert {i: r.n_chars for i, r in got.items()} == {i: len(t) for i, t in texts.items()}
    assert [len(got[i].fingerprint) // syncmers.WIDTH for i in (1, 2, 3, 4, 5)] == [1, 1, 0, 128, 128]
    assert got[1].n_anchors == 1_000_000 - 2 and got[2].n_anchors == 300_000 - 7 - 2 and got[3].n_anchors == 0
    assert got[4].shared_edited < 1 and got[3].near_edited == 0.0 + (got[3].edited.strip() == "")

import zlib

import numpy as np
import pytest

from scriptorium.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op5_quality(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    model = quality.Model()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, starts, y = rng.random((9, quality.FEATURES)), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(p := model.forward(x, starts)["p"]) + (1 - y) * np.log(1 - p))
    for name, g in model.gradients(x, starts, y).items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        before = model.w[name][at]
        model.w[name][at] = before + 1e-5
        up = loss()
        model.w[name][at] = before - 1e-5
        down = loss()
        model.w[name][at] = before
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_passages_cover_the_whole_text():
    text = ("é" * 3000 + "abcabcabc").encode()
    x = quality.passages(text) ** 2
    sizes = [quality.PASSAGE] * (len(text) // quality.PASSAGE) + [len(text) % quality.PASSAGE]
    assert x[:, :256].sum(1) == pytest.approx(np.ones(len(sizes)), rel=1e-5)
    counts = (x[:, :256] * np.array(sizes)[:, None]).sum(0)
    assert counts.round().tolist() == np.bincount(np.frombuffer(text, np.uint8), minlength=256).tolist()
    assert quality.passages(None).shape == quality.passages(b"").shape == (1, quality.FEATURES)


def plain_passages(text):
    """Features by the definition, byte by byte."""
    n = max(1, -(-len(text) // quality.PASSAGE))
    out = np.zeros((n, quality.FEATURES))
    low = quality.FEATURES - quality.LAGS
    for i, b in enumerate(text):
        row = out[i // quality.PASSAGE]
        row[b] += 1
        if i + 1 < len(text):
            row[256 + (b * 167 + text[i + 1] * 241) % (low - 256)] += 1
        for lag in range(1, quality.LAGS):
            if i >= lag and text[i - lag] == b:
                row[low + lag] += 1
    out[:, low] = out[:, low + 3 :].max(1)
    for k in range(n):
        out[k] /= max(1, min(quality.PASSAGE, len(text) - k * quality.PASSAGE))
    return np.sqrt(out)


def test_blocks_of_passages_against_plain():
    rng = np.random.default_rng(2)
    for size in (0, 1, 5, 511, 512, 513, 1500, 2048):
        text = bytes(rng.integers(97, 100, size, dtype=np.uint8))
        want = plain_passages(text)
        assert quality.passages(text) == pytest.approx(want, abs=1e-6)
        assert np.concatenate(list(quality.passage_blocks(text, 2))) == pytest.approx(want, abs=1e-6)


def test_score_in_blocks_is_that_of_the_whole_bag(monkeypatch):
    model, text = quality.Model(), b"some text of many passages 0123456789\n" * 400
    model.w["attend"] *= 30  # so that passages differ in weight
    want = float(model.forward(quality.passages(text), np.zeros(1, np.int64))["p"][0])
    for size in (1, 3, 1024):
        monkeypatch.setattr(quality, "passage_blocks", lambda t, size=size, f=quality.passages: (f(t, k, k + size) for k in range(0, -(-len(t) // quality.PASSAGE), size)))
        assert model.score(text) == pytest.approx(want, abs=1e-5)


def test_memory_of_a_long_text():
    import resource

    model = quality.Model()
    model.score(b"warm up " * 100_000)
    text = b"a long text of two hundred million bytes. " * 4_800_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert 0 <= model.score(text) <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kB


def test_every_passage_of_the_sample_trains(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality.Model, "fit", lambda self, bags, y, *_: (fitted.append((bags, y)), self)[1])
    docs = spark.createDataFrame([(1, "x" * 100_000), (2, "y"), (3, "z" * 5000), (4, "w" * 900)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 0.7), (4, 1.0)], "doc_id bigint, quality double")
    quality.train(docs, labels, parts=10**9)
    quality.train(docs, labels, parts=10**9, sample_passages=5)
    assert sorted((len(b), y) for b, y in zip(*fitted[0], strict=True)) == [(1, 0.0), (2, 1.0), (196, 1.0)]
    assert sorted((len(b), y) for b, y in zip(*fitted[1], strict=True)) == [(1, 0.0), (2, 1.0)]


def test_sample_is_bounded_and_repeatable(spark):
    docs, labels = (queries.table(spark, SF, t) for t in ("documents", "labels"))
    a, b = quality.train(docs, labels, sample=60), quality.train(docs.repartition(7), labels.repartition(3), sample=60)
    assert all(np.array_equal(a.w[k], b.w[k]) for k in a.w)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, ""), (None, "y"), (4, "z" * 100_000)], "doc_id bigint, text string")
    docs = docs.selectExpr("*", "1 as y", "2.0 as score", "'q' as quality")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 7), (None, 0), (99, 0)], "doc_id bigint, quality int")
    for own, want in ((labels, 1.0), (labels.limit(0), 0.5)):
        got = quality.score(docs, quality.train(docs, own, parts=10**9)).collect()
        assert len(got) == 6 and {r.score for r in got} == {want}
    both = labels.union(spark.createDataFrame([(4, 0), (4, 1)], labels.schema))
    got = quality.score(docs, quality.train(docs, both, parts=10**9)).collect()
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and all(0 <= r.score <= 1 for r in got)
    model = quality.train(docs.limit(0), labels)
    assert quality.score(docs.limit(0), model).count() == 0

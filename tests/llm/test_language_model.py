import math
import zlib
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import language_model, queries

SF = "/root/testdata/sf0.001"


def plain(rows, parts=10):
    """(doc_id, held_out, n_tokens, n_known, N, base) of each row."""
    words = lambda t: [*(t or "").encode().lower().split(), None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % parts == 0
    counts = Counter(w for i, t in rows if not out(i) for w in words(t))
    total, kinds = sum(counts.values()), len(counts)  # the end counts as a token
    result = []
    for i, t in rows:
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words(t))
        result.append((i, out(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), total, base))
    return result


def test_base_score_against_plain(spark):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(queries.op4_language_model(spark, SF).collect(), key=lambda r: r.doc_id)
    for r, want in zip(got, sorted(plain(rows)), strict=True):
        assert tuple(r)[:5] == want[:5]
        assert r.base_score == pytest.approx(want[5], rel=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize(("block_bytes", "range_grams"), [(20_000, 10_000), (1 << 30, 3_000), (5_000, 1 << 40)])
def test_blocks_and_ranges_give_the_same_base(spark, block_bytes, range_grams):
    frame = queries.table(spark, SF, "documents")
    one = {r.doc_id: r for r in language_model.score(frame).collect()}
    other = {r.doc_id: r for r in language_model.score(frame, block_bytes=block_bytes, range_grams=range_grams).collect()}
    for i, r in one.items():
        assert tuple(other[i])[:5] == tuple(r)[:5] and other[i].base_score == pytest.approx(r.base_score, rel=1e-9)
        assert abs(other[i].score - r.score) < 0.05 * r.n_tokens  # other arrays have other chance hits
    assert sum(r.score for r in other.values()) == pytest.approx(sum(r.score for r in one.values()), rel=0.01)


def exact_scores(rows, parts=10):
    """The score of each row, by the docstring's formula from exact counts."""
    docs = [(i is not None and zlib.crc32(str(i).encode()) % parts == 0, i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for out, _, ws in docs:
        if not out:
            one.update(ws)
            two.update(zip(["start", *ws[:-1]], ws, strict=True))
            three.update(zip(["start", *ws[:-2]], ws[:-1], ws[1:], strict=True))
    one["start"] = sum(not out for out, _, _ in docs)
    total, kinds = sum(one.values()) - one["start"], len(one) - 1

    def share_and_discount(counts):
        n, n1, n2 = sum(counts.values()), sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        return 1 - n1 / n, n1 / (n1 + 2 * n2)

    s2, d2 = share_and_discount(two)
    s3, d3 = share_and_discount(three)
    scores = {}
    for _, i, ws in docs:
        want = 0.0
        for k, w in enumerate(ws):
            v, u = ws[k - 1] if k else "start", ws[k - 2] if k > 1 else "start"
            p = (one[w] + 0.1) / (total + 0.1 * (kinds + 1))
            if one[v]:
                p = s2 * (max(two[v, w] - d2, 0) + d2 * p) / one[v] + (1 - s2) * p
            if k and two[u, v]:
                p = s3 * (max(three[u, v, w] - d3, 0) + d3 * p) / two[u, v] + (1 - s3) * p
            want += math.log10(p)
        scores[i] = want, len(ws)
    return scores


def test_score_against_exact_counts(spark):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = exact_scores(rows)
    got = {r.doc_id: r.score for r in queries.op4_language_model(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, (score, n) in want.items():
        assert abs(got[i] - score) < 0.1 * n  # quantised counts and chance hits
    assert sum(got.values()) == pytest.approx(sum(s for s, _ in want.values()), rel=0.01)


def test_probabilities_sum_to_at_most_one():
    """Over all words after every context, from the levels that exact counts have."""
    rng = np.random.default_rng(3)
    words = rng.zipf(1.3, 3000).clip(1, 60).tolist()
    docs = [[*words[a : a + 30], None] for a in range(0, 3000, 30)]
    one, two, three = Counter(), Counter(), Counter()
    for ws in docs:
        one.update(ws)
        two.update(zip(["s", *ws[:-1]], ws, strict=True))
        three.update(zip(["s", *ws[:-2]], ws[:-1], ws[1:], strict=True))
    count = lambda c, n: sum(v == n for v in c.values())
    sums = [sum(one.values()), len(one), *(x for c in (two, three) for x in (sum(c.values()), count(c, 1), count(c, 2)))]
    level = lambda n: int(language_model.levels_of(np.array([n]))[0]) if n else 0
    kinds = list(one)
    for u, v in [(a, b) for (a, b) in two if a != "s" and b is not None][:200]:
        total = 0.0
        for w in kinds:  # u v w as a document of three tokens; the last one counts
            _, p3 = language_model.probabilities(
                np.array(sums), np.array([one[u], one[v], one[w]], float), np.array([0, level(two[u, v]), level(two[v, w])]), np.array([0, 0, level(three[u, v, w])]), np.array([0])
            )
            total += p3[2]
        assert 0.2 < total <= 1 + 1e-9


def test_twice_is_told_from_once(spark):
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 1000, 200))  # noqa: E731  hardly a triple comes by chance
    rows = [(i, text()) for i in range(1, 300)]
    rows += [(1000 + i, t) for i, t in rows[:30]]
    own = {r.doc_id: r for r in language_model.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    twice = [i for i, _ in rows[:30] if not own[i].held_out and not own[1000 + i].held_out]
    once = [i for i, _ in rows[30:299] if not own[i].held_out]
    gain = lambda i: (own[i].score - own[i].base_score) / own[i].n_tokens
    assert min(map(gain, twice)) > max(map(gain, once))


def test_filter_has_no_misses():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    counts = rng.zipf(1.5, len(keys)).clip(1, 10**9)
    own = language_model.Filter(keys, counts)
    found, want = own.levels(keys), language_model.levels_of(counts)
    assert (found >= want).all() and (found > want).mean() < 0.02
    assert (own.levels(rng.integers(0, 2**63, 20_000).astype(np.uint64)) > 0).mean() < 0.02
    low, high = language_model.bounds()
    assert (low[want] <= counts).all() and (counts <= high[want]).all()
    assert not language_model.Filter(keys[:0], counts[:0]).levels(keys).any()


@pytest.mark.parametrize("values", [[], [0], [0, 1, 255, 256], [2**63, 5], [254, 255, 70_000]])
def test_packed_numbers_come_back(values):
    own = np.array(values, np.uint64)
    back, at = language_model.from_planes(memoryview(language_model.planes(own)), 0, len(own))
    assert back.tolist() == values and at == len(language_model.planes(own))
    if not len(own) or own.max() < 2**63:
        data = language_model.small(own.astype(np.int64))
        back, at = language_model.from_small(memoryview(data), 0, len(own))
        assert back.tolist() == values and at == len(data)


def test_long_texts(spark):
    long = "lorem ipsum dolor " * 200_000
    rows = [(1, long), (2, "x" * 2_000_000), (3, " " * 2_000_000), (4, "lorem ipsum dolor")]
    got = {r.doc_id: r for r in language_model.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(got[i].n_tokens) for i in (1, 2, 3, 4)] == [600_001, 2, 1, 4]
    for i, r in got.items():
        assert r.base_score == pytest.approx(next(w[5] for w in plain(rows) if w[0] == i), rel=1e-9)


def test_texts_move_once(spark):
    plan = language_model.score(queries.table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") >= 3 and "BroadcastExchange" not in plan


def test_rows(spark):
    rows = [(1, None), (1, ""), (2, "a b a"), (2, "a b a"), (None, "a q"), (3, " \t"), (4, "A B"), (17, "zz a"), (29, "b")]
    frame = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id bigint, text string, n bigint, score double")
    got = sorted((tuple(r)[:6] for r in language_model.score(frame, 3).collect()), key=str)
    want = sorted(plain(rows, 3), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    assert language_model.score(frame.limit(0)).count() == 0
    alone = language_model.score(frame.where("doc_id = 1"), 1).collect()  # nothing to learn from
    assert [(r.n_known, r.train_tokens) for r in alone] == [(0, 0)] * 2

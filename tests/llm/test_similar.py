import random

import numpy as np
import pytest

import corpus_pipeline
from scriptorium.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) > 0


def plain_components(texts):
    """ids -> least id reachable over links of Jaccard similarity 0.8 or more."""
    sets = {i: plain_set(t) for i, t in texts.items()}
    label, ids = {}, sorted(texts)
    for i in ids:
        if i in label:
            continue
        label[i], queue = i, [i]
        while queue:
            at = queue.pop()
            near = [j for j in ids if j not in label and alike(sets[at], sets[j])]
            label |= dict.fromkeys(near, i)
            queue += near
    return label


def changed(text, n, rng):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.random()}"
    return " ".join(words)


def test_stage_drops_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    least = plain_components(texts)
    assert least[145] == 6 and least[177] == 1  # similarity 0.83, 7 and 11 bits of a 64-bit SimHash apart
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [i for i in sorted(texts) if least[i] == i]


@pytest.mark.parametrize(("sets", "most_missed"), [(100, 0.03), (200_000, 0.03), (20_000_000, 0.08)])  # measured: 0.01, 0.01 and 0.04, here with the noise of 300 pairs
def test_recall_of_single_pairs(sets, most_missed):
    """Pairs of nothing but each other, close to the threshold: what the masks of the index find of them."""
    rng, found = random.Random(11), {0.8: [], 0.85: [], 0.9: []}
    chosen = np.array(simhash.masks(*simhash.index_shape(sets)), np.int64)
    for k in range(900):
        n = rng.randint(60, 400)
        least = (0.8, 0.85, 0.9)[k % 3]
        own = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        gone = round(n * (1 - least) / (1 + least))  # so many shingles replaced
        other = np.concatenate((own[gone:], np.array([rng.getrandbits(64) for _ in range(gone)], np.uint64)))
        apart = np.array(simhash.wide_fingerprint(np.unique(own)), np.int64) ^ np.array(simhash.wide_fingerprint(np.unique(other)), np.int64)
        found[least].append(bool(((apart & chosen) == 0).all(1).any()) and int(np.bitwise_count(apart.view(np.uint64)).sum()) <= simhash.WIDE)
    missed = [1 - np.mean(found[s]) for s in found]
    assert missed[0] < most_missed and missed[1] < 0.03 and missed[2] < 0.01


@pytest.mark.parametrize(("group_limit", "limit"), [(20_000, 1000), (6, 4)])
def test_against_brute_force(spark, group_limit, limit):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 200)))
        texts += [base, *(changed(base, n, rng) for n in (1, 1, 2))]
    chain = [" ".join(f"c{i}" for i in range(k, k + 100)) for k in range(0, 60, 6)]  # only neighbours are alike
    star = " ".join(f"s{i}" for i in range(300))
    texts += [*chain, star, *(changed(star, 5, rng) for _ in range(30)), "", " ", "One two", "one  TWO", "a b c d e f g"]
    texts = dict(enumerate(rng.sample(texts, len(texts))))
    want = plain_components(texts)
    assert 40 < len(set(want.values())) < len(want)
    found = simhash.similar(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), group_limit=group_limit, limit=limit)
    assert {r.doc_id: r.component_id for r in found.collect()} == want


def test_forest_of_wide_codes_is_complete():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**63, (30, 2), dtype=np.uint64)[rng.integers(0, 30, 500)]
    flips = (rng.random((500, 128)) < 0.1).astype(np.uint8)
    codes = np.unique(codes ^ np.packbits(flips, axis=1).view(np.uint64), axis=0)
    keys = np.sort(rng.integers(0, 3, len(codes)))
    order = np.lexsort((simhash.gray_rank(codes[:, 1]), simhash.gray_rank(codes[:, 0]), keys))
    codes, keys = codes[order], keys[order]
    label, n = np.arange(len(codes)), len(codes)
    near = (np.bitwise_count(codes[:, None] ^ codes[None]).sum(2) <= 20) & (keys[:, None] == keys[None])
    for _ in range(n):
        now = np.where(near, label[None], n).min(1)
        if (now == label).all():
            break
        label = now
    assert simhash.forest(keys, codes, 20).tolist() == label.tolist()


def test_edge_cases(spark):
    text = " ".join(map(str, range(50)))
    rows = [(7, None), (3, ""), (5, " \t\n"), (9, "Aa b"), (9, "aA B"), (None, "aa b"), (11, "x"), (20, text), (20, "another text"), (None, text + " 50"), (13, text + " 51")]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, digest string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.similar(frame).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (5, 3), (9, 9), (9, 9), (None, 9), (11, 11), (20, 13), (20, 13), (None, None), (13, 13)], key=str)
    assert simhash.similar(frame.limit(0)).count() == 0


def test_long_texts(spark):
    texts = {1: "word " * 400_000, 2: "word " * 400_001, 3: "x" * 2_000_000, 4: " " * 2_000_000, 5: " ".join(f"w{k}" for k in range(200_000)), 6: " ".join(f"w{k}" for k in range(200_003))}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar(frame).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}[2] == 1

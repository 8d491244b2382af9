import numpy as np
import pytest
import xxhash

from scriptorium.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """ids -> least id reachable over links of 3 bits or fewer."""
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if label[j] < label[i] and (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[i], changed = label[j], True
    return label


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = {d.doc_id: plain_print(d.text) for d in docs}
    want = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_long_text_in_blocks():
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    assert simhash.fingerprint(text, block=64) == plain_print(text.decode())


@pytest.mark.parametrize("limit", [20_000, 8])
def test_links_are_complete_whatever_the_group_limit(spark, limit):
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, 40, dtype=np.uint64)[rng.integers(0, 40, 600)]
    for _ in range(4):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)) * (rng.random(600) < 0.6)
    codes = np.unique(codes).tolist()
    frame = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)), i) for i, c in enumerate(codes)], "bits bigint, first_id bigint")
    label = dict(enumerate(range(len(codes))))
    found = simhash.components(simhash.links(frame, limit)).collect()
    label |= {r.id: r.component_id for r in found}
    assert label == plain_components(dict(enumerate(codes)))


def test_edge_cases(spark):
    rows = [(7, None), (3, ""), (5, " \t\n"), (9, "Aa b"), (9, "aA B"), (None, "aa b"), (11, "x")]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, bits string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (5, 3), (9, 9), (9, 9), (None, 9), (11, 11)], key=str)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0

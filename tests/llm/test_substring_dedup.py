import hashlib
import random
import re

import pytest

from scriptorium.llm import queries, substring_dedup

SF = "/root/testdata/sf0.001"


def plain(rows, window=13):
    """doc_id, kept words, removed count, by the least doc_id of every window."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, ws in words:
        if i is not None:
            for k in range(len(ws) - window + 1):
                key = tuple(ws[k : k + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, ws in words:
        gone = set()
        if i is not None:
            for k in range(len(ws) - window + 1):
                if least[tuple(ws[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def test_query_against_brute_force(spark):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain(rows)}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op8_substring_dedup(spark, SF).collect()}
    assert got == want
    assert sum(n for _, n, _ in got.values())


@pytest.mark.parametrize(("window", "hot"), [(13, 2000), (13, 1), (6, 3), (3, 2000)])
def test_random_texts(spark, window, hot):
    rng = random.Random(window + hot)
    passages = [" ".join(rng.choice("abcdé") for _ in range(rng.randint(1, 30))) for _ in range(25)]
    rows = [(rng.randint(0, 40), " ".join(rng.choice(passages) for _ in range(rng.randint(0, 6)))) for _ in range(60)]
    rows += [(None, rows[0][1]), (3, None), (4, ""), (5, " \t "), (rows[1][0], rows[1][1]), (99, "a " * 500), (98, "a " * 400)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, anchor string, first int")
    got = substring_dedup.remove_repeats(frame, window, hot).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == sorted(plain(rows, window), key=str)
    assert all(sum(s.after - s.first for s in r.spans) == r.n_removed for r in got)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert substring_dedup.remove_repeats(frame).count() == 0

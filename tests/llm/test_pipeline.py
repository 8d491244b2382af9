import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from scriptorium.llm import bpe, quality

from .test_decontaminate import plain as plain_hits
from .test_similar import plain_components
from .test_substring_dedup import plain as plain_repeats

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("lang", "kept")  # a name that a stage uses itself
    columns = docs.columns
    at = {c: columns.index(c) for c in columns}
    steps = dict(corpus_pipeline.STAGES)

    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = steps["quality"](spark, docs, SF)
    assert rows_of(good) == sorted((tuple(r) for r in docs.collect() if model.score(r.text.encode()) >= 0.3), key=str)

    good = docs.where("doc_id % 10 <> 3")
    least = plain_components({r.doc_id: r.text for r in good.collect()})
    unique = steps["near_duplicates"](spark, good, SF)
    assert rows_of(unique) == sorted((tuple(r) for r in good.collect() if least[r.doc_id] == r.doc_id), key=str)
    assert unique.columns == columns

    without = steps["repeated_passages"](spark, unique, SF)
    kept = {i: (gone, text) for i, _, gone, text in plain_repeats([(r.doc_id, r.text) for r in unique.collect()])}
    want = []
    for r in unique.collect():
        row, (gone, text) = list(r), kept[r.doc_id]
        if gone:
            row[at["text"]], row[at["n_chars"]] = text, len(text)
        want.append(tuple(row))
    assert rows_of(without) == sorted(want, key=str) and without.columns == columns and any(g for g, _ in kept.values())

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = steps["decontaminated"](spark, without, SF)
    hits = {r.doc_id: plain_hits(r.text, items) for r in without.collect()}
    dirty = {i for i, (n, hit, _) in hits.items() if hit and 20 * hit >= n}
    assert dirty and rows_of(clean) == sorted((tuple(r) for r in without.collect() if r.doc_id not in dirty), key=str)

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in clean.collect()}
    coded = steps["encoded"](spark, clean, SF).collect()
    assert {r.doc_id for r in coded} == set(texts)
    for r in coded:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, bytes(r.ids)) == (len(ids), b"".join(i.to_bytes(4, "little") for i in ids))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows_go_through(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "a b c"), (None, None), (7, "only one of its kind " * 30)]
    docs = spark.createDataFrame([(i, t, len(t or ""), "x", 1) for i, t in rows], "doc_id bigint, text string, n_chars bigint, items string, component_id int")
    for data in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, data, SF)
            if name != "encoded":
                assert out.columns == data.columns
                data = out
        assert out.count() == (5 if data.columns and docs.count() and not data.isEmpty() else 0)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    n = out.count()
    assert 0 < n < 200 and set(out.columns) >= {"doc_id", "n_tokens"}


def test_rows_of_one_id_and_long_texts(spark):
    """Of rows with one doc_id the least by the text stays, however the frame is dealt; long texts go through every stage."""
    own = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, "b text", 3, "x"), (1, "a text", 9, "y"), (1, "a text", 7, "z"), (2, own, 0, "x"), (3, " " * 2_000_000, 0, "x"), (4, "q" * 2_000_000, 0, "x"), (5, None, 1, "x"), (5, "only", 1, "x")]
    docs = spark.createDataFrame([(i, t, len(t or ""), n, s) for i, t, n, s in rows], "doc_id bigint, text string, n_chars bigint, _row int, source string")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    for n in (1, 5):
        kept = {r.doc_id: (r.text, r["_row"], r.source) for r in stage(spark, docs.repartition(n), SF).collect()}
        assert kept == {1: ("a text", 7, "z"), 2: (own, 0, "x"), 3: (" " * 2_000_000, 0, "x"), 4: ("q" * 2_000_000, 0, "x")}  # document 5 has a row without words, as 3 has
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert 3 <= out.count() <= len(rows)
        docs = docs if name == "encoded" else out

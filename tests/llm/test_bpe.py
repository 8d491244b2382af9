import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from scriptorium.llm import bpe, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_against_the_library(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op10_byte_bpe(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(d.text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert got[d.doc_id] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


def test_odd_white_space_and_long_words(library, ranks):
    rng = random.Random(1)
    letters = "abcdeABC  \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0᠎​ 　﻿0129\xb2\xbd'''.,!\xe9中\U0001f600_"
    encoder, decoder = bpe.Encoder(ranks, public_tokenizers.PATTERN, memo=50), bpe.Decoder(ranks)
    for k in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + "ab" * (k % 90)
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert decoder.decode(ids) == text.encode()


def test_rows(spark):
    frame = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "hi", "x"), (2, "a" * 200_000, "x"), (2, "a" * 200_000, "x")], "doc_id bigint, text string, ids string")
    got = bpe.encode(frame, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(r.n_tokens for r in got)[:3] == [0, 0, 1]
    assert sorted(len(r.decoded) for r in got) == [0, 0, 2, 200_000, 200_000]
    assert bpe.encode(frame.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_native_fold(spark, library, ranks):
    words = ["a", "the", " the", "thinondble", "  ", "中文", "x9", "", "aaaaaaaa"]
    got = {r.word: list(r.ids) for r in bpe.fold_words(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()}
    assert got == {w: library.encode_ordinary(w) for w in words}

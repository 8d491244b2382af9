import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from scriptorium.llm import bpe, queries, token_counts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain(text, ranks, library, rule):
    """Counts by walking over every byte."""
    raw = text.encode()
    lines = raw.split(b"\n")
    sizes = [len(x) + 1 for x in lines[:-1]] + ([len(lines[-1])] if lines[-1] or len(lines) == 1 else [])
    owner = [k for k, n in enumerate(sizes) for _ in range(n)]
    pieces = {r: t for t, r in ranks.items()}
    counts, at = [0.0] * len(sizes), 0
    for t in library.encode_ordinary(text):
        held = owner[at : at + len(pieces[t])]
        at += len(pieces[t])
        if rule == "start":
            counts[held[0]] += 1
        elif rule == "majority":
            counts[max(sorted(set(held)), key=held.count)] += 1
        else:
            for k in held:
                counts[k] += 1 / len(held)
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_rules_against_plain(spark, rule):
    ranks = bpe.read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {1: "a\n\n\nb  \n  c", 2: "", 3: "one line", 4: "é\n\n中文\n \n\n\n\n", 5: "\n", 6: "x\n" * 50, 7: "  \n \n\t\n  end", 8: None}
    frame = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id bigint, text string, section int")
    rows = sorted(token_counts.section_tokens(frame, PATH, public_tokenizers.PATTERN, rule).collect(), key=lambda r: (r.doc_id, r.section))
    for i, text in texts.items():
        own, text = [r for r in rows if r.doc_id == i], text or ""
        assert [r.n_tokens for r in own] == pytest.approx(plain(text, ranks, library, rule))
        assert "".join(text[r.first_char : r.after_char] for r in own) == text
        assert sum(r.n_tokens for r in own) == pytest.approx(own[0].doc_tokens)
    assert any(r.crossing for r in rows)


def test_query_against_plain(spark):
    ranks = bpe.read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sorted(queries.op2_token_counts(spark, SF).collect(), key=lambda r: (r.doc_id, r.section))
    assert {r.doc_id for r in rows} == set(docs)
    for i, text in docs.items():
        own = [r for r in rows if r.doc_id == i]
        assert [r.n_tokens for r in own] == plain(text, ranks, library, "start")
        assert "".join(text[r.first_char : r.after_char] for r in own) == text
        assert {r.doc_tokens for r in own} == {len(library.encode_ordinary(text))}


def test_long_texts(spark):
    texts = {1: " " * 2_000_000, 2: "\n" * 300_000, 3: "x" * 2_000_000, 4: "word " * 400_000}
    rows = token_counts.section_tokens(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), PATH, public_tokenizers.PATTERN)
    got = {r.doc_id: (r.sections, r.tokens, r.doc, r.chars) for r in rows.groupBy("doc_id").agg(F.count("section").alias("sections"), F.sum("n_tokens").alias("tokens"), F.max("doc_tokens").alias("doc"), F.max("after_char").alias("chars")).collect()}
    for i, text in texts.items():
        sections, tokens, doc, chars = got[i]
        assert (sections, tokens, chars) == (300_000 if i == 2 else 1, doc, len(text)) and 0 < doc <= len(text)


def test_edges(spark):
    frame = spark.createDataFrame([(None, "a\nb"), (2, "x"), (2, "x")], "doc_id bigint, text string")
    got = token_counts.section_tokens(frame, PATH, public_tokenizers.PATTERN)
    assert sorted(((r.doc_id, r.section) for r in got.collect()), key=str) == [(2, 0), (2, 0), (None, 0), (None, 1)]
    assert token_counts.section_tokens(frame.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(frame, PATH, public_tokenizers.PATTERN, "none")

import hashlib
import random
import re

from scriptorium.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, window=13):
    doc, hit, found = plain_words(text), set(), set()
    for item, it_text in items:
        words = plain_words(it_text)
        n = min(window, len(words))
        if not n:
            continue
        windows = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        for i in range(len(doc) - n + 1):
            if tuple(doc[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item or "")
    return len(doc), len(hit), sorted(found)


def test_query_against_brute_force(spark):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op7_decontaminate(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n, hit, found = plain(d.text, items)
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert got[d.doc_id] == (n, hit, len(found), digest, hit > 0 and 20 * hit >= n)
    assert any(g[-1] for g in got.values())


def test_random_texts_with_few_words_and_shards(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abC") for _ in range(n))
    items = [(f"i{k}", text(rng.randint(0, 9))) for k in range(12)] + [("i0", text(6)), (None, "Zé z"), ("none", None)]
    docs = [(k, text(rng.randint(0, 60))) for k in range(60)] + [(100, None), (100, "x zé Z x"), (101, "")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, items string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = sorted((i, *plain(t, items, 5)) for i, t in docs)
    for words, at_once in ((1 << 20, 4), (8, 3), (5, 1)):  # one automaton, several in a pass, several passes
        found = decontaminate.judged(decontaminate.find_windows(frame, bench, 5, words, at_once)).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found) == want


def test_items_of_one_text_and_shards(spark):
    """Copies of an item are one sequence with all their ids, however the rest is cut into shards."""
    words = [f"w{k}" for k in range(60)]
    items = [(f"copy{k}", " ".join(words[:20])) for k in range(9)] + [(f"own{k}", " ".join(words[k : k + 14])) for k in range(0, 40, 2)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = [(1, " ".join(words)), (2, " ".join(["x", *words[5:19], "y"])), (3, "X " * 50)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = sorted((i, *plain(t, items)) for i, t in docs)
    for words_, at_once in ((1 << 20, 4), (30, 2), (1, 1)):
        found = decontaminate.judged(decontaminate.find_windows(frame, bench, shard_words=words_, pass_shards=at_once)).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found) == want
    assert len(want[1][3]) > 9


def test_spans_are_cut_out(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    bench = spark.createDataFrame([("a", item), ("b", "Zwei Wörter")], "item_id string, text string")
    texts = {1: f"Éa, {item.upper()}! end.", 2: "no\thit  here", 3: None, 4: "", 5: f"x zwei--wörter y {item} z", 6: item, 7: "pad " * 900 + "zwei wörter"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").selectExpr("*", "'q' as clean_")
    found = decontaminate.find_windows(frame, bench)
    clean = lambda **k: {r.doc_id: r.clean for r in decontaminate.without_spans(found, **k).collect()}
    assert clean() == {1: "Éa, ! end.", 2: "no\thit  here", 3: None, 4: "", 5: "x  y  z", 6: "", 7: "pad " * 900}
    assert clean(least=13)[5] == "x zwei--wörter y  z"
    assert clean(percent=5)[7] == texts[7] and clean(percent=5)[5] == "x  y  z"


def test_long_texts(spark):
    bench = spark.createDataFrame([("a", " ".join(f"w{k}" for k in range(20)))], "item_id string, text string")
    texts = {1: "w0 " * 700_000, 2: " " * 2_000_000 + " ".join(f"w{k}" for k in range(20)), 3: "w" * 2_000_000}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.judged(decontaminate.find_windows(frame, bench)).collect()}
    assert got == {1: (700_000, 0), 2: (20, 20), 3: (1, 0)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    row = decontaminate.judged(decontaminate.find_windows(docs, none)).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
    assert decontaminate.find_windows(docs.limit(0), none).count() == 0

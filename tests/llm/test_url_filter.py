import random

from scriptorium.llm import queries, url_filter

SF = "/root/testdata/sf0.001"


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h) + len(p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_query_against_plain(spark):
    got = {r.page_id: tuple(r)[1:] for r in queries.op9_url_filter(spark, SF).collect()}
    assert got == {r.page_id: plain(r.url, queries.URL_RULES) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def test_random_urls(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aB.") for _ in range(rng.randint(0, 4)))
    tail = lambda: "".join(rng.choice("/a?#:é\n") for _ in range(rng.randint(0, 6)))
    urls = [f"http://{word()}{tail()}" for _ in range(300)] + [None, "", "no host", "x://", "://A.b/", "a://b://c/", "http://É.A.b/a"]
    rules = [(rng.choice(["allow", "block"]), word().lower(), "/" * rng.randint(0, 1) + "a" * rng.randint(0, 2)) for _ in range(40)]
    pages = spark.createDataFrame([(k % 50, u, "x") for k, u in enumerate(urls)], "page_id bigint, url string, rule string")
    frame = spark.createDataFrame([*rules, (None, "a", "/")], "action string, host string, path string")
    want = sorted(((k % 50, *plain(u, rules)) for k, u in enumerate(urls)), key=str)
    for most in (256, 1):
        monkeypatch.setattr(url_filter, "MOST_LENGTHS", most)
        assert sorted(map(tuple, url_filter.filter_urls(pages, frame).collect()), key=str) == want
    assert {r.verdict for r in url_filter.filter_urls(pages, frame.limit(0), "block").collect()} == {"block"}
    assert url_filter.filter_urls(pages.limit(0), frame).count() == 0


def test_repeated_and_unnamed_rows_and_long_urls(spark):
    long = "http://" + ".".join("a" * 60 for _ in range(30)) + ".com/fr/" + "x" * 100_000
    rows = [(None, "http://a.com/fr/1"), (None, "http://a.com/fr/1"), (3, "http://a.com/fr/1"), (4, long), (None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "action string, host string, path string")
    got = sorted(map(tuple, url_filter.filter_urls(pages, rules, "block").collect()), key=str)
    want = [(i, *plain(u, queries.URL_RULES)) for i, u in rows]
    assert got == sorted([(*w[:4], w[4] if w[3] else "block") for w in want], key=str)


def test_rows_are_found_again_after_a_shuffle(spark):
    """Nothing depends on the order in which a frame comes out when it's computed anew."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rules = spark.createDataFrame(queries.URL_RULES, "action string, host string, path string")
    want = sorted(map(tuple, url_filter.filter_urls(pages, rules).collect()))
    assert sorted(map(tuple, url_filter.filter_urls(pages.repartition(13), rules).collect())) == want

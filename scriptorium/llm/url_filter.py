"""Operator 9: URL filter lists by host-suffix and path-prefix expressions.

Each URL expands to every suffix of its host at label boundaries, joined with every prefix of
its path that has the length of some rule's path. Expressions meet rules by an equi-join on the
first four bytes of their SHA-256; full digests confirm a match, and the longest rule wins
(then the one with the longer host, then block before allow). Only built-in expressions are
used. A verdict depends on the host and the path alone, so each distinct pair of them is judged once and meets its pages by
the pair; of a page only its id, host and path move.

Rules join without a hint, so Spark broadcasts them below its own size threshold and shuffles
beyond it. Path lengths come from the rules as a list of at most ``MOST_LENGTHS`` numbers; a
rule list with more kinds of lengths expands all prefixes instead.

Cases: a null url, or one without ``://``, has an empty host and path and falls to the default
verdict. Repeated rows get a verdict each. Repeated rules count once; a rule with a null part
is void. Empty tables give no rows, or the default for every row. Columns other than page_id
and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import halved

MOST_LENGTHS = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    """After the first ``://``, up to a slash, question mark, hash or the end; A-Z lowered."""
    found = F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: str) -> Column:
    """After the host, up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression.cast("binary"), 256))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (page_id, url), rules (action, host, path): page_id, host, path, rule, verdict for every page."""
    rules = rules.select("action", "host", "path").dropna().distinct()
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().limit(MOST_LENGTHS + 1).collect())
    urls = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    labels = F.split("host", r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if len(lengths) <= MOST_LENGTHS:
        sizes = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    else:
        sizes = F.sequence(F.lit(0), F.length("path"))
    tries = (
        urls.select("host", "path").distinct()
        .select("host", F.explode(hosts).alias("suffix"), sizes.alias("sizes"), "path")
        .select("host", "suffix", F.explode("sizes").alias("size"), "path")
        # a newline can be in neither, so that no two pairs give one expression
        .select("host", "path", _digest(F.concat("suffix", F.lit("\n"), F.substring("path", F.lit(1), F.col("size")))).alias("full"))
        .withColumn("short", F.substring("full", 1, 4))
    )
    known = rules.select(
        _digest(F.concat("host", F.lit("\n"), "path")).alias("rule_full"), F.concat("host", "path").alias("rule"), "action",
        (F.length("host") + F.length("path")).alias("long"), F.length("host").alias("long_host"),
    ).withColumn("short", F.substring("rule_full", 1, 4))
    best = F.max(F.struct("long", "long_host", (F.col("action") == "block").alias("blocks"), "rule", "action"))
    found = tries.join(known, "short").where("full = rule_full").groupBy("host", "path", halved("host")).agg(best.alias("best")).select("host", "path", "best.rule", "best.action")
    return urls.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))

"""URL filters: rules by host and path, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One of these rejects a URL.
STRICT = (
    "adult-x", "ads-track", "casino", "casinos", "cheap-pills", "cialis", "escort", "escorts", "free-bets", "hardcore", "hentai", "malware", "milf",
    "payday-loan", "payday-loans", "phishing", "porn", "porno", "pornhub", "sexcam", "sexcams", "spam-farm", "sportsbook", "viagra", "warez", "webcam-sex", "xvideos", "xxx",
)
#: SOFT_HITS different ones of these reject a URL.
SOFT = (
    "ads", "adult", "bet", "bets", "betting", "bonus", "cam", "cheap", "click", "coupon", "crack", "dating", "deals", "farm", "free", "gambling", "girls", "hot", "jackpot", "keygen",
    "loan", "loans", "lottery", "nude", "pills", "poker", "promo", "seo", "sex", "slots", "spam", "torrent", "track", "tracker", "win", "winner",
)
SOFT_HITS = 2
#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://``, empty."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end; without ``://``, empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule fits its host and all hosts that end in a dot and it, if the path starts with its path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest is looked at first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def automaton(strict=STRICT, soft=SOFT):
    a = ahocorasick.Automaton()
    for t in soft:
        a.add_word(t, (t, False))
    for t in strict:
        a.add_word(t, (t, True))
    a.make_automaton()
    return a


def hits(url: str, a) -> tuple[int, int]:
    """Different strict and soft terms in a URL. A term counts only between characters that aren't letters or digits."""
    url, strict, soft = url.lower(), set(), set()
    for end, (term, is_strict) in a.iter(url):
        start = end - len(term) + 1
        if (start == 0 or not url[start - 1].isalnum()) and (end + 1 == len(url) or not url[end + 1].isalnum()):
            (strict if is_strict else soft).add(term)
    return len(strict), len(soft)


def judged(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """Per page: page_id, host, path, rule (null without one), verdict (allow or block), strict_hits, soft_hits.

    The rule's verdict holds; without a rule, the URL is blocked if it has one strict term or ``soft_hits`` different soft
    ones, anywhere from host to fragment. A null URL, or one without ``://``, has an empty host and path and so no
    rule; a null or empty one has no terms and is allowed. Repeated rows are judged each; an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(strict, soft)
        for b in batches:
            n = [hits(u, a) if u else (0, 0) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in n], pa.int32()), pa.array([y for _, y in n], pa.int32())], ["page_id", "url", "strict_hits", "soft_hits"]
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.mapInArrow(count, "page_id bigint, url string, strict_hits int, soft_hits int")
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "strict_hits", "soft_hits")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_hits), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "strict_hits", "soft_hits")


def sql(rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS) -> str:
    """The same in DuckDB's SQL, for ASCII URLs."""

    def terms(words) -> str:
        return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){re.escape(w)}([^a-z0-9]|$)')::INT" for w in words)

    cases = {"rule": "", "verdict": ""}
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r)):
        fits = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        cases["rule"] += f" {fits} THEN '{h}{p}'"
        cases["verdict"] += f" {fits} THEN '{v}'"
    return rf"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, lower(coalesce(url, '')) AS u
  FROM pages),
h AS (SELECT *, {terms(strict)} AS strict_hits, {terms(soft)} AS soft_hits FROM p)
SELECT page_id, host, path, CASE{cases["rule"]} END AS rule,
       CASE{cases["verdict"]} WHEN strict_hits > 0 OR soft_hits >= {soft_hits} THEN 'block' ELSE 'allow' END AS verdict, strict_hits, soft_hits
FROM h
"""

"""URL filters: pattern rules found by their rarest literal token, in DataFrame functions only.

A rule is a host with a path, or a pattern. A host rule fits its host and all subdomains where the url's path
starts with the rule's. A pattern is text in which ``||`` at the start stands for the start of the host or of one of its labels,
``*`` for anything and ``^`` for a separator or the end; it may fit anywhere else. Both look at host and path alone.

Words of a rule that any url it fits must hold as whole words (runs of a-z and 0-9) can serve to find it. Their numbers are
counted over all urls, and each rule is filed under its rarest. A url looks up its own words in that index, by hash,
and only the rules found there run their regular expression. Rules without such a word are filed under the empty word, which every url has, so none is missed.
The index is a constant of the plan, ``CHUNK`` rules at a time; a row is judged by itself, so nothing is shuffled
but the word counts, which are aggregated where the urls are.

Of the host rules that fit, the longest wins (ties: the lesser text, then block); where none fits, the longest of the patterns that fit;
where none does, the verdict is allow.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no host rule and is judged as any other; empty and
very long urls are read whole; rows that repeat are judged alike; other columns stay out of the way, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.common import free_names, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[a-z0-9]+"
#: Rules in one constant of the plan.
CHUNK = 5_000
ENTRY = "word string, regex string, exact boolean, size int, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    """``exact``: a host and path such as ``example.net/en/``; else a pattern."""

    text: str
    verdict: str = "block"
    exact: bool = False

    def regex(self) -> str:
        """A Java regular expression over host and path."""
        quoted = lambda x: re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", x)
        if self.exact:
            host, slash, path = self.text.partition("/")
            return r"^(?:[^/]*\.)?" + quoted(host + slash + path) + ("" if slash else "(?=/|$)")
        body = self.text.removeprefix("||")
        start = r"(?:[^/]*?\.)??" if body != self.text else r"(?s:.*?)"
        pieces = [quoted(x).replace(r"\^", "(?:[^A-Za-z0-9_.%-]|$)") for x in body.split("*")]
        # Each piece is taken at its first place after the one before, and stays there, so the time is linear.
        return r"\A" + "".join(f"(?>{start if i == 0 else '(?s:.*?)'}{x})" for i, x in enumerate(pieces))

    def words(self) -> list[str]:
        """Words that any url the rule fits has as whole words."""
        body = self.text.removeprefix("||").translate(str.maketrans(UPPER, LOWER))
        anchored = self.exact or body != self.text.translate(str.maketrans(UPPER, LOWER))
        closed = self.exact and "/" not in body
        found = []
        for m in re.finditer(WORD, body):
            left = m.start() == 0 and anchored or m.start() > 0 and body[m.start() - 1] != "*"
            right = m.end() == len(body) and closed or m.end() < len(body) and body[m.end()] != "*"
            if left and right:
                found.append(m[0])
        return found


#: The rules of the registered query, and patterns chosen here for what they leave open: names of sites that sell, bet or track.
HOST_RULES = [Rule("net/", "block", True), Rule("example.net/en/", "allow", True), Rule("example.com/de/", "block", True), Rule("org/fr/", "allow", True)]
PATTERNS = [Rule(x) for x in ("||ads-*.", "||adult-*.", "||casino-*.", "||spam-*.", "||*-pills.", "||*-bets.", "/adserver/", "/popunder^", "/doorway/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) after the first ``://`` up to / ? # or the end; path from there up to ? # or the end."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def url_words(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(target, UPPER, LOWER), F.lit(WORD), F.lit(0)))


def word_counts(pages: DataFrame, rules: list[Rule], url: str = "url") -> dict[str, int]:
    """In how many rows each word of a rule occurs; there are no more of them than the rules have words."""
    known = sorted({w for r in rules for w in r.words()})
    if not known:
        return {}
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.explode(url_words(F.concat(host, path))).alias("word")).filter(F.col("word").isin(known))
    return {r.word: r.n for r in rows.groupBy("word").agg(F.count("*").alias("n")).collect()}


def filed(rules: list[Rule], counts: dict[str, int]) -> list[list[dict]]:
    """The index: rules in buckets by the checksum of their rarest word (ties: the longest, then the least)."""
    buckets: list[list[dict]] = [[] for _ in range(max(1, 2 * len(rules)))]
    for r in rules:
        word = min(r.words(), key=lambda w: (counts.get(w, 0), -len(w), w), default="")
        buckets[zlib.crc32(word.encode()) % len(buckets)].append({"word": word, "regex": r.regex(), "exact": r.exact, "size": len(r.text), "rule": r.text, "verdict": r.verdict})
    return buckets


def fitting(target: Column, words: Column, buckets: list[list[dict]]) -> Column:
    """array of ENTRY: the rules that fit."""
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>>")
    found = F.flatten(F.transform(words, lambda w: F.filter(F.get(index, F.pmod(F.crc32(w.cast("binary")), F.lit(len(buckets))).cast("int")), lambda r: r["word"] == w)))
    return F.filter(found, lambda r: F.regexp_like(target, r["regex"]))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the host rule that won, else null), pattern (the pattern that won, else null), verdict.

    Where ``pages`` has columns of these names, the added ones get an underscore more.
    """
    counts = word_counts(pages, rules, url)
    names = pages.columns
    host, path, rule, pattern, verdict, target, words, best = free_names(names, "host", "path", "rule", "pattern", "verdict", "url_target", "url_words", "url_best")
    h, p = host_and_path(F.col(url))
    rows = pages.withColumns({host: h, path: p})
    rows = rows.withColumn(target, F.concat(host, path))
    rows = rows.withColumn(words, F.array_append(url_words(F.col(target)), F.lit("")))
    rank = lambda r: F.struct(r["exact"].alias("exact"), r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))
    order = lambda x, y: F.when(x["exact"] != y["exact"], F.when(x["exact"], 1).otherwise(-1)).when(x["size"] != y["size"], F.signum(x["size"] - y["size"]).cast("int")).when(x["rule"] != y["rule"], F.when(x["rule"] < y["rule"], 1).otherwise(-1)).when(x["verdict"] == y["verdict"], 0).when(x["verdict"] == "block", 1).otherwise(-1)
    win = lambda x, y: F.when(x.isNull() | (order(y, x) > 0), y).otherwise(x)
    kind = "struct<exact:boolean,size:int,rule:string,verdict:string>"
    won = F.lit(None).cast(kind)
    for at in range(0, len(rules), CHUNK):
        fits = F.transform(fitting(F.col(target), F.col(words), filed(rules[at : at + CHUNK], counts)), rank)
        rows = rows.withColumn(best, F.aggregate(fits, won, lambda acc, r: win(acc, r.cast(kind))))
        won = F.col(best)
    won = F.col(best) if rules else won
    exact = F.coalesce(won["exact"], F.lit(False))
    return rows.select(*[F.col(f"`{c}`") for c in names], host, path, F.when(exact, won["rule"]).alias(rule), F.when(~exact, won["rule"]).alias(pattern), F.coalesce(won["verdict"], F.lit("allow")).alias(verdict))


def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), HOST_RULES + PATTERNS).select("page_id", "host", "path", "rule", "verdict")


# The patterns as plain regular expressions, each over every url.
ORACLE_OP13 = r"""
WITH parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
judged AS (SELECT p.page_id, p.host, p.path,
  (SELECT max_by(r.host || r.path, length(r.host || r.path)) FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule FROM parts p)
SELECT page_id, j.host, j.path, rule, CASE WHEN rule IS NOT NULL THEN r.verdict
  WHEN regexp_matches(j.host || j.path, '(?s)^([^/]*\.)?(ads|adult|casino|spam)-.*\.|-(pills|bets)\.|/adserver/|/doorway/|/popunder([^A-Za-z0-9_.%-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM judged j LEFT JOIN rules r ON rule = r.host || r.path
"""

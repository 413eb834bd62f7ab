"""URL rules found by their rarest literal token; only the rules so found run their pattern.

A rule is a host and the start of a path, with a verdict. Its literal tokens are the labels of
its host and those segments of its path that are whole (a `/` follows). The rule is kept under
the token that the urls hold least often; a url looks up its own tokens.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Rules that one index holds; longer lists are judged index by index, and the longest rule of all wins.
INDEX_RULES = 100_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def tokens(self) -> list[str]:
        return [*self.host.split("."), *(x for x in self.path.split("/")[:-1] if x)]

    def pattern(self) -> str:
        return rf"(?:.*\.)?{re.escape(self.host)}\n{re.escape(self.path)}.*"


def parse_rules(lines: str | list[str]) -> list[Rule]:
    """`allow host/path` or `block host/path`, separated by commas or line ends."""
    out = []
    for line in re.split(r"[,\n]", lines) if isinstance(lines, str) else lines:
        if line.strip():
            verdict, _, rule = line.strip().partition(" ")
            host, slash, path = rule.strip().partition("/")
            out.append(Rule(verdict, host.lower(), slash + path))
    return out


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(F.split(host, r"\."), F.split(path, "/")))


def token_frequencies(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many rows of urls (host, path) hold each literal token of the rules; at most as many entries as the rules have tokens."""
    names = sorted({t for r in rules for t in r.tokens()})
    if not names:
        return {}
    held = F.array_intersect(_tokens(F.col("host"), F.col("path")), F.array(*map(F.lit, names)))
    return {r[0]: r[1] for r in urls.select(F.explode(held).alias("token")).groupBy("token").count().collect()}


def _matcher(rules: list[Rule], seen: dict[str, int]):
    index: dict[str, list[tuple[Rule, re.Pattern]]] = {}
    for rule in rules:
        rarest = min(rule.tokens(), key=lambda t: (seen.get(t, 0), t))
        index.setdefault(rarest, []).append((rule, re.compile(rule.pattern(), re.S)))

    def longest(host: str, path: str) -> Rule | None:
        fit = [rule for token in {*host.split("."), *path.split("/")} if token in index for rule, pattern in index[token] if pattern.fullmatch(f"{host}\n{path}")]
        return max(fit, key=lambda r: (len(r.name), r.verdict == "allow", r.name), default=None)

    return longest


def _judge(rules: list[Rule], seen: dict[str, int]):
    made = []

    @F.pandas_udf("name string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(_matcher(rules, seen))
        found = [made[0](h, p) for h, p in zip(hosts, paths)]
        return pd.DataFrame({"name": [r and r.name for r in found], "verdict": [r and r.verdict for r in found]}, dtype=object)

    return judge


def url_verdicts(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id_col, host, path, rule and verdict of every row of pages; repeated rows give a row each.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule wins (of
    two as long, one that allows). Without a rule: null and `default`. A null url, or one without ://, has
    an empty host and path, which no rule fits. The rules come from the driver, so they are of its size.
    """
    host, path = host_path(F.col(url_col))
    urls = pages.select(F.col(id_col), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rules = [r for r in rules if r.host]
    seen = token_frequencies(urls, rules)
    best = None
    for low in range(0, len(rules), INDEX_RULES):
        one = _judge(rules[low : low + INDEX_RULES], seen)("host", "path")
        if best is None:
            urls = urls.withColumn("_best", one)
        else:
            rank = lambda c: F.coalesce(F.length(c["name"]) * 2 + (c["verdict"] == "allow").cast("int"), F.lit(-1))
            urls = urls.withColumn("_one", one).withColumn("_best", F.when(rank(F.col("_one")) > rank(F.col("_best")), F.col("_one")).otherwise(F.col("_best"))).drop("_one")
        best = True
    if not best:
        urls = urls.withColumn("_best", F.lit(None).cast("struct<name:string,verdict:string>"))
    return urls.select(id_col, "host", "path", F.col("_best.name").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))

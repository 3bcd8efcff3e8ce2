"""URL filters: allow and block rules in a trie of reversed host labels and path segments.

A rule is a host and a path, such as ``example.net/en/``.  It fits its host and all subdomains,
where the url's path starts with the rule's.  Hosts go into the trie label by label from the
right, paths below them segment by segment; a path's last segment is a prefix of the url's.
Of the rules that fit, the one with most host labels counts, then the one with the longest path;
the same host and path in both lists is blocked.  Urls that no rule fits get the default verdict.

Hosts and paths are cut out by column expressions; a Python worker sees those two columns only,
walks the trie once for each url and remembers the nodes of a bounded number of hosts.  A trie
of at most ``block`` rules is broadcast.  More rules make more tries, one pass over the urls each,
written in between; the best rule so far goes along, so that no worker ever holds more than a trie.

Defined cases: a null url, or one without ``://``, has an empty host and an empty path, which only
rules for an empty host could fit.  Hosts are compared as they stand in the url, port and user
included, A-Z lower-cased; paths are compared as they are, so an empty path fits no rule but one
with an empty path.  Rules without a host are an error.  Repeated rows are judged alike, each.
An empty table gives an empty one; an empty list of rules gives every url the default.  Further
columns, whatever their names, pass through; added columns that clash get a leading ``_``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .columns import fresh, quoted
from .store import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rules in one broadcast trie (about 100 MB at 20 nodes of 50 bytes a rule), and hosts remembered by a worker.
BLOCK, HOSTS = 100_000, 50_000
ALLOW, DENY = "allow", "block"

_LOWERED = str.maketrans(UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def parse_rule(rule: str) -> tuple[str, str]:
    """Host and path of ``example.net/en/``."""
    host, slash, path = rule.partition("/")
    if not host:
        raise ValueError(f"a rule needs a host: {rule!r}")
    return host.translate(_LOWERED), slash + path


class Node:
    """Children by label or segment; what ends here."""

    __slots__ = ("below", "ends", "paths", "sizes")

    def __init__(self):
        self.below: dict[str, Node] = {}
        self.paths: Node | None = None  # of a host: where its paths start
        self.ends: dict[str, tuple[str, str]] = {}  # last segments, and the rule and verdict of each
        self.sizes: tuple[int, ...] = ()  # lengths of last segments, longest first


class Trie:
    """Rules by host labels from the right, then by path segments from the left."""

    def __init__(self, rules: Iterable[tuple[str, str]] = ()):
        self.root = Node()
        for verdict, rule in rules:
            self.add(verdict, rule)

    def add(self, verdict: str, rule: str) -> None:
        if verdict not in (ALLOW, DENY):
            raise ValueError(f"a verdict is {ALLOW} or {DENY}: {verdict!r}")
        host, path = parse_rule(rule)
        node = self.root
        for label in reversed(host.split(".")):
            node = node.below.setdefault(label, Node())
        node.paths = node.paths or Node()
        node = node.paths
        *whole, last = path.split("/")
        for segment in whole:
            node = node.below.setdefault(segment, Node())
        if node.ends.get(last, ("", ALLOW))[1] != DENY:
            node.ends[last] = (rule, verdict)
            node.sizes = tuple(sorted({*node.sizes, len(last)}, reverse=True))

    def hosts(self, host: str) -> list[tuple[int, Node]]:
        """(labels, where paths start) of the host and its parents that have rules, longest first."""
        node, found = self.root, []
        for depth, label in enumerate(reversed(host.split(".")), 1):
            node = node.below.get(label)
            if node is None:
                break
            if node.paths is not None:
                found.append((depth, node.paths))
        return found[::-1]

    @staticmethod
    def longest(start: Node, path: str) -> tuple[int, str, str] | None:
        """(length, rule, verdict) of the longest path that the url's path starts with."""
        node, at, best = start, 0, None
        while True:
            end = path.find("/", at)
            segment = path[at:] if end < 0 else path[at:end]
            for size in node.sizes:
                hit = node.ends.get(segment[:size]) if size <= len(segment) else None
                if hit is not None:
                    best = (at + size, *hit)
                    break
            if end < 0:
                return best
            node = node.below.get(segment)
            if node is None:
                return best
            at = end + 1

    def match(self, path: str, starts: list[tuple[int, Node]]) -> tuple[int, int, str, str] | None:
        """(labels, length, rule, verdict) that counts, given hosts() of the url's host."""
        for depth, start in starts:
            hit = self.longest(start, path)
            if hit is not None:
                return (depth, *hit)
        return None


_MATCH = "labels int, length int, rule string, verdict string"


def _matcher(shared):
    """A column function from host and path to the rule that counts, nulls where none does."""

    @F.pandas_udf(_MATCH)
    def matched(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie, known = shared.value, {}
        for hosts, paths in batches:
            found = []
            for host, path in zip(hosts, paths):
                starts = known.get(host)
                if starts is None:
                    if len(known) >= HOSTS:
                        known.clear()
                    starts = known[host] = trie.hosts(host)
                found.append((trie.match(path, starts) if starts else None) or (None, None, None, None))
            yield pd.DataFrame(found, columns=["labels", "length", "rule", "verdict"]).astype({"labels": "Int32", "length": "Int32"})

    return matched


def _better(new: Column, old: Column) -> Column:
    """Of two matches, the longer; of equals, the one that blocks."""
    def rank(m):
        return F.struct(m["labels"], m["length"], (m["verdict"] == DENY).cast("int"))

    return F.when(old["rule"].isNull() | (new["rule"].isNotNull() & (rank(new) > rank(old))), new).otherwise(old)


def _blocks(spark, rules, block: int) -> Iterator[list[tuple[str, str]]]:
    """Rules in lists of about `block`; those of a table are fetched block by block."""
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        for lo in range(0, len(rules), block):
            yield rules[lo : lo + block]
        return
    rules = rules.select("verdict", "rule").distinct()
    n = -(-rules.count() // block)
    kept = materialize(rules) if n > 1 else rules
    for b in range(n):
        part = kept.filter(F.pmod(F.xxhash64("rule"), F.lit(n)) == b) if n > 1 else kept
        yield [(r.verdict, r.rule) for r in part.collect()]


def judge_urls(pages: DataFrame, rules, url="url", default=ALLOW, block=BLOCK) -> DataFrame:
    """pages with host, path, rule and verdict; rules: (verdict, rule) pairs, or a table of them."""
    spark = pages.sparkSession
    host, path, rule, verdict, best = fresh(pages, "host", "path", "rule", "verdict", "best")
    df = pages.withColumns({host: host_of(quoted(url)), path: path_of(quoted(url))}).withColumn(best, F.lit(None).cast(f"struct<{_MATCH.replace(' ', ':').replace(',:', ',')}>"))
    for k, part in enumerate(_blocks(spark, rules, block)):
        new = fresh(df, "new")[0]
        hit = _matcher(spark.sparkContext.broadcast(Trie(part)))(quoted(host), quoted(path))
        if k:
            df = materialize(df)
        df = df.withColumn(new, hit).withColumn(best, _better(quoted(new), quoted(best))).drop(new)
    return df.withColumns({rule: quoted(best)["rule"], verdict: F.coalesce(quoted(best)["verdict"], F.lit(default))}).drop(best)


def keep_allowed(pages: DataFrame, rules, url="url", default=ALLOW, block=BLOCK) -> DataFrame:
    """The rows whose url is allowed, with their own columns."""
    judged = judge_urls(pages, rules, url, default, block)
    return judged.filter(quoted(judged.columns[-1]) == ALLOW).select([quoted(c) for c in pages.columns])

"""Long lists of path patterns, in order, over many paths: an index by segments.

A pattern is a glob as ignore files and owner files have it: `*` and `?` stay inside a segment, `**`
spans any number of them, a pattern without a slash but at its end fits at any depth, and one that
ends in a slash fits what is below such a folder.  A pattern that fits a folder fits all below it.

Patterns go into a trie, segment by segment: plain segments are looked up by name, those with
wildcards by the plain text that they end or begin with, and a leaf keeps the numbers of the patterns
that end there.  A path
goes down the trie once, whatever the number of patterns.  A trie of at most `block` patterns is
broadcast; longer lists make several, one pass over the paths each, whose best numbers are compared.
Equal patterns are one, with the numbers of the first and of the last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.storage import materialize

#: Patterns in one broadcast trie (some 60 MB).
BLOCK = 200_000


def segments(pattern: str) -> list[str]:
    """A pattern's segments from the root on; ** where any number of them may stand."""
    body = pattern.strip()
    anchored, folder = "/" in body.rstrip("/"), body.endswith("/")
    parts = [p for p in body.split("/") if p]
    if not parts:
        return []
    out = parts if anchored else ["**", *parts]
    out = [*out, *(["*"] if out[-1] == "**" else []), "*"] if folder else out
    flat = [p for i, p in enumerate(out) if not (p == "**" and i and out[i - 1] == "**")]
    return flat if flat[-1] != "**" else [*flat[:-1], "*"]  # below a folder: at least one segment more


class _Node:
    __slots__ = ("any", "below", "first", "heads", "last", "tails", "wild")

    def __init__(self):
        self.below: dict[str, _Node] = {}
        self.wild: dict[str, _Node] = {}
        # of segments with wildcards: by length, then by text, of what they end with, else of what they begin with
        self.tails: dict[int, dict[str, list[tuple[_Segment, _Node]]]] = {}
        self.heads: dict[int, dict[str, list[tuple[_Segment, _Node]]]] = {}
        self.any: _Node | None = None  # below **
        self.first = self.last = None  # numbers of the patterns that end here

    def wildcard(self, text: str) -> _Node:
        """The node below a segment with wildcards."""
        if text not in self.wild:
            self.wild[text] = node = _Node()
            tail, head = re.split(r"[*?]", text)[-1], re.split(r"[*?]", text)[0]
            index, key = (self.tails, tail) if tail else (self.heads, head)
            index.setdefault(len(key), {}).setdefault(key, []).append((_Segment(text), node))
        return self.wild[text]

    def steps(self, part: str) -> list[_Node]:
        """The nodes that a path's segment leads to."""
        found = [self.below[part]] if part in self.below else []
        for size, by_text in self.tails.items():
            found += [n for pattern, n in by_text.get(part[len(part) - size :] if size <= len(part) else "", ()) if pattern.match(part)]
        for size, by_text in self.heads.items():
            found += [n for pattern, n in by_text.get(part[:size], ()) if pattern.match(part)]
        return found


class _Segment:
    """A segment with wildcards; one around a single run of stars needs no regular expression, others get theirs when first asked."""

    __slots__ = ("ends", "found", "text")

    def __init__(self, text: str):
        self.text, self.found = re.sub(r"\*+", "*", text), None
        self.ends = tuple(self.text.split("*")) if self.text.count("*") == 1 and "?" not in self.text else None

    def match(self, part: str) -> bool:
        if self.ends:
            head, tail = self.ends
            return len(part) >= len(head) + len(tail) and part.startswith(head) and part.endswith(tail)
        if self.found is None:
            self.found = re.compile("".join(".*" if t == "*" else "." if t == "?" else re.escape(t) for t in re.findall(r"\*|\?|[^*?]+", self.text)) + r"\Z", re.S)
        return self.found.match(part) is not None

    def __reduce__(self):
        return _Segment, (self.text,)


class PatternIndex:
    """Patterns by number; match() gives the least or the greatest number of those that fit a path."""

    def __init__(self, patterns):
        """patterns: (number, glob), or (first, last, glob)."""
        self.root = _Node()
        for number, *greatest, pattern in patterns:
            parts = segments(pattern)
            node = self.root
            for p in parts:
                if p == "**":
                    node.any = node.any or _Node()
                    node = node.any
                elif "*" in p or "?" in p:
                    node = node.wildcard(p)
                else:
                    node = node.below.setdefault(p, _Node())
            if parts:
                node.first = number if node.first is None else min(node.first, number)
                most = greatest[0] if greatest else number
                node.last = most if node.last is None else max(node.last, most)

    def match(self, path: str, last: bool) -> int | None:
        parts = [p for p in path.split("/") if p]
        best, here = None, [self.root]
        seen_any: list[_Node] = []
        better = max if last else min
        for part in parts:
            for node in here:  # what stands below ** may begin at this segment, and at every later one
                if node.any is not None and node.any not in seen_any:
                    seen_any.append(node.any)
            step: list[_Node] = []
            for node in (*here, *seen_any):
                step += node.steps(part)
            here = list(dict.fromkeys(step))
            for node in here:
                number = node.last if last else node.first
                if number is not None:
                    best = number if best is None else better(best, number)
        return best


def _matcher(shared, last: bool):
    @F.pandas_udf("long")
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for paths in batches:
            yield pd.Series([shared.value.match(p, last) if p is not None else None for p in paths], dtype="Int64")

    return matched


def match(paths: DataFrame, rules: DataFrame, number: str, pattern: str, last: bool = False, block: int = BLOCK) -> DataFrame:
    """paths (path, ...) with `number` of the first, or last, rule that fits; null for none.

    rules: any table with a number and a glob.
    """
    spark = paths.sparkSession
    n = F.col(number).cast("long")
    rows = materialize(rules.groupBy(F.col(pattern).alias("p")).agg(F.min(n).alias("first"), F.max(n).alias("last")).select("first", "last", "p"))
    blocks = max(1, -(-rows.count() // block))
    # a task a core, since each one loads the trie
    out = paths.repartition(max(1, spark.sparkContext.defaultParallelism)).withColumn(number, F.lit(None).cast("long"))
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("p"), F.lit(blocks)) == b) if blocks > 1 else rows
        index = spark.sparkContext.broadcast(PatternIndex(part.toLocalIterator()))
        if b:
            out = materialize(out)
        found = _matcher(index, last)(F.col("path"))
        out = out.withColumn(number, (F.greatest if last else F.least)(F.col(number), found))
    return out


def owners(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, owners) of the last rule that fits; rules: (rule_no, glob, owners)."""
    found = match(paths.select("path").distinct(), rules, "rule_no", "glob", last=True)
    return found.join(rules.select(F.col("rule_no").cast("long").alias("rule_no"), "owners"), "rule_no", "left").select("path", "owners")

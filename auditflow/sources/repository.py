"""Source trees as a files relation.

Listing, reading and measuring run in tasks, which must see the tree (a shared or local one): see
treesource.  walk() lists a tree on the driver, for small ones.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths, text

#: Directories that are never entered, and the size limit.
IGNORED = (".git", ".github", ".auditflow", "target", "node_modules", "dist", "build", ".next", ".nuxt", ".cache", "coverage", "vendor", "Pods", "DerivedData")
MAX_BYTES = 2 * 1024 * 1024

def ignore_patterns(raw: str) -> list[str]:
    """The globs that an ignore entry stands for: a bare name four, a path two."""
    p = raw.strip().strip("/")
    if not p:
        return []
    if "/" not in p:
        return [p, f"**/{p}", f"{p}/**", f"**/{p}/**"]
    return [p] if p.endswith("/**") else [p, f"{p}/**"]


def matches(path: str, patterns: list[str]) -> bool:
    for p in patterns:
        if p.startswith("**/") and (fnmatch.fnmatchcase(path, p[3:]) or fnmatch.fnmatchcase(path, "*/" + p[3:])):
            return True
        if fnmatch.fnmatchcase(path, p):
            return True
    return False


class Ignore:
    """The rules of .gitignore files: of a directory and those above it, the last that matches decides.

    A rule with ! lets in again, one that ends in / is about directories, and one with another /
    stands for its own directory's paths only.
    """

    def __init__(self):
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []

    def read(self, path: str, below: str) -> None:
        """Rules of a file for paths below a directory ('' or one that ends in /)."""
        try:
            with open(path, encoding="utf-8") as f:
                lines = f.read().splitlines()
        except (OSError, UnicodeDecodeError):
            return
        for line in lines:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            again = line.startswith("!")
            body = line[again:].removeprefix("\\")
            folder, body = body.endswith("/"), body.rstrip("/")
            anchored, body = "/" in body, body.lstrip("/")
            parts = re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^]]+\]|[^*?\[/]+|/|.", body)
            turn = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]", "/": "/"}
            text = "".join(turn.get(p) or (p if p[0] == "[" and len(p) > 1 else re.escape(p)) for p in parts)
            self.rules.append((below, re.compile(("" if anchored else "(?:.*/)?") + text + "$"), folder, again))

    def hides(self, path: str, folder: bool) -> bool:
        for below, pattern, only_folders, again in reversed(self.rules):
            if path.startswith(below) and (folder or not only_folders) and pattern.match(path[len(below) :]):
                return not again
        return False


def global_ignore() -> str:
    """The user's own ignore file, where Git looks for it by default."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return os.path.join(home, "git", "ignore")


def walk(root: str, exclude: tuple[str, ...] = (), max_files: int | None = None) -> list[str]:
    """Files below root, hidden ones too, in component order; ignored directories are not entered."""
    patterns = [g for x in (*IGNORED, *exclude) for g in ignore_patterns(x)]
    ignore, found = Ignore(), []
    ignore.read(global_ignore(), "")
    ignore.read(os.path.join(root, ".git", "info", "exclude"), "")
    for top, dirs, names in os.walk(root):
        rel = os.path.relpath(top, root).replace(os.sep, "/")
        inside = "" if rel == "." else rel + "/"
        ignore.read(os.path.join(top, ".gitignore"), inside)
        dirs[:] = sorted(d for d in dirs if not matches(inside + d, patterns) and not ignore.hides(inside + d, True))
        found += [inside + n for n in names if not matches(inside + n, patterns) and not ignore.hides(inside + n, False)]
    found.sort(key=lambda p: p.split("/"))
    return found[:max_files] if max_files else found


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1].lower()
    return paths.NAMES.get(name) or paths.LANGUAGES.get(name.rsplit(".", 1)[-1] if "." in name[1:] else "")


def _load(root: str, max_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, low in zip(b["path"], b["low"]):
                full, reason, content, size = os.path.join(root, p), None, None, 0
                try:
                    size = os.path.getsize(full)
                    if max_bytes and size > max_bytes:
                        reason = "large-file"
                    elif low:
                        reason = "low-signal"
                    else:
                        with open(full, encoding="utf-8", newline="") as f:
                            content = f.read()
                except (OSError, UnicodeDecodeError):
                    reason = "binary"
                rows.append((p, language_of(p), reason, size, content))
            yield pd.DataFrame(rows, columns=["path", "language", "skip_reason", "size", "content"])

    return run


def load(spark: SparkSession, root: str, exclude=(), max_files=None, max_bytes=MAX_BYTES, include_low_signal=False) -> DataFrame:
    """(path, language, skip_reason, size, content, non_empty_lines, branches) of a tree.

    Size comes before low-signal paths, and those before reading; texts that are no UTF-8 are binary.
    """
    from .treesource import tree

    listed = tree(spark, root, tuple(exclude)).select("path")
    if max_files:
        listed = listed.orderBy(paths.ordered(F.col("path"))).limit(max_files)
    low = F.lit(False) if include_low_signal else paths.low_signal(F.col("path"))
    n = max(1, spark.sparkContext.defaultParallelism)
    loaded = listed.withColumn("low", low).repartition(n, "path").mapInPandas(_load(root, max_bytes), "path string, language string, skip_reason string, size long, content string")
    return measured(loaded)


def measured(files: DataFrame) -> DataFrame:
    c = F.col("content")
    return files.withColumns({"non_empty_lines": text.non_empty_lines(c), "branches": text.branches(c)})


def in_memory(files: DataFrame, path: str, content: str, language: str | None = None) -> DataFrame:
    """Any table with a text column as a files relation."""
    lang = F.col(language) if language else F.lit(None).cast("string")
    return measured(files.select(F.col(path).alias("path"), lang.alias("language"), F.lit(None).cast("string").alias("skip_reason"), F.length(content).cast("long").alias("size"), F.col(content).alias("content")))


def from_table(files: DataFrame, max_bytes=MAX_BYTES, include_low_signal=False) -> DataFrame:
    """A table (path, content as text or bytes, and others) under the rules of load().

    Bytes that are no UTF-8 are binary; skipped files keep no content.
    """
    body = F.col("content")
    size = F.coalesce(F.octet_length(body), F.lit(0))
    valid = F.is_valid_utf8(body.cast("string")) if files.schema["content"].dataType.typeName() == "binary" else F.lit(True)
    low = F.lit(False) if include_low_signal else paths.low_signal(F.col("path"))
    reason = F.when((size > max_bytes) if max_bytes else F.lit(False), "large-file").when(low, "low-signal").when(~F.coalesce(valid, F.lit(True)), "binary")
    out = files.withColumns({"skip_reason": reason, "size": size.cast("long")})
    return measured(out.withColumn("content", F.when(F.col("skip_reason").isNull(), body.cast("string"))))

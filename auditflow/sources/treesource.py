"""Source trees and Git diffs as data sources: listed and read by tasks, not by the driver.

`source_tree` gives (path, size) of the files below a folder.  The driver goes down the tree only
until there are enough folders to share out; each partition is a folder with all below it, or the
files of one folder alone, and its task applies the ignore rules of that place.  Filters on the
path prune: folders that cannot hold a match are not entered.

`git_diff` gives (path, status, side, line, text): the changed lines of a working tree or between two
revisions, with one row without a side for every changed file.  The driver sees names of changed
files; the diff of each is read and parsed by a task.

Both read where the tasks run, so the tree must be on storage that all workers see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .gitdiff import git, parse_diff
from .repository import IGNORED, Ignore, global_ignore, ignore_patterns, matches

#: Folders shared out at most; below them a task goes on alone.
SHARES = 1024
_TREE = pa.schema([("path", pa.string()), ("size", pa.int64())])
_LINES = pa.schema([("path", pa.string()), ("status", pa.string()), ("side", pa.string()), ("line", pa.int32()), ("text", pa.string())])
#: Rows of a batch at most.
BATCH = 4096


class _Paths:
    """What filters on the path allow: exact paths, prefixes, or everything."""

    def __init__(self):
        self.exact: set[str] | None = None
        self.prefixes: list[str] = []

    def take(self, f: Filter) -> bool:
        """Whether a filter is one of these, and so need not be evaluated again."""
        if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.exact = values if self.exact is None else self.exact & values
            return True
        if isinstance(f, StringStartsWith) and f.attribute == ("path",):
            self.prefixes.append(f.value)
            return True
        return False

    def allows(self, path: str) -> bool:
        return (self.exact is None or path in self.exact) and all(path.startswith(p) for p in self.prefixes)

    def enters(self, folder: str) -> bool:
        """Whether a folder ('' or one that ends in /) may hold an allowed path."""
        near = all(p.startswith(folder) or folder.startswith(p) for p in self.prefixes)
        return near and (self.exact is None or any(p.startswith(folder) for p in self.exact))


class Folder(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str, exclude: tuple[str, ...], shares: int):
        self.root, self.shares, self.allowed = root, shares, _Paths()
        self.patterns = [g for x in (*IGNORED, *exclude) for g in ignore_patterns(x)]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.allowed.take(f):
                yield f

    def _rules(self, folder: str) -> Ignore:
        """The ignore rules that hold in a folder, those of the folders above it first."""
        ignore = Ignore()
        ignore.read(global_ignore(), "")
        ignore.read(os.path.join(self.root, ".git", "info", "exclude"), "")
        above = ""
        for part in ["", *folder.rstrip("/").split("/")] if folder else [""]:
            above += f"{part}/" if part else ""
            ignore.read(os.path.join(self.root, above, ".gitignore"), above)
        return ignore

    def _list(self, folder: str, ignore: Ignore) -> tuple[list[str], list[os.DirEntry]]:
        """Folders to enter and files of a folder, after the rules."""
        folders, files = [], []
        try:
            entries = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
        except OSError:
            return [], []
        for e in entries:
            path = folder + e.name
            inside = e.is_dir(follow_symlinks=False)
            if matches(path, self.patterns) or ignore.hides(path, inside):
                continue
            if inside:
                if self.allowed.enters(path + "/"):
                    folders.append(path + "/")
            elif self.allowed.allows(path):
                files.append(e)
        return folders, files

    def partitions(self) -> Sequence[InputPartition]:
        """Folder by folder, level by level, until there are enough to share out."""
        level, alone = [""], []
        while level and len(level) + len(alone) < self.shares:
            below = [f for folder in level for f in self._list(folder, self._rules(folder))[0]]
            if len(below) + len(alone) + len(level) > self.shares:
                break
            alone += level
            level = below
        return [Folder(f, False) for f in alone] + [Folder(f, True) for f in level]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int]] = []
        todo = [partition.folder]
        while todo:
            folder = todo.pop()
            below, files = self._list(folder, self._rules(folder))
            todo += below if partition.deep else []
            for e in files:
                try:
                    rows.append((folder + e.name, e.stat(follow_symlinks=False).st_size))
                except OSError:
                    continue
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows))), schema=_TREE)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TREE)], schema=_TREE)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, size long"

    def reader(self, schema) -> DataSourceReader:
        exclude = tuple(x for x in self.options.get("exclude", "").split("\n") if x)
        return TreeReader(self.options["path"], exclude, int(self.options.get("shares", SHARES)))


class Changed(InputPartition):
    def __init__(self, files: list[tuple[str, list[str]]]):
        super().__init__(files)
        self.files = files


class DiffReader(DataSourceReader):
    def __init__(self, repo: str, base: str, head: str, shares: int):
        self.repo, self.shares, self.allowed = repo, shares, _Paths()
        self.revisions = [f"{base}..{head}" if head else base] if base else ["HEAD"]
        self.untracked = not base

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.allowed.take(f):
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        names = git(self.repo, "diff", "--name-status", "-z", "-M", "--no-ext-diff", *self.revisions).split("\0")
        files, i = [], 0
        while i + 1 < len(names):
            n = 3 if names[i][:1] in ("R", "C") else 2
            if self.allowed.allows(names[i + n - 1]):
                files.append(("tracked", names[i + 1 : i + n]))
            i += n
        if self.untracked:
            files += [("new", [p]) for p in git(self.repo, "ls-files", "-z", "--others", "--exclude-standard").split("\0") if p and self.allowed.allows(p)]
        n = max(1, -(-len(files) // self.shares))
        return [Changed(files[i : i + n]) for i in range(0, len(files), n)]

    def read(self, partition: Changed) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        common = ["diff", "--unified=0", "--no-color", "--no-ext-diff", "-M"]
        for kind, paths in partition.files:
            text = git(self.repo, *common, *self.revisions, "--", *paths) if kind == "tracked" else git(self.repo, *common, "--no-index", "/dev/null", paths[0], fine=(0, 1))
            rows: list[tuple] = []
            for f in parse_diff(text):
                rows.append((f["path"], f["status"], None, None, None))
                for h in f["hunks"]:
                    for side, at in (("added", h["new"]), ("removed", h["old"])):
                        rows += [(f["path"], f["status"], side, at[0] + j, t) for j, t in enumerate(h[side])] if at else []
            for lo in range(0, len(rows), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows[lo : lo + BATCH]), _LINES)], schema=_LINES)


class GitDiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_diff"

    def schema(self) -> str:
        return "path string, status string, side string, line int, text string"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return DiffReader(o["path"], o.get("base", ""), o.get("head", ""), int(o.get("shares", SHARES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SourceTree, GitDiff):
        spark.dataSource.register(source)


def tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), shares: int = SHARES) -> DataFrame:
    """(path, size) of the files below root, ignored ones left out."""
    register(spark)
    return spark.read.format("source_tree").option("exclude", "\n".join(exclude)).option("shares", shares).load(root)


def diff(spark: SparkSession, repo: str, base: str | None = None, head: str | None = None, shares: int = SHARES) -> DataFrame:
    """The changed lines of a repository, and a row without a side for each changed file."""
    register(spark)
    return spark.read.format("git_diff").option("base", base or "").option("head", head or "").option("shares", shares).load(repo)

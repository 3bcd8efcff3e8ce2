"""Queries on trees of files: rows are written as files to the shared folder, and the tree is read back."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources import repository, treesource
from .catalog import _register
from .storage import shared_dir, table

#: Places of files by number, and whether the ignore rules let them in.
PLACES = (("src/pkg{m}/a{k}.py", True), (".hidden/b{k}.py", True), ("node_modules/m/c{k}.js", False), ("pkg{m}/logs/d{k}.log", False), ("pkg{m}/keep{k}.log", True), ("pkg{m}/fixtures/e{k}.md", True), ("pkg{m}/private/f{k}.py", None), ("pkg{m}/deep/er/still/g{k}.py", True))
IGNORE = "*.log\n!keep*.log\n"
_NO = f"s_suppkey % {len(PLACES)}"
_PATH = "CASE no " + " ".join(f"WHEN {i} THEN '{p}'" for i, (p, _) in enumerate(PLACES)) + " END"
_KEPT = ", ".join(str(i) for i, (_, kept) in enumerate(PLACES) if kept)
_OPEN = next(i for i, (_, kept) in enumerate(PLACES) if kept is None)
_SIZE = "s_suppkey % 60 + 1"
_FILES = f"made AS (SELECT replace(replace({_PATH}, '{{m}}', CAST(s_suppkey % 5 AS VARCHAR)), '{{k}}', CAST(s_suppkey AS VARCHAR)) AS path, CAST({_SIZE} AS BIGINT) AS size, no, s_suppkey % 5 AS m FROM (SELECT s_suppkey, {_NO} AS no FROM supplier)), listed AS (SELECT * FROM made WHERE no IN ({_KEPT}) OR no = {_OPEN} AND m <> 1 UNION ALL SELECT '.gitignore', {len(IGNORE)}, -1, 0 UNION ALL SELECT 'pkg1/.gitignore', 8, -1, 0)"


def _write(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "w", encoding="utf-8") as f:
                    f.write(content)
            yield b[["path"]]

    return run


def written_tree(spark, files: DataFrame) -> str:
    """Files (path, content) below a new folder of the shared one, which must be a file system's; they go when the application ends."""
    where = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    root = where.removeprefix("file://")
    files.select("path", "content").mapInPandas(_write(root), "path string").write.format("noop").mode("overwrite").save()
    return root


def _tree(spark, sf_dir) -> str:
    made = F.expr(_PATH.replace("no ", f"{_NO} ", 1))
    path = F.replace(F.replace(made, F.lit("{m}"), (F.col("s_suppkey") % 5).cast("string")), F.lit("{k}"), F.col("s_suppkey").cast("string"))
    rows = table(spark, sf_dir, "supplier").select(path.alias("path"), F.repeat(F.lit("x"), F.expr(_SIZE).cast("int")).alias("content"))
    rules = spark.createDataFrame([(".gitignore", IGNORE), ("pkg1/.gitignore", "private/")], "path string, content string")
    return written_tree(spark, rows.unionByName(rules))


@_register("SELECT path, size FROM listed", also=_FILES)
def tree_files(spark, sf_dir):
    return treesource.tree(spark, _tree(spark, sf_dir), shares=7)


@_register("SELECT path, size FROM listed WHERE starts_with(path, 'src/pkg3/')", also=_FILES)
def tree_files_below(spark, sf_dir):
    return treesource.tree(spark, _tree(spark, sf_dir)).filter("path LIKE 'src/pkg3/%'")


@_register("SELECT path, CASE WHEN size > 40 THEN 'large-file' WHEN contains(path, '/fixtures/') THEN 'low-signal' END AS skip_reason, CASE WHEN size <= 40 AND NOT contains(path, '/fixtures/') THEN CASE WHEN no = -1 AND m = 0 AND size > 8 THEN 2 ELSE 1 END ELSE 0 END AS non_empty_lines FROM listed", also=_FILES)
def tree_loaded(spark, sf_dir):
    return repository.load(spark, _tree(spark, sf_dir), max_bytes=40).select("path", "skip_reason", F.coalesce("non_empty_lines", F.lit(0)).cast("int").alias("non_empty_lines"))

"""Git changes: unified diffs as relations of files, ranges and lines."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

_FILE = re.compile(r'^diff --git (?:"?a/(.*?)"?) (?:"?b/(.*?)"?)$')
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_STATUS = {"new file mode ": "added", "deleted file mode ": "deleted", "rename from ": "renamed"}


def parse_diff(diff: str) -> list[dict]:
    """Changed files of a diff without context lines: path, status, and hunks.

    A hunk has new and old ranges (start, stop; None if empty) and its added and removed lines.
    Lines before the first file are ignored, and so are headers inside hunks' counts.
    """
    files: list[dict] = []
    left_old = left_new = 0
    for line in diff.splitlines():
        hunk = files[-1]["hunks"][-1] if files and files[-1]["hunks"] else None
        if hunk and (left_old or left_new) and line[:1] in "+-":
            side = "added" if line[0] == "+" else "removed"
            hunk[side].append(line[1:])
            left_new -= line[0] == "+"
            left_old -= line[0] == "-"
            continue
        if m := _FILE.match(line):
            files.append({"path": m[2], "status": "modified", "hunks": []})
        elif not files:
            continue
        elif m := _HUNK.match(line):
            old, n_old, new, n_new = (int(x) if x is not None else 1 for x in m.groups())
            left_old, left_new = n_old, n_new
            files[-1]["hunks"].append({"new": (new, new + n_new - 1) if n_new else None, "old": (old, old + n_old - 1) if n_old else None, "added": [], "removed": []})
        elif line[:4] in ("+++ ", "--- ") and not line.endswith("/dev/null"):
            if (line[0] == "-") == (files[-1]["status"] == "deleted"):
                files[-1]["path"] = re.sub(r"^[ab]/", "", line[4:].strip('"'))
        else:
            files[-1]["status"] = next((s for p, s in _STATUS.items() if line.startswith(p)), files[-1]["status"])
    return files


def changes(spark: SparkSession, diff: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, status), (path, start, stop) of changed lines, and (path, side, line, text)."""
    files = parse_diff(diff)
    ranges = [(f["path"], *h["new"]) for f in files for h in f["hunks"] if h["new"]]
    lines = [(f["path"], side, at[0] + i, t) for f in files for h in f["hunks"] for side, at in (("added", h["new"]), ("removed", h["old"])) if at for i, t in enumerate(h[side])]
    return (
        spark.createDataFrame([(f["path"], f["status"]) for f in files], "path string, status string"),
        spark.createDataFrame(ranges, "path string, start int, stop int"),
        spark.createDataFrame(lines, "path string, side string, line int, text string"),
    )


def git(repo: str, *a: str, fine: tuple[int, ...] = (0,)) -> str:
    r = subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *a], capture_output=True, text=True, check=False, errors="replace")
    if r.returncode not in fine:
        raise RuntimeError(f"git {a[0]}: {r.stderr.strip()}")
    return r.stdout


def diff_of(repo: str, base: str | None = None, head: str | None = None) -> str:
    """The diff of the working tree, or between two revisions; untracked files count as added."""
    common = ["diff", "--unified=0", "--no-color", "--no-ext-diff"]
    if base:
        return git(repo, *common, f"{base}..{head}" if head else base)
    new = "".join(git(repo, *common, "--no-index", "/dev/null", p, fine=(0, 1)) for p in git(repo, "ls-files", "--others", "--exclude-standard").splitlines())
    return git(repo, *common, "HEAD") + new


def changes_of(spark: SparkSession, repo: str, base: str | None = None, head: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """changes() of a repository whose diff is read by tasks, file by file."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    from ..plans.storage import materialize
    from .treesource import diff

    d = materialize(diff(spark, repo, base, head))
    lines = d.filter("side IS NOT NULL").select("path", "side", "line", "text")
    # neighbouring added lines make a range
    w = Window.partitionBy("path").orderBy("line")
    runs = lines.filter("side = 'added'").withColumn("run", F.col("line") - F.row_number().over(w)).groupBy("path", "run").agg(F.min("line").alias("start"), F.max("line").alias("stop"))
    return d.filter("side IS NULL").select("path", "status"), runs.select("path", "start", "stop"), lines


def blob(repo: str, revision: str, path: str) -> str | None:
    r = subprocess.run(["git", "-C", repo, "show", f"{revision}:{path}"], capture_output=True, text=True, check=False)
    return r.stdout if r.returncode == 0 else None

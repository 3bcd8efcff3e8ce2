"""What changed lines begin or cease to do.

Lines come as (path, side, line, text) with side added or removed; kinds are found by patterns
of the file's language, so every signal is a text heuristic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import base_name, extension, test_file

#: Kinds of added behaviour, with patterns that hold in any language.
ADDED = (
    ("subprocess-added", r"\bsubprocess\.|\bos\.(system|popen|exec\w*|spawn\w*)\(|\bchild_process\b|\bexec(File|Sync)?\(|\bspawn(Sync)?\(|\bexec\.Command\(|\bCommand::new\(|\bRuntime\.getRuntime\(\)\.exec|\bProcessBuilder\(|\bProcess\.Start\("),
    ("network-call-added", r"\brequests\.(get|post|put|patch|delete|head|request)\(|\burllib\.request\b|\bhttpx\.|\baiohttp\.|\bfetch\(|\baxios\b|\bhttp\.(Get|Post|NewRequest)\(|\breqwest::|\bTcpStream::|\bnet\.Dial\(|\bHttpClient\b|\bOkHttpClient\b|\bsocket\.socket\("),
    ("fs-write-added", r"\bopen\([^)]*['\"][wax]b?\+?['\"]|\.write_text\(|\.write_bytes\(|\bfs\.(write|append)\w*\(|\bos\.(WriteFile|Create)\(|\bioutil\.WriteFile\(|\bfs::write\(|\bFile::create\(|\bFiles\.write\w*\(|\bFile\.Write\w*\("),
    ("env-var-introduced", r"\bos\.environ\b|\bos\.getenv\(|\bprocess\.env\.|\bos\.Getenv\(|\benv::var\(|\bSystem\.getenv\(|\bEnvironment\.GetEnvironmentVariable\("),
    ("raw-sql-added", r"(?i)['\"`]\s*(select\s.+\sfrom\s|insert\s+into\s|update\s.+\sset\s|delete\s+from\s|drop\s+table\s|alter\s+table\s)"),
)
#: Imports: by a quoted name after from, require or import; Python's; Rust's.
_IMPORTS = (r"(?:\bfrom\s+|\brequire\(\s*|\bimport\s+)['\"]([@\w./-]+)['\"]", r"^\s*(?:import|from)\s+([\w.]+)\s*(?:import\b|as\b|,|$)", r"^\s*(?:pub\s+)?use\s+(\w+)::")

#: Words whose loss is a signal.
ERROR_WORDS = r"\btry\b|\bcatch\b|\bexcept\b|\brescue\b|\bif err != nil\b|\bunwrap_or|\?;|\bResult<"
AUTH_WORDS = r"(?i)\b(require_?auth\w*|login_required|is_?authenticated|check_?permission\w*|has_?permission\w*|authorize\w*|authenticate\w*|verify_?token|ensure_?logged_?in|PreAuthorize)\b"


def imported_module(text: Column) -> Column:
    """The module that a line imports, null for none."""
    groups = [F.regexp_extract(text, p, 1) for p in _IMPORTS]
    return F.coalesce(*(F.when(g != "", g) for g in groups))


def added(lines: DataFrame, local: DataFrame) -> DataFrame:
    """(path, kind, line) of added lines, once a kind and line; local: (name) of own packages.

    Tests are left out; imports count if they leave the repository.
    """
    new = lines.filter((F.col("side") == "added") & ~test_file(F.col("path")))
    code = ~F.col("text").rlike(r"^\s*(//|#|\*|/\*)")
    kinds = [F.when(code & F.col("text").rlike(p), F.lit(k)) for k, p in ADDED]
    migration = F.when(F.col("path").rlike(r"(^|/)migrations?/|\.sql$"), F.lit("migration-added"))
    found = new.select("path", "line", F.explode(F.array_compact(F.array(*kinds, migration))).alias("kind"))
    module = imported_module(F.col("text"))
    top = F.regexp_extract(module, r"^(@[^/]+/[^/]+|[^/.]+)", 1)  # the package: a scope and a name, or the first part
    out = new.select("path", "line", top.alias("name"), module.alias("module")).filter("module IS NOT NULL AND module NOT LIKE '.%'")
    out = out.join(local.select("name").distinct(), "name", "left_anti").select("path", "line", F.lit("dependency-import-added").alias("kind"))
    return found.unionByName(out).select("path", "kind", "line").distinct()


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind) of files with less error handling or fewer access checks than before, and of tests that are gone.

    before, after: (path, content); a file that is gone counts as empty.
    """
    n = lambda p, w: F.regexp_count(F.coalesce(p, F.lit("")), F.lit(w))
    j = before.select("path", F.col("content").alias("old")).join(after.select("path", F.col("content").alias("new")), "path", "left")
    empty = F.trim(F.coalesce("new", F.lit(""))) == ""
    test = test_file(F.col("path"))
    kinds = [
        F.when(~test & ~empty & (n(F.col("old"), ERROR_WORDS) > n(F.col("new"), ERROR_WORDS)), F.lit("error-handling-removed")),
        F.when(~test & (n(F.col("old"), AUTH_WORDS) > n(F.col("new"), AUTH_WORDS)), F.lit("auth-check-removed")),
        F.when(test & empty & (F.trim(F.coalesce("old", F.lit(""))) != ""), F.lit("test-deleted-or-emptied")),
    ]
    return j.select("path", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


def missing_test(signals: DataFrame, changed: DataFrame) -> DataFrame:
    """One row (missing): code behind a boundary changed and no test did."""
    boundary = signals.agg(F.coalesce(F.bool_or(F.col("boundary").isin("access-control", "request-trust")), F.lit(False)).alias("b"))
    tested = changed.agg(F.coalesce(F.bool_or(test_file(F.col("path"))), F.lit(False)).alias("t"))
    return boundary.crossJoin(tested).select((F.col("b") & ~F.col("t")).alias("missing"))  # one row each


def language_of(path: Column) -> Column:
    ext = F.lower(extension(path))
    return F.when(ext == "py", "Python").when(ext.isin("ts", "tsx"), "TypeScript").when(ext.isin("js", "jsx", "mjs", "cjs"), "JavaScript").when(ext == "rs", "Rust").when(ext == "go", "Go").otherwise(base_name(path))

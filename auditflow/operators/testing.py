"""Tests and the code that they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import TEST_DIRECTORIES, base_name, extension, has_component, parent, test_file


def subjects(files: DataFrame) -> DataFrame:
    """(test, subject): test files beside the file that their name derives from, if it is there.

    a_test.go, a.test.ts, a.spec.ts, a_tests.rs and test_a.py are about a, in the same directory
    or the one above a test directory.
    """
    name = F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", "")
    stem = F.regexp_replace(F.regexp_replace(name, r"(\.test|\.spec|_tests?|Tests?)$", ""), r"^test_", "")
    tests = files.filter(test_file(F.col("path"))).select(F.col("path").alias("test"), stem.alias("stem"), extension(F.col("path")).alias("ext"), parent(F.col("path")).alias("dir"))
    own = F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat(F.col("dir"), F.lit("/"))), "stem", F.lit("."), "ext")
    up = parent(F.col("dir"))
    above = F.concat(F.when(up == "", "").otherwise(F.concat(up, F.lit("/"))), "stem", F.lit("."), "ext")
    each = tests.select("test", F.explode(F.array(own, above)).alias("subject")).filter("test <> subject")
    return each.join(files.select(F.col("path").alias("subject")), "subject", "left_semi").distinct()


def test_edges(files: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, deferred) from tests to their subjects."""
    return subjects(files).select(F.col("test").alias("src"), F.col("subject").alias("dst"), F.lit("test-of").alias("kind"), F.lit(False).alias("deferred"))


def without_test(files: DataFrame) -> DataFrame:
    """(path): production files that have no test beside them and carry none inside.

    files: (path, role, has_inline_tests).
    """
    covered = subjects(files).select(F.col("subject").alias("path")).distinct()
    return files.filter((F.col("role") == "production") & ~F.coalesce("has_inline_tests", F.lit(False))).join(covered, "path", "left_anti").select("path")


def missing_test_folder(files: DataFrame) -> DataFrame:
    """One row (missing): whether no path has a test directory."""
    return files.agg((~F.coalesce(F.bool_or(has_component(F.lower("path"), TEST_DIRECTORIES)), F.lit(False))).alias("missing"))


#: What marks tests inside a source file, by language.
INLINE = {"Rust": r"#\[(cfg\(test\)|test|tokio::test)\]", "Python": r"(?m)^\s*(def test_|class Test|import (unittest|pytest))", "Go": r"func Test[A-Z]\w*\(", "JavaScript": r"\b(describe|it|test)\(['\"]", "TypeScript": r"\b(describe|it|test)\(['\"]", "Java": r"@Test\b", "Kotlin": r"@Test\b", "C#": r"\[(Test|Fact|Theory|TestMethod)\]"}


def with_inline_tests(files: DataFrame) -> DataFrame:
    found = F.lit(False)
    for language, pattern in INLINE.items():
        found = F.when(F.col("language") == language, F.col("content").rlike(pattern)).otherwise(found)
    return files.withColumn("has_inline_tests", F.coalesce(found, F.lit(False)))

"""What files export, and imports that no longer find it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import extension, parent
from ..plans.storage import shuffled

_ALL = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
_NAME = lambda c, pattern: F.filter(F.transform(c, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")
_JS_KINDS = "async function|function|class|const|let|var|type|interface|enum|namespace"


def exported(content: Column, language: Column) -> Column:
    """Sorted distinct names that a text exports, by its language's declarations; null text has none."""
    text = F.coalesce(content, F.lit(""))
    # of `pub use a::{B, c::{D as E}};` the last name of each part
    used = F.flatten(F.transform(_ALL(text, r"(?m)^\s*pub use ([^;]*);"), lambda x: F.regexp_extract_all(x, F.lit(r"([A-Za-z_]\w*)\s*(?=[,}]|$)"), F.lit(1))))
    used = F.filter(used, lambda x: x != "self")
    rust = F.concat(_ALL(text, r"(?m)^\s*pub (?:async fn|fn|struct|enum|trait|type|const|static|mod) ([A-Za-z_]\w*)"), used)
    listed = F.flatten(F.transform(_ALL(text, r"(?m)^\s*export (?!default )[^{\n=(]*\{([^}]*)\}"), lambda x: F.split(x, ",")))
    renamed = F.transform(listed, lambda x: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^type\s+", ""), r"^.*\sas\s+", ""))
    default = F.transform(_ALL(text, r"(?m)^\s*export (default )"), lambda x: F.lit("default"))
    js = F.concat(default, _ALL(text, rf"(?m)^\s*export (?:{_JS_KINDS}) ([A-Za-z_$][\w$]*)"), _NAME(renamed, r"^([A-Za-z_$][\w$]*)$"))
    python = F.flatten(F.transform(_ALL(text, r"(?m)^\s*__all__[^=\n]*=\s*[\[(]([^\])]*)[\])]"), lambda x: F.regexp_extract_all(x, F.lit(r"""['"]([A-Za-z_]\w*)['"]"""), F.lit(1))))
    group = F.flatten(F.transform(_ALL(text, r"(?ms)^(?:const|var|type)\s*\((.*?)^\)"), lambda x: F.regexp_extract_all(x, F.lit(r"(?m)^(?:\t| {1,4})([A-Z]\w*)"), F.lit(1))))
    go = F.concat(_ALL(text, r"(?m)^\s*(?:func|type|var|const) ([A-Z]\w*)"), group)
    found = F.when(language == "Rust", rust).when(language.isin("JavaScript", "TypeScript"), js).when(language == "Python", python).when(language == "Go", go)
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))


def exports(files: DataFrame) -> DataFrame:
    """(path, symbol) of files (path, language, content)."""
    return files.select("path", F.explode(exported(F.col("content"), F.col("language"))).alias("symbol"))


def named_imports(files: DataFrame) -> DataFrame:
    """(importer, spec, symbol) of JavaScript's and TypeScript's braces and default imports."""
    js = files.filter(F.col("language").isin("JavaScript", "TypeScript"))
    text = F.coalesce("content", F.lit(""))
    whole = F.regexp_extract_all(text, F.lit(r"(?m)^\s*import\s[^;\n]*?from\s*['\"][^'\"\n]+['\"]"), F.lit(0))
    each = js.select(F.col("path").alias("importer"), F.explode(whole).alias("x")).withColumn("spec", F.regexp_extract("x", r"from\s*['\"]([^'\"]+)['\"]", 1))
    inside = F.transform(F.split(F.regexp_extract("x", r"\{([^}]*)\}", 1), ","), lambda s: F.regexp_extract(F.regexp_replace(F.trim(s), r"^type\s+", ""), r"^([A-Za-z_$][\w$]*)", 1))
    default = F.when(F.regexp_extract("x", r"^\s*import\s+(?:type\s+)?([A-Za-z_$][\w$]*)\s*(?:,|\s+from)", 1) != "", F.lit("default"))
    names = F.filter(F.array_append(inside, default), lambda s: s.isNotNull() & (s != ""))
    return each.select("importer", "spec", F.explode(names).alias("symbol"))


def unresolved_kind(spec: Column, path: Column, known_dirs: Column) -> Column:
    """relative-path, local-alias or workspace-package for an import that should mean a file here; null: external."""
    first = F.element_at(F.filter(F.split(spec, r"[/\\.:]"), lambda s: s != ""), 1)
    alias = F.startswith(spec, F.lit("@/")) | F.startswith(spec, F.lit("~/")) | (spec == "~")
    return F.when(F.startswith(spec, F.lit(".")), "relative-path").when(alias, "local-alias").when(F.array_contains(known_dirs, first), "workspace-package")


def unresolved_totals(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """(ext, kind, n): unresolved imports that should mean a file here, by the importer's ending.

    An import counts if it is relative, a local alias, or begins with the name of a directory of
    the repository; the first segments are joined with the directories' names.
    """
    dirs = files.select(F.explode(F.split(parent(F.col("path")), "/")).alias("_dir")).filter("_dir <> ''").distinct()
    open_ = resolved.filter("dst IS NULL AND NOT guarded AND trim(spec) <> ''").withColumn("spec", F.trim("spec"))
    first = F.element_at(F.filter(F.split("spec", r"[/\\.:]"), lambda s: s != ""), 1)
    j = open_.withColumn("_first", first).join(shuffled(dirs), F.col("_first") == F.col("_dir"), "left")
    kind = unresolved_kind(F.col("spec"), F.col("src"), F.when(F.col("_dir").isNotNull(), F.array("_dir")).otherwise(F.array().cast("array<string>")))
    return j.select(extension(F.col("src")).alias("ext"), kind.alias("kind")).filter("kind IS NOT NULL").groupBy("ext", "kind").agg(F.count(F.lit(1)).alias("n"))

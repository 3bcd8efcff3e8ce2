"""Rules that need a file's path and text only; each gives rows of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as t
from ..functions.paths import depth_below, parent

#: Default thresholds.
LARGE, HUGE, DEPTH, CROWDED = 300, 1000, 5, 20
COMPLEX, VERY_COMPLEX, LEAST_LINES, LEAST_LINES_HIGH = 200, 400, 10, 25
IMPORT_DEPTH = 3


def finding(df: DataFrame, rule_id, severity, line) -> DataFrame:
    lit = lambda x: x if not isinstance(x, (str, int)) else F.lit(x)
    return df.select(lit(rule_id).alias("rule_id"), "path", lit(severity).alias("severity"), lit(line).cast("int").alias("line_start"))


def large_files(files: DataFrame) -> DataFrame:
    """files: (path, role, non_empty_lines)."""
    big = files.filter((F.col("role") == "production") & (F.col("non_empty_lines") > LARGE))
    return finding(big, "architecture.large-file", F.when(F.col("non_empty_lines") >= HUGE, "HIGH").otherwise("MEDIUM"), 1)


def complex_files(files: DataFrame) -> DataFrame:
    """files: (path, non_empty_lines, branches); density is branches per thousand lines."""
    d = F.floor(F.col("branches") * 1000 / F.col("non_empty_lines"))
    rows = files.filter(F.col("non_empty_lines") >= LEAST_LINES).withColumn("_d", d).filter(F.col("_d") >= COMPLEX)
    return finding(rows, "code-quality.complex-file", F.when((F.col("_d") >= VERY_COMPLEX) & (F.col("non_empty_lines") >= LEAST_LINES_HIGH), "HIGH").otherwise("MEDIUM"), 1)


def markers(files: DataFrame) -> DataFrame:
    """TODO, FIXME and HACK in comments of (path, content), one a line."""
    each = files.select("path", F.posexplode(t.lines(F.col("content"))).alias("i", "line")).withColumn("_m", t.marker(F.col("line"))).filter("_m IS NOT NULL")
    return finding(each, F.concat(F.lit("code-marker."), F.lower("_m")), F.when(F.col("_m") == "TODO", "LOW").otherwise("MEDIUM"), F.col("i") + 1)


def deep_directories(files: DataFrame, root: str = "", most: int = DEPTH) -> DataFrame:
    return finding(files.filter(depth_below(F.col("path"), root) > most), "architecture.deep-directory-nesting", "LOW", 1)


def crowded_directories(files: DataFrame, most: int = CROWDED) -> DataFrame:
    d = files.groupBy(parent(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    return finding(d, "architecture.too-many-modules", "MEDIUM", 1)


def deep_imports(files: DataFrame) -> DataFrame:
    """The first import line of (path, content) that climbs three directories or more."""
    each = files.select("path", F.posexplode(t.lines(F.col("content"))).alias("i", "line"))
    hit = each.filter(F.col("line").rlike(r"^\s*(import\b|export\b.*\bfrom\b|from\b|.*\brequire\s*\()") & (t.import_depth(F.col("line")) >= IMPORT_DEPTH))
    return finding(hit.groupBy("path").agg(F.min("i").alias("i")), "architecture.deep-relative-imports", "LOW", F.col("i") + 1)


def barrels(files: DataFrame) -> DataFrame:
    """Index files of (path, content) with many re-exports or wildcard exports."""
    code = F.col("content")
    named = F.regexp_count(code, F.lit(r"(?m)^\s*export\s+(?:type\s+)?\{[^}]*\}\s+from\b"))
    wild = F.regexp_count(code, F.lit(r"(?m)^\s*export\s+\*"))
    rows = files.filter(F.col("path").rlike(r"(^|/)index\.(ts|tsx|js|jsx)$")).withColumns({"_n": named + wild, "_w": wild}).filter((F.col("_n") >= 8) | (F.col("_w") >= 3))
    return finding(rows, "architecture.barrel-file-risk", F.when((F.col("_n") >= 15) | (F.col("_w") >= 6), "MEDIUM").otherwise("LOW"), 1)


def private_keys(files: DataFrame) -> DataFrame:
    each = files.select("path", F.posexplode(t.lines(F.col("content"))).alias("i", "line")).filter(t.key_header(F.col("line")))
    return finding(each, "security.private-key-candidate", "CRITICAL", F.col("i") + 1)


#: Line patterns of rules that need no more: id, severity, languages (none: all), pattern.
LINE_RULES = (
    ("language.rust.panic-risk", "MEDIUM", ("Rust",), r"\b(panic|todo|unimplemented|unreachable)!\s*[\(\[{]|\.unwrap\(\)|\.expect\("),
    ("language.go.panic-exit-risk", "MEDIUM", ("Go",), r"\bpanic\(|\blog\.Fatal(f|ln)?\(|\bos\.Exit\("),
    ("language.python.exception-risk", "MEDIUM", ("Python",), r"^\s*except\s*:|\braise\s+NotImplementedError\b"),
    ("language.javascript.runtime-exit-risk", "MEDIUM", ("JavaScript", "TypeScript"), r"\bprocess\.exit\("),
    ("language.managed.fatal-exception-risk", "MEDIUM", ("Java", "Kotlin", "C#"), r"\bSystem\.exit\(|\bEnvironment\.(Exit|FailFast)\(|\bTODO\(|\bnew\s+NotImplementedException\("),
    ("framework.js.var-declaration", "LOW", ("JavaScript", "TypeScript"), r"^\s*(export\s+)?var\s+[A-Za-z_$]"),
    ("framework.js.console-log", "LOW", ("JavaScript", "TypeScript"), r"\bconsole\.log\("),
    ("framework.react.class-component", "LOW", ("JavaScript", "TypeScript"), r"\bclass\s+\w+\s+extends\s+(React\.)?(Pure)?Component\b"),
    ("framework.react.prop-types", "LOW", ("TypeScript",), r"\.propTypes\s*=|from\s+['\"]prop-types['\"]"),
    ("framework.react-native.inline-style", "MEDIUM", ("JavaScript", "TypeScript"), r"\bstyle=\{\{"),
    ("framework.react-native.direct-state-mutation", "HIGH", ("JavaScript", "TypeScript"), r"\bthis\.state\.[\w.\[\]]+\s*=[^=]"),
    ("framework.react-native.async-storage-from-core", "HIGH", ("JavaScript", "TypeScript"), r"\bimport\s*\{[^}]*\bAsyncStorage\b[^}]*\}\s*from\s*['\"]react-native['\"]"),
    ("framework.react-native.old-react-navigation", "MEDIUM", ("JavaScript", "TypeScript"), r"from\s+['\"]react-navigation['\"]"),
    ("framework.django.debug-true", "HIGH", ("Python",), r"^\s*DEBUG\s*=\s*True\b"),
    ("framework.django.missing-allowed-hosts", "HIGH", ("Python",), r"^\s*ALLOWED_HOSTS\s*=\s*\[\s*\]"),
    ("framework.django.raw-sql-query", "MEDIUM", ("Python",), r"\.(raw|execute)\(\s*(f['\"]|.*(%\s|\.format\())"),
)


def line_rules(files: DataFrame) -> DataFrame:
    """All LINE_RULES over (path, language, content) in one pass; comment lines are skipped."""
    each = files.select("path", "language", F.posexplode(t.lines(F.col("content"))).alias("i", "line")).filter(~F.col("line").rlike(r"^\s*(//|#|\*|/\*)"))
    hits = [F.when(F.col("language").isin(*langs) & F.col("line").rlike(p), F.struct(F.lit(r).alias("r"), F.lit(s).alias("s"))) for r, s, langs, p in LINE_RULES]
    hit = each.withColumn("_h", F.explode(F.array_compact(F.array(*hits))))
    settings = F.col("path").rlike(r"(^|/)settings(/[^/]+)?\.py$")
    hit = hit.filter(~F.col("_h.r").isin("framework.django.debug-true", "framework.django.missing-allowed-hosts") | settings)
    return finding(hit, F.col("_h.r"), F.col("_h.s"), F.col("i") + 1)

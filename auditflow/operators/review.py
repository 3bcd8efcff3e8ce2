"""Operators scoped to a change: lines in a diff, functions, signals, owners, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.paths import base_name, tokens
from .patterns import first_match

LARGE_FILES, LARGE_LINES, GREW, DEEP = 5, 200, 50, 3

#: File names, words and endings of the boundary classes.
DEPLOY_NAMES = ("containerfile", "jenkinsfile", "action.yml", "action.yaml", ".gitlab-ci.yml", "azure-pipelines.yml", "azure-pipelines.yaml", "dockerfile")
SUPPLY_NAMES = ("package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "cargo.toml", "cargo.lock", "go.mod", "go.sum", "requirements.txt", "pyproject.toml", "poetry.lock", "pipfile", "pipfile.lock", "pom.xml", "build.gradle", "build.gradle.kts", "gemfile", "gemfile.lock")
TRUST_WORDS = ("cors", "csp", "helmet")
ACCESS_WORDS = ("auth", "authz", "authn", "login", "logout", "signin", "signout", "session", "sessions", "permission", "permissions", "acl", "guard", "guards", "identity", "credential", "credentials")
ACCESS_PARTS = ("oauth", "jwt", "rbac", "passport", "authentic", "authoriz")
DEFINITE = ("subprocess-added", "env-var-introduced", "migration-added", "error-handling-removed", "test-deleted-or-emptied", "auth-check-removed", "taint-sql", "taint-exec")


def in_diff(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings with a line in a changed range of their file; ranges: (path, start, stop)."""
    r = ranges.select(F.col("path").alias("_p"), "start", "stop")
    return findings.join(r, (F.col("path") == F.col("_p")) & F.col("line_start").between(F.col("start"), F.col("stop")), "left_semi")


def touched_functions(functions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Functions (path, name, first, last) that overlap a changed range."""
    r = ranges.select(F.col("path").alias("_p"), "start", "stop")
    return functions.join(r, (F.col("path") == F.col("_p")) & (F.col("first") <= F.col("stop")) & (F.col("start") <= F.col("last")), "left_semi")


def matched_by_ordinal(before: DataFrame, after: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """after beside before (columns old_*): rows of one name are matched in their order."""
    w = Window.partitionBy(*by).orderBy(*order)
    a = after.withColumn("ordinal", F.row_number().over(w))
    b = before.withColumn("ordinal", F.row_number().over(w)).select(*by, "ordinal", *(F.col(c).alias(f"old_{c}") for c in before.columns if c not in by))
    return a.join(b, [*by, "ordinal"], "left")


def algorithmic(matched: DataFrame) -> DataFrame:
    """Kinds of change of functions with lines, depth, loops and recursive, now and old_*."""
    grew = F.col("lines") - F.coalesce("old_lines", F.lit(0))
    kinds = [
        F.when((F.col("depth") > F.coalesce("old_depth", F.lit(0))) & (F.col("depth") >= DEEP), F.lit("nesting-increased")),
        F.when((F.col("loops") >= 2) & (F.coalesce("old_loops", F.lit(0)) < 2), F.lit("nested-loop-added")),
        F.when(F.col("recursive") & ~F.coalesce("old_recursive", F.lit(False)), F.lit("recursion-added")),
        F.when(grew > GREW, F.lit("function-grew")),
    ]
    return matched.withColumn("kind", F.explode(F.array_compact(F.array(*kinds))))


def boundary(path: Column, custom: str | None = None) -> Column:
    """The class of what a path decides, null for none; custom: a further pattern, tried last."""
    low = F.lower(path)
    name, words = base_name(low), tokens(path)
    within = lambda ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
    deploy = F.contains(low, F.lit(".github/workflows/")) | low.rlike(r"(^|/)\.circleci/|\.tf$|\.tfvars$") | name.isin(*DEPLOY_NAMES) | F.startswith(name, F.lit("dockerfile."))
    out = F.when(deploy, "deploy-surface").when(name.isin(*SUPPLY_NAMES), "supply-chain").when((name == ".env") | F.startswith(name, F.lit(".env.")), "secret-config")
    out = out.when(within(TRUST_WORDS), "request-trust").when(low.rlike("|".join(ACCESS_PARTS)) | within(ACCESS_WORDS), "access-control")
    return out.when(path.rlike(custom), "custom") if custom else out


def tier(kind: Column, in_access: Column, coarse: Column) -> Column:
    """How sure a signal is: coarse ones are noise, and calls inside access control count more."""
    return F.when(coarse, "noise").when(kind.isin(*DEFINITE) | ((kind == "network-call-added") & in_access), "definitely").otherwise("maybe")


def diff_size(ranges: DataFrame) -> DataFrame:
    """One row: changed files and lines."""
    return ranges.agg(F.count_distinct("path").alias("files"), F.coalesce(F.sum(F.col("stop") - F.col("start") + 1), F.lit(0)).alias("lines")).withColumn("large", (F.col("files") > LARGE_FILES) & (F.col("lines") > LARGE_LINES))


def merged_signals(signals: DataFrame) -> DataFrame:
    """Signals (kind, path, line, radius, seq, plan) once per kind and path, lines united."""
    plan = F.min_by("plan", F.when(F.col("plan").isNotNull(), F.col("seq")))
    return signals.groupBy("kind", "path").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.max("radius").alias("radius"), plan.alias("plan"))


def tier_order(path="path", line="line", headline="headline", id_="id") -> list[Column]:
    return [F.col(path).asc_nulls_first(), F.col(line).asc_nulls_first(), F.col(headline), F.col(id_)]


def importer_counts(signals: DataFrame, edges: DataFrame) -> DataFrame:
    """signals with the number of files that import theirs."""
    n = edges.select("src", "dst").distinct().groupBy("dst").agg(F.count(F.lit(1)).alias("importers"))
    return signals.join(n, F.col("path") == F.col("dst"), "left").drop("dst").withColumn("importers", F.coalesce("importers", F.lit(0)))


def removed_but_imported(before: DataFrame, after: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, symbol, importer): symbols that a file no longer exports and others still import."""
    gone = before.select("path", "symbol").distinct().join(after.select("path", "symbol"), ["path", "symbol"], "left_anti")
    return gone.join(imports.select("path", "symbol", "importer").distinct(), ["path", "symbol"])


def owners(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, owners): owners of the last rule whose pattern matches; rules: (rule_no, pattern, owners)."""
    return paths.select("path").distinct().withColumn("owners", first_match(F.col("path"), rules, "rule_no", "pattern", "owners", last=True))


def ownership_summary(owned: DataFrame) -> DataFrame:
    """One row: distinct owners in order, and paths without any."""
    return owned.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("owners")))).alias("owners"), F.count_if(F.col("owners").isNull() | (F.size("owners") == 0)).alias("unowned"))


def expired(expires: Column, today: Column) -> Column:
    """Whether a YYYY-MM-DD date has passed; texts that are no date never expire."""
    return F.coalesce(F.try_to_timestamp(expires, F.lit("yyyy-MM-dd")).cast("date") < today, F.lit(False))


def readiness(signals: DataFrame) -> DataFrame:
    """One row: verdict and reason counts of signals (tier, gate_eligible, suppressed)."""
    live = ~F.col("suppressed")
    blocking = F.count_if(live & F.col("gate_eligible") & (F.col("tier") == "definitely"))
    review = F.count_if(live & F.col("tier").isin("definitely", "maybe"))
    r = signals.agg(blocking.alias("blocking"), review.alias("to_review"), F.count_if(F.col("suppressed")).alias("suppressed"))
    return r.withColumn("verdict", F.when(F.col("blocking") > 0, "blocked").when(F.col("to_review") > 0, "review").otherwise("ready"))

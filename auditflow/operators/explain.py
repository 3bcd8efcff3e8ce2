"""Why a rule's finding is what it is: gates, overrides, records, plans and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranks import SEVERITIES, label, severity_rank

#: Gates of a rule in their order; the first that fails makes it not apply.
GATES = ("language", "language-support", "framework", "runtime", "paradigm", "low-signal-path", "config-role", "generated-role")
#: Levels of language support, from the least.
SUPPORT = ("text", "lexical", "import-graph", "syntax")

_CHECKS = {"SECURITY": "check whether the value is live and who can reach it", "ARCHITECTURE": "check the imports and layers named above", "CODE_QUALITY": "read the code named above and judge its complexity", "TESTING": "look for tests of this behaviour elsewhere", "FRAMEWORK": "check the framework's version and its documentation"}
REDACTED = "[evidence withheld]"
SENSITIVE = ("security.secret-candidate", "security.private-key-candidate")


def _any(allowed: Column, actual: Column) -> Column:
    """Whether lists meet; an empty or null list of allowed values lets all pass."""
    return allowed.isNull() | (F.size(allowed) == 0) | F.coalesce(F.arrays_overlap(allowed, actual), F.lit(False))


def gate_results() -> Column:
    """array<struct<gate, passed>> of a row with a rule's columns (languages, minimum_support,
    frameworks, runtimes, paradigms, suppress_low_signal, suppress_config, suppress_generated) and a
    file's (f_languages, f_support, f_frameworks, f_runtimes, f_paradigms, f_low_signal, f_roles)."""
    level = lambda c: F.array_position(F.array(*map(F.lit, SUPPORT)), c)
    role = lambda r: F.coalesce(F.array_contains("f_roles", r), F.lit(False))
    tests = (
        _any(F.col("languages"), F.col("f_languages")), F.col("minimum_support").isNull() | F.coalesce(level(F.col("f_support")) >= level(F.col("minimum_support")), F.lit(False)),
        _any(F.col("frameworks"), F.col("f_frameworks")), _any(F.col("runtimes"), F.col("f_runtimes")), _any(F.col("paradigms"), F.col("f_paradigms")),
        ~(F.coalesce("suppress_low_signal", F.lit(False)) & F.col("f_low_signal")), ~(F.coalesce("suppress_config", F.lit(False)) & role("config")), ~(F.coalesce("suppress_generated", F.lit(False)) & role("generated")),
    )
    return F.array(*(F.struct(F.lit(g).alias("gate"), t.alias("passed")) for g, t in zip(GATES, tests)))


def gated(findings: DataFrame, knowledge: DataFrame) -> DataFrame:
    """findings (rule_id, f_*) with failed_gate: the first gate of the rule that the file fails, null for none.

    Rules without knowledge apply everywhere.  knowledge has one row a rule.
    """
    k = knowledge.withColumnRenamed("rule_id", "_rule")
    df = findings.join(k, F.col("rule_id") == F.col("_rule"), "left").withColumn("_gates", gate_results())
    failed = F.element_at(F.transform(F.filter("_gates", lambda g: ~g["passed"]), lambda g: g["gate"]), 1)
    failed = F.when(F.col("_rule").isNotNull() & F.exists("_gates", lambda g: ~g["passed"]), failed)
    return df.withColumn("failed_gate", failed).select(*findings.columns, "failed_gate")


def project_decisions(projects: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Decisions on rules that are about a whole project: its languages, frameworks and runtimes as one file's."""
    return gated(projects, knowledge)


def trace(findings: DataFrame, knowledge: DataFrame) -> DataFrame:
    """findings with steps: what was looked up and passed, up to the first gate that failed.

    A step has stage, status and label.
    """
    k = knowledge.withColumnRenamed("rule_id", "_rule")
    df = findings.join(k, F.col("rule_id") == F.col("_rule"), "left").withColumn("_gates", gate_results())
    step = lambda stage, status, name: F.struct(F.lit(stage).alias("stage"), status.alias("status"), name.alias("label"))
    known = F.col("_rule").isNotNull()
    first = F.array(step("rule-lookup", F.when(known, "matched").otherwise("not-matched"), F.lit("knowledge-entry")))
    bad = F.array_position(F.transform("_gates", lambda g: g["passed"]), False)  # 0: none fails
    shown = F.when(bad > 0, F.slice("_gates", F.lit(1), bad.cast("int"))).otherwise(F.col("_gates"))
    gates = F.transform(shown, lambda g: F.struct(F.lit("applicability").alias("stage"), F.when(g["passed"], "passed").otherwise("failed").alias("status"), g["gate"].alias("label")))
    base = F.when(bad == 0, F.array(step("base-decision", F.lit("applied"), F.concat(F.lit("severity "), "severity")))).otherwise(F.array().cast("array<struct<stage:string,status:string,label:string>>"))
    steps = F.when(known, F.concat(first, gates, base)).otherwise(first)
    return df.withColumn("steps", steps).select(*findings.columns, "steps")


def redacted(snippet: Column, rule_id: Column) -> Column:
    """The snippet, or a notice where the rule's evidence is itself a secret."""
    return F.when(rule_id.isin(*SENSITIVE), REDACTED).otherwise(snippet)


def redacted_output(line: Column) -> Column:
    """A line of a program's output without assigned secrets and tokens."""
    key = r"(?i)((?:[\w-]*[_-])?(?:token|password|secret|credential)\s*[=:]\s*)(?<![A-Za-z0-9][=:])\S.*$"
    tokens = F.transform(F.filter(F.split(line, r"\s+"), lambda t: t != ""), lambda t: F.when(t.rlike(r"^[^A-Za-z0-9._-]*[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}[^A-Za-z0-9._-]*$"), "[token]").when(t.rlike(r"^[^A-Za-z0-9._-]*(ghp_[\w.-]{20,}|github_pat_[\w.-]{21,}|sk-[\w.-]{21,}|AKIA[\w.-]{16})[^A-Za-z0-9._-]*$"), "[token]").otherwise(t))
    assigned = line.rlike(r"(?i)(?<![A-Za-z0-9_-])([A-Za-z0-9_-]*[_-])?(token|password|secret|credential)\s*[=:]")
    return F.when(assigned, F.concat(F.regexp_extract(line, r"(?i)^(.*?(?<![A-Za-z0-9_-])(?:[A-Za-z0-9_-]*[_-])?(?:token|password|secret|credential)\s*[=:]\s*)", 1), F.lit("[value withheld]"))).otherwise(F.array_join(tokens, " "))


def verification_plan() -> Column:
    """Steps to confirm a finding of HIGH confidence by its evidence; null for others."""
    each = F.transform("evidence", lambda e: F.concat(F.lit("See "), e["path"], F.lit(":"), e["line_start"], F.coalesce(F.concat(F.lit("-"), e["line_end"]), F.lit("")), F.lit(" for: "), redacted(F.trim(F.coalesce(e["snippet"], F.lit(""))), F.col("rule_id"))))
    check = F.lit(None).cast("string")
    for category, text in _CHECKS.items():
        check = F.when(F.col("category") == category, text).otherwise(check)
    steps = F.concat(each, F.array_compact(F.array(check)), F.array(F.lit("nothing was run: confirm by reading or by a test")))
    return F.when(F.col("confidence") == "HIGH", steps)


def records(findings: DataFrame) -> DataFrame:
    """findings with record: severity, confidence, recommendation, number of evidences and plan."""
    return findings.withColumn("record", F.struct("severity", "confidence", "recommendation", F.size("evidence").alias("evidence"), verification_plan().alias("plan")))


def explained(findings: DataFrame, knowledge: DataFrame, registry: DataFrame) -> DataFrame:
    """findings with what is known of their rule, the decision's trace, and the score's parts."""
    r = registry.select(F.col("rule_id").alias("_id"), F.struct("category", "lifecycle", "signal_source", "default_severity", "max_severity").alias("rule"))
    df = trace(findings, knowledge).join(F.broadcast(r), F.col("rule_id") == F.col("_id"), "left").drop("_id")  # one row a rule of the registry
    return df.withColumn("score_parts", F.transform("signals", lambda s: F.concat_ws(" ", s["id"], s["weight"]))) if "signals" in findings.columns else df


def decision_summary(findings: DataFrame, errors: Column | None = None, hidden: int = 0) -> DataFrame:
    """One row: pass, review or block, and the counts behind it."""
    errors = F.lit(0) if errors is None else errors
    n = findings.agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("priority") == "P0").alias("p0"), F.count_if(F.col("priority") == "P1").alias("p1"), F.count_if(F.col("confidence") == "HIGH").alias("verification_plans"))
    verdict = F.when((errors > 0) | (F.col("p0") > 0), "block").when(F.col("findings") == 0, "pass").otherwise("review")
    return n.withColumns({"verdict": verdict, "hidden": F.lit(hidden)})


def lowered(severity: Column, by: int) -> Column:
    """A severity some ranks lower, not under the least."""
    return label(F.greatest(severity_rank(severity) - by, F.lit(0)), SEVERITIES)

"""Risk scores: a base from the finding itself, then ordered overlays.

A score is clamped to 0..100 after the base and after every overlay, so overlays do not
commute; each is a projection of its own.  An overlay whose signal is there already does
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules
from ..functions.paths import cluster_scope
from ..functions.ranks import priority_of

#: Fixed values of the formula.
SEVERITY_BASE = {"CRITICAL": 95, "HIGH": 75, "MEDIUM": 45, "LOW": 20, "INFO": 5}
CONFIDENCE_PERCENT = {"HIGH": 110, "MEDIUM": 100, "LOW": 80}
SECURITY, TESTING, BROAD = 12, -12, -12
ROLE_WEIGHTS = {"production": 10, "test": -20, "generated": -30, "config": -18, "low-signal-path": -15, "entrypoint": 10, "controller": 12, "service": 10, "domain": 8, "react-component": 4}
BASELINE_NEW, BASELINE_EXISTING, IN_DIFF, HOTSPOT, HUB, DEPENDENCY, BLAST = 10, -8, 12, 5, 8, 5, 6
HUB_IN, HUB_OUT, DEPENDENCY_IN = 3, 8, 2
CLUSTER_LEAST = 3


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def _of(labels: dict[str, int], c: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in labels.items():
        out = F.when(c == name, n).otherwise(out)
    return out


def signal(id_: Column | str, weight: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(id_).alias("id"), lit(weight).cast("int").alias("weight"))


def confidence_delta(base: Column, confidence: Column) -> Column:
    """(base * percent + 50) div 100 - base: halves round up."""
    return (F.floor((base * _of(CONFIDENCE_PERCENT, confidence) + 50) / 100) - base).cast("int")


def base_score(findings: DataFrame, roles: str | None = None) -> DataFrame:
    """findings (rule_id, category, severity, confidence) with signals, score and priority.

    roles: a column with the finding's file roles (array of keys of ROLE_WEIGHTS; null: no file).
    """
    base = _of(SEVERITY_BASE, F.col("severity"))
    delta = confidence_delta(base, F.col("confidence"))
    found = [
        signal(F.concat(F.lit("severity."), F.lower("severity")), base),
        F.when(delta != 0, signal(F.concat(F.lit("confidence."), F.lower("confidence")), delta)),
        F.when(F.col("category") == "SECURITY", signal("category.security", SECURITY)),
        F.when(F.col("category") == "TESTING", signal("category.testing-gap", TESTING)),
        F.when(F.col("rule_id").isin(*rules.BROAD_MAINTAINABILITY), signal("knowledge.broad-maintainability", BROAD)),
    ]
    if roles:
        has = lambda r: F.array_contains(roles, r)
        for role, weight in ROLE_WEIGHTS.items():
            when = has(role) & ~has("test") & ~has("generated") if role == "low-signal-path" else has(role)
            found.append(F.when(when, signal(f"role.{role}", weight)))
    scored = findings.withColumn("signals", F.array_compact(F.array(*found)))
    return rescored(scored, F.aggregate("signals", F.lit(0), lambda a, s: a + s["weight"]))


def rescored(df: DataFrame, score: Column) -> DataFrame:
    return df.withColumn("score", clamp(score)).withColumn("priority", priority_of(F.col("score")))


def overlay(df: DataFrame, id_: Column | str, weight: Column | int, when: Column) -> DataFrame:
    """Add a signal where `when` holds and the finding has none of that id; score and band follow."""
    s = signal(id_, weight)
    fires = F.coalesce(when, F.lit(False)) & ~F.exists("signals", lambda x: x["id"] == s["id"])
    df = df.withColumn("_fires", fires)
    df = df.withColumns({"score": F.when(F.col("_fires"), clamp(F.col("score") + s["weight"])).otherwise(F.col("score")), "signals": F.when(F.col("_fires"), F.concat("signals", F.array(s))).otherwise(F.col("signals"))})
    return df.withColumn("priority", priority_of(F.col("score"))).drop("_fires")


def graph_impact(degrees: DataFrame) -> DataFrame:
    """(node, impact): hubs and shared dependencies of (node, fan_in, fan_out)."""
    impact = F.when((F.col("fan_in") >= HUB_IN) | (F.col("fan_out") >= HUB_OUT), "hub").when(F.col("fan_in") >= DEPENDENCY_IN, "dependency")
    return degrees.select("node", impact.alias("impact")).filter("impact IS NOT NULL")


def graph_overlay(df: DataFrame, impacts: DataFrame) -> DataFrame:
    df = df.join(impacts, F.col("path") == F.col("node"), "left")
    df = overlay(df, F.concat(F.lit("graph."), F.col("impact")), F.when(F.col("impact") == "hub", HUB).otherwise(DEPENDENCY), F.col("impact").isNotNull())
    return df.drop("node", "impact")


def cluster_weight(size: Column) -> Column:
    return F.when(size >= 16, 7).when(size >= 6, 5).when(size >= 3, 3).otherwise(0)


def cluster_sizes(findings: DataFrame) -> DataFrame:
    """(rule_id, scope, n): areas in which a rule repeats at least three times."""
    return findings.groupBy("rule_id", cluster_scope(F.col("path")).alias("scope")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CLUSTER_LEAST)


def cluster_overlay(df: DataFrame) -> DataFrame:
    sizes = cluster_sizes(df).select(F.col("rule_id").alias("_rule"), F.col("scope").alias("_scope"), F.col("n").alias("_n"))
    df = df.join(sizes, (F.col("rule_id") == F.col("_rule")) & (cluster_scope(F.col("path")) == F.col("_scope")), "left")
    return overlay(df, "cluster.repeated", cluster_weight(F.col("_n")), F.col("_n").isNotNull()).drop("_rule", "_scope", "_n")


def hotspots(findings: DataFrame) -> DataFrame:
    """(package, n): packages with more than one finding of high or critical severity."""
    return findings.filter(F.col("severity").isin("HIGH", "CRITICAL") & F.col("package").isNotNull()).groupBy("package").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def hotspot_overlay(df: DataFrame) -> DataFrame:
    hot = hotspots(df).select(F.col("package").alias("_hot"))
    df = df.join(hot, F.col("package") == F.col("_hot"), "left")
    return overlay(df, "workspace.hotspot", HOTSPOT, F.col("_hot").isNotNull()).drop("_hot")


def baseline_overlay(df: DataFrame, status: str = "status") -> DataFrame:
    new = F.col(status) == "new"
    return overlay(df, F.when(new, "baseline.new").otherwise("baseline.existing"), F.when(new, BASELINE_NEW).otherwise(BASELINE_EXISTING), F.col(status).isNotNull())


def review_overlay(df: DataFrame, in_diff: str = "in_diff") -> DataFrame:
    return overlay(df, "review.in-diff", IN_DIFF, F.col(in_diff))


def blast_overlay(df: DataFrame, impacted: DataFrame) -> DataFrame:
    """impacted: (path) of files in the blast radius."""
    hit = impacted.select(F.col("path").alias("_hit")).distinct()
    df = df.join(hit, F.col("path") == F.col("_hit"), "left")
    return overlay(df, "review.blast-radius", BLAST, F.col("_hit").isNotNull()).drop("_hit")

"""Score formula, its bands and the order of overlays."""

import pytest
from pyspark.sql import functions as F

from auditflow.functions import rules
from auditflow.operators import findings, risk

#: rule, category, severity, confidence, flags -> score, band
CASES = [
    ("code-marker.todo", "CODE_QUALITY", "INFO", "MEDIUM", {}, 5, "P3"),
    ("code-marker.todo", "CODE_QUALITY", "LOW", "MEDIUM", {}, 20, "P3"),
    ("code-quality.long-function", "CODE_QUALITY", "MEDIUM", "MEDIUM", {}, 33, "P3"),
    ("architecture.large-file", "ARCHITECTURE", "HIGH", "MEDIUM", {}, 63, "P2"),
    ("security.private-key-candidate", "SECURITY", "CRITICAL", "MEDIUM", {}, 100, "P0"),
    ("architecture.large-file", "ARCHITECTURE", "HIGH", "LOW", {}, 48, "P2"),
    ("security.secret-candidate", "SECURITY", "HIGH", "MEDIUM", {}, 87, "P1"),
    ("testing.source-without-test", "TESTING", "LOW", "LOW", {}, 4, "P3"),
    ("architecture.test-leak", "ARCHITECTURE", "MEDIUM", "HIGH", {}, 50, "P2"),
]


@pytest.mark.parametrize("rule,category,severity,confidence,flags,score,band", CASES)
def test_base(spark, rule, category, severity, confidence, flags, score, band):
    df = spark.createDataFrame([(rule, category, severity, confidence)], "rule_id string, category string, severity string, confidence string")
    r = risk.base_score(df).first()
    assert (r.score, r.priority) == (score, band)
    assert r.signals[0].id == f"severity.{severity.lower()}"


def _scored(spark, score, **more):
    df = spark.createDataFrame([(score,)], "score int").withColumn("signals", F.array(risk.signal("severity.high", 75))).withColumn("priority", F.lit("P1"))
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_overlays_clamp_one_by_one(spark):
    df = _scored(spark, 95, status="existing", in_diff=True)
    up_down = risk.baseline_overlay(risk.review_overlay(df)).first().score
    down_up = risk.review_overlay(risk.baseline_overlay(df)).first().score
    assert (up_down, down_up) == (92, 99)


def test_overlay_is_idempotent(spark):
    df = _scored(spark, 50, in_diff=True)
    r = risk.review_overlay(risk.review_overlay(df)).first()
    assert r.score == 62 and [s.id for s in r.signals] == ["severity.high", "review.in-diff"]


def test_roles(spark):
    df = spark.createDataFrame([("x", "CODE_QUALITY", "MEDIUM", "MEDIUM", ["test", "low-signal-path"]), ("x", "CODE_QUALITY", "MEDIUM", "MEDIUM", ["production", "entrypoint"]), ("x", "CODE_QUALITY", "MEDIUM", "MEDIUM", None)], "rule_id string, category string, severity string, confidence string, roles array<string>")
    assert [r.score for r in risk.base_score(df, "roles").collect()] == [25, 65, 45]


def test_demoted_hub_is_restored(spark):
    """MEDIUM confidence stands for "not set": the registry's HIGH comes back."""
    df = spark.createDataFrame([("architecture.high-instability-hub", "HIGH", "MEDIUM"), ("architecture.large-file", "CRITICAL", "HIGH"), ("code-marker.todo", "INFO", "HIGH"), ("nobody.knows", "LOW", "LOW")], "rule_id string, severity string, confidence string")
    got = {r.rule_id: (r.severity, r.confidence) for r in findings.enriched(df, rules.table(spark)).collect()}
    assert got == {"architecture.high-instability-hub": ("HIGH", "HIGH"), "architecture.large-file": ("HIGH", "MEDIUM"), "code-marker.todo": ("LOW", "LOW"), "nobody.knows": ("LOW", "LOW")}


def test_registry():
    assert len(rules.rows()) == 54 and len({r[1] for r in rules.rows()}) == 54

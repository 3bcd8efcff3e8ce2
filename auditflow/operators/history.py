"""Baselines, run history and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.ranks import PRIORITIES, SEVERITIES, priority_rank, severity_rank

KEEP_RUNS, KEEP_BYTES = 50, 5 * 1024 * 1024

#: What two runs must share, in the order in which a difference is reported.
IDENTITY = (("workspace", "workspace-mismatch"), ("analysis_target", "target-mismatch"), ("scope", "scope-mismatch"), ("base_revision", "revision-range-mismatch"), ("head_revision", "revision-range-mismatch"), ("profile", "profile-mismatch"), ("config_fingerprint", "config-mismatch"), ("selection_fingerprint", "selection-mismatch"), ("overlay_fingerprint", "overlay-mismatch"), ("analysis_schema", "analysis-schema-mismatch"))


def is_legacy(key: Column) -> Column:
    """Keys of an older form, which end in a line or a range of lines, from 1."""
    number = "0*[1-9][0-9]*"
    return key.rlike(f":{number}(-{number})?$")


def baseline_status(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """findings (key, rule_id, path, title) with status existing or new.

    A finding exists if the baseline has its key, or a legacy entry with its rule, path and
    message.
    """
    keys = baseline.select(F.col("key").alias("_key")).distinct()
    old = baseline.filter(is_legacy(F.col("key"))).select(F.col("rule_id").alias("_r"), F.col("path").alias("_p"), F.col("message").alias("_m")).distinct()
    df = findings.join(keys, F.col("key") == F.col("_key"), "left")
    df = df.join(old, (F.col("rule_id") == F.col("_r")) & (F.col("path") == F.col("_p")) & (F.col("title") == F.col("_m")), "left")
    return df.withColumn("status", F.when(F.col("_key").isNotNull() | F.col("_r").isNotNull(), "existing").otherwise("new")).drop("_key", "_r", "_p", "_m")


def last_per_key(findings: DataFrame, order: str) -> DataFrame:
    """One row per occurrence_key: the last in order."""
    return findings.groupBy("occurrence_key").agg(F.max_by(F.struct(*findings.columns), F.col(order)).alias("r")).select("r.*")


def run_delta(current: DataFrame, prior: DataFrame, order: str = "seq") -> DataFrame:
    """(occurrence_key, rule_id, path, state, old_severity, new_severity, shifted)."""
    side = lambda df, p: last_per_key(df, order).select(F.col("occurrence_key"), *(F.col(c).alias(f"{p}{c}") for c in ("rule_id", "path", "severity")))
    j = side(current, "n_").join(side(prior, "o_"), "occurrence_key", "full_outer")
    state = F.when(F.col("o_rule_id").isNull(), "new").when(F.col("n_rule_id").isNull(), "resolved").otherwise("persisting")
    shifted = (state == "persisting") & (F.col("n_severity") != F.col("o_severity"))
    return j.select("occurrence_key", F.coalesce("n_rule_id", "o_rule_id").alias("rule_id"), F.coalesce("n_path", "o_path").alias("path"), state.alias("state"), F.col("o_severity").alias("old_severity"), F.col("n_severity").alias("new_severity"), F.coalesce(shifted, F.lit(False)).alias("shifted"))


def gate(findings: DataFrame, new=None, severity=None, priority=None) -> DataFrame:
    """One row (failed, passed) for a threshold on new findings, any findings, or priority."""
    if priority:
        bad = priority_rank(F.col("priority")) <= PRIORITIES.index(priority)
    elif new:
        bad = (F.col("status") == "new") & (severity_rank(F.col("severity")) >= SEVERITIES.index(new))
    else:
        bad = severity_rank(F.col("severity")) >= SEVERITIES.index(severity)
    return findings.agg(F.count_if(bad).alias("failed")).select("failed", (F.col("failed") == 0).alias("passed"))


def mismatch(current: DataFrame, prior: DataFrame, on: str) -> DataFrame:
    """(on, reason): the first part of the identity in which runs differ; null: comparable."""
    p = prior.select(F.col(on), *(F.col(c).alias(f"_{c}") for c, _ in IDENTITY), F.col("schema_version").alias("_v"))
    reason = F.when(F.col("schema_version") != F.col("_v"), "schema-mismatch")
    for c, name in IDENTITY:
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), name)
    return current.join(p, on).select(on, reason.alias("reason"))


def kept_runs(runs: DataFrame, by: list[str], runs_kept=KEEP_RUNS, bytes_kept=KEEP_BYTES) -> DataFrame:
    """The newest runs of each ledger, at most so many and so many bytes in all.

    runs: by..., recorded_at, run, n_bytes.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("recorded_at"), F.desc("run"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = runs.withColumns({"_n": F.row_number().over(w), "_b": F.sum("n_bytes").over(upto)})
    return ranked.filter((F.col("_n") <= runs_kept) & (F.col("_b") <= bytes_kept)).drop("_n", "_b")


def newest_compatible(runs: DataFrame, current: DataFrame, identity: list[str]) -> DataFrame:
    """Of runs, for each current identity, the newest one that shares it."""
    row = F.struct(*runs.columns)
    return runs.join(current.select(*identity).distinct(), identity, "left_semi").groupBy(*identity).agg(F.max_by(row, F.struct("recorded_at", "run")).alias("r")).select("r.*")

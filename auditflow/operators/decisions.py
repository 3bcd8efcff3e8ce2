"""Knowledge decisions: whether a rule applies to a file, and how severely.

A decision starts from the rule's own severity.  Gates of the rule (languages, roles) may make it
not apply; then overrides apply in their order, each by rule and context, until one suppresses;
then the repository's own overlay, by rule and path glob, if it has not expired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranks import SEVERITIES, label, severity_rank


#: Rows of a configuration table that may be broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 20_000


def small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it is small."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def applies(rule_languages: Column, language: Column) -> Column:
    """Whether a rule's languages (null: all) include the file's."""
    return rule_languages.isNull() | F.coalesce(F.array_contains(rule_languages, language), F.lit(False))


def decided(findings: DataFrame, gates: DataFrame, overrides: DataFrame, overlay: DataFrame, today: Column) -> DataFrame:
    """findings with severity, action (keep, lower, raise, suppress, not-applicable) and reason.

    findings: finding_no, rule_id, path, language, role, severity.  gates: rule_id, languages.
    overrides: ord, rule_id, role, severity (null: suppress), reason.  overlay: ord, rule_id,
    pattern, severity (null: suppress), expires, reason.  All but findings are configuration.
    """
    g = gates.select(F.col("rule_id").alias("_g"), F.col("languages").alias("_languages"))
    df = findings.join(small(g), F.col("rule_id") == F.col("_g"), "left")
    o = overrides.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("ord", "role", "severity", "reason"))).alias("_o")).withColumnRenamed("rule_id", "_or")
    v = overlay.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("ord", "pattern", "severity", "expires", "reason"))).alias("_v")).withColumnRenamed("rule_id", "_vr")
    df = df.join(small(o), F.col("rule_id") == F.col("_or"), "left").join(small(v), F.col("rule_id") == F.col("_vr"), "left")
    start = F.struct(severity_rank(F.col("severity")).alias("rank"), F.lit(False).alias("gone"), F.lit(None).cast("string").alias("reason"))

    def fold(steps, holds, start_):
        def step(acc, s):
            hit = ~acc["gone"] & F.coalesce(holds(s), F.lit(False))
            rank = F.coalesce(severity_rank(s["severity"]), acc["rank"])
            return F.struct(F.when(hit, rank).otherwise(acc["rank"]).alias("rank"), (acc["gone"] | (hit & s["severity"].isNull())).alias("gone"), F.when(hit, s["reason"]).otherwise(acc["reason"]).alias("reason"))

        return F.aggregate(steps, start_, step)

    none_o, none_v = F.array().cast(df.schema["_o"].dataType), F.array().cast(df.schema["_v"].dataType)
    known = fold(F.coalesce("_o", none_o), lambda s: s["role"].isNull() | (s["role"] == F.col("role")), start)
    df = df.withColumn("_k", known)
    live = lambda s: s["expires"].isNull() | (F.to_date(s["expires"]) >= today)
    df = df.withColumn("_k", fold(F.coalesce("_v", none_v), lambda s: F.regexp_like("path", s["pattern"]) & live(s), F.col("_k")))
    fits, before = applies(F.col("_languages"), F.col("language")), severity_rank(F.col("severity"))
    action = F.when(~fits, "not-applicable").when(F.col("_k.gone"), "suppress").when(F.col("_k.rank") < before, "lower").when(F.col("_k.rank") > before, "raise").otherwise("keep")
    out = df.withColumns({"action": action, "reason": F.col("_k.reason"), "severity": label(F.col("_k.rank"), SEVERITIES)})
    return out.select(*findings.columns, "action", "reason")

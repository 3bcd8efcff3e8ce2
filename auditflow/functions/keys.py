"""Stable and exact identities of findings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def masked(text: Column) -> Column:
    """Lower case; string literals and digit runs as '#', white space runs as one space."""
    x = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*("|$)', r'"#$1')
    x = F.regexp_replace(F.lower(x), "[0-9]+", "#")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def fingerprint(*columns: Column) -> Column:
    """16 hex digits of the masked parts."""
    return F.substring(F.sha2(F.concat_ws("\n", *map(masked, columns)), 256), 1, 16)


def stable_key(rule_id: Column, path: Column, title: Column, description: Column, snippet: Column) -> Column:
    """rule:path:hash; it survives moved lines and changed literals."""
    what = F.when(F.trim(F.coalesce(snippet, F.lit(""))) == "", description).otherwise(snippet)
    return F.when(path.isNull(), F.concat_ws(":", rule_id, fingerprint(title, description))).otherwise(F.concat_ws(":", rule_id, path, fingerprint(title, what)))


def occurrence_key(rule_id: Column, title: Column, evidence: Column) -> Column:
    """16 hex digits of the exact evidence: structs of path, line_start, line_end, snippet."""
    each = F.transform(evidence, lambda e: F.concat_ws("\u0001", e["path"], e["line_start"], F.coalesce(e["line_end"].cast("string"), F.lit("")), e["snippet"]))
    rest = F.when(F.size(evidence) == 0, title).otherwise(F.array_join(each, "\u0001"))
    return F.substring(F.sha2(F.concat_ws("\u0001", rule_id, rest), 256), 1, 16)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)

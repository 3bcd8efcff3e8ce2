"""Ordered labels as ranks, and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Labels from lowest to highest, and the order of categories in reports.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
CONFIDENCES = ("LOW", "MEDIUM", "HIGH")
PRIORITIES = ("P0", "P1", "P2", "P3")
CATEGORIES = ("SECURITY", "ARCHITECTURE", "FRAMEWORK", "CODE_QUALITY", "TESTING")


def rank(label: Column, labels: tuple[str, ...]) -> Column:
    """Place of label in labels, from 0; null for others."""
    at = F.array_position(F.array(*map(F.lit, labels)), label)
    return F.when(at > 0, at - 1).cast("int")


def label(place: Column, labels: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, labels)), place)


def severity_rank(c: Column) -> Column:
    return rank(c, SEVERITIES)


def confidence_rank(c: Column) -> Column:
    return rank(c, CONFIDENCES)


def priority_rank(c: Column) -> Column:
    return rank(c, PRIORITIES)


def category_rank(c: Column) -> Column:
    return rank(c, CATEGORIES)


def priority_of(score: Column) -> Column:
    """The risk band of a score."""
    return F.when(score >= 90, "P0").when(score >= 70, "P1").when(score >= 40, "P2").otherwise("P3")

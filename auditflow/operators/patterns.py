"""Configured lists of path patterns, applied in order.

Such a list is a file's lines: it is read to the driver, up to MOST entries, and becomes one
expression of the paths, so that no path is paired with every pattern in a join.  A longer list is an
error rather than a broadcast of unknown size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MOST = 2000


def entries(table: DataFrame, order: str) -> list:
    rows = table.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a list of more than {MOST} patterns")
    return sorted(rows, key=lambda r: r[order])


def first_match(path: Column, table: DataFrame, order: str, pattern: str, value: str | None = None, last: bool = False) -> Column:
    """The value (by default the order) of the first, or last, entry whose pattern matches; null for none."""
    rows = entries(table, order)
    if not rows:
        return F.lit(None).cast(table.schema[value or order].dataType)
    kind = table.schema[value or order].dataType
    lit = lambda v: F.array(*map(F.lit, v)).cast(kind) if isinstance(v, list) else F.lit(v).cast(kind)
    return F.coalesce(*(F.when(path.rlike(r[pattern]), lit(r[value or order])) for r in (reversed(rows) if last else rows)))

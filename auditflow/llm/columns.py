"""Helpers for tables whose other columns must pass through untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Stands for a null doc_id: null ids are one document that comes before all others.
NULL_ID = -(1 << 63)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for added columns that clash with none that df has (case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID))


def rekeyed(column: Column) -> Column:
    """The long column under another, equally distinct value.

    An aggregate joined back on its own grouping key reads the aggregate's partitions as they
    are, and a hot key's rows then meet in one task.  Joined on rekeyed() columns, both sides
    are dealt anew, which lets adaptive execution split a hot key over tasks.
    """
    return column.bitwiseXOR(F.lit(1).cast("long"))

"""Functions, nesting and scores from the table of syntax nodes.

Every node knows what stands around it, so that an owner or a depth is an expression over that
array; one aggregate by file and function gives the measures of all functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Words of loops.
LOOPS = ("for", "foreach", "while", "loop", "do")


def around(kind: str) -> Column:
    """The structures of a kind around a node, outermost first."""
    return F.filter("around", lambda a: a["kind"] == kind)


def owner() -> Column:
    """The innermost function around a node; null outside functions."""
    fs = around("function")
    return F.when(F.size(fs) > 0, F.element_at(fs, -1))


def nested(kind: str = "control", words: tuple[str, ...] | None = None) -> Column:
    """How many structures of a kind (and with one of the words) stand between a node and its function."""
    own = F.coalesce(owner()["pre"], F.lit(-1))
    inside = F.filter("around", lambda a: (a["kind"] == kind) & (a["pre"] > own) & (a["word"].isin(*words) if words else F.lit(True)))
    return F.size(inside)


def functions(nodes: DataFrame) -> DataFrame:
    """(path, language, name, first, last, lines, score, depth, loops, recursive) of each function.

    A structure costs one more than the structures around it in its function; an `else if` on the
    level of its `if` and a logical operator cost one.  What stands in an inner function is its own.
    """
    control, own = F.col("kind") == "control", owner()
    is_function = F.col("kind") == "function"
    callee = F.regexp_replace("name", r"^(this|self|cls|Self)(\.|::)", "")
    told = nodes.filter(F.col("kind").isin("function", "control", "elseif", "logical", "call"))
    rows = told.select(
        "path", "language", F.when(is_function, F.col("pre")).otherwise(own["pre"]).alias("f"),
        F.when(is_function, F.struct("name", "first", "last")).alias("self"),
        F.when(control, 1 + nested()).when(F.col("kind").isin("elseif", "logical"), 1).otherwise(0).alias("cost"),
        F.when(control, 1 + nested()).otherwise(0).alias("deep"),
        F.when(control & F.col("word").isin(*LOOPS), 1 + nested(words=LOOPS)).otherwise(0).alias("loop"),
        ((F.col("kind") == "call") & (own["name"] != "") & (callee == own["name"])).alias("again"),
    ).filter("f IS NOT NULL")
    measured = rows.groupBy("path", "language", "f").agg(F.max("self").alias("s"), F.sum("cost").cast("int").alias("score"), F.max("deep").alias("depth"), F.max("loop").alias("loops"), F.coalesce(F.bool_or("again"), F.lit(False)).alias("recursive"))
    return measured.select("path", "language", "s.name", "s.first", "s.last", (F.col("s.last") - F.col("s.first") + 1).alias("lines"), "score", "depth", "loops", "recursive")


def crossings(nodes: DataFrame, most: int) -> DataFrame:
    """The control structures that are the first below the allowed depth, functions around them notwithstanding."""
    return nodes.filter((F.col("kind") == "control") & (F.size(around("control")) == most))

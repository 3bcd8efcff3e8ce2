"""Findings on rings of imports and on imports that mean nothing.

Rings go by strongly connected components; every step treats all components at once.  The ring that
a finding shows is a shortest one through the first node that has it, found by walking along the
nodes that are one step nearer to its start each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.storage import materialize
from .graph import components_strong, contained, reverse, shortest_cycles, spread
from .textrules import finding

#: Edges of one component that a walk holds; cycles that it meets, and how deep it goes.
MOST_EDGES, MOST_CYCLES, DEPTH = 1_000_000, 1000, 64
#: Endings of languages whose deferred imports are types, which do not run.
_TYPED = r"\.[cm]?[jt]sx?$"


def ring_paths(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, nodes): a shortest cycle of each component, from its start."""
    inside = materialize(edges.select("src", "dst").distinct().join(components.toDF("src", "a"), "src").join(components.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst"))
    short = materialize(shortest_cycles(inside, components))
    starts = short.select("component", "start", F.col("start").alias("node"))
    longest = short.agg(F.max("length")).first()[0] or 0
    back = materialize(spread(reverse(inside), starts, max(longest - 1, 0), ["component", "start"]).select("component", F.col("node").alias("dst"), F.col("hop").alias("left")))
    path = short.select("component", "length", F.col("start").alias("src"), F.array("start").alias("nodes"))
    for step in range(1, longest):
        more = path.filter(F.col("length") > step).join(inside, "src").join(back, ["component", "dst"]).filter(F.col("left") == F.col("length") - step)
        nearer = more.groupBy("component").agg(F.min_by(F.struct("length", F.col("dst").alias("src"), F.array_append("nodes", F.col("dst")).alias("nodes")), "dst").alias("p")).select("component", "p.*")
        path = materialize(nearer.unionByName(path.filter(F.col("length") <= step).select("component", "length", "src", "nodes")))
    return path.select("component", "nodes")


def circular_dependencies(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with nodes and size, one a component of production files; files: (path, role).

    edges: (src, dst, deferred).  Rings of eager imports are grave.  Rings that only deferred
    imports close are slight, and none at all among files whose deferred imports are types; they are
    left out where the component holds a grave one.
    """
    full = materialize(contained(edges.select("src", "dst", "deferred")))
    production = files.filter("role = 'production'").select(F.col("path").alias("node"))

    def rings(e: DataFrame) -> DataFrame:
        c = materialize(components_strong(e))
        other = c.join(production, "node", "left_anti").select("component").distinct()
        return materialize(c.join(other, "component", "left_anti"))

    def told(c: DataFrame, e: DataFrame, severity: str) -> DataFrame:
        sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        rows = ring_paths(e, c.select("node", "component")).join(sizes, "component").withColumn("path", F.col("nodes")[0])
        return rows.select(F.lit("architecture.circular-dependency").alias("rule_id"), "path", F.lit(severity).alias("severity"), F.lit(1).alias("line_start"), "nodes", "size")

    eager = full.filter("NOT deferred")
    grave = rings(eager)
    wide = rings(full)
    touched = wide.join(grave.select("node"), "node", "left_semi").select("component").distinct()
    runs = wide.filter(~F.col("node").rlike(_TYPED)).select("component").distinct()
    slight = materialize(wide.join(touched, "component", "left_anti").join(runs, "component", "left_semi"))
    return told(grave, eager, "HIGH").unionByName(told(slight, full, "LOW"))


def unresolved_imports(resolved: DataFrame) -> DataFrame:
    """Findings for local imports (src, spec, line, guarded, candidates, dst) that mean no file: by a relative path, or a module declared."""
    local = F.col("spec").rlike(r"^\.{1,2}/|^\.+\w|^(mod|file) ") & (F.size("candidates") > 0)
    rows = resolved.filter(F.col("dst").isNull() & ~F.col("guarded") & local)
    return finding(rows.groupBy(F.col("src").alias("path"), "spec").agg(F.min("line").alias("line")), "architecture.unresolved-local-import", "HIGH", F.col("line"))


def _walk(most: int, depth: int, most_edges: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict = {}
        n = 0
        for b in batches:
            n += len(b)
            if n > most_edges:
                raise ValueError(f"more than {most_edges} edges lie in one component")
            for a, c in zip(b["src"], b["dst"]):
                out.setdefault(a, []).append(c)
        found, state = [], {}
        for start in sorted(out):
            if start in state or len(found) > most:
                continue
            stack, todo = [start], [(start, iter(sorted(out[start])))]
            state[start] = 1
            while todo:
                node, targets = todo[-1]
                step = next(targets, None) if len(found) <= most else None
                if step is None:
                    todo.pop()
                    stack.pop()
                    state[node] = 2
                elif state.get(step) == 1:
                    found.append(stack[stack.index(step) :])
                elif step not in state and len(todo) <= depth:
                    state[step] = 1
                    stack.append(step)
                    todo.append((step, iter(sorted(out.get(step, ())))))
        turned = {tuple(p[p.index(min(p)) :] + p[: p.index(min(p))]) for p in found}
        yield pd.DataFrame({"cycle": [list(p) for p in sorted(turned)][: most + 1]})

    return run


def cycles_met(edges: DataFrame, components: DataFrame, most: int = MOST_CYCLES, depth: int = DEPTH, most_edges: int = MOST_EDGES) -> DataFrame:
    """(component, cycle): the cycles that a depth-first walk of each component meets, from their smallest node.

    A walk goes from the smallest node on, targets in order, `depth` deep; it stops once it has met
    more than `most`.  Components are walked apart, each in its own group.
    """
    inside = edges.select("src", "dst").distinct().join(components.toDF("src", "component"), "src").join(components.toDF("dst", "b"), "dst").filter("component = b").select("component", "src", "dst")
    run = _walk(most, depth, most_edges)

    def grouped(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = pd.concat(list(run(iter([rows]))))
        found.insert(0, "component", key[0])
        return found

    return inside.groupBy("component").applyInPandas(grouped, "component string, cycle array<string>")

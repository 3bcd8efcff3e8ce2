"""Rules and changes that go by functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import low_signal
from .review import algorithmic, matched_by_ordinal, touched_functions
from .syntaxtree import crossings
from .textrules import finding

#: Default thresholds, and how many times longer a component or hook may be.
LONG, COMPLEX, DEEP = 50, 15, 4
COMPONENT_TIMES, HOOK_TIMES = 3, 2


def _audited(functions: DataFrame, files: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """functions of files (path, role) with one of the roles."""
    return functions.join(files.filter(F.col("role").isin(*roles)).select("path", "role"), "path")


def long_functions(functions: DataFrame, files: DataFrame, most: int = LONG) -> DataFrame:
    """Functions over `most` lines; in a .jsx or .tsx file a capitalised name is a component and useX a hook."""
    view = F.col("path").rlike(r"\.[jt]sx$")
    component, hook = view & F.col("name").rlike("^[A-Z]"), F.col("name").rlike("^use[A-Z]") & F.col("language").isin("JavaScript", "TypeScript")
    times = F.when(component, COMPONENT_TIMES).when(hook, HOOK_TIMES).otherwise(1)
    rows = _audited(functions, files, ("production", "test")).filter(~low_signal(F.col("path")) & (F.col("lines") > most * times))
    return finding(rows, "code-quality.long-function", F.when(component | hook, "LOW").otherwise("MEDIUM"), F.col("first"))


def complex_functions(functions: DataFrame, files: DataFrame, most: int = COMPLEX) -> DataFrame:
    rows = _audited(functions, files, ("production",)).filter(~low_signal(F.col("path")) & (F.col("score") > most))
    return finding(rows, "code-quality.complex-function", "MEDIUM", F.col("first"))


def deep_control_flow(nodes: DataFrame, files: DataFrame, most: int = DEEP) -> DataFrame:
    """The structures of syntax nodes at which control flow first stands deeper than `most`."""
    return finding(_audited(crossings(nodes, most), files, ("production",)), "code-quality.deep-control-flow", "LOW", F.col("first"))


def algorithmic_changes(before: DataFrame, after: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, name, first, kind): what changed functions became, by occurrence of their name."""
    pairs = matched_by_ordinal(before, after, ["path", "name"], ["first"])
    return algorithmic(touched_functions(pairs, ranges)).select("path", "name", "first", "kind")

"""Functions of source files: where they stand, how deep and how long they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import syntaxtree
from .syntax import nodes


def functions(files: DataFrame) -> DataFrame:
    """Functions of files (path, language, content), measured on their syntax nodes."""
    return syntaxtree.functions(nodes(files, ("function", "control", "elseif", "logical", "call")))

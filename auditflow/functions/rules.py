"""The rule registry as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values, one rule a line: id | category | default severity | ceiling | default confidence
#: | ceiling | confidence set by context | lifecycle | signal source.
REGISTRY = """
architecture.large-file | ARCHITECTURE | MEDIUM | HIGH | MEDIUM | MEDIUM | no | experimental | text-heuristic
architecture.deep-directory-nesting | ARCHITECTURE | LOW | LOW | MEDIUM | MEDIUM | no | experimental | text-heuristic
architecture.deep-relative-imports | ARCHITECTURE | LOW | MEDIUM | MEDIUM | MEDIUM | no | preview | text-heuristic
architecture.barrel-file-risk | ARCHITECTURE | LOW | LOW | LOW | LOW | no | experimental | text-heuristic
architecture.too-many-modules | ARCHITECTURE | MEDIUM | MEDIUM | MEDIUM | MEDIUM | no | experimental | text-heuristic
architecture.circular-dependency | ARCHITECTURE | HIGH | HIGH | HIGH | HIGH | no | stable | import-graph
architecture.unresolved-local-import | ARCHITECTURE | HIGH | HIGH | HIGH | HIGH | no | preview | import-graph
architecture.excessive-fan-out | ARCHITECTURE | MEDIUM | MEDIUM | HIGH | HIGH | no | stable | import-graph
architecture.high-instability-hub | ARCHITECTURE | HIGH | HIGH | HIGH | HIGH | yes | stable | import-graph
architecture.dead-module | ARCHITECTURE | LOW | LOW | HIGH | HIGH | yes | experimental | import-graph
architecture.layer-violation | ARCHITECTURE | MEDIUM | MEDIUM | HIGH | HIGH | no | experimental | import-graph
architecture.test-leak | ARCHITECTURE | MEDIUM | MEDIUM | HIGH | HIGH | no | experimental | import-graph
architecture.package-boundary-violation | ARCHITECTURE | MEDIUM | MEDIUM | MEDIUM | HIGH | yes | experimental | import-graph
behavioral.removed-export-still-imported | CODE_QUALITY | HIGH | HIGH | HIGH | HIGH | no | preview | ast
code-quality.complex-file | CODE_QUALITY | MEDIUM | HIGH | MEDIUM | MEDIUM | no | preview | text-heuristic
code-quality.long-function | CODE_QUALITY | MEDIUM | MEDIUM | HIGH | HIGH | yes | preview | ast
code-marker.todo | CODE_QUALITY | LOW | LOW | LOW | LOW | no | experimental | text-heuristic
code-marker.fixme | CODE_QUALITY | MEDIUM | MEDIUM | LOW | LOW | no | experimental | text-heuristic
code-marker.hack | CODE_QUALITY | MEDIUM | MEDIUM | LOW | LOW | no | experimental | text-heuristic
code-quality.complex-function | CODE_QUALITY | MEDIUM | MEDIUM | HIGH | HIGH | no | preview | ast
code-quality.deep-control-flow | CODE_QUALITY | LOW | LOW | MEDIUM | MEDIUM | no | preview | ast
framework.react-native.inline-style | FRAMEWORK | MEDIUM | MEDIUM | MEDIUM | MEDIUM | no | preview | ast
framework.react-native.deprecated-api | FRAMEWORK | HIGH | HIGH | HIGH | HIGH | no | preview | ast
framework.react-native.flatlist-missing-key | FRAMEWORK | LOW | LOW | MEDIUM | MEDIUM | no | preview | ast
framework.react-native.async-storage-from-core | FRAMEWORK | HIGH | HIGH | HIGH | HIGH | no | preview | ast
framework.react-native.old-react-navigation | FRAMEWORK | MEDIUM | MEDIUM | HIGH | HIGH | no | preview | dependency-manifest
framework.react-native.direct-state-mutation | FRAMEWORK | HIGH | HIGH | HIGH | HIGH | no | preview | ast
framework.react-native.old-architecture | FRAMEWORK | MEDIUM | MEDIUM | HIGH | HIGH | no | preview | framework-detector
framework.react-native.architecture-mismatch | FRAMEWORK | HIGH | HIGH | HIGH | HIGH | no | preview | framework-detector
framework.react-native.hermes-mismatch | FRAMEWORK | MEDIUM | MEDIUM | HIGH | HIGH | no | preview | framework-detector
framework.react-native.hermes-disabled | FRAMEWORK | LOW | LOW | HIGH | HIGH | no | preview | framework-detector
framework.react-native.codegen-missing | FRAMEWORK | MEDIUM | MEDIUM | HIGH | HIGH | no | preview | framework-detector
framework.js.var-declaration | FRAMEWORK | LOW | LOW | MEDIUM | MEDIUM | no | preview | ast
framework.js.console-log | FRAMEWORK | LOW | LOW | LOW | LOW | no | experimental | ast
framework.react.class-component | FRAMEWORK | LOW | LOW | MEDIUM | MEDIUM | no | preview | ast
framework.react.prop-types | FRAMEWORK | LOW | LOW | MEDIUM | MEDIUM | no | preview | ast
framework.rn-async-storage-legacy | FRAMEWORK | MEDIUM | MEDIUM | HIGH | HIGH | no | preview | dependency-manifest
framework.rn-navigation-compat | FRAMEWORK | HIGH | HIGH | HIGH | HIGH | no | preview | dependency-manifest
framework.rn-reanimated-compat | FRAMEWORK | HIGH | HIGH | HIGH | HIGH | no | preview | dependency-manifest
framework.rn-gesture-handler-old | FRAMEWORK | HIGH | HIGH | HIGH | HIGH | no | preview | dependency-manifest
framework.rn-new-arch-incompatible-dep | FRAMEWORK | MEDIUM | MEDIUM | MEDIUM | MEDIUM | no | preview | dependency-manifest
framework.django.debug-true | SECURITY | HIGH | HIGH | HIGH | HIGH | no | preview | config-file
framework.django.missing-allowed-hosts | SECURITY | HIGH | HIGH | HIGH | HIGH | no | preview | config-file
framework.django.raw-sql-query | SECURITY | MEDIUM | MEDIUM | MEDIUM | MEDIUM | no | preview | text-heuristic
language.rust.panic-risk | CODE_QUALITY | MEDIUM | HIGH | HIGH | HIGH | yes | preview | ast
language.go.panic-exit-risk | CODE_QUALITY | MEDIUM | HIGH | HIGH | HIGH | no | preview | ast
language.python.exception-risk | CODE_QUALITY | MEDIUM | HIGH | HIGH | HIGH | no | preview | ast
language.javascript.runtime-exit-risk | CODE_QUALITY | MEDIUM | HIGH | HIGH | HIGH | no | preview | ast
language.managed.fatal-exception-risk | CODE_QUALITY | MEDIUM | HIGH | HIGH | HIGH | no | preview | ast
security.env-file-committed | SECURITY | CRITICAL | CRITICAL | HIGH | HIGH | yes | stable | config-file
security.private-key-candidate | SECURITY | CRITICAL | CRITICAL | HIGH | HIGH | no | stable | text-heuristic
security.secret-candidate | SECURITY | HIGH | HIGH | MEDIUM | HIGH | yes | preview | text-heuristic
testing.missing-test-folder | TESTING | MEDIUM | MEDIUM | MEDIUM | MEDIUM | no | experimental | text-heuristic
testing.source-without-test | TESTING | LOW | LOW | LOW | LOW | no | experimental | text-heuristic
"""

#: Rule groups that policies name.
BROAD_MAINTAINABILITY = ("architecture.large-file", "code-quality.long-function", "code-quality.complex-file")
IMPORT_GRAPH = ("architecture.circular-dependency", "architecture.excessive-fan-out", "architecture.high-instability-hub")
RUNTIME = ("language.rust.panic-risk", "language.javascript.runtime-exit-risk", "language.go.panic-exit-risk", "language.python.exception-risk", "language.jvm.exception-risk", "language.csharp.exception-risk")
MAINTAINABILITY = ("testing.source-without-test", "code-marker.todo", "architecture.deep-directory-nesting", "architecture.too-many-modules", "architecture.large-file", "architecture.barrel-file-risk", "architecture.deep-relative-imports", "code-quality.long-function", "code-quality.complex-file", "code-quality.complex-function", "code-quality.cyclomatic-complexity", "code-quality.deep-control-flow")
STRICT_ONLY = (*MAINTAINABILITY, "testing.missing-test-folder", "code-marker.fixme", "code-marker.hack")
FRAMEWORK_STYLE = ("framework.js.var-declaration", "framework.js.console-log", "framework.react.class-component", "framework.react.prop-types", "framework.react-native.inline-style", "framework.react-native.flatlist-missing-key", "framework.react-native.old-architecture", "framework.react-native.hermes-disabled")
SECRET_LEAKS = ("security.secret-candidate", "security.private-key-candidate")
PACKAGE_BOUNDARY = "architecture.package-boundary-violation"
DIRECT_EVIDENCE = ("ast", "config-file", "dependency-manifest", "import-graph", "framework-detector", "git-diff")


def rows() -> list[tuple]:
    """(rule_no, rule_id, category, severities, confidences, contextual, lifecycle, source)."""
    out = []
    for i, line in enumerate(REGISTRY.strip().splitlines()):
        r, cat, sev, top, conf, most, ctx, life, source = (x.strip() for x in line.split("|"))
        out.append((i, r, cat, sev, top, conf, most, ctx == "yes", life, source))
    return out


COLUMNS = ("rule_no", "rule_id", "category", "default_severity", "max_severity", "default_confidence", "max_confidence", "contextual_confidence", "lifecycle", "signal_source")


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "rule_no int, rule_id string, category string, default_severity string, max_severity string, default_confidence string, max_confidence string, contextual_confidence boolean, lifecycle string, signal_source string")


def values_sql() -> str:
    """The same table as a VALUES list."""
    quote = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows()) + f") AS rules({', '.join(COLUMNS)})"

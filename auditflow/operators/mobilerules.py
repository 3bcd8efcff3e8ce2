"""Rules on mobile projects: platform switches, versions of dependencies, and uses of old interfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as t

#: Interfaces that left the framework's core, and packages without its new architecture.
REMOVED_APIS = ("ViewPagerAndroid", "ToolbarAndroid", "DatePickerAndroid", "TimePickerAndroid", "MaskedViewIOS", "ProgressBarAndroid", "ProgressViewIOS", "SegmentedControlIOS", "CheckBox")
OLD_ARCHITECTURE = ("react-native-camera", "react-native-firebase", "react-native-linear-gradient", "react-native-maps", "react-native-svg", "react-native-video", "rn-fetch-blob", "@react-native-community/cameraroll", "@react-native-community/netinfo", "react-native-share", "react-native-splash-screen")
#: Rule, package, first good major version, the framework's least version (major, minor).
VERSIONS = (
    ("framework.rn-navigation-compat", "@react-navigation/native", 6, (0, 73)),
    ("framework.rn-reanimated-compat", "react-native-reanimated", 3, (0, 73)),
    ("framework.rn-gesture-handler-old", "react-native-gesture-handler", 2, (0, 72)),
)
LIST_WINDOW = 20


def version_key(version: Column) -> Column:
    """A version as one number that orders majors, minors and patches; null for none."""
    v = F.regexp_replace(F.trim(version), r"^[\^~=><]+\s*", "")
    part = lambda i: F.coalesce(F.regexp_extract(v, rf"^(?:\d+\.){{{i}}}(\d+)", 1).try_cast("long"), F.lit(0))
    return F.when(v.rlike(r"^\d+(\.|$)"), part(0) * 10**12 + part(1) * 10**6 + part(2))


def _row(df: DataFrame, rule: Column | str, severity: str, path: Column | str = "package.json", line: int | Column = 1) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(lit(rule).alias("rule_id"), lit(path).alias("path"), F.lit(severity).alias("severity"), lit(line).cast("int").alias("line_start"))


def dependency_rules(dependencies: DataFrame) -> DataFrame:
    """Findings on (root, name, version) of projects that depend on the framework."""
    core = dependencies.filter("name = 'react-native'").select(F.col("root").alias("_root"), version_key(F.col("version")).alias("_core"))
    d = dependencies.join(core, F.col("root") == F.col("_root")).withColumn("_v", version_key(F.col("version")))
    path = F.concat_ws("/", F.when(F.col("root") != "", F.col("root")), F.lit("package.json"))
    out = _row(d.filter("name = '@react-native-community/async-storage'"), "framework.rn-async-storage-legacy", "MEDIUM", path)
    for rule, name, major, (a, b) in VERSIONS:
        old = d.filter((F.col("name") == name) & (F.col("_v") < major * 10**12) & (F.col("_core") >= a * 10**12 + b * 10**6))
        out = out.unionByName(_row(old, rule, "HIGH", path))
    return out.unionByName(_row(d.filter(F.col("name").isin(*OLD_ARCHITECTURE) & (F.col("_core") >= 71 * 10**6)), "framework.rn-new-arch-incompatible-dep", "MEDIUM", path))


def profile_rules(profiles: DataFrame, codegen_used: Column | None = None) -> DataFrame:
    """Findings on platform switches of profiles; codegen_used: whether a project's sources need code generation."""
    p = profiles.filter("detected")
    switches = ("android_new_arch", "ios_new_arch", "expo_new_arch")
    any_ = lambda value: F.coalesce(F.greatest(*(F.coalesce((F.col(c) == value).cast("int"), F.lit(0)) for c in switches)) > 0, F.lit(False))
    prefix = "framework.react-native."
    out = _row(p.filter(~(any_(True) & ~any_(False))), prefix + "old-architecture", "MEDIUM").unionByName(_row(p.filter("arch_mismatch"), prefix + "architecture-mismatch", "HIGH"))
    out = out.unionByName(_row(p.filter("hermes_mismatch"), prefix + "hermes-mismatch", "MEDIUM"))
    pod_off = F.coalesce(F.col("podfile").rlike(r"hermes_enabled(: | => )false"), F.lit(False))
    gradle_off = F.coalesce(F.col("gradle").rlike(r"(?m)^\s*(hermesEnabled|enableHermes)\s*=\s*false\b"), F.lit(False))
    out = out.unionByName(_row(p.filter(pod_off), prefix + "hermes-disabled", "LOW", "ios/Podfile")).unionByName(_row(p.filter(gradle_off), prefix + "hermes-disabled", "LOW", "android/gradle.properties"))
    needs = F.lit(False) if codegen_used is None else codegen_used
    return out.unionByName(_row(p.filter(any_(True) & ~F.col("has_codegen") & needs), prefix + "codegen-missing", "MEDIUM"))


def codegen_used(files: DataFrame) -> DataFrame:
    """One row (used): whether any source declares a native module or component to generate code for."""
    hit = F.col("content").rlike(r"\bTurboModuleRegistry\b|\bcodegenNativeComponent\b")
    return files.agg(F.coalesce(F.bool_or(F.col("language").isin("JavaScript", "TypeScript") & hit), F.lit(False)).alias("used"))


def source_rules(files: DataFrame) -> DataFrame:
    """Removed interfaces, and lists without keys, in files (path, content) that name the framework."""
    js = files.filter(F.col("path").rlike(r"\.(js|jsx|ts|tsx|mjs|cjs)$") & F.contains("content", F.lit("react-native"))).withColumn("lines", t.lines(F.col("content")))
    each = js.select("path", "lines", F.posexplode("lines").alias("i", "line")).filter(~F.col("line").rlike(r"^\s*(//|#|\*|/\*)"))
    old = each.filter(F.col("line").rlike("|".join(REMOVED_APIS)))
    lists = each.filter(F.col("path").rlike(r"\.[jt]sx$") & F.contains("line", F.lit("<FlatList")))
    window = F.array_join(F.slice("lines", F.col("i") + 1, F.lit(LIST_WINDOW)), "\n")
    bare = lists.filter(~F.contains(window, F.lit("keyExtractor")))
    prefix = "framework.react-native."
    return _row(old, prefix + "deprecated-api", "HIGH", F.col("path"), F.col("i") + 1).unionByName(_row(bare, prefix + "flatlist-missing-key", "LOW", F.col("path"), F.col("i") + 1))

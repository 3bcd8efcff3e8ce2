"""Rules on syntax: patterns of nodes and of what stands around them.

A pattern is an expression over a node's kind, name and surroundings, so all rules take one pass
over the node table and no join.  Text in strings and comments makes no nodes and so no hits.
What a hit weighs depends on its file: tests, scripts, entry points and domain code by their paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from .syntaxtree import around
from .textrules import finding

SCRIPTS = ("JavaScript", "TypeScript")
#: Kinds of nodes that the rules look at, and kinds to list around them.
KINDS = ("call", "macro", "catch", "assert", "throw", "declare", "type", "import", "jsx", "assign", "constant", "string", "concat")
AROUND = ("assign", "call", "arg", "throw")
#: Panics by rank where several stand on a line, and what a failing call's name tells of outside input.
PANICS = ("todo", "unimplemented", "panic", "unwrap_err", "unwrap", "expect_err", "expect")
OUTSIDE = (".parse(", "from_str(", "from_slice(", "json", "env::var", "std::env", "var_os(", "fs::", "file::open", "read_to_string", ".read_", ".recv", ".send", "request", "reqwest", "hyper", "axum", "headers", "query", "params", "body", "sqlx", "diesel", "postgres", "mysql", "redis", "database", "db.", "pool.", "conn.", "tcpstream", "udp", "socket")
FATAL = {"Java": ("RuntimeException", "IllegalStateException"), "Kotlin": ("RuntimeException", "IllegalStateException"), "C#": ("RuntimeException", "IllegalStateException", "Exception")}
UNFINISHED = ("NotImplementedException", "NotImplementedError")


def _named(*names: str) -> Column:
    return F.col("name").isin(*names)


def test_only() -> Column:
    """Whether a node stands in, or is, an item for tests only."""
    gate = r"cfg\(test\)|#\[test\]"
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    return bare(F.col("marks")).rlike(gate) | F.exists("around", lambda a: bare(a["marks"]).rlike(gate))


def _parent(kind: str) -> Column:
    """The innermost listed structure around a node, if it is of this kind; else null."""
    last = F.try_element_at("around", F.lit(-1))
    return F.when(last["kind"] == kind, last)


def _panic() -> Column:
    """The panic that a Rust node is: one of PANICS; null for none."""
    macro = F.when((F.col("kind") == "macro") & _named("todo", "unimplemented", "panic"), F.col("name"))
    method = F.when(F.col("kind") == "call", F.regexp_extract("name", r"\.(unwrap_err|unwrap|expect_err|expect)$", 1))
    found = F.coalesce(macro, F.when(method != "", method))
    literal = F.col("name").rlike(r"(^|::)(Regex::new|Selector::parse)\(''\)\.(unwrap|expect)$")
    return F.when((F.col("language") == "Rust") & ~literal & ~test_only(), found)


def signals() -> Column:
    """The risk that a node is, as rule:signal; null for none."""
    kind, name, language = F.col("kind"), F.col("name"), F.col("language")
    call, script = kind == "call", language.isin(*SCRIPTS)
    rust = F.when(_panic().isNotNull(), F.concat(F.lit("language.rust.panic-risk:"), _panic()))
    go = F.when((language == "Go") & call, F.when(name == "panic", "panic").when(_named("log.Fatal", "log.Fatalf"), "log-fatal").when(name == "os.Exit", "os-exit"))
    bare = (kind == "catch") & (name == "")
    unfinished = (call & (name == "NotImplementedError")) | ((kind == "throw") & (name == "NotImplementedError"))
    python = F.when(language == "Python", F.when(bare, "broad-except").when(kind == "assert", "assert").when(unfinished, "not-implemented"))
    exit_ = F.when(script & call & (name == "process.exit"), "process-exit")
    thrown = F.lit(False)
    for lang, names in FATAL.items():
        thrown = thrown | (language == lang) & (kind == "throw") & F.regexp_extract("name", r"^(?:new)?([\w.]+)", 1).isin(*names)
    missing = (kind == "throw") & F.regexp_extract("name", r"^(?:new)?([\w.]+)", 1).isin(*UNFINISHED) | call & F.regexp_replace("name", r"^.*\.", "").isin("TODO")
    managed = F.when(language.isin(*FATAL), F.when(missing, "not-implemented").when(thrown, "fatal-exception"))
    tag = lambda rule, c: F.when(c.isNotNull(), F.concat(F.lit(f"{rule}:"), c))
    return F.coalesce(rust, tag("language.go.panic-exit-risk", go), tag("language.python.exception-risk", python), tag("language.javascript.runtime-exit-risk", exit_), tag("language.managed.fatal-exception-risk", managed))


def file_classes(path: Column) -> dict[str, Column]:
    """What a path says of a file, beyond its role."""
    low = F.lower(path)
    name = paths.base_name(low)
    return {
        "test": paths.test_file(path),
        "test-support": name.rlike(r"^test_?(utils?|support|helpers?)\.") | low.rlike(r"(^|/)testing/"),
        "script": low.rlike(r"(^|/)(scripts?|bin)/"),
        "entrypoint": name.isin(*paths.ENTRYPOINTS),
        "domain": low.rlike(r"(^|/)domain/"),
        "infrastructure": low.rlike(r"(^|/)(infra|infrastructure)/"),
    }


def severity(rule: Column, signal: Column, name: Column, path: Column) -> Column:
    """What a risk weighs in its file; null where it is none there."""
    c = file_classes(path)
    low = F.lower(name)
    saved = low.rlike(r"::to_(string|string_pretty|value|vec|vec_pretty|writer|writer_pretty)\(") & ~low.rlike("from_(str|slice|reader|value)")
    outside = ~low.contains(".lock()") & ~saved & F.exists(F.array(*map(F.lit, OUTSIDE)), lambda s: low.contains(s)) & ~low.rlike(r"^''\.parse\(\)")
    plain = signal.isin("unwrap", "expect")
    rust = (
        F.when(c["test"] & plain, None).when(signal.isin("todo", "unimplemented"), F.when(c["test"], "LOW").otherwise("HIGH")).when(low.rlike(r"^''\.parse\(\)"), "LOW")
        .when(c["test"] & (signal == "panic"), "LOW").when(~c["test"] & outside, "HIGH").when(c["test-support"] & (plain | (signal == "panic")), "LOW").when(c["domain"] & (signal == "panic"), "HIGH").otherwise("MEDIUM")
    )
    go = F.when(c["test"], None).when((c["script"] | c["entrypoint"]) & signal.isin("os-exit", "log-fatal"), "LOW").when(c["domain"], "HIGH").otherwise("MEDIUM")
    python = F.when(c["test"] | c["infrastructure"] | signal.isin("assert", "not-implemented"), "LOW").otherwise("MEDIUM")
    script = F.when(c["test"], None).when(c["script"] | c["entrypoint"], "LOW").otherwise("HIGH")
    managed = F.when(c["test"], "LOW").when(c["domain"], "HIGH").when(c["test-support"], "LOW").when(signal == "not-implemented", "HIGH").otherwise("MEDIUM")
    table = {"rust.panic-risk": rust, "go.panic-exit-risk": go, "python.exception-risk": python, "javascript.runtime-exit-risk": script, "managed.fatal-exception-risk": managed}
    out = F.lit(None).cast("string")
    for suffix, value in table.items():
        out = F.when(rule == f"language.{suffix}", value).otherwise(out)
    skipped = paths.config_file(path) | paths.generated_file(path) | paths.low_signal(path) & ~c["test"]
    return F.when(~skipped, out)


def language_risks(nodes: DataFrame) -> DataFrame:
    """Findings of the language rules; of several panics on a line of Rust the gravest."""
    hits = nodes.withColumn("_s", signals()).filter("_s IS NOT NULL").select("path", "first", "name", F.split("_s", ":")[0].alias("rule"), F.split("_s", ":")[1].alias("signal"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PANICS)), F.col("signal")), F.lit(0))
    weighed = hits.withColumn("severity", severity(F.col("rule"), F.col("signal"), F.col("name"), F.col("path"))).withColumn("rank", F.when(F.col("rule") == "language.rust.panic-risk", rank).otherwise(0)).filter("severity IS NOT NULL")
    rust = weighed.filter("rank > 0").groupBy("rule", "path", "first").agg(F.min_by("severity", "rank").alias("severity"))
    every = weighed.filter("rank = 0").select("rule", "path", "first", "severity").unionByName(rust)
    return finding(every, F.col("rule"), F.col("severity"), F.col("first"))


#: Rules of frameworks: id, severity, whether one finding a file is all.
FRAMEWORK = (
    ("framework.js.var-declaration", "LOW", True), ("framework.js.console-log", "LOW", True), ("framework.react.class-component", "LOW", True), ("framework.react.prop-types", "LOW", True),
    ("framework.react-native.inline-style", "MEDIUM", False), ("framework.react-native.direct-state-mutation", "HIGH", False), ("framework.react-native.async-storage-from-core", "HIGH", False), ("framework.react-native.old-react-navigation", "MEDIUM", False),
    ("framework.django.debug-true", "HIGH", True), ("framework.django.missing-allowed-hosts", "HIGH", True), ("framework.django.raw-sql-query", "MEDIUM", False),
)


def _patterns() -> dict[str, Column]:
    kind, name, path, language = F.col("kind"), F.col("name"), F.col("path"), F.col("language")
    script, test = language.isin(*SCRIPTS), paths.test_file(path)
    settings = path.rlike(r"(^|/)settings(/[^/]+)?\.py$") & (language == "Python")
    top = F.size(around("function")) == 0
    raw = _parent("arg").isNotNull() & F.get("around", F.size("around") - 2)["name"].rlike(r"\.(raw|execute)$")
    built = (kind == "concat") | (kind == "string") & (F.col("word") == "f") & (F.col("upto") > F.col("pre")) | (kind == "call") & (name == "''.format")
    return {
        "framework.js.var-declaration": script & ~test & (kind == "declare") & (F.col("word") == "var"),
        "framework.js.console-log": script & ~test & (kind == "call") & (name == "console.log"),
        "framework.react.class-component": path.rlike(r"\.[jt]sx$") & (kind == "type") & name.rlike(r"\bextends React \. (Pure)?Component\b"),
        "framework.react.prop-types": script & (kind == "import") & name.rlike(r"from['\"]prop-types['\"]$"),
        "framework.react-native.inline-style": script & (kind == "jsx") & (name == "style"),
        "framework.react-native.direct-state-mutation": script & (kind == "assign") & name.rlike(r"^this\.state[.\[]"),
        "framework.react-native.async-storage-from-core": script & (kind == "import") & name.rlike(r"\{.*\bAsyncStorage\b.*\}from['\"]react-native['\"]$"),
        "framework.react-native.old-react-navigation": script & (kind == "import") & name.rlike(r"from['\"]react-navigation['\"]$"),
        "framework.django.debug-true": settings & top & (kind == "constant") & (name == "True") & (_parent("assign")["name"] == "DEBUG"),
        "framework.django.missing-allowed-hosts": settings & top & (kind == "assign") & (name == "ALLOWED_HOSTS") & (F.col("upto") == F.col("pre")),
        "framework.django.raw-sql-query": (language == "Python") & built & raw,
    }


def _below(paths_: DataFrame, roots: DataFrame) -> DataFrame:
    """The distinct paths that stand below one of the roots ('' is the whole tree)."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return paths_.select("path", F.explode(above).alias("root")).join(roots.select("root").distinct(), "root", "left_semi").select("path").distinct()


def framework_rules(nodes: DataFrame, native: DataFrame) -> DataFrame:
    """Findings of the framework rules.

    native: (root) of mobile projects, below which alone the mobile rules hold.  The rule on
    run-time types holds where the tree has TypeScript at all.
    """
    patterns = _patterns()
    hit = F.array_compact(F.array(*(F.when(patterns[r], F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(o).alias("one"))) for r, s, o in FRAMEWORK)))
    rows = nodes.select("path", "language", "first", F.explode(hit).alias("h")).select("path", "first", "h.*")
    mobile = rows.filter("rule LIKE 'framework.react-native.%'")
    mobile = mobile.join(_below(mobile.select("path").distinct(), native), "path", "left_semi")
    typed = nodes.agg(F.bool_or(F.col("language") == "TypeScript").alias("typed"))  # one row
    others = rows.filter("rule NOT LIKE 'framework.react-native.%'").crossJoin(F.broadcast(typed)).filter("rule <> 'framework.react.prop-types' OR typed").drop("typed")
    every = others.unionByName(mobile)
    once = every.filter("one").groupBy("rule", "severity", "path").agg(F.min("first").alias("first"))
    each = every.filter("NOT one").select("rule", "severity", "path", "first").distinct()
    return finding(once.unionByName(each), F.col("rule"), F.col("severity"), F.col("first"))

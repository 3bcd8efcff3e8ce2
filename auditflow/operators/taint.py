"""Untrusted input that reaches a dangerous call inside one function, by def-use chains.

From the syntax nodes come definitions (what is assigned, once its value is known) and uses (names
and calls), each with its function.  A use meets the last definition before it of its name, or of
what that name is a field of: one window over both, by file, function and name.  So a clean value
assigned later clears a name and its fields, a field keeps its own value beside its object's, and
`+=` adds to what was there.  A definition made of a tainted use is tainted in turn; definitions
depend on earlier ones only, so each function's are settled in one pass over its edges, in order.
A tainted use among a sink's arguments is a signal.  What stands inside a coercion to a number is
clean; SQL with the value as a bound parameter, and files of tests, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..plans.storage import materialize
from ..sources import syntax
from .syntaxtree import owner

#: Names that untrusted values come from, calls that they must not reach, and coercions.
SOURCES = (
    ("http-request", r"^(?:this\.)?(?:req|request|ctx\.request|flask\.request)\.(?:query|params|body|headers|cookies|args|form|values|json|data|files|GET|POST|get_json|query_params)\b|^r\.(?:URL\.Query|FormValue|PostFormValue|Header\.Get)\b|(?:^|\.)getParameter$"),
    ("process-args", r"^(?:sys\.argv|process\.argv|os\.Args)\b|\benv::args\b"),
)
SINKS = (
    ("taint-sql", r"\.(?:query|execute|executemany|raw|Exec|Query|QueryRow|executeQuery|executeUpdate)$"),
    ("taint-exec", r"^(?:os\.system|os\.popen|subprocess\.\w+|(?:child_process\.)?(?:exec|execSync|spawn|spawnSync|execFile)|exec\.Command|(?:\w+::)*Command::new)$|\.getRuntime\(\)\.exec$"),
    ("taint-fs-write", r"^(?:fs\.(?:write|append)\w*|os\.(?:WriteFile|Create)|(?:std::)?fs::write|open|Files\.write\w*)$"),
    ("taint-network", r"^(?:fetch|axios(?:\.\w+)?|requests\.\w+|http\.(?:Get|Post)|reqwest::get|(?:urllib\.request\.)?urlopen)$"),
)
COERCIONS = ("int", "float", "bool", "Number", "parseInt", "parseFloat", "Boolean", "strconv.Atoi", "strconv.ParseInt", "strconv.ParseFloat", "strconv.ParseBool", "Integer.parseInt", "Long.parseLong")
KINDS = ("assign", "ref", "call", "string")
AROUND = ("assign", "call", "arg")


def _kind_of(name: Column, table) -> Column:
    """The first kind of a table of patterns that a name has; null for none."""
    return F.coalesce(*(F.when(name.rlike(p), k) for k, p in table))


def _path(name: Column) -> Column:
    """A name up to its first bracket, fields by dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(name, r"^[^\[(]*", 0), r"\?\.|::", "."), r"^\.|\.$", "")


def _prefixes(path: Column) -> Column:
    parts = F.split(path, r"\.")
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")))


def definitions(nodes: DataFrame) -> DataFrame:
    """(path, scope, def, key, pos, adds): what assignments define, at the end of their values."""
    names = F.split(F.regexp_replace("name", r"[{}()\s]|^\[|\]$", ""), ",")
    each = nodes.filter("kind = 'assign'").select("path", "scope", F.col("pre").alias("def"), F.explode(names).alias("n"), (2 * F.col("upto") + 1).alias("pos"), (F.col("word") == "+=").alias("more"))
    bound = F.regexp_replace("n", r"^[^\[]*:(?=\w)|^\.\.\.|^\*", "")
    return each.select("path", "scope", "def", _path(bound).alias("key"), "pos", (F.col("more") | F.col("n").contains("[")).alias("adds")).filter("key <> ''")


def uses(nodes: DataFrame) -> DataFrame:
    """(path, scope, use, function, key, pos, source, targets) of names and calls in values or sinks' arguments.

    targets: assignments and sinks around a use, but for those outside a coercion around it.
    """
    guard = F.coalesce(F.array_max(F.transform(F.filter("around", lambda a: (a["kind"] == "call") & a["name"].isin(*COERCIONS)), lambda a: a["pre"])), F.lit(-1))
    first = lambda a: F.exists("around", lambda b: (b["kind"] == "arg") & (b["pre"] == a["pre"] + 1))
    any_sink, sql = "|".join(p for _, p in SINKS), dict(SINKS)["taint-sql"]
    sink = lambda a: F.when(a["kind"] == "call", _kind_of(a["name"], SINKS))
    inside = F.filter("around", lambda a: (a["pre"] > F.greatest("scope", guard)) & ((a["kind"] == "assign") | (a["kind"] == "call") & a["name"].rlike(any_sink) & (~a["name"].rlike(sql) | first(a))))
    targets = F.transform(inside, lambda a: F.struct(a["pre"].alias("pre"), sink(a).alias("sink"), a["first"].alias("line"), a["name"].alias("name")))
    call = F.col("kind") == "call"
    key = F.when(call, F.regexp_extract(_path(F.col("name")), r"^(.*)\.[^.]*$", 1)).otherwise(_path(F.col("name")))
    flat = nodes.filter("kind IN ('ref', 'call')").select("path", "scope", F.col("pre").alias("use"), "function", key.alias("key"), (2 * F.col("pre")).alias("pos"), _kind_of(F.regexp_replace("name", r"\?\.", "."), SOURCES).alias("source"), targets.alias("targets"))
    return flat.filter(F.size("targets") > 0)


def reaching(used: DataFrame, defined: DataFrame) -> DataFrame:
    """used with def: the last definition before each use of its name or of what it is a field of; null for none."""
    asked = used.select("path", "scope", "use", "pos", F.explode(_prefixes(F.col("key"))).alias("key"))
    events = asked.select("path", "scope", "key", "pos", "use", F.lit(None).cast("int").alias("def")).unionByName(defined.select("path", "scope", "key", "pos", F.lit(None).cast("int").alias("use"), "def"))
    w = Window.partitionBy("path", "scope", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(F.when(F.col("def").isNotNull(), F.col(c)), ignorenulls=True).over(w)
    met = events.withColumns({"d": last("def"), "at": last("pos")}).filter("use IS NOT NULL AND d IS NOT NULL")
    found = met.groupBy("path", "use").agg(F.max_by("d", "at").alias("def"))
    return used.join(found, ["path", "use"], "left")


_SETTLED = pa.schema([("path", pa.string()), ("def", pa.int32()), ("from", pa.string())])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tainted definitions, from edges (path, scope, src, dst, source) that come function by function, in order.

    Edges lead to later definitions only, so one look at each is enough.
    """
    key, known = None, {}
    for batch in batches:
        rows = []
        for path, scope, src, dst, own in zip(*(c.to_pylist() for c in batch.columns)):
            if (path, scope) != key:
                key, known = (path, scope), {}
            found = own if own is not None else known.get(src)
            best = None if found is None else min(found, known.get(dst, found))
            if best is not None and best != known.get(dst):
                known[dst] = best
                rows.append((path, dst, best))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SETTLED)], schema=_SETTLED)


def taint(files: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """(path, function, kind, line, source) of files (path, language, content), once a line and kind.

    ranges: (path, start, stop) of changed lines, outside which sinks are left out.
    """
    # a file that names no source has no flow
    named = F.col("content").rlike(r"\b(?:req|request|FormValue|URL\.Query|PostFormValue|Header\.Get|getParameter|argv|os\.Args|env::args)\b")
    n = syntax.nodes(files.filter(~paths.test_file(F.col("path")) & named), KINDS, AROUND)
    n = materialize(n.withColumns({"scope": F.coalesce(owner()["pre"], F.lit(-1)), "function": F.coalesce(owner()["name"], F.lit(""))}))
    defined = definitions(n)
    own = F.array(F.struct(F.col("def").alias("pre"), F.lit(None).cast("string").alias("sink"), F.lit(0).alias("line"), F.lit("").alias("name")))
    again = defined.filter("adds").select("path", "scope", F.col("def").alias("use"), F.lit("").alias("function"), "key", (F.col("pos") - 1).alias("pos"), F.lit(None).cast("string").alias("source"), own.alias("targets"))
    met = materialize(reaching(uses(n).unionByName(again), defined))
    ends = defined.groupBy("path", "def").agg(F.max("pos").alias("pos"))
    flow = met.select("path", "scope", F.col("def").alias("src"), "source", F.explode("targets").alias("t")).filter("t.sink IS NULL AND (source IS NOT NULL OR src IS NOT NULL)")
    edges = flow.select("path", "scope", "src", F.col("t.pre").alias("dst"), "source").join(ends.select("path", F.col("def").alias("dst"), "pos"), ["path", "dst"])
    ordered = edges.repartition("path").sortWithinPartitions("path", "scope", "pos", F.col("src").asc_nulls_first()).select("path", "scope", "src", "dst", "source")
    tainted = ordered.mapInArrow(_settled, "path string, def int, from string").groupBy("path", "def").agg(F.min("from").alias("from"))
    hits = met.select("path", "function", "def", "source", F.explode("targets").alias("t")).filter("t.sink IS NOT NULL").join(tainted, ["path", "def"], "left")
    hits = hits.withColumn("source", F.coalesce("source", "from")).filter("source IS NOT NULL").select("path", "function", F.col("t.sink").alias("kind"), F.col("t.line").alias("line"), "source", F.col("t.pre").alias("pre"), F.col("t.name").alias("name"))
    # a file opened for reading is no sink: the mode stands among the arguments
    modes = n.filter((F.col("kind") == "string") & F.col("name").rlike(r"^[wax]b?\+?$")).select("path", F.explode(F.filter("around", lambda a: (a["kind"] == "call") & (a["name"] == "open"))["pre"]).alias("pre")).distinct()
    found = hits.filter("name <> 'open'").unionByName(hits.filter("name = 'open'").join(modes, ["path", "pre"], "left_semi").select(hits.columns))
    if ranges is not None:
        r = ranges.select(F.col("path").alias("_p"), "start", "stop")
        found = found.join(r, (F.col("path") == F.col("_p")) & F.col("line").between(F.col("start"), F.col("stop")), "left_semi")
    return found.groupBy("path", "line", "kind").agg(F.min("source").alias("source"), F.min_by("function", "pre").alias("function")).select("path", "function", "kind", "line", "source")

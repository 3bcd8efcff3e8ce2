"""The engine's relations as views of the test tables.

Each column is one SQL expression that Spark and other SQL engines read alike, so queries and
the SQL that they are compared with start from the same relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rules
from .storage import table

_FINDINGS = {
    "finding_no": "o_orderkey",
    "rule_no": "CAST(o_custkey % 54 AS INT)",
    "path": "concat(CASE o_custkey % 9 WHEN 0 THEN 'tests' WHEN 1 THEN 'examples' WHEN 2 THEN 'src/generated' WHEN 3 THEN 'docs' ELSE 'src' END, '/pkg', o_custkey % 7, '/mod', o_custkey % 40, CASE o_custkey % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.tsx' ELSE '.py' END)",
    "line_start": "CAST(o_orderkey % 12 + 1 AS INT)",
    "line_end": "CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 12 + 1 + o_orderkey % 3 AS INT) END",
    "snippet": "concat('let  V = \"', o_orderkey % 5, '\" + ', o_custkey % 3, '0')",
    "title": "concat('Finding ', o_orderkey % 2)",
    "description": "concat('About ', o_custkey % 2)",
    "recommendation": "CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE concat('fix ', o_orderkey % 6) END",
    "docs_url": "CASE WHEN o_orderkey % 3 <> 0 THEN concat('https://docs.example/', o_orderkey % 4) END",
    "severity": "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' WHEN '4' THEN 'LOW' ELSE 'INFO' END",
    "confidence": "CASE o_orderstatus WHEN 'F' THEN 'HIGH' WHEN 'O' THEN 'MEDIUM' ELSE 'LOW' END",
    "package": "CASE WHEN o_custkey % 7 < 5 THEN concat('pkg', o_custkey % 7) END",
    "detector": "concat('d', o_custkey % 2)",
    "day": "CAST(o_orderdate AS DATE)",
}
_FILES = {
    "path": "concat(source, '/', lang, '/', CASE WHEN doc_id % 11 = 0 THEN 'tests/' WHEN doc_id % 13 = 0 THEN 'generated/' ELSE '' END, 'doc', doc_id, '.txt')",
    "language": "lang",
    "content": "text",
    "size": "CAST(n_chars AS BIGINT)",
}


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


def part_path(key: str) -> str:
    """The file that stands for a part, as an expression of its key."""
    return f"concat('src/d', {key} % 25, '/m', {key}, CASE WHEN {key} % 4 = 0 THEN '.ts' ELSE '.py' END)"


_KIND = "CASE WHEN a.l_suppkey % 5 = 0 THEN 're-exports' WHEN a.l_suppkey % 7 = 0 THEN 'test-of' ELSE 'imports' END AS kind"
_NEIGHBOURS = "FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"
_EDGES = f"""
SELECT DISTINCT {part_path("a.l_partkey")} AS src,
       {part_path("b.l_partkey")} AS dst,
       {_KIND}, a.l_suppkey % 3 = 0 AS deferred
{_NEIGHBOURS}
"""

#: Files of many lines: a line repeated.
_TALL = {
    "path": "concat('src/tall', s_suppkey, '.rs')",
    "n": "s_suppkey * 13 % 1200",
    "content": "repeat(concat('let x = ', s_suppkey, ';', chr(10)), CAST(s_suppkey * 13 % 1200 AS INT))",
}

#: Lines of source files: the text, and what rules are to find in it, by language (* for any).
#: A finding is (rule, severity, languages).
SNIPPETS = (
    ("let total = a + b;", ()),
    ("// TODO: tidy this", (("code-marker.todo", "LOW", "*"),)),
    ("value = load()  # FIXME and HACK", (("code-marker.fixme", "MEDIUM", "*"),)),
    ("/* HACK around it */", (("code-marker.hack", "MEDIUM", "*"),)),
    ("process.exit(1);", (("language.javascript.runtime-exit-risk", "MEDIUM", "JavaScript TypeScript"),)),
    ("console.log(total);", (("framework.js.console-log", "LOW", "JavaScript TypeScript"),)),
    ("var count = 0;", (("framework.js.var-declaration", "LOW", "JavaScript TypeScript"),)),
    ("const panel = make({ style={{ width: 1 }} });", (("framework.react-native.inline-style", "MEDIUM", "JavaScript TypeScript"),)),
    ("class Panel extends React.Component {", (("framework.react.class-component", "LOW", "JavaScript TypeScript"),)),
    ("this.state.items = [];", (("framework.react-native.direct-state-mutation", "HIGH", "JavaScript TypeScript"),)),
    ("value.unwrap();", (("language.rust.panic-risk", "MEDIUM", "Rust"),)),
    ("panic!(bad);", (("language.rust.panic-risk", "MEDIUM", "Rust"),)),
    ("log.Fatal(err)", (("language.go.panic-exit-risk", "MEDIUM", "Go"),)),
    ("os.Exit(2)", (("language.go.panic-exit-risk", "MEDIUM", "Go"),)),
    ("except:", (("language.python.exception-risk", "MEDIUM", "Python"),)),
    ("raise NotImplementedError", (("language.python.exception-risk", "MEDIUM", "Python"),)),
    ("System.exit(3);", (("language.managed.fatal-exception-risk", "MEDIUM", "Java"),)),
    ("cursor.execute(f\"select {name}\")", (("framework.django.raw-sql-query", "MEDIUM", "Python"),)),
    ("-----BEGIN RSA PRIVATE KEY-----", (("security.private-key-candidate", "CRITICAL", "*"),)),
    ("api_key = \"Zx81kQp0Lm27Vt\"", (("secret", "HIGH", "*"),)),
    ("token = process.env.TOKEN", ()),
    ("password = \"changeme\"", ()),
    ("secret: my-long-plain-slug", (("secret", "LOW", "*"),)),
    ("fetch(\"https://x.example/?token=abc123def456\")", ()),
    ("import thing from \"../../../deep/thing\"", (("architecture.deep-relative-imports", "LOW", "*"),)),
    ("// process.exit(9) is only spoken of", ()),
    ("if a && b || c { go() }", ()),
)
_ENDINGS = ("rs", "py", "ts", "js", "go", "java")
_LANGUAGE = ("Rust", "Python", "TypeScript", "JavaScript", "Go", "Java")
_SLOTS = ("o_orderkey % {n}", "o_custkey % {n}", "(o_orderkey * 7 + o_custkey * 3) % {n}", "(o_orderkey + o_custkey * 11) % {n}")
_CODE = {
    "path": "concat('src/area', o_custkey % 12, CASE WHEN o_orderkey % 17 = 0 THEN '/tests' WHEN o_orderkey % 19 = 0 THEN '/a/b/c/d/e' ELSE '' END, '/unit', o_orderkey, '.', CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDINGS)) + " END)",
    "language": "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_LANGUAGE)) + " END",
} | {f"s{i}": f"CAST({e.format(n=len(SNIPPETS))} AS INT)" for i, e in enumerate(_SLOTS)}


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SNIPPET_ROWS = ", ".join(f"({i}, {_sql_text(t)})" for i, (t, _) in enumerate(SNIPPETS))
_EXPECTED_ROWS = ", ".join(f"({i}, '{r}', '{s}', {'NULL' if langs == '*' else repr(lang)})" for i, (_, found) in enumerate(SNIPPETS) for r, s, langs in found for lang in ([None] if langs == "*" else langs.split()))
_CODE_SQL = f"""code AS ({_select(_CODE, 'orders')}), snippets(no, line) AS (VALUES {_SNIPPET_ROWS}), expected(no, rule_id, severity, lang) AS (VALUES {_EXPECTED_ROWS}),
lines AS (SELECT path, language, 1 AS line_start, s0 AS no FROM code UNION ALL SELECT path, language, 2, s1 FROM code UNION ALL SELECT path, language, 3, s2 FROM code UNION ALL SELECT path, language, 4, s3 FROM code),
planted AS (SELECT l.path, l.language, l.line_start, e.rule_id, e.severity FROM lines l JOIN expected e ON l.no = e.no AND (e.lang IS NULL OR e.lang = l.language))"""

#: Common table expressions with the same relations: rules, findings (enriched with the registry's columns), files, edges.
SQL = {
    "findings": f"raw AS ({_select(_FINDINGS, 'orders')}), findings AS (SELECT raw.*, r.rule_id, r.category, r.lifecycle, r.signal_source, r.default_severity, r.max_severity, r.default_confidence, r.max_confidence, r.contextual_confidence FROM raw JOIN {rules.values_sql().replace(' AS rules(', ' AS r(')} ON raw.rule_no = r.rule_no)",
    "files": f"files AS ({_select(_FILES, 'documents')})",
    "edges": f"edges AS ({_EDGES})",
    "tall": f"tall AS ({_select(_TALL, 'supplier')})",
    "code": _CODE_SQL,
}


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(*(F.expr(e).alias(n) for n, e in _FINDINGS.items()))
    return raw.join(F.broadcast(rules.table(spark)), "rule_no")  # 54 rows


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(F.expr(e).alias(n) for n, e in _FILES.items()))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_EDGES.replace("FROM lineitem a JOIN lineitem b", "FROM {l} a JOIN {l} b"), l=table(spark, sf_dir, "lineitem"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind) of edges by the parts that the files stand for, pairs more than once; part_path names the files."""
    pairs = f"SELECT a.l_partkey AS src, b.l_partkey AS dst, {_KIND} {_NEIGHBOURS}"
    return spark.sql(pairs.replace("FROM lineitem a JOIN lineitem b", "FROM {l} a JOIN {l} b"), l=table(spark, sf_dir, "lineitem"))


def tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(*(F.expr(e).alias(n) for n, e in _TALL.items()))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files (path, language, content) of four lines each, taken from SNIPPETS."""
    c = table(spark, sf_dir, "orders").select(*(F.expr(e).alias(n) for n, e in _CODE.items()))
    known = F.array(*(F.lit(t) for t, _ in SNIPPETS))
    return c.select("path", "language", F.concat_ws("\n", *(F.get(known, F.col(f"s{i}")) for i in range(len(_SLOTS)))).alias("content"))

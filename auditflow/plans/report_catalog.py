"""Queries on scores by role, graph overlays and rules, reviews, decisions, reports and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths
from ..operators import explain, findings as fo, graph, metrics, review, reviewreport, risk, visibility
from ..streaming import incremental
from . import relations as rel
from .catalog import _BASE, _BROAD, _NODES, _RISKY, _SCOPE, _SEV, _band, _clamped, _register, _risky, _visibility_sql
from .storage import materialize, table

# ---- findings and scores --------------------------------------------------------------------

_FILE_ROWS = "fp AS (SELECT DISTINCT path FROM findings), ff AS (SELECT path, CASE WHEN ends_with(path, '.rs') THEN 'Rust' WHEN ends_with(path, '.tsx') THEN 'TypeScript' ELSE 'Python' END AS language FROM fp WHERE NOT contains(path, '/pkg6/'))"


@_register("SELECT finding_no, f.path, ff.language AS file_language FROM findings f LEFT JOIN ff ON f.path = ff.path", "findings", also=_FILE_ROWS)
def findings_with_files(spark, sf_dir):
    """Findings below the root repo/ beside their files, some of which are unknown."""
    f = rel.findings(spark, sf_dir).select("finding_no", "path")
    files = f.select("path").distinct().filter("path NOT LIKE '%/pkg6/%'").select("path", paths.language(F.col("path")).alias("language"))
    rooted = f.withColumn("path", F.concat(F.lit("./repo//"), "path"))
    return fo.with_files(rooted, files.withColumn("path", F.concat(F.lit("repo/"), "path")), "repo").select("finding_no", paths.relative(F.col("path"), "repo").alias("path"), "file_language")


_ROLE_SUM = "CASE WHEN starts_with(path, 'tests/') THEN -20 WHEN contains(path, '/generated/') THEN -30 WHEN starts_with(path, 'docs/') THEN 0 ELSE 10 END + CASE WHEN ends_with(path, '.tsx') THEN 4 ELSE 0 END + CASE WHEN starts_with(path, 'examples/') THEN -15 ELSE 0 END"


@_register(f"SELECT finding_no, score, {_band('score')} AS priority FROM (SELECT finding_no, {_clamped(f'(({_BASE}) * (CASE confidence WHEN {chr(39)}HIGH{chr(39)} THEN 110 WHEN {chr(39)}MEDIUM{chr(39)} THEN 100 ELSE 80 END) + 50) // 100 + CASE category WHEN {chr(39)}SECURITY{chr(39)} THEN 12 WHEN {chr(39)}TESTING{chr(39)} THEN -12 ELSE 0 END + CASE WHEN {_BROAD} THEN -12 ELSE 0 END + {_ROLE_SUM}')} AS score FROM findings)", "findings")
def risk_by_role(spark, sf_dir):
    f = rel.findings(spark, sf_dir).withColumn("roles", paths.risk_roles(F.col("path")))
    return risk.base_score(f, "roles").select("finding_no", "score", "priority")


_GRAPHED = f"""{_RISKY}, deg2 AS (SELECT path AS node, count(*) AS fan_in FROM findings GROUP BY path),
g1 AS (SELECT r.*, {_clamped("r.score + CASE WHEN d.fan_in >= 3 THEN 8 WHEN d.fan_in >= 2 THEN 5 ELSE 0 END")} AS s FROM risky r JOIN deg2 d ON r.path = d.node),
g2 AS (SELECT *, {_clamped("s + CASE WHEN contains(path, '/pkg2/') THEN 6 ELSE 0 END")} AS t FROM g1)"""


@_register(f"SELECT finding_no, t AS score, {_band('t')} AS priority FROM g2", "findings", also=_GRAPHED)
def graph_and_blast_overlays(spark, sf_dir):
    """Hubs and shared dependencies by the number of a file's findings, then a blast radius of one package."""
    f = _risky(spark, sf_dir)
    impacts = risk.graph_impact(f.groupBy(F.col("path").alias("node")).agg(F.count(F.lit(1)).alias("fan_in")).withColumn("fan_out", F.lit(0)))
    hit = f.filter("path LIKE '%/pkg2/%'").select("path")
    return risk.blast_overlay(risk.graph_overlay(f, impacts), hit).select("finding_no", "score", "priority")


@_register("SELECT finding_no, rule_id FROM shown WHERE visible", "findings", also=_visibility_sql())
def visible_findings(spark, sf_dir):
    f = visibility.classified(_risky(spark, sf_dir).withColumn("has_evidence", F.lit(True)))
    return visibility.profile(f).select("finding_no", "rule_id")


@_register("SELECT package, count(*) AS findings, CAST(floor(greatest(0.0, least(100.0, 100.0 - sum(CASE severity WHEN 'CRITICAL' THEN 20.0 WHEN 'HIGH' THEN 5.0 WHEN 'MEDIUM' THEN 2.0 WHEN 'LOW' THEN 0.5 ELSE 0.0 END) / greatest(any_value(n) / 1000.0, 0.5)))) AS INT) AS maintainability_score FROM shown JOIN (SELECT concat('pkg', i) AS package, 50000 * (i + 1) AS n FROM range(5) t(i)) USING (package) WHERE NOT visible GROUP BY package", "findings", also=_visibility_sql())
def maintainability_score(spark, sf_dir):
    f = visibility.classified(_risky(spark, sf_dir).withColumn("has_evidence", F.lit(True)))
    lines = spark.createDataFrame([(f"pkg{i}", 50000 * (i + 1)) for i in range(5)], "package string, non_empty_lines long")
    return metrics.maintainability_score(f.filter("package IS NOT NULL"), lines, ["package"])


@_register("SELECT count(*) AS visible, 100 AS evidence_percent, CAST((count(*) FILTER (trim(recommendation) <> '') * 100 + count(*) // 2) // count(*) AS INT) AS recommendation_percent, CAST((count(*) FILTER (docs_url IS NOT NULL) * 100 + count(*) // 2) // count(*) AS INT) AS high_risk_docs_percent, CAST(floor(greatest(0.0, 100.0 - sum(CASE severity WHEN 'CRITICAL' THEN 20.0 ELSE 5.0 END) / 1000.0)) AS INT) AS health_score FROM findings WHERE severity IN ('HIGH', 'CRITICAL')", "findings")
def refiltered_summary(spark, sf_dir):
    kept = fo.matching(_risky(spark, sf_dir), "HIGH")
    return metrics.recomputed(kept, spark.createDataFrame([(1_000_000,)], "non_empty_lines long"))


@_register("SELECT finding_no FROM risky WHERE priority <= 'P1'", "findings", also=_RISKY)
def priority_filter(spark, sf_dir):
    return fo.matching(_risky(spark, sf_dir), priority="P1").select("finding_no")


@_register("SELECT language, count(*) AS files, CAST(sum(n) AS BIGINT) AS non_empty_lines, (SELECT count(*) FROM tall) + 2 AS total_files, (SELECT count(*) FROM tall) AS files_with_language FROM (SELECT 'Rust' AS language, n FROM tall) GROUP BY language", "tall")
def repository_facts(spark, sf_dir):
    from ..sources import repository

    f = repository.measured(rel.tall(spark, sf_dir).select("path", F.lit("Rust").alias("language"), "content"))
    other = spark.createDataFrame([("a", None, 1), ("b", None, 2)], "path string, language string, non_empty_lines long")
    return metrics.repository_facts(f.select("path", "language", "non_empty_lines").unionByName(other))


@_register(f"SELECT rule_id, {_SCOPE} AS scope, count(*) AS n, CASE max({_SEV}) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'INFO' END AS worst FROM findings GROUP BY ALL", "findings")
def rule_scope_clusters(spark, sf_dir):
    return metrics.rule_scopes(rel.findings(spark, sf_dir))


@_register("SELECT rule_id, path, severity, line_start, confidence FROM (SELECT rule_id, path, severity, line_start, NULL AS confidence FROM planted WHERE starts_with(rule_id, 'code-marker.') UNION ALL SELECT 'security.secret-candidate', path, NULL, line_start, severity FROM planted WHERE rule_id = 'secret')", "code")
def finding_union(spark, sf_dir):
    from ..operators import security, textrules

    code = rel.code(spark, sf_dir)
    secrets = security.secret_lines(code).withColumn("rule_id", F.lit("security.secret-candidate"))
    return fo.union([textrules.markers(code), secrets]).select("rule_id", "path", "severity", "line_start", "confidence")


@_register("SELECT finding_no, CASE WHEN finding_no % 3 = 0 THEN 'new' END AS status FROM risky", "findings", also=_RISKY)
def findings_beside_status(spark, sf_dir):
    status = rel.findings(spark, sf_dir).filter("finding_no % 3 = 0").select("finding_no", F.lit("new").alias("status"))
    return fo.with_status_order(_risky(spark, sf_dir), status).select("finding_no", "status")


@_register("SELECT count(*) AS files_discovered, count(*) AS files_analyzed, 0 AS large_files_skipped, 0 AS binary_files_skipped, 0 AS low_signal_skipped, CAST(sum(n) AS BIGINT) AS non_empty_lines FROM tall", "tall")
def merged_package_counters(spark, sf_dir):
    """Counters of three packages' scans added up."""
    from ..sources import repository

    f = repository.from_table(rel.tall(spark, sf_dir).withColumn("k", F.regexp_extract("path", "([0-9]+)", 1).cast("long") % 3)).withColumn("path", F.lit("x"))
    return metrics.merged_packages([metrics.scan_counters(f.filter(F.col("k") == i)) for i in range(3)])


# ---- graphs ---------------------------------------------------------------------------------


def _sparse(spark, sf_dir) -> DataFrame:
    """Edges of a sparse graph over parts: each imports one or two others."""
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("src/m"), c, F.when(c % 4 == 0, ".rs").otherwise(".py"))
    to = F.explode(F.array(k * 2, F.when(k % 3 == 0, (k * k) % 97 + 1), F.when(k == 7, F.lit(3)))).alias("t")
    return table(spark, sf_dir, "part").select(k.alias("k"), to).filter("t IS NOT NULL").select(name(F.col("k")).alias("src"), name(F.col("t")).alias("dst"), F.lit("imports").alias("kind"), (F.col("k") % 5 == 0).alias("deferred"))


_NAME = lambda c: f"concat('src/m', {c}, CASE WHEN {c} % 4 = 0 THEN '.rs' ELSE '.py' END)"
_SPARSE = f"links AS (SELECT p_partkey AS k, unnest(list_filter([p_partkey * 2, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey * p_partkey) % 97 + 1 END, CASE WHEN p_partkey = 7 THEN 3 END], lambda x: x IS NOT NULL)) AS t FROM part), sparse AS (SELECT {_NAME('k')} AS src, {_NAME('t')} AS dst, k % 5 = 0 AS deferred FROM links), snodes AS (SELECT src AS node FROM sparse UNION SELECT dst FROM sparse), sdeg AS (SELECT node, (SELECT count(DISTINCT src) FROM sparse WHERE dst = node) AS fan_in, (SELECT count(DISTINCT dst) FROM sparse WHERE src = node) AS fan_out FROM snodes)"


@_register("SELECT node, fan_out FROM deg WHERE fan_out > 15", "edges", also=f"{_NODES}, e AS (SELECT DISTINCT src, dst, kind FROM edges), deg AS (SELECT src AS node, count(*) AS fan_out FROM e GROUP BY src)")
def excessive_fan_out(spark, sf_dir):
    e = rel.edges(spark, sf_dir)
    return graph.excessive_fan_out(graph.degrees(graph.nodes_of(e), e))


@_register("SELECT node FROM (SELECT concat('c', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '/lib.rs' ELSE '/mod.rs' END) AS node, s_suppkey % 3 AS k FROM supplier) WHERE k = 0")
def rust_facades(spark, sf_dir):
    k = F.col("s_suppkey")
    body = F.when(k % 3 == 0, "//! docs\n#[cfg(x)]\npub mod a;\npub(crate) use a::B;\n\nextern crate c;\n").when(k % 3 == 1, "mod a;\nfn main() {}\n").otherwise("// nothing\n")
    f = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), k, F.when(k % 2 == 0, "/lib.rs").otherwise("/mod.rs")).alias("path"), body.alias("content"))
    return graph.rust_facades(f)


@_register(f"SELECT node AS path, 'LOW' AS confidence FROM sdeg WHERE fan_in = 0 AND node NOT IN ('src/m3.py', {_NAME('1')}) AND NOT ends_with(node, '.rs')", also=_SPARSE)
def dead_module_findings(spark, sf_dir):
    """An open import might mean m3; Rust has more open imports than edges; m1 is an entry point."""
    e = _sparse(spark, sf_dir)
    n = graph.nodes_of(e)
    p = F.col("path")
    files = n.select(F.col("node").alias("path"), F.lit("production").alias("role"), (F.col("node") == "src/m1.py").alias("entrypoint"), paths.public_api(F.col("node")).alias("public"), F.lit(False).alias("has_inline_tests"))
    unresolved = spark.createDataFrame([("py", "./gone/m3"), *[("rs", f"crate::gone{i}") for i in range(3)]], "ext string, spec string")
    resolved = spark.createDataFrame([("py", 10_000), ("rs", 2)], "ext string, edges long")
    return graph.dead_modules(files, graph.degrees(n, e), unresolved, resolved).select(p, "confidence")


@_register("SELECT 'hub' AS kind, node, fan_in, fan_out, true AS truncated FROM (SELECT * FROM deg WHERE fan_out > 0 ORDER BY fan_out DESC, fan_in DESC, node LIMIT 10) UNION ALL SELECT 'dependency', node, fan_in, fan_out, true FROM (SELECT * FROM deg WHERE fan_in > 0 ORDER BY fan_in DESC, fan_out DESC, node LIMIT 10)", "edges", also=f"{_NODES}, e AS (SELECT DISTINCT src, dst, kind FROM edges), deg AS (SELECT node, (SELECT count(*) FROM e WHERE dst = node) AS fan_in, (SELECT count(*) FROM e WHERE src = node) AS fan_out FROM nodes)")
def graph_hubs(spark, sf_dir):
    e = rel.edges(spark, sf_dir)
    return graph.hubs(graph.degrees(graph.nodes_of(e), e))


@_register()  # which cycles a depth-first walk meets has no SQL form; tests hold it against brute force
def bounded_cycles(spark, sf_dir):
    return graph.bounded_cycles(materialize(_sparse(spark, sf_dir))).select(F.array_join("cycle", " > ").alias("cycle"), "truncated")


@_register("SELECT src, dst FROM sparse WHERE NOT deferred", also=_SPARSE)
def eager_sparse_edges(spark, sf_dir):
    return graph.eager(_sparse(spark, sf_dir)).select("src", "dst")


_CONTAINED = "VALUES ('a/mod.rs', 'a/b.rs', true), ('a/mod.rs', 'a/b/mod.rs', true), ('a/b.rs', 'a/b/c.rs', true), ('a/b.rs', 'a/c.rs', false), ('a/x.py', 'a/y.py', false), ('src/lib.rs', 'src/m.rs', true), ('a/b.rs', 'z/b/c.rs', false)"


@_register(f"SELECT concat(n_nationkey, '/', s) AS src, concat(n_nationkey, '/', d) AS dst FROM nation, ({_CONTAINED}) t(s, d, inside) WHERE NOT inside")
def edges_without_containment(spark, sf_dir):
    pairs = [("a/mod.rs", "a/b.rs"), ("a/mod.rs", "a/b/mod.rs"), ("a/b.rs", "a/b/c.rs"), ("a/b.rs", "a/c.rs"), ("a/x.py", "a/y.py"), ("src/lib.rs", "src/m.rs"), ("a/b.rs", "z/b/c.rs")]
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("s"), F.lit(b).alias("d")) for a, b in pairs))).alias("p")
    e = table(spark, sf_dir, "nation").select("n_nationkey", each).select(F.concat_ws("/", "n_nationkey", "p.s").alias("src"), F.concat_ws("/", "n_nationkey", "p.d").alias("dst"))
    return graph.contained(e)


_CHANGED7 = "(contains(node, '7.ts') OR contains(node, '99.py'))"


@_register(f"SELECT src, dst FROM edges WHERE {_CHANGED7.replace('node', 'src')} AND {_CHANGED7.replace('node', 'dst')}", "edges")
def induced_edges(spark, sf_dir):
    e = rel.edges(spark, sf_dir)
    n = graph.nodes_of(e).filter(F.contains("node", F.lit("7.ts")) | F.contains("node", F.lit("99.py")))
    return graph.induced(e, n).select("src", "dst")


_IMPORTS = "imp AS (SELECT p_partkey AS k, concat('m', p_partkey, '.py') AS src, CASE p_partkey % 4 WHEN 0 THEN concat('.x', p_partkey) WHEN 1 THEN 'numpy' WHEN 2 THEN '  ' ELSE 'own' END AS spec, CASE WHEN p_partkey % 4 = 3 THEN concat('m', p_partkey - 1, '.py') END AS dst FROM part)"


def _snapshot(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("m"), c, F.lit(".py"))
    p = table(spark, sf_dir, "part")
    spec = F.when(k % 4 == 0, F.concat(F.lit(".x"), k)).when(k % 4 == 1, "numpy").when(k % 4 == 2, "  ").otherwise("own")
    imports = p.select(name(k).alias("src"), spec.alias("spec"), F.when(k % 4 == 3, name(k - 1)).alias("dst"))
    return graph.snapshot(p.select(name(k).alias("path")), imports, p.select(name(k).alias("path"), F.concat(F.lit("pkg"), k % 3).alias("package")), p.filter("p_partkey % 10 = 1").select(name(k).alias("src"), name(k + 1).alias("dst")))


@_register("SELECT concat('file:', src) AS id, 'file' AS kind, src AS label FROM imp UNION SELECT concat('external:', spec), 'external', spec FROM imp WHERE dst IS NULL AND trim(spec) <> '' UNION SELECT concat('package:pkg', i), 'package', concat('pkg', i) FROM range(3) t(i)", also=_IMPORTS)
def snapshot_nodes(spark, sf_dir):
    return _snapshot(spark, sf_dir)[0]


@_register("SELECT concat('file:', src) AS src, concat('file:', dst) AS dst, 'imports' AS kind, 'HIGH' AS confidence FROM imp WHERE dst IS NOT NULL UNION ALL SELECT concat('file:', src), concat('external:', spec), 'depends-on', CASE WHEN starts_with(spec, '.') THEN 'LOW' ELSE 'MEDIUM' END FROM imp WHERE dst IS NULL AND trim(spec) <> '' UNION ALL SELECT concat('file:m', k, '.py'), concat('file:m', k + 1, '.py'), 'test-of', 'HIGH' FROM imp WHERE k % 10 = 1", also=_IMPORTS)
def snapshot_edges(spark, sf_dir):
    return _snapshot(spark, sf_dir)[1]


@_register("SELECT count(*) AS file_nodes, count(*) FILTER (k % 4 = 0) + 1 AS external_nodes, count(*) FILTER (k % 4 = 3) AS resolved_edges, count(*) FILTER (k % 4 = 1) AS external_edges, count(*) FILTER (k % 4 = 0) AS unresolved_edges FROM imp", also=_IMPORTS)
def snapshot_capabilities(spark, sf_dir):
    return graph.snapshot_capabilities(*_snapshot(spark, sf_dir))


@_register("SELECT concat('file:', src) AS src, concat('file:', dst) AS dst, 'imports' AS kind, 'HIGH' AS confidence FROM (SELECT DISTINCT src, dst FROM sparse)", also=_SPARSE)
def coupling_snapshot(spark, sf_dir):
    return graph.coupling_snapshot(_sparse(spark, sf_dir))[1]


@_register(
    f"SELECT 'files' AS section, 'files' AS item, count(*) AS n, false AS truncated FROM snodes UNION ALL SELECT 'import-edges', 'edges', count(*), false FROM (SELECT DISTINCT src, dst FROM sparse) UNION ALL SELECT 'hub', node, fan_out, true FROM (SELECT * FROM sdeg WHERE fan_out > 0 ORDER BY fan_out DESC, fan_in DESC, node LIMIT 10) UNION ALL SELECT 'dependency', node, fan_in, true FROM (SELECT * FROM sdeg WHERE fan_in > 0 ORDER BY fan_in DESC, fan_out DESC, node LIMIT 10) UNION ALL SELECT 'changed-blast-radius', dst, count(DISTINCT src), false FROM sparse WHERE dst IN ('src/m4.rs', 'src/m10.py', {_NAME('37')}) GROUP BY dst",
    also=_SPARSE,
)
def context_summary(spark, sf_dir):
    changed = spark.createDataFrame([("src/m4.rs",), ("src/m10.py",), ("src/m37.py",)], "node string")
    return graph.context_summary(materialize(_sparse(spark, sf_dir)), changed)


@_register("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'available' WHEN event_id % 7 = 0 THEN 'no-file-graph' WHEN event_id % 3 = 2 AND event_id % 5 = 0 THEN 'unresolved-target' WHEN event_id % 3 = 2 AND event_id % 11 > 5 THEN 'language-unmapped' WHEN event_id % 2 = 0 THEN 'limited' ELSE 'available' END AS readiness FROM events")
def graph_readiness(spark, sf_dir):
    e = F.col("event_id")
    claim = F.when(e % 3 == 0, "presence").when(e % 3 == 1, "absence").otherwise("target-absence")
    r = graph.readiness(claim, F.when(e % 7 == 0, 0).otherwise(3), F.when(e % 2 == 0, 4).otherwise(0), e % 5 == 0, e % 11, F.lit(5))
    return table(spark, sf_dir, "events").select("event_id", r.alias("readiness"))


# ---- reviews --------------------------------------------------------------------------------

_KINDS = ("subprocess-added", "network-call-added", "fs-write-added", "taint-sql", "access-control")
_SIG = "sig AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'subprocess-added' WHEN 1 THEN 'network-call-added' WHEN 2 THEN 'fs-write-added' WHEN 3 THEN 'taint-sql' ELSE 'access-control' END AS kind, CASE WHEN event_id % 5 = 4 THEN 'boundary' WHEN event_id % 5 = 3 THEN 'taint' ELSE 'behavioral' END AS family, concat('src/r', event_id % 60, '.py') AS path, CAST(event_id % 40 + 1 AS INT) AS line, event_id % 13 = 0 AS coarse FROM events), access AS (SELECT DISTINCT path FROM sig WHERE kind = 'access-control'), tiers AS (SELECT family, kind, path, CASE WHEN coarse THEN 'noise' WHEN kind IN ('subprocess-added', 'taint-sql', 'access-control') OR (kind = 'network-call-added' AND path IN (SELECT path FROM access)) THEN 'definitely' ELSE 'maybe' END AS tier, line FROM sig), merged AS (SELECT family, kind, path, tier, min(line) AS line, string_agg(DISTINCT line, ',' ORDER BY line) AS lines FROM tiers GROUP BY ALL)"


def _signals(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (e % 5).cast("int"))
    df = table(spark, sf_dir, "events").select(e, kind.alias("kind"), F.concat(F.lit("src/r"), e % 60, F.lit(".py")).alias("path"), (e % 40 + 1).cast("int").alias("line"), (e % 13 == 0).alias("rough"))
    parts = [reviewreport.signals_of(df.filter(e % 5 == i), "boundary" if i == 4 else "taint" if i == 3 else "behavioral", coarse=F.col("rough")) for i in range(5)]
    return fo.union(parts)


def _no_ranges(spark) -> DataFrame:
    return spark.createDataFrame([], "path string, start int, stop int")


@_register("SELECT family, kind, path, tier, line, lines, tier = 'definitely' AS gate_eligible FROM merged", also=_SIG)
def tiered_signals(spark, sf_dir):
    t = reviewreport.tiered(_signals(spark, sf_dir), _no_ranges(spark))
    return t.select("family", "kind", "path", "tier", "line", F.array_join("lines", ",").alias("lines"), "gate_eligible")


@_register("SELECT 'large-diff' AS kind, concat(count(*), ' files, ', count(*) * 10, ' changed lines') AS detail FROM supplier HAVING count(*) > 5 AND count(*) * 10 > 200 UNION ALL SELECT NULL, NULL FROM supplier WHERE false")
def large_diff_signal(spark, sf_dir):
    """Nothing but size: a signal only if over 5 files and 200 lines changed."""
    ranges = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("path"), F.lit(1).alias("start"), F.lit(10).alias("stop"))
    return reviewreport.tiered(_signals(spark, sf_dir).limit(0), ranges).select("kind", "detail")


_GONE = "WHEN kind = 'subprocess-added' THEN 'scripts run programs' WHEN kind = 'fs-write-added' AND regexp_matches(path, '/r[0-9]\\.py$') THEN 'own files'"


@_register(f"SELECT kind, path, tier, CASE {_GONE} END AS reason, tier = 'definitely' AND CASE {_GONE} END IS NULL AS gate_eligible FROM merged", also=_SIG)
def suppressed_signals(spark, sf_dir):
    """An overlay without a path, feedback with one, and entries that have expired."""
    schema = "kind string, pattern string, expires string, reason string"
    overlay = spark.createDataFrame([("subprocess-added", None, None, "scripts run programs"), ("taint-sql", None, "2000-01-01", "expired")], schema)
    feedback = spark.createDataFrame([("fs-write-added", r"/r[0-9]\.py$", "2999-01-01", "own files"), ("subprocess-added", ".*", None, "too late"), ("network-call-added", "^lib/", None, "elsewhere")], schema)
    s = reviewreport.suppressed(reviewreport.tiered(_signals(spark, sf_dir), _no_ranges(spark)), overlay, feedback, F.current_date())
    return s.select("kind", "path", "tier", "reason", "gate_eligible")


@_register("SELECT count(*) FILTER (tier = 'definitely' AND kind <> 'subprocess-added') AS failed, count(*) FILTER (tier = 'definitely' AND kind <> 'subprocess-added') = 0 AS passed FROM merged", also=_SIG)
def signal_gate(spark, sf_dir):
    schema = "kind string, pattern string, expires string, reason string"
    overlay = spark.createDataFrame([("subprocess-added", None, None, "ours")], schema)
    return reviewreport.signal_gate(reviewreport.suppressed(reviewreport.tiered(_signals(spark, sf_dir), _no_ranges(spark)), overlay, overlay.limit(0), F.current_date()))


_RANGED = "rng AS (SELECT DISTINCT path, line_start AS start, line_start + CAST(finding_no % 3 AS INT) AS stop FROM findings WHERE finding_no % 90 = 0), chg AS (SELECT DISTINCT path FROM rng), indiff AS (SELECT finding_no FROM findings f WHERE EXISTS (SELECT 1 FROM rng r WHERE r.path = f.path AND (f.line_start BETWEEN r.start AND r.stop OR f.line_start + 20 BETWEEN r.start AND r.stop)) OR (category = 'ARCHITECTURE' AND line_start = 1 AND line_end IS NULL AND path IN (SELECT path FROM chg)))"


def _review_inputs(spark, sf_dir):
    f = _risky(spark, sf_dir)
    f = f.withColumn("evidence", F.array(F.struct("path", "line_start", "line_end"), F.struct(F.col("path").alias("path"), (F.col("line_start") + 20).alias("line_start"), F.col("line_start").alias("line_end"))))
    r = f.filter("finding_no % 90 = 0").select("path", F.col("line_start").alias("start"), (F.col("line_start") + (F.col("finding_no") % 3).cast("int")).alias("stop")).distinct()
    return f, r.select("path").distinct(), r


@_register("SELECT finding_no FROM indiff", "findings", also=_RANGED)
def findings_in_diff(spark, sf_dir):
    f, changed, ranges = _review_inputs(spark, sf_dir)
    return reviewreport.in_diff(f, changed, ranges)


def _report(spark, sf_dir) -> reviewreport.Report:
    f, changed, ranges = _review_inputs(spark, sf_dir)
    edges = f.select(F.concat(F.lit("imp/"), F.col("rule_no") % 9).alias("src"), F.col("path").alias("dst"), F.lit("imports").alias("kind"), F.lit(False).alias("deferred")).distinct()
    rules = spark.createDataFrame([(1, "^src/", ["@core"])], "rule_no int, pattern string, owners array<string>")
    none = spark.createDataFrame([], "kind string, pattern string, expires string, reason string")
    return reviewreport.assembled(f, changed, ranges, _signals(spark, sf_dir), edges, rules, none, none, F.current_date())


_REVIEWED = f"{_RISKY}, {_RANGED}, {_SIG}, rv AS (SELECT r.*, i.finding_no IS NOT NULL AS in_diff, {_clamped('r.score + CASE WHEN i.finding_no IS NOT NULL THEN 12 ELSE 0 END')} AS s2 FROM risky r LEFT JOIN indiff i USING (finding_no)), rvp AS (SELECT *, {_band('s2')} AS band FROM rv), touched AS (SELECT path FROM chg UNION SELECT DISTINCT concat('imp/', rule_no % 9) FROM findings WHERE path IN (SELECT path FROM chg))"


@_register("SELECT finding_no, in_diff, s2 AS score, band AS priority FROM rvp", "findings", also=_REVIEWED)
def reviewed_findings(spark, sf_dir):
    """The findings of an assembled review; importers of changed files hold none, so only the diff weighs."""
    return _report(spark, sf_dir).findings.select("finding_no", "in_diff", "score", "priority")


@_register(
    "SELECT code, n, blocking FROM (SELECT 'priority-p0' AS code, count(*) FILTER (in_diff AND band = 'P0') AS n, true AS blocking FROM rvp UNION ALL SELECT 'priority-p1', count(*) FILTER (in_diff AND band = 'P1'), false FROM rvp UNION ALL SELECT 'visible-finding', count(*) FILTER (in_diff), false FROM rvp UNION ALL SELECT 'definitely-sensitive', count(*) FILTER (tier = 'definitely'), false FROM merged UNION ALL SELECT 'maybe-sensitive', count(*) FILTER (tier = 'maybe'), false FROM merged"
    " UNION ALL SELECT 'boundary-missing-test', CASE WHEN (SELECT count(*) FROM chg WHERE starts_with(path, 'tests/')) = 0 THEN 1 ELSE 0 END, false UNION ALL SELECT 'unowned-surface', count(*) FILTER (NOT starts_with(path, 'src/')), false FROM touched UNION ALL SELECT 'verification-failed', 2, true) WHERE n > 0",
    "findings", also=_REVIEWED,
)
def review_reasons(spark, sf_dir):
    checks = spark.createDataFrame([("failed", True), ("failed", True), ("passed", True)], "status string, revision_compatible boolean")
    return reviewreport.reasons(_report(spark, sf_dir), checks=checks)


@_register("SELECT package AS root, a AS p0, CASE WHEN b > 0 THEN 'blocked' WHEN a + b > 0 THEN 'review' ELSE 'ready' END AS verdict FROM (VALUES ('x', 0, 0), ('y', 2, 0), ('z', 1, 3)) t(package, a, b)")
def review_verdicts(spark, sf_dir):
    """Verdicts of no reasons, of reasons that do not block, and of one that does."""
    out = []
    for root, plain, hard in (("x", 0, 0), ("y", 2, 0), ("z", 1, 3)):
        rows = [("maybe-sensitive", 1, False)] * plain + [("priority-p0", 1, True)] * hard
        v = reviewreport.verdict(spark.createDataFrame(rows, "code string, n long, blocking boolean"))
        out.append(v.select(F.lit(root).alias("root"), F.lit(plain).alias("p0"), "verdict"))
    return fo.union(out)


@_register("SELECT string_agg(DISTINCT o, ',' ORDER BY o) AS owners, count(*) FILTER (o IS NULL) AS unowned FROM (SELECT path, CASE WHEN contains(path, '/pkg3/') THEN '@three' WHEN starts_with(path, 'src/') THEN '@core' END AS o FROM (SELECT DISTINCT path FROM findings))", "findings")
def ownership_summary(spark, sf_dir):
    rules = spark.createDataFrame([(1, "^src/", ["@core"]), (2, "/pkg3/", ["@three"])], "rule_no int, pattern string, owners array<string>")
    return review.ownership_summary(review.owners(rel.findings(spark, sf_dir), rules)).select(F.array_join("owners", ",").alias("owners"), "unowned")


# ---- decisions ------------------------------------------------------------------------------

_GATED = "CASE finding_no % 10 WHEN 1 THEN 'language' WHEN 2 THEN 'language-support' WHEN 3 THEN 'framework' WHEN 4 THEN 'runtime' WHEN 5 THEN 'paradigm' WHEN 6 THEN 'low-signal-path' WHEN 7 THEN 'config-role' WHEN 8 THEN 'generated-role' END"


def _known(spark, sf_dir):
    """Findings each of whose files fails at most one gate of rule r1; rule r2 is unknown."""
    n = F.col("finding_no") % 10
    bad = lambda i, yes, no: F.when(n == i, yes).otherwise(no)
    arr = lambda v: F.array(F.lit(v))
    f = rel.findings(spark, sf_dir).select(
        "finding_no", "severity", F.when(F.col("finding_no") % 7 == 0, "r2").otherwise("r1").alias("rule_id"), bad(1, arr("Go"), arr("Python")).alias("f_languages"), bad(2, F.lit("text"), F.lit("syntax")).alias("f_support"), bad(3, arr("flask"), arr("django")).alias("f_frameworks"),
        bad(4, arr("browser"), arr("server")).alias("f_runtimes"), bad(5, arr("functional"), arr("oop")).alias("f_paradigms"), (n == 6).alias("f_low_signal"), bad(7, arr("config"), bad(8, arr("generated"), arr("production"))).alias("f_roles"),
    )
    from ..sources.config import KNOWLEDGE

    return f, spark.createDataFrame([("r1", ["Python", "Ruby"], "import-graph", ["django"], ["server"], ["oop"], True, True, True)], KNOWLEDGE)


@_register(f"SELECT finding_no, CASE WHEN finding_no % 7 <> 0 THEN {_GATED} END AS failed_gate FROM findings", "findings")
def knowledge_gates(spark, sf_dir):
    return explain.gated(*_known(spark, sf_dir)).select("finding_no", "failed_gate")


@_register(f"SELECT finding_no, CASE WHEN finding_no % 7 = 0 THEN 1 WHEN finding_no % 10 BETWEEN 1 AND 8 THEN 1 + finding_no % 10 ELSE 10 END AS steps, CASE WHEN finding_no % 7 = 0 THEN 'not-matched' WHEN finding_no % 10 BETWEEN 1 AND 8 THEN 'failed' ELSE 'applied' END AS last FROM findings", "findings")
def decision_traces(spark, sf_dir):
    t = explain.trace(*_known(spark, sf_dir))
    return t.select("finding_no", F.size("steps").alias("steps"), F.element_at("steps", -1)["status"].alias("last"))


@_register("SELECT p_partkey % 2 = 0 AS django, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'framework' END AS failed_gate, count(*) AS projects FROM part GROUP BY ALL")
def project_decisions(spark, sf_dir):
    even = F.col("p_partkey") % 2 == 0
    one = lambda v: F.array(F.lit(v))
    p = table(spark, sf_dir, "part").select(F.lit("r1").alias("rule_id"), even.alias("django"), one("Python").alias("f_languages"), F.lit("syntax").alias("f_support"), F.when(even, one("django")).otherwise(one("flask")).alias("f_frameworks"), one("server").alias("f_runtimes"), one("oop").alias("f_paradigms"), F.lit(False).alias("f_low_signal"), one("production").alias("f_roles"))
    return explain.project_decisions(p, _known(spark, sf_dir)[1]).groupBy("django", "failed_gate").agg(F.count(F.lit(1)).alias("projects"))


@_register("SELECT finding_no, CASE WHEN confidence = 'HIGH' THEN 3 END AS steps, CASE WHEN confidence = 'HIGH' THEN concat('See ', path, ':', line_start, CASE WHEN line_end IS NOT NULL THEN concat('-', line_end) ELSE '' END, ' for: ', CASE WHEN rule_id IN ('security.secret-candidate', 'security.private-key-candidate') THEN '[evidence withheld]' ELSE snippet END) END AS first FROM findings", "findings")
def verification_plans(spark, sf_dir):
    f = rel.findings(spark, sf_dir).withColumn("evidence", F.array(F.struct("path", "line_start", "line_end", "snippet")))
    r = explain.records(f)
    return r.select("finding_no", F.size("record.plan").alias("steps"), F.element_at("record.plan", 1).alias("first")).withColumn("steps", F.when(F.col("first").isNotNull(), F.col("steps")))


@_register("SELECT finding_no, CASE WHEN rule_no % 2 = 0 THEN category END AS category, CASE WHEN rule_no % 2 = 0 THEN lifecycle END AS lifecycle FROM findings", "findings")
def explained_findings(spark, sf_dir):
    from ..functions import rules

    f, k = _known(spark, sf_dir)
    named = f.drop("rule_id").join(rel.findings(spark, sf_dir).select("finding_no", "rule_id", "rule_no"), "finding_no")
    known = rules.table(spark).filter("rule_no % 2 = 0")
    return explain.explained(named, k, known).select("finding_no", "rule.category", "rule.lifecycle")


@_register("SELECT count(*) AS findings, count(*) FILTER (priority = 'P0') AS p0, count(*) FILTER (priority = 'P1') AS p1, count(*) FILTER (confidence = 'HIGH') AS verification_plans, CASE WHEN count(*) FILTER (priority = 'P0') > 0 THEN 'block' WHEN count(*) = 0 THEN 'pass' ELSE 'review' END AS verdict, 4 AS hidden FROM risky", "findings", also=_RISKY)
def decision_summary(spark, sf_dir):
    return explain.decision_summary(_risky(spark, sf_dir), hidden=4)


_OUTPUT = (("x --api_token=abc def", "x --api_token=[value withheld]"), ("Password: hunter2", "Password: [value withheld]"), ("tokens: 3 left", "tokens: 3 left"), ("use ghp_abcdefghijklmnopqrstuv now", "use [token] now"), ("id aaaa.bbbb.cccc ok", "id [token] ok"), ("plain  text", "plain text"))
_OUTPUT_ROWS = ", ".join(f"({i}, '{b}')" for i, (_, b) in enumerate(_OUTPUT))


@_register(f"SELECT event_id, said FROM events JOIN (VALUES {_OUTPUT_ROWS}) t(no, said) ON event_id % {len(_OUTPUT)} = no")
def redacted_output(spark, sf_dir):
    line = F.get(F.array(*(F.lit(a) for a, _ in _OUTPUT)), (F.col("event_id") % len(_OUTPUT)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", explain.redacted_output(line).alias("said"))


# ---- incremental runs -----------------------------------------------------------------------


@_register("SELECT path, CASE WHEN n % 7 = 0 AND n % 5 = 0 THEN 'missing-cache-entry' WHEN n % 7 = 0 THEN 'missing-file-role-cache' WHEN n % 5 = 0 THEN 'missing-findings-cache' WHEN n % 3 = 0 THEN 'content-changed' WHEN n % 2 = 0 THEN 'config-changed' END AS miss FROM (SELECT path, CAST(regexp_extract(path, '([0-9]+)\\.txt$', 1) AS BIGINT) AS n FROM files)", "files")
def cache_miss_reasons(spark, sf_dir):
    n = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long")
    f = rel.files(spark, sf_dir).select("path", F.sha2("content", 256).alias("hash"))
    roles = f.filter(n % 7 != 0)
    old = F.when(n % 3 == 0, F.lit("other")).otherwise(F.col("hash"))
    found = f.filter(n % 5 != 0).select("path", old.alias("hash"), F.when(n % 2 == 0, "v1").otherwise("v2").alias("config"))
    return incremental.cache_misses(f, roles, found, "v2").select("path", "miss")


@_register("SELECT hash, language, used FROM (SELECT concat('h', event_id % 700) AS hash, event_type AS language, max(event_id) AS used FROM events GROUP BY ALL) ORDER BY used DESC, hash, language LIMIT 300")
def facts_store(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("h"), F.col("event_id") % 700).alias("hash"), F.col("event_type").alias("language"), F.col("event_id").alias("used"))
    return incremental.stored(e.filter("used % 2 = 0"), e.filter("used % 2 = 1"), 300)


@_register("SELECT path, language FROM files WHERE CAST(regexp_extract(path, '([0-9]+)\\.txt$', 1) AS BIGINT) % 4 = 0 AND sha256(coalesce(content, '')) NOT IN (SELECT sha256(coalesce(content, '')) FROM files g WHERE CAST(regexp_extract(g.path, '([0-9]+)\\.txt$', 1) AS BIGINT) % 4 <> 0 AND g.language IS NOT DISTINCT FROM files.language)", "files")
def files_to_analyse(spark, sf_dir):
    n = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long")
    f = rel.files(spark, sf_dir).select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"), "language")
    return incremental.to_analyse(f.filter(n % 4 == 0), f.filter(n % 4 != 0)).select("path", "language")


@_register("SELECT 2 AS revisions, count(*) AS files FROM files", "files")
def workspace_revisions(spark, sf_dir):
    """The revision does not depend on the order of rows, and does on a configuration."""
    f = rel.files(spark, sf_dir).select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))
    same = incremental.workspace_revision(f, "a").unionByName(incremental.workspace_revision(f.repartition(5), "a")).unionByName(incremental.workspace_revision(f, "b"))
    return same.agg(F.count_distinct("revision").alias("revisions"), F.max("files").alias("files"))

"""Queries over small tables that hold the cases a cut would leave out."""

import random

from pyspark.sql import functions as F

from auditflow.operators import graph, review
from auditflow.plans import catalog
from auditflow.sinks import reports

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


def test_file_metrics_has_a_row_for_every_file(spark, tmp_path):
    texts = ["if a\n// if x\nelif y", "# for all\n  * if one\n/* case */\nwhile b && c", "plain if", "", None]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts, 1)], TEXT).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: (r.non_empty_lines, r.branches) for r in catalog.queries()["file_metrics"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    assert [got[f"s/en/doc{i}.txt"] for i in (1, 2, 3, 4)] == [(3, 2), (4, 2), (1, 0), (0, 0)]


def test_shortest_cycles_looks_past_the_first_two_nodes(spark, tmp_path):
    """A ring of six parts whose last two also point at each other."""
    pairs = [(1, 2), (2, 3), (3, 5), (5, 6), (6, 7), (7, 1), (7, 6)]
    rows = [(n, part, 1, line, 1.0) for n, pair in enumerate(pairs) for line, part in enumerate(pair, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in catalog.queries()["shortest_cycles"](spark, str(tmp_path)).select("component", "start", "length").collect()]
    assert got == [("src/d1/m1.py", "src/d6/m6.py", 2)]


def _random_edges(rng, n, m):
    return sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)})


def _components(pairs):
    """Strong components by reachability, those with a cycle."""
    nodes = {x for p in pairs for x in p}
    out = {x: {b for a, b in pairs if a == x} for x in nodes}
    reach = {}
    for x in nodes:
        seen, todo = set(), list(out[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += out[y]
        reach[x] = seen
    return {x: min(y for y in nodes if y in reach[x] and x in reach[y]) for x in nodes if x in reach[x]}, out


def _distance(out, start, inside):
    """Steps of the shortest way from start back to it."""
    level, seen, n = [start], set(), 0
    while level:
        n += 1
        level = [y for x in level for y in out[x] if y in inside]
        if start in level:
            return n
        level = [y for y in dict.fromkeys(level) if y not in seen]
        seen |= set(level)
    return None


def test_shortest_cycles_by_brute_force(spark):
    for seed in range(4):
        pairs = _random_edges(random.Random(seed), 14, 20)
        component, out = _components(pairs)
        want = {}
        for x in sorted(component):
            inside = {y for y in component if component[y] == component[x]}
            want[component[x]] = min(want.get(component[x], (99, "")), (_distance(out, x, inside), x))
        edges = spark.createDataFrame([(a, b, "imports") for a, b in pairs], "src string, dst string, kind string")
        got = {r.component: (r.length, r.start) for r in graph.shortest_cycles(edges, graph.components_strong(edges)).collect()}
        assert got == want


def test_shortest_cycles_takes_every_node_as_start(spark):
    """70 nodes lie on cycles of three through y and z, which come after them and also point at each other."""
    pairs = [("y", "z"), ("z", "y")] + [p for i in range(70) for p in ((f"n{i:02}", "z"), ("y", f"n{i:02}"))]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    components = graph.nodes_of(edges).select("node", F.lit("n00").alias("component"))
    assert [tuple(r) for r in graph.shortest_cycles(edges, components).collect()] == [("n00", "y", 2)]


def test_longer_shortest_cycles_by_brute_force(spark):
    """Walks ahead and back meet at the right length, whichever side goes on; the first node of equally short cycles counts."""
    for seed in (0, 2):
        rng = random.Random(seed)
        place = {f"n{i:03}": i for i in rng.sample(range(200), 120)}
        pairs = [(a, b) for a, b in ((rng.choice(list(place)), rng.choice(list(place))) for _ in range(800)) if 0 < (place[b] - place[a]) % 200 < 50]  # round a ring, so that no cycle is shorter than five
        component, out = _components(pairs)
        want = {}
        for x in sorted(component):
            inside = {y for y in component if component[y] == component[x]}
            want[component[x]] = min(want.get(component[x], (999, "")), (_distance(out, x, inside), x))
        rows = [(x, c) for x, c in component.items()]
        edges = spark.createDataFrame(pairs, "src string, dst string")
        got = {r.component: (r.length, r.start) for r in graph.shortest_cycles(edges, spark.createDataFrame(rows, "node string, component string")).collect()}
        assert got == want and all(n > 4 for n, _ in want.values())


def _walked(pairs):
    """Cycles that a depth-first walk in name order meets, by plain recursion."""
    out, state, found = {}, {}, set()
    for a, b in pairs:
        out.setdefault(a, []).append(b)

    def visit(x, path):
        state[x] = 1
        for y in sorted(out.get(x, ())):
            if state.get(y) == 1:
                c = path[path.index(y) :]
                i = c.index(min(c))
                found.add(tuple(c[i:] + c[:i]))
            elif y not in state:
                visit(y, [*path, y])
        state[x] = 2

    for x in sorted({x for p in pairs for x in p}):
        if x not in state:
            visit(x, [x])
    return sorted(found)


def test_bounded_cycles_by_brute_force(spark):
    for seed in range(4):
        pairs = _random_edges(random.Random(seed), 12, 22)
        component, _ = _components(pairs)
        inside = [(a, b) for a, b in pairs if component.get(a) is not None and component.get(a) == component.get(b)]
        edges = spark.createDataFrame([(a, b, "imports") for a, b in pairs], "src string, dst string, kind string")
        assert sorted(tuple(r.cycle) for r in graph.bounded_cycles(edges, most=1000).collect()) == _walked(inside)
    few = graph.bounded_cycles(spark.createDataFrame([("a", "b", "i"), ("b", "a", "i"), ("c", "c", "i")], "src string, dst string, kind string"), most=1).collect()
    assert [(list(r.cycle), r.truncated) for r in few] == [(["a", "b"], True)]


def test_layers_and_owners_by_order(spark):
    nodes = spark.createDataFrame([("a/x",), ("b/y",), ("c",)], "path string")
    rules = spark.createDataFrame([(1, "^a/", ["@a"]), (2, "x$", ["@x", "@y"]), (3, "^b/", [])], "rule_no int, pattern string, owners array<string>")
    assert {r.path: r.owners for r in review.owners(nodes, rules).collect()} == {"a/x": ["@x", "@y"], "b/y": [], "c": None}
    assert {r.path: r.owners for r in review.owners(nodes, rules.limit(0)).collect()} == {"a/x": None, "b/y": None, "c": None}


def test_budget_equals_a_plain_fold(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(("SECURITY", "TESTING")), rng.choice(("HIGH", "LOW")), f"r{i % 3}", f"p{i % 5}", i % 7, rng.choice((10, 10, 50, 90)), rng.randrange(5, 40)) for i in range(200)]
    df = spark.createDataFrame(rows, "finding_no int, category string, severity string, rule_id string, path string, line_start int, score int, cost int")
    for budget in (0, 300, 1500, 99999):
        want = set()
        for c in ("SECURITY", "TESTING"):
            mine = sorted((r for r in rows if r[1] == c), key=lambda r: (-r[6], -{"HIGH": 3, "LOW": 1}[r[2]], r[3], f"{r[4]}:{r[5]}", r[0]))
            used, share = 0, budget * len(mine) // len(rows)
            for r in mine:
                used += r[7]
                if used <= share:
                    want.add(r[0])
        assert {r.finding_no for r in reports.within_budget(df, "cost", budget).collect()} == want

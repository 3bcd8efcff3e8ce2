"""Graph operators on small hand-made graphs, and components on random ones."""

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from auditflow.operators import graph

TINY = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "a")]


def edges(spark, pairs, kind="imports"):
    return spark.createDataFrame([(a, b, kind, False) for a, b in pairs], "src string, dst string, kind string, deferred boolean")


def names(df, *columns):
    return sorted(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect())


def test_tiny(spark):
    e = edges(spark, TINY)
    assert names(graph.components_strong(e), "node", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]
    assert names(graph.cycles(graph.components_strong(e)), "component", "size") == [("a", 3), ("d", 1)]
    assert names(graph.shortest_cycles(e, graph.components_strong(e)), "component", "start", "length") == [("a", "a", 2), ("d", "d", 1)]
    seeds = spark.createDataFrame([("b",)], "node string")
    assert names(graph.blast_radius(e, seeds), "node") == ["a", "c", "e"]
    assert names(graph.one_hop_radius(e, seeds), "node") == ["a"]
    assert names(graph.dead(graph.nodes_of(e), e), "node") == ["d", "e"]
    isolated = graph.nodes_of(e).unionByName(spark.createDataFrame([("z",)], "node string"))
    d = {r.node: (r.fan_in, r.fan_out, round(r.instability, 3)) for r in graph.degrees(isolated, e).collect()}
    assert d["z"] == (0, 0, 0.0) and d["c"] == (2, 1, 0.333) and d["d"] == (1, 1, 0.5)


def test_impact_passes_through_changed(spark):
    e = edges(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("e", "d")])
    changed = spark.createDataFrame([("a",), ("b",)], "node string")
    assert names(graph.impact(e, changed, 3), "seed", "node", "hop") == [("a", "c", 2), ("a", "d", 3), ("b", "c", 1), ("b", "d", 2), ("b", "e", 3)]


def test_two_kinds_count_twice_in_degrees(spark):
    e = edges(spark, [("a", "b")]).unionByName(edges(spark, [("a", "b")], "test-of"))
    d = {r.node: r.fan_in for r in graph.degrees(graph.nodes_of(e), e).collect()}
    assert d["b"] == 2
    assert graph.direct_dependents(e).first().dependents == ["a"]


def test_eager_wins(spark):
    df = spark.createDataFrame([("a", "b", True), ("a", "b", False), ("a", "c", True)], "src string, dst string, deferred boolean")
    assert names(graph.eager(graph.edges_of(df)), "src", "dst") == [("a", "b")]


def _strong(pairs):
    reach = {}
    for n in {x for p in pairs for x in p}:
        seen, todo = set(), [n]
        while todo:
            for a, b in pairs:
                if a == todo[-1] and b not in seen:
                    seen.add(b)
                    todo.insert(0, b)
            todo.pop()
        reach[n] = seen
    return sorted((n, min(m for m in reach if m in reach[n] and n in reach[m])) for n in reach if n in reach[n])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), min_size=1, max_size=12))
def test_components_of_random_graphs(spark, pairs):
    assert names(graph.components_strong(edges(spark, pairs)), "node", "component") == _strong(pairs)


def _blocks(rng, blocks, size):
    """Dense blocks: the first three in a ring of blocks, the others in a chain with a tail and a loop; by shuffled names."""
    names_ = [f"n{i:03}" for i in rng.sample(range(500), blocks * size + 2)]
    of = [names_[i * size : (i + 1) * size] for i in range(blocks)]
    pairs = {(a, b) for block in of for a in block for b in block if a != b and rng.random() < 0.9}
    pairs |= {(rng.choice(of[a]), rng.choice(of[b])) for a, b in [(0, 1), (1, 2), (2, 0), *((i, i + 1) for i in range(2, blocks - 1))]}
    return sorted(pairs | {(of[-1][0], names_[-1]), (names_[-1], names_[-2]), (names_[-2], names_[-2])})


def test_components_of_dense_graphs(spark):
    import random

    for seed in range(2):
        pairs = _blocks(random.Random(seed), 6, 14)
        assert names(graph.components_strong(edges(spark, pairs)), "node", "component") == _strong(pairs)


def test_dense_graphs_shrink_before_their_rounds(spark, monkeypatch):
    """Rounds run over few edges a node; all of them are written as names and as numbers only."""
    pairs = [(f"n{i:02}", f"n{j:02}") for i in range(30) for j in range(30) if i != j]
    written = []

    def counted(df, real=graph.materialize):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "materialize", counted)
    assert names(graph.components_strong(edges(spark, pairs)), "component") == ["n00"] * 30
    assert sum(n > len(pairs) / 2 for n in written) == 2, written


def test_packages(spark):
    nodes = spark.createDataFrame([("p/a/x.py",), ("p/ab/x.py",), ("q.py",)], "node string")
    packages = spark.createDataFrame([("root", ""), ("p", "p"), ("pa", "p/a")], "package string, root string")
    assert names(graph.package_of(nodes, packages), "node", "package") == [("p/a/x.py", "pa"), ("p/ab/x.py", "p"), ("q.py", "root")]


def test_strong_components_leave_few_files(spark):
    """What rounds wrote goes with them: no edges of trimming, colouring and walking stay."""
    import os

    from auditflow.plans.storage import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    n = 6
    ring = spark.createDataFrame([(f"n{i:02}", f"n{(i + 1) % n:02}") for i in range(n)], "src string, dst string")
    before = set(os.listdir(folder))
    assert names(graph.components_strong(ring), "component") == ["n00"] * n
    left = set(os.listdir(folder)) - before
    assert len(left) < 14, len(left)

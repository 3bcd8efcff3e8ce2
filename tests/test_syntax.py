"""The syntax reader and what is built on its nodes: functions, rules on trees, def-use chains."""

import random

import pytest

from auditflow.operators import functionrules, syntaxtree, taint, treerules
from auditflow.sources import spans, syntax

FILES = "path string, language string, content string"
PARTS = [*"(){}[];,.:=<>!?&|+-*/'\"`$@#\n ", "if", "else", "for", "fn", "func", "fun", "function", "class", "=>", "->", "::", "match", "switch", "case", "try", "catch", "do", "return", "new", "x", "use", "mod", "impl", 'r#"', '"""', "${", "//", "/*", "*/", "&&", "'a", "é", "export", "record", "def", "    "]


def _functions(spark, *texts):
    rows = [(f"f{i}", lang, text) for i, (lang, text) in enumerate(texts)]
    got = spans.functions(spark.createDataFrame(rows, FILES)).orderBy("path", "first", "last", "name").collect()
    return [(r.path, r.name, r.first, r.last, r.score, r.depth, r.loops, r.recursive) for r in got]


def test_functions_of_awkward_texts(spark):
    got = _functions(
        spark,
        ("Rust", 'fn a() {\n    // if {\n    let s = "if { for";\n    if x { }\n}\n'),
        ("JavaScript", "class A { m() { while (a) { do { b(); } while (c); } } }"),
        ("Go", "func Map[T any](x []T) {\n}\n"),
        ("TypeScript", "const r = /[{]/;\nfunction a() { return `${`}`}`; }\nconst f = (a) => a ? 1 : 0\n"),
        ("Kotlin", "fun a() = 1\nfun b() = if (x) 1 else 2\n"),
        ("Rust", "fn broken( { if a { }\nfn next() { loop {} }"),
        ("Python", "def a(:\n    pass\ndef b(x):\n    if x: pass\n"),
        ("Java", "class A { int f(int a) { if (a > 0) x(); else if (a < 0) y(); return 1; } }"),
    )
    assert got == [
        ("f0", "a", 1, 5, 1, 1, 0, False), ("f1", "m", 1, 1, 3, 2, 2, False), ("f2", "Map", 1, 2, 0, 0, 0, False), ("f3", "a", 2, 2, 0, 0, 0, False), ("f3", "f", 3, 3, 0, 0, 0, False),
        ("f4", "a", 1, 1, 0, 0, 0, False), ("f4", "b", 2, 2, 1, 1, 0, False), ("f5", "broken", 1, 2, 1, 1, 0, False), ("f5", "next", 2, 2, 1, 1, 1, False), ("f6", "b", 3, 4, 1, 1, 0, False), ("f7", "f", 1, 1, 3, 2, 0, False),
    ]


def test_no_text_no_nodes(spark):
    assert syntax.nodes_of(None, "Rust") == syntax.nodes_of("x", None) == syntax.nodes_of("", "Go") == syntax.nodes_of("x", "COBOL") == []
    assert syntax.nodes(spark.createDataFrame([("a", "Rust", None), ("b", None, "x")], FILES)).count() == 0


def test_order_numbers_are_intervals_whatever_the_text():
    rng = random.Random(3)
    for _ in range(250):
        text = "".join(rng.choice(PARTS) + rng.choice(("", "", " ", "\n")) for _ in range(rng.randint(1, 90)))
        for language in (*syntax.BRACED, "Python"):
            rows = syntax.nodes_of(text, language)
            assert [r[0] for r in rows] == list(range(len(rows))) == sorted(r[1] for r in rows)
            for pre, post, *_, first, last, upto, around in rows:
                assert first <= last and pre <= upto < len(rows)
                for a in around:
                    assert a < pre and rows[a][1] > post and rows[a][8] >= upto


@pytest.mark.parametrize("text", ["(" * 30_000, "{" * 30_000, "a(b(" * 8000, "<" * 20_000 + "a", "x = " * 20_000, "if (a) " * 3000])
def test_deep_texts_end(text):
    for language in ("Rust", "TypeScript", "C#"):
        assert isinstance(syntax.nodes_of(text, language), list)


def test_long_files_come_in_batches(spark):
    n = 4000
    df = spark.createDataFrame([("a.rs", "Rust", "fn f() { if a && b { c(); } }\n" * n)], FILES)
    got = spans.functions(df).groupBy("name", "score").count().collect()
    assert [(r.name, r.score, r["count"]) for r in got] == [("f", 2, n)]


def test_crossings_go_through_functions(spark):
    """Depth is not reset by a function inside another."""
    text = "function a() {\n if (x) {\n  for (;;) {\n   run(() => {\n    while (y) {\n     if (z) { if (w) {} }\n    }\n   });\n  }\n }\n}\n"
    df = spark.createDataFrame([("a.js", "JavaScript", text)], FILES)
    roles = spark.createDataFrame([("a.js", "production")], "path string, role string")
    assert [r.line_start for r in functionrules.deep_control_flow(syntax.nodes(df), roles, most=3).collect()] == [6]
    assert functionrules.deep_control_flow(syntax.nodes(df), roles, most=5).count() == 0
    assert syntaxtree.crossings(syntax.nodes(df), 0).count() == 1


def test_the_gravest_panic_of_a_line(spark):
    rows = [("src/a.rs", "Rust", "fn f() { a.expect(\"x\"); b.unwrap(); todo!(); }\nfn g() { self.db.lock().unwrap(); }\nfn h() { \"1\".parse::<u8>().unwrap(); }\nfn i() { println!(\"{}\", x.unwrap()); }\n")]
    got = treerules.language_risks(syntax.nodes(spark.createDataFrame(rows, FILES), treerules.KINDS, treerules.AROUND)).collect()
    assert {(r.line_start, r.severity) for r in got} == {(1, "HIGH"), (2, "MEDIUM"), (3, "LOW"), (4, "MEDIUM")}


def test_generated_files_and_configuration_carry_no_risk(spark):
    rows = [(p, "JavaScript", "process.exit(1)") for p in ("src/a.js", "generated/a.js", "bin/tool.js", "__tests__/a.js")]
    got = treerules.language_risks(syntax.nodes(spark.createDataFrame(rows, FILES), treerules.KINDS, treerules.AROUND)).collect()
    assert {(r.path, r.severity) for r in got} == {("src/a.js", "HIGH"), ("bin/tool.js", "LOW")}


def _taint(spark, language, text, path="src/a"):
    return sorted((r.line, r.kind, r.source, r.function) for r in taint.taint(spark.createDataFrame([(path, language, text)], FILES)).collect())


def test_taint_by_field_and_cleared(spark):
    text = "function f(req) {\nu.name = req.body.name;\nfetch(u.name);\nfetch(u.age);\nu = clean();\nfetch(u.name);\nn = parseInt(req.query.n);\nexec(n);\nconst sql = `select ${req.params.id}`;\ndb.query(sql);\ndb.query('select ?', sql);\n}\n"
    assert _taint(spark, "JavaScript", text) == [(3, "taint-network", "http-request", "f"), (10, "taint-sql", "http-request", "f")]


def test_taint_stays_in_its_function_and_order(spark):
    text = "def a(request):\n    x = request.args['x']\n\ndef b(x):\n    os.system(x)\n\ndef c():\n    os.system(y)\n    y = sys.argv[1]\n    z = y.strip()\n    os.system(int(z))\n    subprocess.run(\n        ['sh', z])\n    open(z)\n    open(z, 'w')\n    requests.get(z if z else request.form['u'])\n"
    assert _taint(spark, "Python", text) == [(12, "taint-exec", "process-args", "c"), (15, "taint-fs-write", "process-args", "c"), (16, "taint-network", "http-request", "c")]
    assert _taint(spark, "Python", text, "tests/test_a.py") == []


def test_taint_of_destructured_and_top_level_values(spark):
    text = "const { id, name: n } = req.body;\ndb.query(id + 1);\ndb.query(n);\nfs.writeFile(process.argv[2], 'x');\n"
    assert _taint(spark, "TypeScript", text) == [(2, "taint-sql", "http-request", ""), (3, "taint-sql", "http-request", ""), (4, "taint-fs-write", "process-args", "")]

"""Queries on syntax: functions, nesting, rules on trees, over sources of eight languages.

The texts are made of the tables' rows: how deep a function nests, which statements it holds and
where its file stands follow from a key.  SQL counts the same from the key alone; it knows what was
planted in each line, not the reader that finds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..operators import functionrules, syntaxtree, taint, treerules
from ..sources import spans, syntax
from .catalog import _register
from .storage import table

_lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

#: A source by language: ending, head, first line of a function, a step deeper (one line), what is
#: innermost (one line), a step back, end, and a tail.  Beside them the functions of head, innermost
#: line and tail: (name, part, line in it, last line in it, score, depth, loops, recursive).
SOURCES = (
    ("Rust", "rs", "// fn fake() { if a {} }\nconst S: &str = r#\"} fn fake() {\"#;\n", "pub(crate) fn nest<'a, T: Fn(u8) -> u8>(c: &'a [T; 2]) -> Vec<u8> where T: Copy {\n", "if c == '{' {\n", "c.iter().map(|x| x + 1);\n", "}\n", "}\n",
     "impl<T> Walk for Tree<T> {\n  fn again(&self, n: u8) -> Option<[u8; 2]> { for x in n { while x { self.again(x); } } None }\n  fn pick(n: u8) -> u8 { match n { 1 if n > 0 => { if n { 2 } else { 3 } } _ => 4 } }\n}\n",
     (("again", "tail", 2, 2, 3, 2, 2, True), ("pick", "tail", 3, 3, 3, 2, 0, False))),
    ("Go", "go", "var s = `} func fake() { if`\n/* func fake() {\n*/\n", "func nest[K comparable, V any](m map[K]V) (out []V, err error) {\n", "if c := m; c != nil {\n", "out = append(out, struct{ a int }{1}.a)\n", "}\n", "}\n",
     "func (t *Tree[T]) again(n int) interface{} {\n\tfor i := 0; i < n; i++ {\n\t\tfor range n {\n\t\t\tt.again(i)\n\t\t}\n\t}\n\treturn nil\n}\nfunc pick(n int) int { switch n { case 1: if n > 0 { return 1 } }; return 2 }\n",
     (("again", "tail", 1, 8, 3, 2, 2, False), ("pick", "tail", 9, 9, 3, 2, 0, False))),
    ("Java", "java", "// class Fake { void fake() {\nclass A<T extends B> {\n  String s = \"} void fake() {\";\n", "  @Get(\"{x}\") public <K, V> Map<K, List<V>> nest(K c) throws E {\n", "if (c == '{') {\n", "list.forEach(x -> x.run());\n", "}\n", "}\n",
     "int again(int n) { for (int i = 0; i < n; i++) while (n > i) again(i); return 0; }\nA(int n) { try { go(); } catch (E e) { if (n > 1 && n < 3) { return; } } }\n}\n",
     (("again", "tail", 1, 1, 3, 2, 2, True), ("A", "tail", 2, 2, 4, 2, 0, False))),
    ("C#", "cs", "namespace N {\nclass A<T> where T : new() {\n  string s = @\"} void Fake() { \"\"\"; string r = $\"{(s == \"}\" ? \"{\" : s)}\";\n", "  public async Task<(int, string)> nest<K>(K c) where K : class {\n", "if (c == '{') {\n", "list.ForEach(x => x.Run());\n", "}\n", "}\n",
     "  public int One(int n) => n > 1 ? n : 2;\n  int Again(int n) { foreach (var x in n) do { Again(x); } while (x); return 0; }\n}\n}\n",
     (("One", "tail", 1, 1, 0, 0, 0, False), ("Again", "tail", 2, 2, 3, 2, 2, True))),
    ("Kotlin", "kt", "/* fun fake() { /* nested */ if */\nval s = \"} ${if (a) \"{\" else \"}\"} fun fake() {\"\n", "internal fun <T : Any> List<T>.nest(c: (T) -> Unit): Map<String, T> where T : X {\n", "if (c == '{') {\n", "list.map { x -> x + 1 }\n", "}\n", "}\n",
     "fun one(n: Int) = if (n > 1) 1 else 2\nfun again(n: Int): Int {\n  when (n) {\n    1 -> for (x in n) again(x)\n    else -> { }\n  }\n  return 0\n}\n",
     (("one", "tail", 1, 1, 1, 1, 0, False), ("again", "tail", 2, 8, 3, 2, 1, True))),
    ("JavaScript", "js", "const brace = /[/{]+\\/(?:x)/g; // function fake() {\nconst text = `a ${brace ? `}` : '{'} function fake() {`;\n", "const nest = async function* named(c, {d, e}) {\n", "if (c == '{') {\n", "c.map(x => x.y);\n", "}\n", "};\n",
     "const one = (n) => n ? 1 : 0\nfunction again(n) { for (const x of n) while (x) again(x); }\nclass A extends B { static async #run() { try { go(); } finally { if (a || b) {} } } }\n",
     (("", "mid", 1, 1, 0, 0, 0, False), ("one", "tail", 1, 1, 0, 0, 0, False), ("again", "tail", 2, 2, 3, 2, 2, True), ("#run", "tail", 3, 3, 4, 2, 0, False))),
    ("TypeScript", "ts", "type F = { a: (x: number) => string };\nconst t: F[] = [], r = a / b / c;\n", "export const nest = async (c: Array<string>): Promise<Map<string, F>> => {\n", "if (c == '{') {\n", "c.map((x: number): number => x + 1);\n", "}\n", "};\n",
     "export function again<T extends F>(n: T): { a: number } { for (const x of n) for (const y in x) again(y); }\nclass A<T> { private one = (n: number) => n && 1; get(): void { if (a) b(); else if (c) d(); } }\n",
     (("", "mid", 1, 1, 0, 0, 0, False), ("again", "tail", 1, 1, 3, 2, 2, True), ("one", "tail", 2, 2, 1, 0, 0, False), ("get", "tail", 2, 2, 2, 1, 0, False))),
)
#: Names of the nested function where the text gives it another.
_NEST = {"JavaScript": "named"}
#: Python nests by indent: its steps are made one by one.
_PY = ("Python", "py", "text = '''\ndef fake():\n    if a: pass\n'''\n", "@deco\nasync def nest(c, *d: int) -> list[int]:\n", (("again", "tail", 2, 6, 6, 3, 2, True),))
_PY_TAIL = "class A:\n    def again(self, n):\n        for x in n:\n            while x:\n                if x: self.again(x)\n        return 0\n"
LANGUAGES = tuple(s[0] for s in SOURCES) + ("Python",)
_N = "c_custkey % 8"


def _pick(values, number: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), number.cast("int"))


def _dealt(files: DataFrame) -> DataFrame:
    """Files over all cores: the tables that they are made of are one file each."""
    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism), "path")


def sources(spark, sf_dir) -> DataFrame:
    """(c_custkey, path, language, content): a file for each customer, its function nested c_custkey % 8 deep."""
    k = F.col("c_custkey")
    no, n = (k / 8).cast("int") % len(LANGUAGES), (k % 8).cast("int")
    part = lambda i: _pick([s[i] for s in SOURCES] + [""], no)
    braced = F.concat(part(2), part(3), F.repeat(part(4), n), part(5), F.repeat(part(6), n), part(7), part(8))
    steps = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.when(i <= n, F.concat(F.repeat(F.lit("    "), i), F.lit("if c:\n"))).otherwise("")), "")
    python = F.concat(F.lit(_PY[2] + _PY[3]), steps, F.repeat(F.lit("    "), n + 1), F.lit("run(c)\n"), F.lit(_PY_TAIL))
    return _dealt(table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("src/s"), k, F.lit("."), _pick([s[1] for s in SOURCES] + ["py"], no)).alias("path"), _pick(LANGUAGES, no).alias("language"), F.when(no == len(SOURCES), python).otherwise(braced).alias("content")))


def _planted() -> str:
    """Functions by language: line where each begins and ends, with n for the depth of nesting."""
    rows = []
    for i, s in enumerate(SOURCES):
        head, tail = s[2].count("\n"), f"{s[2].count(chr(10))} + 3 + 2 * n"
        rows.append((i, _NEST.get(s[0], "nest"), f"{head} + 1", f"{head} + 3 + 2 * n", "n * (n + 1) // 2", "n", 0, False))
        for name, part, a, b, score, depth, loops, again in s[9]:
            base = tail if part == "tail" else f"{head} + 1 + n"
            rows.append((i, name, f"{base} + {a}", f"{base} + {b}", str(score), str(depth), loops, again))
    i, head = len(SOURCES), _PY[2].count("\n")
    rows.append((i, "nest", f"{head} + 2", f"{head} + 3 + n", "n * (n + 1) // 2", "n", 0, False))
    for name, _, a, b, score, depth, loops, again in _PY[4]:
        rows.append((i, name, f"{head} + 3 + n + {a}", f"{head} + 3 + n + {b}", str(score), str(depth), loops, again))
    each = " UNION ALL ".join(f"SELECT c_custkey, path, {_lit(name)} AS name, CAST({a} AS INT) AS first, CAST({b} AS INT) AS last, CAST({s} AS INT) AS score, CAST({d} AS INT) AS depth, {lo} AS loops, {_lit(r)} AS recursive FROM made WHERE no = {i}" for i, name, a, b, s, d, lo, r in rows)
    ends = " ".join(f"WHEN {i} THEN '{s[1]}'" for i, s in enumerate(SOURCES))
    made = f"made AS (SELECT c_custkey, no, n, concat('src/s', c_custkey, '.', CASE no {ends} ELSE 'py' END) AS path FROM (SELECT c_custkey, c_custkey // 8 % {len(LANGUAGES)} AS no, {_N} AS n FROM customer))"
    return f"{made}, planted AS ({each})"


_PLANTED = _planted()


@_register("SELECT path, name, first, last, last - first + 1 AS lines, score, depth, loops, recursive FROM planted", also=_PLANTED)
def syntax_functions(spark, sf_dir):
    return spans.functions(sources(spark, sf_dir)).drop("language")


def _production(files: DataFrame) -> DataFrame:
    return files.select("path", paths.role(F.col("path")).alias("role"))


@_register("SELECT 'code-quality.long-function' AS rule_id, path, 'MEDIUM' AS severity, first AS line_start FROM planted WHERE last - first + 1 > 11", also=_PLANTED)
def syntax_long_functions(spark, sf_dir):
    f = sources(spark, sf_dir)
    return functionrules.long_functions(spans.functions(f), _production(f), most=11)


@_register("SELECT 'code-quality.complex-function' AS rule_id, path, 'MEDIUM' AS severity, first AS line_start FROM planted WHERE score > 15", also=_PLANTED)
def syntax_complex_functions(spark, sf_dir):
    f = sources(spark, sf_dir)
    return functionrules.complex_functions(spans.functions(f), _production(f))


@_register("SELECT 'code-quality.deep-control-flow' AS rule_id, path, 'LOW' AS severity, first + 5 AS line_start FROM planted WHERE name IN ('nest', 'named') AND depth > 4", also=_PLANTED)
def syntax_deep_structures(spark, sf_dir):
    """The fifth `if` of the nested function, and it alone."""
    f = sources(spark, sf_dir)
    return functionrules.deep_control_flow(syntax.nodes(f, ("control",)), _production(f))


@_register("SELECT c_custkey, CAST(score AS BIGINT) AS inside FROM planted WHERE name IN ('nest', 'named') AND depth > 0", also=_PLANTED)
def nested_structures(spark, sf_dir):
    """Pairs of a control structure of the nested function and one it stands in, itself included, by intervals."""
    f = sources(spark, sf_dir)
    n = syntax.nodes(f, ("control",)).filter(syntaxtree.owner()["name"].isin("nest", "named")).select("path", "pre", "upto")
    outer = n.select("path", F.col("pre").alias("a"), F.col("upto").alias("b"))
    pairs = n.join(outer, "path").filter("pre BETWEEN a AND b")
    return pairs.groupBy("path").agg(F.count(F.lit(1)).alias("inside")).select(F.regexp_extract("path", r"s(\d+)\.", 1).cast("long").alias("c_custkey"), "inside")


# ---- rules on trees -------------------------------------------------------------------------

#: Statements of two lines by language, with the rule they break, the line (0 or 1), and what it weighs
#: in production code, in tests, in scripts and in domain code (null: nothing).
_P = "language.rust.panic-risk"
_G = "language.go.panic-exit-risk"
_J = "language.javascript.runtime-exit-risk"
_M = "language.managed.fatal-exception-risk"
_E = "language.python.exception-risk"
STATEMENTS = {
    "Rust": ("fn run() {\n", "}\n", (
        ("let a = b\n  .unwrap();\n", _P, 1, "MEDIUM", None, "MEDIUM", "MEDIUM"), ("// x.unwrap()\nlet s = \"y.unwrap() panic!()\";\n", None, 0, None, None, None, None), ("todo!(\"later\");\nlet a = 1;\n", _P, 0, "HIGH", "LOW", "HIGH", "HIGH"),
        ("#[cfg(test)]\nmod tests { fn t() { x.unwrap(); panic!(); } }\n", None, 0, None, None, None, None), ("panic!(\n);\n", _P, 0, "MEDIUM", "LOW", "MEDIUM", "HIGH"), ("Regex::new(r\"a+\")\n.unwrap();\n", None, 0, None, None, None, None),
        ("let n = serde_json::from_str(t)\n.expect(\"n\");\n", _P, 1, "HIGH", None, "HIGH", "HIGH"), ("let a = m.lock().unwrap_or(1);\nlet q = a.unwrap_or_default();\n", None, 0, None, None, None, None))),
    "Go": ("func run() {\n", "}\n", (
        ("panic(\n  \"x\")\n", _G, 0, "MEDIUM", None, "MEDIUM", "HIGH"), ("s := \"panic(1)\" // os.Exit(1)\nlog.Println(s)\n", None, 0, None, None, None, None), ("if a {\nos.Exit(1) }\n", _G, 1, "MEDIUM", None, "LOW", "HIGH"), ("log.Fatalf(\"%d\",\n 1)\n", _G, 0, "MEDIUM", None, "LOW", "HIGH"), ("my.panic(1)\n_ = `log.Fatal(`\n", None, 0, None, None, None, None))),
    "Python": ("def run():\n", "", (
        ("    try: go()\n    except: pass\n", _E, 1, "MEDIUM", "LOW", "MEDIUM", "MEDIUM"), ("    s = 'except:'  # raise NotImplementedError\n    go(s)\n", None, 0, None, None, None, None), ("    assert go(\n        1)\n", _E, 0, "LOW", "LOW", "LOW", "LOW"), ("    try: go()\n    except ValueError: pass\n", None, 0, None, None, None, None), ("    if a:\n        raise NotImplementedError('x')\n", _E, 1, "LOW", "LOW", "LOW", "LOW"))),
    "TypeScript": ("function run() {\n", "}\n", (
        ("process\n  .exit(1);\n", _J, 1, "HIGH", None, "LOW", "HIGH"), ("const s = `process.exit(1)`;\n// process.exit(2)\n", None, 0, None, None, None, None), ("list.map(x =>\n process.exit(x));\n", _J, 1, "HIGH", None, "LOW", "HIGH"), ("my.process.exit(1);\nconst r = /process.exit(1)/;\n", None, 0, None, None, None, None))),
    "Java": ("class A { void run() {\n", "} }\n", (
        ("throw new RuntimeException(\n\"x\");\n", _M, 0, "MEDIUM", "LOW", "MEDIUM", "HIGH"), ("String s = \"throw new RuntimeException(1)\";\n// TODO(\n", None, 0, None, None, None, None), ("if (a)\nthrow new IllegalStateException();\n", _M, 1, "MEDIUM", "LOW", "MEDIUM", "HIGH"), ("throw new\nIOException();\n", None, 0, None, None, None, None), ("throw new NotImplementedException();\nint z;\n", _M, 0, "HIGH", "LOW", "HIGH", "HIGH"))),
    "Kotlin": ("fun run() {\n", "}\n", (
        ("TODO(\n\"x\")\n", _M, 0, "HIGH", "LOW", "HIGH", "HIGH"), ("val s = \"TODO()\"\n/* TODO() */\n", None, 0, None, None, None, None), ("if (a)\nthrow RuntimeException(\"a\")\n", _M, 1, "MEDIUM", "LOW", "MEDIUM", "HIGH"), ("throw MyException()\nval a = 1\n", None, 0, None, None, None, None))),
    "C#": ("class A { void run() {\n", "} }\n", (
        ("throw new Exception(\n\"x\");\n", _M, 0, "MEDIUM", "LOW", "MEDIUM", "HIGH"), ("var s = $\"{a} throw new Exception()\";\n// throw new Exception();\n", None, 0, None, None, None, None), ("if (a) {\nthrow new NotImplementedException(); }\n", _M, 1, "HIGH", "LOW", "HIGH", "HIGH"), ("throw new ArgumentException();\nint z;\n", None, 0, None, None, None, None))),
}
_FOLDERS = ("src/area", "tests/area", "scripts/area", "src/domain")
_ENDING = {"Rust": "rs", "Go": "go", "Python": "py", "TypeScript": "ts", "Java": "java", "Kotlin": "kt", "C#": "cs"}
_RISKY = tuple(STATEMENTS)
_SLOTS = 3


def _slot(i: int, n: int) -> str:
    return f"(c_custkey // {7 * len(_FOLDERS)} * {2 * i + 1} + c_custkey * {i}) % {n}"


def risky(spark, sf_dir) -> DataFrame:
    """(path, language, content): three statements a customer, in a folder that tells their role."""
    k = F.col("c_custkey")
    no, folder = (k % len(_RISKY)).cast("int"), (k / len(_RISKY)).cast("int") % len(_FOLDERS)
    body = F.lit("")
    for i in reversed(range(len(_RISKY))):
        head, tail, statements = STATEMENTS[_RISKY[i]]
        slots = [_pick([s[0] for s in statements], F.expr(_slot(j, len(statements)).replace("//", "div"))) for j in range(_SLOTS)]
        body = F.when(no == i, F.concat(F.lit(head), *slots, F.lit(tail))).otherwise(body)
    path = F.concat(_pick(_FOLDERS, folder), F.lit("/r"), k, F.lit("."), _pick([_ENDING[x] for x in _RISKY], no))
    return _dealt(table(spark, sf_dir, "customer").select(path.alias("path"), _pick(_RISKY, no).alias("language"), body.alias("content")))


def _risks() -> str:
    rows, lines = [], []
    for i, lang in enumerate(_RISKY):
        statements = STATEMENTS[lang][2]
        for j, (_, rule, at, *weights) in enumerate(statements):
            rows += [f"({i}, {j}, {w}, {_lit(rule)}, {at}, {_lit(x)})" for w, x in enumerate(weights) if rule and x]
        lines += [f"SELECT c_custkey, {i} AS lang, {s} AS slot, {_slot(s, len(statements))} AS stmt FROM customer WHERE c_custkey % {len(_RISKY)} = {i}" for s in range(_SLOTS)]
    folders = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FOLDERS))
    ends = " ".join(f"WHEN {i} THEN '{_ENDING[x]}'" for i, x in enumerate(_RISKY))
    return f"""breaks(lang, stmt, folder, rule_id, below, severity) AS (VALUES {", ".join(rows)}), slots AS ({" UNION ALL ".join(lines)}),
risks AS (SELECT rule_id, concat(CASE b.folder {folders} END, '/r', c_custkey, '.', CASE s.lang {ends} END) AS path, severity, CAST(2 + 2 * slot + below AS INT) AS line_start
          FROM slots s JOIN breaks b ON s.lang = b.lang AND s.stmt = b.stmt AND b.folder = c_custkey // {len(_RISKY)} % {len(_FOLDERS)})"""


@_register("SELECT rule_id, path, severity, line_start FROM risks", also=_risks())
def tree_risk_findings(spark, sf_dir):
    return treerules.language_risks(syntax.nodes(risky(spark, sf_dir), treerules.KINDS, treerules.AROUND))


#: Files of frameworks: ending, folder, text, and (rule, severity, line, whether it holds below mobile roots only).
FRAMEWORK_FILES = (
    ("tsx", "app", "import { AsyncStorage, View } from 'react-native';\nconst s = \"var x; console.log(1)\"; // var y\nclass P extends React.Component {\n  render() {\n    this.state.items = [];\n    return <View style={{ a: 1 }} />;\n  }\n}\nvar a = 1;\nvar b = 2;\n",
     (("framework.react-native.async-storage-from-core", "HIGH", 1, True), ("framework.react.class-component", "LOW", 3, False), ("framework.react-native.direct-state-mutation", "HIGH", 5, True), ("framework.react-native.inline-style", "MEDIUM", 6, True), ("framework.js.var-declaration", "LOW", 9, False))),
    ("js", "app", "import PropTypes from 'prop-types';\nimport {\n  createStackNavigator,\n} from 'react-navigation';\nrun(() => {\n  console.log(this.state.a === 1);\n  console.log(2);\n});\n",
     (("framework.react.prop-types", "LOW", 1, False), ("framework.react-native.old-react-navigation", "MEDIUM", 2, True), ("framework.js.console-log", "LOW", 6, False))),
    ("js", "__tests__", "console.log(1);\nvar a = 'import x from \"prop-types\"';\n", ()),
    ("py", "shop/settings", "DEBUG = True\nX = 'DEBUG = True'\nALLOWED_HOSTS = []\ndef f():\n    DEBUG = True\n", (("framework.django.debug-true", "HIGH", 1, False), ("framework.django.missing-allowed-hosts", "HIGH", 3, False))),
    ("py", "shop", "DEBUG = True\ndef f(n):\n    cursor.execute(\n        'select %s' % n)\n    db.execute('select %s', n)\n    M.objects.raw(f'select {n}')\n    db.execute('select {}'.format(n))\n    db.execute(f'select 1')\n",
     (("framework.django.raw-sql-query", "MEDIUM", 4, False), ("framework.django.raw-sql-query", "MEDIUM", 6, False), ("framework.django.raw-sql-query", "MEDIUM", 7, False))),
)
_FW_ROWS = ", ".join(f"({i}, {_lit(f[0])}, {_lit(f[1])}, {_lit(r)}, {_lit(s)}, {at}, {_lit(m)})" for i, f in enumerate(FRAMEWORK_FILES) for r, s, at, m in f[3])
_FW_PATH = "concat('p', s_suppkey % 3, '/', folder, '/f', s_suppkey, '.', ext)"


@_register(f"SELECT rule_id, {_FW_PATH} AS path, severity, line_start FROM supplier JOIN framework ON s_suppkey % {len(FRAMEWORK_FILES)} = no WHERE NOT mobile OR s_suppkey % 3 = 1", also=f"framework(no, ext, folder, rule_id, severity, line_start, mobile) AS (VALUES {_FW_ROWS})")
def framework_tree_findings(spark, sf_dir):
    """One of three projects is a mobile one."""
    k = F.col("s_suppkey")
    no = k % len(FRAMEWORK_FILES)
    path = F.concat(F.lit("p"), k % 3, F.lit("/"), _pick([f[1] for f in FRAMEWORK_FILES], no), F.lit("/f"), k, F.lit("."), _pick([f[0] for f in FRAMEWORK_FILES], no))
    f = table(spark, sf_dir, "supplier").select(path.alias("path"), _pick([f[2] for f in FRAMEWORK_FILES], no).alias("content")).withColumn("language", paths.language(F.col("path")))
    return treerules.framework_rules(syntax.nodes(f, treerules.KINDS, treerules.AROUND), spark.createDataFrame([("p1",)], "root string"))


# ---- untrusted input ------------------------------------------------------------------------

#: Chains by language: ending, head with the source, a step, the sink over two lines, and what stands before it by case.
#: {n} is the last step's number, {p} the one before it.
_CHAINS = (
    ("py", "Python", "def view(request):\n    v0 = request.args['q']\n", "    v{n} = 'x' + v{p}\n", "    db.execute(\n        f'select {{{use}}}'{more})\n", {
        "plain": "", "coerced": "    v{n} = int(v{n})\n", "cleared": "    v{n} = 'fixed'\n", "field": "    u.a = v{n}\n", "other": "    u.a = v{n}\n", "whole": "    u = v{n}\n    u.b = 'x'\n", "added": "    w = 'x'\n    w += v{n}\n", "bound": ""}),
    ("ts", "TypeScript", "const run = async (req) => {\n  const v0 = req.query.q;\n", "  const v{n} = `x ${{v{p}}}`;\n", "  await db.query(\n    'select ' + {use}{more});\n", {
        "plain": "", "coerced": "  v{n} = Number(v{n});\n", "cleared": "  v{n} = 'fixed';\n", "field": "  u.a = v{n};\n", "other": "  u.a = v{n};\n", "whole": "  let u = v{n};\n  u.b = 'x';\n", "added": "  let w = 'x';\n  w += v{n};\n", "bound": ""}),
    ("go", "Go", "func run(w http.ResponseWriter, r *http.Request) {\n\tv0, err := r.FormValue(\"q\"), 1\n", "\tv{n} := strings.TrimSpace(v{p})\n", "\tdb.Query(\n\t\t\"select \" + {use}{more})\n", {
        "plain": "", "coerced": "\tv{n}, err = strconv.Atoi(v{n})\n", "cleared": "\tv{n} = \"fixed\"\n", "field": "\tu.a = v{n}\n", "other": "\tu.a = v{n}\n", "whole": "\tu := v{n}\n\tu.b = \"x\"\n", "added": "\tw := \"x\"\n\tw += v{n}\n", "bound": ""}),
)
#: Cases: what the sink is given, and whether that is tainted.
_CASES = (("plain", "v{n}", True), ("coerced", "v{n}", False), ("cleared", "v{n}", False), ("field", "u.a", True), ("other", "u.b", False), ("whole", "u.c", True), ("added", "w", True), ("bound", "k", False))


def chains(spark, sf_dir) -> DataFrame:
    """(path, language, content): a chain of up to 12 assignments for each customer; every ninth is a test."""
    k = F.col("c_custkey")
    made = F.lit(None).cast("string")
    n = (k / 24 % 13).cast("int")
    for i, (_, _, head, step, sink, before) in enumerate(_CHAINS):
        for j, (case, use, _) in enumerate(_CASES):
            fill = lambda t, x, p: F.replace(F.replace(F.lit(t), F.lit("{n}"), x.cast("string")), F.lit("{p}"), p.cast("string"))
            steps = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda s: F.when(s <= n, fill(step.replace("{{", "{").replace("}}", "}"), s, s - 1)).otherwise("")), "")
            last = sink.replace("{use}", "\x00").replace("{more}", ", v{n}" if case == "bound" else "").replace("{{", "{").replace("}}", "}").replace("\x00", use)
            made = F.when((k % 3 == i) & ((k / 3).cast("int") % 8 == j), F.concat(F.lit(head), steps, fill(before[case], n, n), fill(last, n, n), F.lit("" if i == 0 else "}\n"))).otherwise(made)
    folder = F.when(k % 9 == 4, "tests/c").otherwise("src/c")
    files = table(spark, sf_dir, "customer").select(F.concat(folder, k, F.lit("."), _pick([c[0] for c in _CHAINS], k % 3)).alias("path"), _pick([c[1] for c in _CHAINS], k % 3).alias("language"), made.alias("content"))
    return _dealt(files)


_TAINTED = ", ".join(str(j) for j, c in enumerate(_CASES) if c[2])
_TWO_LINES = ", ".join(str(j) for j, c in enumerate(_CASES) if c[0] in ("whole", "added"))
_ONE_LINE = ", ".join(str(j) for j, c in enumerate(_CASES) if c[0] in ("coerced", "cleared", "field", "other"))
_CHAINED = f"chained AS (SELECT concat('src/c', c_custkey, '.', CASE c_custkey % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'ts' ELSE 'go' END) AS path, CASE c_custkey % 3 WHEN 0 THEN 'view' ELSE 'run' END AS function, 'taint-sql' AS kind, 3 + c_custkey // 24 % 13 + CASE WHEN j IN ({_TWO_LINES}) THEN 2 WHEN j IN ({_ONE_LINE}) THEN 1 ELSE 0 END AS line, c_custkey, j FROM (SELECT c_custkey, c_custkey // 3 % 8 AS j FROM customer) WHERE c_custkey % 9 <> 4 AND j IN ({_TAINTED}))"


@_register("SELECT path, function, kind, CAST(line AS INT) AS line, 'http-request' AS source FROM chained", also=_CHAINED)
def taint_chains(spark, sf_dir):
    return taint.taint(chains(spark, sf_dir))


@_register("SELECT path, function, kind, CAST(line AS INT) AS line, 'http-request' AS source FROM chained WHERE c_custkey % 2 = 0", also=_CHAINED)
def taint_in_changed_lines(spark, sf_dir):
    """Only even customers' files changed."""
    f = chains(spark, sf_dir)
    ranges = f.filter(F.regexp_extract("path", r"c(\d+)\.", 1).cast("long") % 2 == 0).select("path", F.lit(1).alias("start"), F.lit(100).alias("stop"))
    return taint.taint(f, ranges)

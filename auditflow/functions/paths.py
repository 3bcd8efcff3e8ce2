"""Path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Path components that mark low-signal code, and other component lists.
LOW_SIGNAL = ("test", "tests", "__tests__", "spec", "specs", "fixture", "fixtures", "mock", "mocks", "__mocks__", "bench", "benches", "example", "examples", "generated", "__generated__", "gen", "codegen")
FIXTURES = ("__fixtures__", "__mocks__", "__snapshots__", "fixture", "fixtures", "mock", "mocks", "snapshot", "snapshots")
DOCUMENTS = ("doc", "docs")
TEST_DIRECTORIES = ("tests", "test", "androidtest", "fixtures", "__tests__")
GENERATED = ("generated", "__generated__", "gen", "codegen", "target", "build")
CONFIG_NAMES = ("package.json", "tsconfig.json", "vite.config.ts", "vite.config.js", "next.config.js", "next.config.mjs", "cargo.toml", "cargo.lock", "projectsettings.asset", "dockerfile", "containerfile", "go.mod", "go.sum", "pyproject.toml", "requirements.txt", "build.gradle", "settings.gradle", "pom.xml")
ENTRYPOINTS = ("main.rs", "build.rs", "main.go", "main.py", "app.py", "program.cs", "main.java", "main.kt", "index.ts", "index.js", "index.tsx", "index.jsx", "main.ts", "main.js", "main.tsx", "main.jsx")
PUBLIC_API = ("index.ts", "index.js", "index.tsx", "index.jsx", "mod.rs", "lib.rs")


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The directory of a path, '' at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """The part after the last dot of the base name, null without one."""
    found = F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(found != "", found)


def has_component(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def clean(path: Column) -> Column:
    """Forward slashes, none doubled, no leading './'; '.' for nothing."""
    x = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    x = F.regexp_replace(x, r"^(\./)+", "")
    return F.when(x == "", ".").otherwise(x)


def relative(path: Column, root: str) -> Column:
    """clean(path) below root where it stands there."""
    p = clean(path)
    top = root.replace("\\", "/").rstrip("/")
    while top.startswith("./"):
        top = top[2:]
    if top in ("", "."):
        return p
    return F.when(p == top, ".").when(F.startswith(p, F.lit(top + "/")), clean(F.substring(p, len(top) + 2, 1 << 30))).otherwise(p)


def normalised(path: Column) -> Column:
    """The path with '.' and '..' resolved lexically."""

    def step(done, p):
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(p == ".", done).when(p == "..", F.when(F.size(done) > 0, up).otherwise(done)).otherwise(F.concat(done, F.array(p)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def depth_below(path: Column, root: str) -> Column:
    """Number of directories between root and the file."""
    return (F.size(parts(relative(path, root))) - 1).cast("int")


def cluster_scope(path: Column) -> Column:
    """The first one or two components: the area of the repository that a finding is in."""
    p = parts(path)
    first, second = F.get(p, 0), F.get(p, 1)
    return F.when(F.size(p) == 0, ".").when(second.isNull() | F.contains(second, F.lit(".")), first).otherwise(F.concat_ws("/", first, second))


def test_like_name(path: Column) -> Column:
    name = base_name(path)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    general = stem.isin("test", "tests") | stem.rlike(r"(_test|\.test|\.spec)$") | F.startswith(name, F.lit("test_")) | name.rlike(r"\.(test|spec)\.")
    return F.when(F.endswith(name, F.lit(".rs")), (name == "tests.rs") | F.endswith(name, F.lit("_tests.rs"))).otherwise(general)


def low_signal(path: Column) -> Column:
    """Tests, fixtures, mocks, benchmarks, examples and generated code, by path."""
    return has_component(path, LOW_SIGNAL) | test_like_name(path)


def public_api(path: Column) -> Column:
    return F.lower(base_name(path)).isin(*PUBLIC_API)


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens, split at separators and camel case humps."""
    humps = F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.array_distinct(F.filter(F.split(F.lower(humps), r"[^a-z0-9]+"), lambda t: t != ""))


def ordered(path: Column) -> Column:
    """A key that orders paths by component."""
    return F.split(path, "/")


def config_file(path: Column) -> Column:
    name = F.lower(base_name(path))
    return name.isin(*CONFIG_NAMES) | name.rlike(r"^appsettings.*\.json$")


def generated_file(path: Column, content: Column | None = None) -> Column:
    by_path = has_component(F.lower(path), GENERATED)
    if content is None:
        return by_path
    bundle = content.rlike(r"Emscripten Module|EMSCRIPTEN_") | content.rlike(r"^\s*/\* eslint-disable \*/\s*(\n|$)")
    return by_path | content.rlike(r"@generated|code generated|Code generated|Code Generated|generated by|Generated by|Generated By") | bundle


def test_file(path: Column) -> Column:
    """Tests by directory or name; naming habits go by the language's ending."""
    low = F.lower(path)
    name = base_name(low)
    folder = F.arrays_overlap(F.slice(F.split(low, "/"), F.lit(1), F.size(F.split(low, "/")) - 1), F.array(*map(F.lit, TEST_DIRECTORIES)))
    general = F.startswith(name, F.lit("tests_")) | name.rlike(r"^tests?\.[^.]*$")
    habit = name.rlike(r"_tests\.rs$|\.(test|spec)\.[cm]?[jt]sx?$|_test\.go$|_test\.py$|tests?\.(java|kt|cs)$") | name.rlike(r"^test_.*\.py$")
    return folder | general | habit


def role(path: Column, content: Column | None = None) -> Column:
    """config, generated, fixture, documentation, test or production: the first that applies."""
    low = F.lower(path)
    return F.when(config_file(path), "config").when(generated_file(path, content), "generated").when(has_component(low, FIXTURES), "fixture").when(has_component(low, DOCUMENTS), "documentation").when(test_file(path), "test").otherwise("production")


def risk_roles(path: Column, content: Column | None = None) -> Column:
    """The roles that weigh in a risk score, as an array."""
    kind, low = role(path, content), F.lower(path)
    return F.array_compact(F.array(
        F.when(kind == "production", F.lit("production")), F.when(test_file(path), F.lit("test")), F.when(generated_file(path, content), F.lit("generated")), F.when(config_file(path), F.lit("config")),
        F.when(low_signal(path), F.lit("low-signal-path")), F.when(base_name(low).isin(*ENTRYPOINTS), F.lit("entrypoint")), F.when(low.rlike(r"controller|(^|/)controllers?/"), F.lit("controller")),
        F.when(low.rlike(r"(^|/)services?/|service\.[a-z]+$"), F.lit("service")), F.when(has_component(low, ("domain",)), F.lit("domain")), F.when(low.rlike(r"\.(jsx|tsx)$"), F.lit("react-component")),
    ))


#: Kinds of modules, in the order in which their patterns are tried.
MODULE_KINDS = ("ui", "infrastructure", "domain", "cli", "shared", "feature")


def module_kind(path: Column, patterns: dict[str, list[str]]) -> Column:
    """The first kind one of whose patterns (regular expressions) matches; unknown for none."""
    out = F.lit("unknown")
    for kind in reversed(MODULE_KINDS):
        for p in patterns.get(kind, ()):
            out = F.when(path.rlike(p), kind).otherwise(out)
    return out


#: Languages by the ending of a name, and by whole name.
LANGUAGES = {"rs": "Rust", "py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "go": "Go", "java": "Java", "kt": "Kotlin", "cs": "C#", "c": "C", "h": "C Header", "cpp": "C++", "cc": "C++", "swift": "Swift", "scala": "Scala", "rb": "Ruby", "php": "PHP", "dart": "Dart", "sh": "Shell", "html": "HTML", "css": "CSS", "scss": "SCSS", "json": "JSON", "toml": "TOML", "yaml": "YAML", "yml": "YAML", "md": "Markdown", "tf": "Terraform", "sql": "SQL", "nix": "Nix"}
NAMES = {"dockerfile": "Dockerfile", "makefile": "Makefile"}


def language(path: Column) -> Column:
    """The language of a file by its name, null for none known."""
    name = F.lower(base_name(path))
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    return F.coalesce(F.element_at(names, name), F.element_at(table, F.regexp_extract(name, r"^.+\.([^.]*)$", 1)))

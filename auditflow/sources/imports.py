"""Imports of source files and the files that they mean."""

from __future__ import annotations

import ast
import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.paths import parent
from ..plans.storage import dealt, materialize, shuffled
from .syntax import nodes_of

_FROM = re.compile(r"""(?:^|from\s*)['"]([^'"]+)['"]$""")
_RUST_TESTS = re.compile(r"cfg\(test\)|#\[test\]")
_RUST_FILE = re.compile(r'#\[path\s*=\s*"([^"]*)"\]')


def _python(text: str) -> list[tuple[str, bool, bool, int]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def visit(node, deferred, guarded):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Import):
                out.extend((a.name, deferred, guarded, child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                stem = "." * child.level + (child.module or "")
                out.extend((stem if child.module else stem + a.name, deferred, guarded, child.lineno) for a in child.names)
            inside = deferred or isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda))
            optional = guarded or isinstance(child, ast.Try) and any(h.type is None or "Error" in ast.dump(h.type) or "Exception" in ast.dump(h.type) for h in child.handlers)
            visit(child, inside, optional)

    visit(tree, False, False)
    return out


def _rust(text: str) -> dict[str, int]:
    """Paths used, modules declared and files named or included, but for tests."""
    rows = nodes_of(text, "Rust")
    gated = lambda r: any(_RUST_TESTS.search(re.sub(r"\s", "", m)) for m in (r[5], *(rows[i][5] for i in r[9])))
    out = []
    for r in rows:
        if r[2] == "use" and r[4].split("::")[0] in ("crate", "self", "super") and not gated(r):
            out.append((r[4].split(" as ")[0], r[6]))
        elif r[2] == "mod" and not gated(r):
            file = _RUST_FILE.search(r[5])
            out.append((f"file {file[1]}" if file else f"mod {r[4]}", r[6]))
        elif r[2] == "macro" and r[4] == "include" and not gated(r):
            out.append((f"file {r[3]}", r[6]))
    return dict(reversed(out))


def _script(text: str, language: str) -> list[tuple[str, bool, bool, int]]:
    """What is imported, exported again, required or loaded later."""
    rows, out = nodes_of(text, language), []
    for r in rows:
        if r[2] in ("import", "export") and (m := _FROM.search(r[4])):
            out.append((m[1], False, False, r[6]))
        elif r[2] == "call" and r[4] in ("require", "import") and r[8] == r[0] + 2 and rows[r[8]][2] == "string":
            out.append((rows[r[8]][4], r[4] == "import", False, r[6]))
    return out


def imports_of(text: str | None, language: str | None) -> list[tuple[str, bool, bool, int]]:
    """(specifier, deferred, guarded, line) of a file, by its syntax."""
    if not text:
        return []
    if language == "Python":
        return _python(text)
    if language == "Rust":
        return [(spec, False, False, line) for spec, line in _rust(text).items()]
    if language in ("JavaScript", "TypeScript"):
        return _script(text, language)
    rows = [r for r in nodes_of(text, language) if r[2] in ("import", "using") and r[4]]
    if language == "C#":
        rows = [r for r in rows if r[2] == "using" and re.fullmatch(r"[\w.]+", r[4]) and not r[4].startswith("var")]
    elif language in ("Java", "Kotlin"):
        rows = [r for r in rows if re.fullmatch(r"[\w.]+\*?", r[4])]
    return [(r[4], False, False, r[6]) for r in rows if r[2] == "import" or language == "C#"]


def alias_targets(spec: str, aliases: dict[str, list[str]]) -> list[str]:
    """What a specifier means under path aliases (a pattern with one * at most -> targets)."""
    out = []
    for pattern in sorted(aliases, key=lambda p: -len(p.split("*")[0])):
        head, star, tail = pattern.partition("*")
        if spec == pattern or star and spec.startswith(head) and spec.endswith(tail) and len(spec) >= len(head) + len(tail):
            out += [t.replace("*", spec[len(head) : len(spec) - len(tail)] if star else "") for t in aliases[pattern]]
    return out


def tsconfig_aliases(text: str) -> dict[str, list[str]]:
    """The aliases of a tsconfig.json, its targets below baseUrl; comments and last commas are allowed."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    try:
        options = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare)).get("compilerOptions", {})
    except (ValueError, AttributeError):
        return {}
    base = options.get("baseUrl", ".")
    return {p: [posixpath.normpath(posixpath.join(base, t)) for t in targets] for p, targets in options.get("paths", {}).items()}


def candidates(spec: str, path: str, language: str | None, module: str = "", aliases: dict[str, list[str]] | None = None) -> list[str]:
    """Paths that an import may mean, the likeliest first; none if it is external.

    A path that ends in / is a directory: the import means its files.
    """
    here = posixpath.dirname(path)
    at = lambda *p: posixpath.normpath(posixpath.join(*p))
    if language in ("JavaScript", "TypeScript"):
        bases = [at(here, spec)] if spec.startswith(".") else alias_targets(spec, aliases or {})
        ends, out = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "json"), []
        for base in bases:
            plain = re.sub(r"\.[cm]?js$", "", base)
            out += [base, *(f"{plain}.{e}" for e in ends), *(f"{base}/index.{e}" for e in ends)]
        return out
    if language == "Python":
        dots = len(spec) - len(spec.lstrip("."))
        tail = spec[dots:].replace(".", "/")
        tops = [at(here, *[".."] * (dots - 1))] if dots else ["", "src", here]
        out = []
        for top in tops:
            base = at(top, tail) if tail else at(top)
            out += [f"{base}.py", f"{base}/__init__.py", f"{posixpath.dirname(base)}.py" if "/" in tail else f"{base}.pyi"]
        return list(dict.fromkeys(x.removeprefix("./") for x in out))
    if language == "Rust":
        stem = posixpath.splitext(posixpath.basename(path))[0]
        own = here if stem in ("mod", "lib", "main") else at(here, stem)
        if spec.startswith("file "):
            return [at(here, spec[5:])]
        if spec.startswith("mod "):
            return [at(own, f"{spec[4:]}.rs"), at(own, spec[4:], "mod.rs")]
        root, *rest = spec.split("::")
        crate = path.split("/src/")[0] + "/src" if "/src/" in path else "src"
        top = {"crate": crate, "self": own, "super": posixpath.dirname(own)}[root]
        while rest[:1] == ["super"]:
            top, rest = posixpath.dirname(top), rest[1:]
        return [c for n in range(len(rest), 0, -1) for c in (at(top, *rest[:n]) + ".rs", at(top, *rest[:n], "mod.rs"))]
    if language == "Go":
        inside = module and (spec == module or spec.startswith(module + "/"))
        return [(spec[len(module) :].strip("/") or ".") + "/"] if inside else []
    if language in ("Java", "Kotlin"):
        p, parts = spec.replace(".", "/"), path.split("/")[:-1]
        above = ["/".join(parts[:i]) + "/" for i in range(len(parts), 0, -1)]  # the file's own source root is one of them
        return [f"{top}{p}.{e}" for top in dict.fromkeys((*above, "", "src/main/java/", "src/main/kotlin/", "src/")) for e in ("java", "kt")]
    return []


def _extract(module: str, aliases: dict[str, list[str]] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, text in zip(b["path"], b["language"], b["content"]):
                for spec, deferred, guarded, line in imports_of(text, language):
                    rows.append((path, spec, deferred, guarded, candidates(spec, path, language, module, aliases), line))
            yield pd.DataFrame(rows, columns=["src", "spec", "deferred", "guarded", "candidates", "line"])

    return run


def imports(files: DataFrame, module: str = "", aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(src, spec, deferred, guarded, candidates, line) of files (path, language, content).

    module is Go's module path, aliases are those of tsconfig_aliases().
    """
    return dealt(files.select("path", "language", "content"), "path").mapInPandas(_extract(module, aliases), "src string, spec string, deferred boolean, guarded boolean, candidates array<string>, line int")


def resolved(found: DataFrame, files: DataFrame) -> DataFrame:
    """imports with dst: the first candidate that is a file; null where none is."""
    found = materialize(found)  # read twice below
    each = found.select("src", "spec", F.posexplode("candidates").alias("i", "dst"))
    # of a directory (Go's package), its first source file stands for it
    go = files.filter(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go")))
    first = go.groupBy(F.concat(F.when(parent(F.col("path")) == "", ".").otherwise(parent(F.col("path"))), F.lit("/")).alias("dst")).agg(F.min("path").alias("means"))
    known = files.select(F.col("path").alias("dst"), F.col("path").alias("means")).unionByName(first)
    hit = each.join(shuffled(known), "dst").groupBy("src", "spec").agg(F.min_by("means", "i").alias("dst"))
    return found.join(shuffled(hit), ["src", "spec"], "left")


def unresolved(resolved_: DataFrame) -> DataFrame:
    """Local imports that mean no file and are not guarded."""
    return resolved_.filter("dst IS NULL AND NOT guarded AND size(candidates) > 0").select("src", "spec")


def edges(resolved_: DataFrame) -> DataFrame:
    """(src, dst, kind, deferred) once a pair; an eager import outweighs a deferred one."""
    e = resolved_.filter("dst IS NOT NULL AND dst <> src").groupBy("src", "dst").agg(F.bool_and("deferred").alias("deferred"))
    return e.select("src", "dst", F.lit("imports").alias("kind"), "deferred")

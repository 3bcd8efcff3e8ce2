"""Frameworks, runtimes and paradigms of a file, by its path, text and language.

Each is an array of names in a fixed order, unknown where nothing tells.  Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .paths import base_name, has_component

SCRIPTS = ("JavaScript", "TypeScript")
JVM = ("Java", "Kotlin", "Scala")
#: Languages of other kinds.
NATIVE, SHELL, FUNCTIONAL, DECLARATIVE, INFRASTRUCTURE = ("C", "C++", "C Header", "Swift"), ("Shell",), ("Scala",), ("HTML", "CSS", "SCSS", "JSON", "TOML", "YAML", "SQL"), ("Terraform", "Dockerfile", "Nix")
#: What a text holds that names its framework, by language.
PYTHON = (("django", "django"), ("flask", "flask"), ("fastapi", "fastapi"))
GO = (("gin", "github.com/gin-gonic/gin"), ("echo", "github.com/labstack/echo"), ("fiber", "github.com/gofiber/fiber"))


def _array(*pairs: tuple[str, Column]) -> Column:
    """The names whose condition holds."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in pairs)))


def _known(found: Column) -> Column:
    return F.when(F.size(found) == 0, F.array(F.lit("unknown"))).otherwise(found)


def frameworks(path: Column, content: Column, language: Column) -> Column:
    """Frameworks of a file; an empty array for none."""
    text, low = F.coalesce(content, F.lit("")), F.lower(F.coalesce(content, F.lit("")))
    has = lambda *parts: F.greatest(*(F.contains(text, F.lit(p)) for p in parts)) if len(parts) > 1 else F.contains(text, F.lit(parts[0]))
    lower = lambda *parts: F.greatest(*(F.contains(low, F.lit(p)) for p in parts))
    view = path.rlike(r"(?i)\.[jt]sx$")
    script, sharp, jvm = language.isin(*SCRIPTS), language == "C#", language.isin("Java", "Kotlin")
    return _array(
        ("react-native", script & has("react-native")), ("expo", script & has("from 'expo", 'from "expo', "expo-status-bar", "expo-router")),
        ("react", script & (view | has("from 'react'", 'from "react"', "React."))), ("next", script & (has("next/") | has_component(path, ("pages", "app")) & view)),
        ("vue", script & has("from 'vue'", 'from "vue"', "@vue/")), ("angular", script & has("@angular/")), ("svelte", script & has("from 'svelte", 'from "svelte')),
        ("nest", script & has("@nestjs/")), ("express", script & has("express")), ("node", script & has("express", "from 'node:", 'from "node:', "process.env", "process.exit")),
        ("unity", sharp & (lower("using unityengine", "monobehaviour") | has_component(F.lower(path), ("assets",)))), ("dotnet", sharp & (lower("using microsoft.aspnetcore", "webapplication.createbuilder", "[apicontroller]") | has_component(F.lower(path), ("controllers", "services")))),
        *((n, (language == "Python") & has(p)) for n, p in PYTHON), *((n, (language == "Go") & has(p)) for n, p in GO),
        ("spring", jvm & lower("org.springframework", "@springbootapplication")), ("android", jvm & (lower("android.", "androidx.") | has_component(F.lower(path), ("android",)))),
        ("flutter", (language == "Dart") & (has("package:flutter") | has_component(path, ("lib", "widgets")))),
    )


def react_component(path: Column, content: Column, language: Column) -> Column:
    text = F.coalesce(content, F.lit(""))
    pascal = base_name(path).rlike(r"^[A-Z][A-Za-z0-9]*\.")
    return language.isin(*SCRIPTS) & (path.rlike(r"(?i)\.[jt]sx$") | pascal & text.rlike(r"return <|</|React\.FC|React\.memo|memo\(|forwardRef\(|React\.createElement"))


def react_hook(path: Column, content: Column, language: Column) -> Column:
    uses = F.coalesce(content, F.lit("")).rlike(r"useState|useEffect|useMemo|useCallback|useReducer|function use|const use")
    return language.isin(*SCRIPTS) & base_name(path).rlike("^use[A-Z]") & uses


def runtimes(path: Column, content: Column, language: Column) -> Column:
    """Where a file runs."""
    f = frameworks(path, content, language)
    on = lambda *names: F.arrays_overlap(f, F.array(*map(F.lit, names)))
    text = F.coalesce(content, F.lit(""))
    main = base_name(path) == "main.rs"
    cluster = F.contains(text, F.lit("apiVersion:")) & text.rlike("kind: (Deployment|Service|ConfigMap)")
    mobile = on("react-native", "expo")
    return _known(_array(
        ("react-native", mobile), ("browser", ~mobile & on("react", "next", "vue", "angular", "svelte")), ("unity", on("unity")), ("dotnet", on("dotnet")), ("node", on("node") | text.rlike(r"process\.env|from ['\"]node:")),
        ("rust-cli", (language == "Rust") & main), ("rust-library", (language == "Rust") & ~main), ("python", language == "Python"), ("go", language == "Go"), ("jvm", language.isin(*JVM)), ("shell", language.isin(*SHELL)), ("native", language.isin(*NATIVE)),
        ("infrastructure", language.isin(*INFRASTRUCTURE) | cluster), ("android", on("android")),
    ))


def paradigms(path: Column, content: Column, language: Column) -> Column:
    """Ways of programming that a file shows; mixed beside them where there are several."""
    text = F.coalesce(content, F.lit(""))
    f = frameworks(path, content, language)
    component, hook, unity = react_component(path, content, language), react_hook(path, content, language), F.array_contains(f, "unity")
    rust, script, loose = language == "Rust", language.isin(*SCRIPTS), language.isin("Python", "Go")
    managed = language.isin("Java", "Kotlin", "C#")
    functional = component | hook | rust & text.rlike(r"\.(map|filter|fold|and_then|unwrap_or_else)\(") | script & text.rlike(r"function |=>|\.(map|filter|reduce)\(") | language.isin(*FUNCTIONAL)
    objects = unity | rust & text.rlike("(impl|trait|struct|enum) ") | script & F.contains(text, F.lit("class ")) | managed & text.rlike("(class|interface|record) ")
    procedural = rust & (base_name(path) == "main.rs") | loose & (text.rlike(r"(def|func) main\(") | has_component(F.lower(path), ("cmd", "scripts")))
    found = _array(("declarative-ui", component), ("functional", functional), ("reactive", hook), ("object-oriented", objects), ("data-oriented", unity), ("procedural", procedural), ("declarative", language.isin(*DECLARATIVE)))
    return _known(F.when(F.size(found) > 1, F.array_append(found, F.lit("mixed"))).otherwise(found))

"""Trees and diffs read by tasks, reports written by tasks, the store of facts."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from auditflow.sources import gitdiff, repository, treesource


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for path, text in {
        "a.py": "x", "pkg/b.py": "y", "pkg/deep/er/c.py": "z", "pkg/deep/.gitignore": "*.log\n!keep.log\n", "pkg/deep/er/d.log": "1", "pkg/deep/er/keep.log": "1", "pkg/other/e.log": "1", ".hidden/f.py": "h", "_under/g.py": "u",
        "node_modules/x.js": "n", ".gitignore": "secret/\n/top.txt\n", "secret/h.py": "s", "pkg/secret/i.py": "s", "top.txt": "t", "pkg/top.txt": "t", "skip/j.py": "k", "Ünï/k.py": "ü",
    }.items():
        os.makedirs(top / os.path.dirname(path), exist_ok=True)
        (top / path).write_text(text)
    return str(top)


@pytest.mark.parametrize("shares", (1, 3, 1000))
def test_a_tree_is_the_same_however_it_is_shared_out(spark, root, shares):
    got = treesource.tree(spark, root, ("skip",), shares)
    assert sorted(r.path for r in got.collect()) == sorted(repository.walk(root, ("skip",)))
    reader = treesource.TreeReader(root, ("skip",), shares)
    assert len(reader.partitions()) <= shares


def test_filters_on_paths_prune(spark, root):
    t = treesource.tree(spark, root)
    assert {r.path for r in t.filter("path LIKE 'pkg/deep/%' AND size > 0").collect()} == {"pkg/deep/.gitignore", "pkg/deep/er/c.py", "pkg/deep/er/keep.log"}
    assert {r.path for r in t.filter(F.col("path").isin("a.py", "pkg/b.py", "no")).collect()} == {"a.py", "pkg/b.py"}
    assert t.filter("path = 'a.py' AND path = 'pkg/b.py'").count() == 0
    reader = treesource.TreeReader(root, (), 1000)
    assert list(reader.pushFilters([treesource.StringStartsWith(("path",), "pkg/deep/")])) == []
    assert [p.folder for p in reader.partitions()] == ["", "pkg/", "pkg/deep/", "pkg/deep/er/"]


def test_no_tree(spark, tmp_path):
    assert treesource.tree(spark, str(tmp_path)).count() == 0 == treesource.tree(spark, str(tmp_path / "none")).count()


def _git(repo, *a):
    subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)


def test_a_diff_read_file_by_file(spark, tmp_path):
    repo = str(tmp_path)
    _git(repo, "init", "-q")
    for name, text in {"a.py": "1\n2\n3\n4\n5\n6\n", "gone.py": "x\n", "old name.py": "r\n" * 30, "same.py": "s\n", "ü.py": "1\n"}.items():
        (tmp_path / name).write_text(text)
    _git(repo, "add", "-A")
    _git(repo, "commit", "-qm", "one")
    (tmp_path / "a.py").write_text("0\n1\n2\nthree\n4\n6\n")
    (tmp_path / "ü.py").write_text("2\n")
    os.remove(tmp_path / "gone.py")
    os.rename(tmp_path / "old name.py", tmp_path / "new name.py")
    _git(repo, "add", "-A")
    (tmp_path / "fresh.py").write_text("n\nm\n")
    plain = gitdiff.changes(spark, gitdiff.diff_of(repo))
    for shares in (1, 100):
        d = treesource.diff(spark, repo, shares=shares)
        lines = sorted((r.path, r.side, r.line, r.text) for r in d.filter("side IS NOT NULL").collect())
        assert lines == sorted(tuple(r) for r in plain[2].collect()) and ("ü.py", "added", 1, "2") in lines
        assert {(r.path, r.status) for r in d.filter("side IS NULL").collect()} == {("a.py", "modified"), ("gone.py", "deleted"), ("new name.py", "renamed"), ("fresh.py", "added"), ("ü.py", "modified")}
    files, ranges, _ = gitdiff.changes_of(spark, repo)
    assert files.count() == 5 and {tuple(r) for r in ranges.filter("path = 'a.py'").collect()} == {("a.py", 1, 1), ("a.py", 4, 4)}
    assert {r.path for r in treesource.diff(spark, repo).filter("path = 'a.py'").collect()} == {"a.py"}
    _git(repo, "commit", "-qam", "two")
    assert treesource.diff(spark, repo, "HEAD~1", "HEAD").filter("side IS NULL").count() == 4
    with pytest.raises(Exception, match="git"):
        treesource.diff(spark, repo, "nowhere").count()


def _findings(spark, n):
    k = F.col("id")
    sev = F.element_at(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))), (k % 5 + 1).cast("int"))
    return spark.range(n).repartition(5).select(
        F.concat(F.lit("rule"), k % 7).alias("rule_id"), F.concat(F.lit("src/f"), k % 40, F.lit(".py")).alias("path"), (k + 1).cast("int").alias("line_start"), sev.alias("severity"), F.lit("HIGH").alias("confidence"),
        F.lit("SECURITY").alias("category"), F.concat(F.lit("A | <b>\n"), k).alias("title"), F.lit("d").alias("description"), F.lit("x = 1").alias("snippet"), (k % 100).cast("int").alias("score"), F.lit("P1").alias("priority"),
    )


def test_a_saved_report_is_the_rendered_one_in_full(spark, tmp_path):
    from auditflow.sinks import document, reports

    f = _findings(spark, 700).cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for fmt in reports.FORMATS:
        where = str(tmp_path / fmt)
        manifest = document.save(f, where, fmt)
        text = "".join(document.pieces(where))
        assert manifest["rows"] == sum(p["rows"] for p in manifest["fragments"]) == 700 and len(manifest["fragments"]) > 1
        want = reports.render(f, fmt, limit=10_000)
        if fmt == "json":
            assert json.loads(text)["findings"] == json.loads(want)["findings"]
        elif fmt == "sarif":
            got, want = json.loads(text)["runs"][0], json.loads(want)["runs"][0]
            assert got["results"] == want["results"] and [r["id"] for r in got["tool"]["driver"]["rules"]] == [r["id"] for r in want["tool"]["driver"]["rules"]]
        else:
            assert text.split() == want.split()
        document.assemble(where, str(tmp_path / f"one.{fmt}"))
        assert (tmp_path / f"one.{fmt}").read_text() == text
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_report_is_replaced_as_a_whole(spark, tmp_path):
    from auditflow.sinks import document

    where = str(tmp_path / "r")
    document.save(_findings(spark, 50), where)
    before = "".join(document.pieces(where))
    bad = _findings(spark, 50).withColumn("title", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        document.save(bad, where)
    assert "".join(document.pieces(where)) == before
    assert document.save(_findings(spark, 0), where)["rows"] == 0 and json.loads("".join(document.pieces(where)))["findings"] == []
    assert os.listdir(where) == [document.MANIFEST]


def test_a_cut_report_says_so(spark):
    from auditflow.sinks import reports

    f = _findings(spark, 30).cache()
    assert json.loads(reports.to_json(f, limit=10))["truncated"] == 20 and json.loads(reports.to_json(f))["truncated"] == 0
    assert json.loads(reports.to_sarif(f, limit=1))["runs"][0]["properties"]["truncated"] == 29
    assert "20 more" in reports.to_markdown(f, limit=10) and "20 more" in reports.to_html(f, limit=10) and "20 more" in reports.to_console(f, limit=10) and "more" not in reports.to_console(f)


def test_a_store_analyses_misses_only(spark, tmp_path):
    from auditflow.streaming.factstore import FactStore

    schema = "path string, language string, content string"
    seen = spark.sparkContext.accumulator(0)

    def analyse(df):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema).select("hash", "language", F.explode(F.split("content", "\n")).alias("line"))

    def files(*texts):
        return spark.createDataFrame([(f"f{i}", "Python" if i % 2 else None, t) for i, t in enumerate(texts)], schema)

    def analysed():
        before, seen.value = seen.value, 0
        return before

    store = FactStore(spark, "file://" + str(tmp_path / "store"), cap=4)
    assert store.facts() is None
    first = files("a\nb", "c", "a\nb", "c", None)
    counts = store.run(first, analyse)
    assert (counts["keys"], counts["misses"]) == (2, 2) and analysed() in (2, 4)  # the rows were counted in one pass, or in a second
    assert sorted((r.path, r.line) for r in store.of(first).filter("line IS NOT NULL").collect()) == [("f0", "a"), ("f0", "b"), ("f1", "c"), ("f2", "a"), ("f2", "b"), ("f3", "c")]
    assert store.run(first, analyse)["misses"] == 0 and analysed() == 0
    counts = store.run(files("a\nb", "d", "e"), analyse)
    assert (counts["keys"], counts["misses"]) == (3, 2) and store.facts().select("hash", "language").distinct().count() in (4, 5)
    counts = store.run(files("a\nb", "d", "g", "h"), analyse)  # more keys than the cap: those not used lately go
    kept = {r.line for r in store.facts().collect()}
    assert {"a", "b", "d", "g", "h"} <= kept and "c" not in kept
    assert store.run(files("x", "c"), analyse)["misses"] == 2


def test_a_run_that_fails_leaves_the_store_as_it_was(spark, tmp_path):
    from auditflow.streaming.factstore import FactStore

    store = FactStore(spark, "file://" + str(tmp_path / "store"))
    files = spark.createDataFrame([("a", "Go", "x")], "path string, language string, content string")
    store.run(files, lambda df: df.select("hash", "language", "content"))
    before = store.manifest()
    with pytest.raises(Exception, match="broken"):
        store.run(files.withColumn("content", F.lit("y")), lambda df: df.withColumn("content", F.raise_error(F.lit("broken")).cast("string")))
    assert store.manifest() == before and [r.content for r in store.of(files).collect()] == ["x"]

"""Very long texts, empty tables and extra columns for every operator's query."""

import random

import pytest
from pyspark.sql import functions as F

from auditflow.llm import linededup, lm, mixing, neardup, packing, queries, secretscan, store, substring, tokencount

from .helpers import SCHEMA, by_id, dedup_lines, dedup_windows, frame, shingles, words

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCUMENT_QUERIES = [n for n in queries.queries() if int(n[2:].split("_")[0]) not in (5, 11, 12, 13)]  # the others are in test_vectors


@pytest.fixture(scope="module")
def long_rows():
    """Texts of 60 000 words: two that share a long passage, one without white space, one of one line a word."""
    rng = random.Random(7)
    a = [f"a{rng.randrange(3000)}" for _ in range(60_000)]
    b = [f"b{rng.randrange(3000)}" for _ in range(60_000)]
    b[1000:1400] = a[50_000:50_400]
    line = "a line of well over forty code points that comes in every one"
    return [(1, " ".join(a), "en", "s", 0), (2, " ".join(b) + f"\n{line}", "en", "s", 0), (3, "x" * 300_000, "en", "s", 0), (4, "\n".join(a[:20_000]) + f"\n{line}", "en", "s", 0)] + [(10 + i, f"{line}\nend {i}", "en", "t", 0) for i in range(4)]


def test_lines_of_long_texts(spark, long_rows):
    assert by_id(linededup.dedup_lines(frame(spark, long_rows)), "doc_id", "n_lines", "n_dropped", "text") == sorted(dedup_lines(long_rows))


def test_windows_of_long_texts(spark, long_rows):
    got = by_id(substring.dedup_texts(frame(spark, long_rows)), "doc_id", "n_words", "n_removed", "text")
    assert got == sorted(dedup_windows(long_rows)) and got[1][2] == 400 and got[3][2] == 20_013


def test_sets_of_long_texts(spark, long_rows):
    got = {r.doc_id: r.n_shingles for r in neardup.near_components(frame(spark, long_rows)).collect()}
    assert got == {d: len(shingles(t)) for d, t, *_ in long_rows}


def test_counts_of_long_texts(spark, long_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(frame(spark, long_rows)).collect()}
    assert got == {d: len(library.encode(t, add_special_tokens=False).ids) for d, t, *_ in long_rows}


def test_scores_mix_and_packing_of_long_texts(spark, long_rows):
    got = {r.doc_id: r for r in lm.lm_scores(frame(spark, long_rows), least=0).collect()}
    assert {d: r.n_tokens for d, r in got.items()} == {d: len(words(t)) + 1 for d, t, *_ in long_rows}
    assert all(r.score < 0 for r in got.values())
    sizes = {r.doc_id: r.size for r in mixing.mix_sources(frame(spark, long_rows)).collect()}
    assert sizes == {d: len(words(t)) for d, t, *_ in long_rows}
    pieces = packing.pack_documents(frame(spark, long_rows)).filter("doc_id = 1").collect()
    assert sum(r.length for r in pieces) > 60_000 and {r.length for r in pieces if r.piece} == {1024}


def test_secrets_of_a_long_text(spark):
    """A hundred thousand matches in one text."""
    n = 100_000
    r = secretscan.scan_secrets(frame(spark, [(1, "token=abcdef " * n, "en", "s", 0)])).first()
    spans = r.spans.split(",")
    assert r.n_assign == n and spans[0] == "assign:0:12" and spans[-1] == f"assign:{13 * (n - 1)}:{13 * (n - 1) + 12}"


def test_a_copied_value_by_repositories_of_one_owner(spark):
    """Three repositories of one owner make an example, two do not; a null source is no null language."""
    value = "password=Zq8vR2mXk01LwPt"
    got = {}
    for n in (2, 3):
        rows = [(i, value, f"lang{i}", "one", 0) for i in range(n)]
        got[n] = {s.split(":")[0] for s in secretscan.scan_secrets(frame(spark, rows)).first().spans.split(",")}
    assert got == {2: {"assign", "live"}, 3: {"assign", "example"}}
    rows = [(0, value, None, "en", 0), (1, value, "en", None, 0)]
    repositories = secretscan.ownership(spark.createDataFrame([("h", None, '{"lang":"en"}'), ("h", "en", '{"source":"en"}')], "hash string, owner string, repository string")).first()
    assert (repositories.owners, repositories.repositories) == (2, 2) and len(rows) == 2


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_documents(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_empty_embeddings(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.queries()["op5_exact_topk"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_extra_columns_change_nothing(spark, small, tmp_path, name):
    """Columns named like the operators' own, beside those of documents."""
    docs = store.table(spark, small, "documents").orderBy("doc_id").limit(60)
    extra = {c: F.lit("x") for c in ("d", "fp", "row", "s", "pattern", "size", "n_words", "kept", "spans", "h", "c", "u", "at", "bucket", "hits", "value", "g", "n_tokens", "lim__lang")}
    results = []
    for sub, df in (("plain", docs), ("wide", docs.withColumns(extra))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{sub}/documents.parquet")
        out = queries.queries()[name](spark, f"{tmp_path}/{sub}")
        columns = [c for c in sorted(out.columns) if c not in ("score", "base_score", "sequence_id", "offset")]
        results.append(sorted((tuple(r[c] for c in columns) for r in out.collect()), key=repr))
    assert results[0] == results[1] and results[0]


def test_links_of_all_texts_of_one_id(spark):
    """Rows that repeat a doc_id with other texts carry the links of each of them."""
    base = [[f"{c}{i}" for i in range(50)] for c in "abc"]
    edited = [[*b[:20], "x", *b[21:]] for b in base]
    rows = [(5, " ".join(base[0])), (5, " ".join(base[1])), (3, " ".join(edited[0])), (9, " ".join(edited[1])), (7, " ".join(base[2])), (8, " ".join(edited[2])), (5, " ".join(base[0]))]
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_components(frame(spark, [(d, t, "en", "s", 0) for d, t in rows])).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (7, 7, True), (8, 7, False)}


def test_a_bucket_of_members_that_are_not_alike(spark):
    """Forms that share a third of their words: no links, and no text is compared."""
    rng = random.Random(4)
    form = [f"form{i}" for i in range(60)]
    rows = [(i, " ".join([*form, *(f"own{i}.{j}" for j in range(rng.randrange(60, 90)))]), "en", "s", 0) for i in range(300)]
    got = neardup.near_components(frame(spark, rows)).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 300

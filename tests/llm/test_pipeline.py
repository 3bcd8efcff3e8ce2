"""The pipeline against a plain version of all its stages, and its stages on awkward tables."""

import collections
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from auditflow.llm import queries, store

from .helpers import SCHEMA, awkward, dedup_lines, frame, shingles, union_find, words

public_tokenizers = pytest.importorskip("public_tokenizers")


def _good(rows):
    """Rows that pass the quality rules, by SQL."""
    con = duckdb.connect()
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(columns)} | {"doc_id": list(range(len(rows)))})
    con.register("documents", table)
    names = "doc_id, kept"
    kept = dict(con.execute(f"SELECT {names} FROM ({queries.oracle_sql()['op9_quality_rules']})").fetchall())
    return [r for i, r in enumerate(rows) if kept[i]]


def _undoubled(rows, k=5):
    sets = {r[0]: shingles(r[1], k) for r in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = union_find(pairs, sets)
    return [r for r in rows if root[r[0]] == r[0]]


def _target(sizes):
    """Targets by the level at which the capped shares fill the total: a walk over the caps' breaks."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, open_ = float(sum(sizes.values())), sum(weight.values())
    out = {}
    for s in sorted(names, key=lambda s: 3 * sizes[s] / weight[s]):
        level = left / open_
        out[s] = min(3.0 * sizes[s], weight[s] * level)
        left, open_ = left - out[s], open_ - weight[s]
    return out


def _hash(doc_id, text):
    h = xxhash.xxh64_intdigest((42).to_bytes(4, "little", signed=True), 42)
    if doc_id is not None:
        h = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), h)
    return xxhash.xxh64_intdigest(xxhash.xxh64_intdigest(text.encode(), 42).to_bytes(8, "little"), h) >> 1


def _mixed(rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets, out = _target(sizes), []
    for s in sizes:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: _hash(r[0], r[1]))
        copies, rest = divmod(min(round(targets[s]), 3 * sizes[s]), sizes[s]) if sizes[s] else (0, 0)
        for r in mine:
            n = len(words(r[1]))
            due = min(n, max(0, rest))
            rest -= n
            out += [r] * ((copies + (2 * due >= n)) if n else 0)
    return out


def _pieces(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = collections.Counter()
    for r in rows:
        x = [*library.encode(r[1], add_special_tokens=False).ids, 2]
        first = len(x) - 1024 * (-(-len(x) // 1024) - 1)
        cuts = [0, *range(first, len(x) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            out[r[0], p, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())] += 1
    return out


def test_run_equals_a_plain_version(spark, small):
    rows = [tuple(r) for r in store.table(spark, small, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    good = _good(rows)
    lined = [(r[0], t, *r[2:]) for r, (_, _, _, t) in zip(good, dedup_lines(good))]
    single = _undoubled(lined)
    mixed = _mixed(single)
    assert len(rows) > len(good) > len(single) > 0 and len(mixed) != len(single)
    got = corpus_pipeline.run(spark, small).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == _pieces(mixed)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 1024
    assert len(places) <= sum(r.length for r in got) / 1024 * 1.02 + 2


def test_stages_keep_clashing_columns(spark):
    docs = frame(spark).withColumns({"n_words": F.lit("mine"), "kept": F.lit(7), "size": F.lit(1.5), "d": F.lit(0), "join_d": F.lit("x"), "copies": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert {(r.n_words, r.kept, r.size, r.join_d, r.copies) for r in out.collect()} <= {("mine", 7, 1.5, "x", 2)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_stages_on_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0, name


def test_stages_in_sequence_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, repeats and a very long text go through all stages."""
    rows = [*awkward(), (777, " ".join(f"long{i % 5000} word{i}" for i in range(60_000)), "en", "a", 0), (778, None, None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 777 in {r.doc_id for r in got} and all(r.length <= 1024 for r in got)

"""Corpus operators on planted cases that a cut would miss."""

import random

from auditflow.llm import quality

from .helpers import frame


def _clean(n, first=0, source="s"):
    rng = random.Random(first)
    return [(first + i, " ".join(f"w{rng.randrange(100, 1000)}" for _ in range(100)), "en", source, 0) for i in range(n)]


def _outliers():
    """One text outside each fence, all of them inside the base rule and the fixed cutoffs of old."""
    word = [f"w{i}" for i in range(100, 1000)]
    short = " ".join("abcdefghijklmnopqrstuvwxyz")
    long = " ".join(f"{w}longtail" for w in word[:100])
    symbols = " ".join(w if i % 3 else f"{w}##" for i, w in enumerate(word[:100]))
    lines = "\n".join(f"same line\n{' '.join(word[10 * i : 10 * i + 22])}" for i in range(0, 12, 3))
    repeats = " ".join((*word[:8], *word[100:130], *word[:8], *word[200:230], *word[:8], *word[300:316]))
    return {"short": short, "long": long, "symbols": symbols, "lines": lines, "repeats": repeats}


def test_each_quality_fence_rejects_its_outlier(spark):
    bad = _outliers()
    rows = _clean(300) + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(bad.values())]
    got = {r.doc_id: r for r in quality.quality_verdicts(frame(spark, rows)).collect()}
    assert all(r.kept for i, r in got.items() if i < 1000)
    assert {n: (got[1000 + i].base_failed, got[1000 + i].kept) for i, n in enumerate(bad)} == {n: (False, False) for n in bad}


def test_quality_fences_have_no_jump_by_size(spark):
    """Long words in a small source of a language of short ones."""
    stat = "lang string, source string, " + ", ".join(f"{s} long" for s in quality.STATS)
    high = {}
    for n in (199, 200):
        rows = [("en", "big", 100, 300, 0, 0, 0)] * 1000 + [("en", "small", 100, 900, 0, 0, 0)] * n
        high[n] = {r.source: r.high_word_length for r in quality.fences(spark.createDataFrame(rows, stat)).collect()}["small"]
    assert 6.5 < high[199] <= high[200] < 1.01 * high[199]


def test_pipeline_takes_five_word_shingles(spark):
    """Three spread edits of 120 words: 0.81 alike by four words, 0.77 by five."""
    import corpus_pipeline

    a = [f"w{i}" for i in range(120)]
    b = [f"new{i}" if i in (20, 60, 100) else w for i, w in enumerate(a)]
    rows = [(1, " ".join(a), "en", "s", 0), (2, " ".join(b), "en", "s", 0), (3, " ".join(a), "en", "s", 0)]
    kept = {r.doc_id for r in corpus_pipeline.minhash_dedup(spark, frame(spark, rows), "").collect()}
    assert kept == {1, 2}

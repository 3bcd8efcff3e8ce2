"""Quality rules whose thresholds follow the corpus.

One vectorised pass takes counts of every text.  Ratios made of them go into relative-error
quantile sketches, one per language, source and ratio: a sketch is the count of values in
each of the buckets (g**(i-1), g**i], so that sketches merge by adding counts, in any order
and with the same result.  The groups of a language, and all of them, merge into sketches of
their own, to which the quartiles of groups with few documents shrink.  Fences outside the middle
half of a group replace fixed cutoffs; they are joined to the documents and filter them.  A text
fails where it stands outside its group's fence by more than an allowance for chance, so one text
passes in a corpus where its like are common and fails in another.

Defined cases: null text has no words and fails the base rule.  Null language or source is a
group like any other.  Repeated rows are judged each for itself.  An empty table has no fences and
no rows.  Very long texts are counted whole, one at a time.  Other columns pass through, whatever
their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from . import textcore as tc
from .columns import fresh, quoted
from .store import materialize

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The base rule's bounds, and the characters that count as symbols.
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: Growth of the sketch's buckets (values are right to 1 %), and the smallest value it tells from 0.
GROWTH, LEAST = 1.02, 1e-6
#: A language's quartiles count as so many documents of each of its groups, those of all documents as so many of each language.
PRIOR = 200
#: Fences stand REACH times the middle half's width outside of it, on both sides.
REACH = 3.0
#: Word length and symbols are means over words, which chance moves by the root of (variance a word /
#: words); NOISE times that is let pass.  Lines and passages recur in bunches, of any size of text:
#: so much of a text may recur over the fence.
NOISE, VARIANCE = 3.0, {"word_length": 9.0, "symbols": 1.0}
BUNCH = {"dup_lines": 0.025, "repeats": 0.2}
#: Ratios with a lower fence: fewer symbols, equal lines or repeats than usual are no fault.
LOWER = ("word_length",)
#: How many groups' fences may be broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 20_000


def _repeats(hashes: np.ndarray, first: np.ndarray, rows: np.ndarray):
    """Of spans by row, those equal to another one of the row: a mask, first ones included."""
    keys = tc.mix(hashes + tc.mix(rows.astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool), keys
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys, keys


def text_stats(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """STATS for the rows of a slice."""
    n = len(off) - 1
    words = tc.words(buf, off)
    body = ~tc.SPACE[buf] & ((buf & 0xC0) != 0x80)
    chars = tc.segment_sum(body.astype(np.int64), off)
    symbols = tc.segment_sum(_SYMBOL[buf].astype(np.int64), off)
    lines = tc.lines(buf, off)
    at = np.searchsorted(words.start, lines.start)
    worded = (at < len(words.start)) & (lines.start < lines.end)
    worded[worded] &= words.start[at[worded]] < lines.end[worded]
    rows = lines.rows[worded]
    prints = tc.fingerprints(buf, lines.start[worded], lines.end[worded])
    again, keys = _repeats(prints, lines.first, rows)
    dup = np.bincount(rows[again], minlength=n)
    if again.any():
        _, one = np.unique(keys[again], return_index=True)
        dup = dup - np.bincount(rows[again][one], minlength=n)
    hashes = tc.fingerprints(buf, words.start, words.end)
    place, row, grams = tc.grams(hashes, words.first, WINDOW)
    again, _ = _repeats(grams, words.first, row)
    cover = np.zeros(len(hashes) + 1, np.int64)
    place = place[again]
    np.add.at(cover, place, 1)
    np.add.at(cover, place + WINDOW, -1)
    covered = (np.cumsum(cover[:-1]) > 0).astype(np.int64)
    return [words.counts, chars, symbols, dup, tc.segment_sum(covered, words.first)]


def _with_stats(names: list[str], text: str, more: list[str], keep_text: bool):
    def run(batches):
        for batch in batches:
            at = names.index(text)
            parts = [text_stats(buf, off) for _, _, buf, off in tc.slices(batch.column(at))]
            stats = [np.concatenate(x).astype(np.int64) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(STATS)
            columns = [c for i, c in enumerate(batch.columns) if keep_text or i != at]
            kept = [c for i, c in enumerate(names) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, stats)], names=[*kept, *more])

    return tc.tidy(run)


def with_stats(docs: DataFrame, text="text", keep_text=True) -> DataFrame:
    """docs with the columns STATS added (with leading underscores where a name is taken)."""
    more = fresh(docs, *STATS)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if keep_text or f.name != text]
    return docs.mapInArrow(_with_stats(docs.columns, text, more, keep_text), ", ".join([*fields, *(f"`{m}` long" for m in more)]))


def ratios(n_words: Column, word_chars: Column, n_symbols: Column, n_dup_lines: Column, n_repeat_words: Column) -> dict[str, Column]:
    words = F.greatest(n_words, F.lit(1))
    return {
        "word_length": word_chars / words,
        "symbols": n_symbols / words,
        "dup_lines": n_dup_lines / words,
        "repeats": n_repeat_words / words,
    }


def sketch(groups: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """(by..., metric, bucket, n): mergeable sketches, bucket null for values under LEAST."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("x")) for k, v in values.items())))
    bucket = F.when(F.col("p.x") >= LEAST, F.ceil(F.log(F.col("p.x")) / math.log(GROWTH)).cast("int"))
    return groups.select(*by, pairs.alias("p")).groupBy(*by, F.col("p.metric").alias("metric"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], points: tuple[float, ...]) -> DataFrame:
    """(by..., metric, total, q array) of the sketches."""
    w = Window.partitionBy(*by, "metric")
    value = F.coalesce(2 * F.pow(F.lit(GROWTH), F.col("bucket")) / (GROWTH + 1), F.lit(0.0))
    ranked = sketches.select(*by, "metric", "n", value.alias("v"), F.sum("n").over(w).alias("total"), F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first())).alias("upto"))
    at = [F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("total") * p), F.lit(1)), F.col("v"))) for p in points]
    return ranked.groupBy(*by, "metric").agg(F.max("total").alias("total"), F.array(*at).alias("q"))


def fences(stats: DataFrame, prior=PRIOR, reach=REACH) -> DataFrame:
    """(lang, source, low_*, high_*): what each language and source lets pass.

    stats: lang, source and the columns STATS.  A group's quartiles are its own and its language's,
    a language's its own and those of all documents, weighted by counts: prior documents for the latter.
    Fences are wider by how far a group's quartiles are from those around it, weighted alike.
    """
    values = ratios(*map(F.col, STATS))
    fine = materialize(sketch(stats, ["lang", "source"], values))
    points = (0.25, 0.75)
    own = quantiles(fine, ["lang", "source"], points)
    by_lang = quantiles(merge(fine, ["lang"]), ["lang"], points).select(F.col("lang").alias("l"), F.col("metric").alias("lm"), F.col("total").alias("lt"), F.col("q").alias("lq"))
    overall = quantiles(merge(fine, []), [], points).select(F.col("metric").alias("am"), F.col("q").alias("aq"))
    joined = own.join(by_lang, own.lang.eqNullSafe(by_lang.l) & (own.metric == by_lang.lm)).join(F.broadcast(overall), F.col("metric") == F.col("am"))  # one row a metric

    def shrunk(own, n, wider):
        return F.zip_with(own, wider, lambda a, b: (n * a + prior * b) / (n + prior))

    both = joined.select("lang", "source", "metric", "total", "q", shrunk(F.col("lq"), F.col("lt"), F.col("aq")).alias("wider"))
    own, n = F.col("q"), F.col("total")
    middle = shrunk(own, n, F.col("wider"))
    # where a group and its surroundings differ, which of them holds is in doubt: their weighted deviation
    doubt = F.sqrt(n * prior) / (n + prior)
    width = reach * (middle[1] - middle[0])
    high = middle[1] + width + doubt * F.abs(own[1] - F.col("wider")[1])
    low = middle[0] - width - doubt * F.abs(own[0] - F.col("wider")[0])
    sides = [(m, "high", high) for m in values] + [(m, "low", low) for m in LOWER]
    return both.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == m, x)).alias(f"{side}_{m}") for m, side, x in sides))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def judged(stats: DataFrame, limits: DataFrame, lang: str, source: str, names: list[str], out: list[str]) -> DataFrame:
    """stats with the columns out (base_failed, kept) added, by limits = fences(...)."""
    n_groups = limits.count()
    group = limits.select(*(F.col(c).alias(f"lim__{c}") for c in limits.columns))
    hit = quoted(lang).eqNullSafe(F.col("lim__lang")) & quoted(source).eqNullSafe(F.col("lim__source"))
    if n_groups <= BROADCAST_GROUPS:
        joined = stats.join(F.broadcast(group), hit, "left")
    else:  # many groups: spread each over salts, so that a hot one takes many tasks
        salts = 64
        salted = stats.withColumn("lim__s", F.pmod(F.xxhash64(*map(quoted, names)), F.lit(salts)))
        each = group.withColumn("lim__r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        joined = salted.join(each, hit & (F.col("lim__s") == F.col("lim__r")), "left").drop("lim__s", "lim__r")
    failed = base_failed(quoted(names[0]), quoted(names[4]))
    fits = F.lit(True)
    words = F.greatest(quoted(names[0]), F.lit(1))
    for m, v in ratios(*map(quoted, names)).items():
        chance = NOISE * F.sqrt(VARIANCE[m] / words) if m in VARIANCE else F.lit(BUNCH[m])
        fits = fits & (v <= F.col(f"lim__high_{m}") + chance)
        if m in LOWER:
            fits = fits & (v >= F.col(f"lim__low_{m}") - chance)
    joined = joined.withColumns({out[0]: failed, out[1]: ~failed & F.coalesce(fits, F.lit(True))})
    return joined.drop(*group.columns)


def quality_verdicts(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", source="source") -> DataFrame:
    """(doc_id, STATS, base_failed, kept) of every row."""
    base = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), quoted(lang).cast("string").alias("lang"), quoted(source).cast("string").alias("source"))
    stats = materialize(with_stats(base, keep_text=False))
    limits = materialize(fences(stats))
    return judged(stats, limits, "lang", "source", list(STATS), ["base_failed", "kept"]).select("doc_id", *STATS, "base_failed", "kept")


def keep_good(docs: DataFrame, text="text", lang="lang", source="source") -> DataFrame:
    """The rows of docs that pass, columns unchanged; texts are read twice and never shuffled."""
    base = docs.select(quoted(text).alias("text"), quoted(lang).cast("string").alias("lang"), quoted(source).cast("string").alias("source"))
    limits = materialize(fences(with_stats(base, keep_text=False)))
    names, out = fresh(docs, *STATS), fresh(docs, "base_failed", "kept")
    return judged(with_stats(docs, text), limits, lang, source, names, out).filter(quoted(out[1])).select(*map(quoted, docs.columns))

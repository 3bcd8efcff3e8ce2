"""Tokens, packing, mixing, search, language model and the pipeline against plain versions."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditflow.llm import lm, mixing, packing, store, textcore, tokencount, tokens, topk

from .helpers import SCHEMA, awkward, by_id, frame, lower, words

public_tokenizers = pytest.importorskip("public_tokenizers")
PARTS = ["a", " ", "\n", "\t", " ", " ", "é", "x1", "<|endoftext|>", "<|startoftext|>", "'s", "\x1c", "  ", "中", "　", "I'll", "...", "\r\n", "\x85", "Å", "Σ", "ſ", "wörd", "🙂"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(libraries):
    texts = odd_texts(1500)
    want = [ids(libraries["byte_bpe_50k.json"], t) for t in texts]
    memo = tokens.Memo(tokens.byte_encoder(), slots=1 << 10)  # so small that it is cleared and grown on the way
    for _ in range(2):
        got = []
        for _, _, buf, off in textcore.slices(pa.array(texts), 2000):
            flat, first = packing.slice_ids(memo, buf, off)
            got += [flat[a : b - 1].tolist() for a, b in zip(first[:-1], first[1:])]
        assert got == want


def test_token_counts(spark, libraries):
    rows = awkward() + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(odd_texts(300, 2))] + [(5000, " ".join(odd_texts(900, 3)), "en", "s", 0)]
    got = by_id(tokencount.count_tokens(frame(spark, rows), huge=4000), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for d, t, *_ in rows:
        n = len(ids(libraries["word_bpe_49k.json"], t))
        want.append((d, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want, key=lambda t: [(x is not None, str(type(x)), x) for x in t])


def test_resynchronisation(libraries):
    library = libraries["word_bpe_49k.json"]
    encode = tokencount.library()[1]
    rng = random.Random(4)
    for text in (" ".join(odd_texts(60, 5)), "x" * 3000, "ab" * 900 + " " + "c d " * 500, "no" * 50 + " gap " * 3, " " * 2000 + "end", "".join(rng.choices("ab ", k=4000))):
        for chunk, overlap, agree in ((200, 10, 2), (300, 40, 8), (1000, 100, 3)):
            assert tokencount.resync_count(text, encode, chunk, overlap, agree) == len(ids(library, text))


def test_packing(spark, libraries):
    rows = awkward() + [(600 + i, "lorem ipsum dolor " * n, "en", "s", 0) for i, n in enumerate((10, 100, 340, 341, 342, 700, 1500, 3))]
    got = packing.pack_documents(frame(spark, rows)).collect()
    library, want = libraries["byte_bpe_50k.json"], collections.Counter()
    for d, t, *_ in rows:
        x = [*ids(library, t), 2]
        cuts = [(0, x)] if len(x) <= 1024 else [(max(0, i), x[max(0, i) : i + 1024]) for i in range(len(x) - 1024 * -(-len(x) // 1024), len(x), 1024)]
        for p, (start, part) in enumerate(cuts):
            want[d, p, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r.length for r in got)
    assert len(bins) <= math.ceil(total / 1024) + 2


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.put(x) for x in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    fit = packing.BestFit(10, 2)
    assert [fit.put(x) for x in (8, 7, 6, 3, 2)] == [(0, 0), (1, 0), (2, 0), (1, 7), (2, 6)]


def test_targets():
    sizes = {"a": 100, "b": 10, "c": 100, None: 30}
    got = mixing.targets(sizes)
    assert got["b"] == 30 and math.isclose(sum(got.values()), 240) and all(got[s] <= 3 * n + 1e-9 for s, n in sizes.items())
    assert math.isclose(got["c"], 3 * got["a"]) and math.isclose(got[None], got["a"])
    assert mixing.targets({"é": 1, "z": 1}) == {"z": 2 / 3, "é": 4 / 3}


def _cost(flow, patterns):
    return sum(sum(min(max(sum(f.values()) - r * patterns[p], 0), patterns[p]) * r for r in range(3)) for p, f in flow.items())


def test_flow_is_of_least_cost():
    patterns, quotas = {("a",): 4, ("a", "b"): 5, ("b",): 3}, {"a": 9, "b": 8}
    flow = mixing.route(patterns, quotas)
    got = collections.Counter()
    for p, f in flow.items():
        assert set(f) <= set(p) and 0 <= sum(f.values()) <= 3 * patterns[p]
        got.update(f)
    assert got == quotas
    best = min(
        _cost({("a",): {"a": x}, ("a", "b"): {"a": 9 - x, "b": 8 - y}, ("b",): {"b": y}}, patterns)
        for x in range(10) for y in range(9) if x <= 12 and y <= 9 and 17 - x - y <= 15
    )
    assert _cost(flow, patterns) == best


def test_mix(spark):
    rng = random.Random(2)
    rows = awkward() + [(2000 + i, "w " * rng.randint(1, 40), "en", rng.choice(["big", "big", "big", "mid", "tiny"] if i else ["tiny"]), 0) for i in range(400)]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    sizes = collections.Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(words(t))
    share = mixing.targets(dict(sizes))
    source = {d: s for d, _, _, s, *_ in rows}
    taken = collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id is not None:
            assert r.source_size == sizes[source[r.doc_id]] and math.isclose(r.target, share[source[r.doc_id]])
            taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - share[s]) <= 1 for s in ("big", "mid", "tiny", "a", "b", "d"))
    again = mixing.mix_sources(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mix_takes_whole_documents_and_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["x", "y"] if i % 3 == 0 else ["x"] if i % 3 == 1 else ["y"]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix_sources(docs).collect()
    assert abs(sum(r.taken for r in got) - 900) <= 3 and max(r.taken for r in got) <= 20
    out = mixing.mixed(frame(spark))
    assert out.columns == SCHEMA_COLUMNS and max(collections.Counter(r.doc_id for r in out.collect() if r.doc_id not in (None, 50)).values()) <= 3


SCHEMA_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def _top(rows, k=5, every=50):
    q = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q.setdefault(i, []).append([math.floor(256 * np.float32(x).astype(float)) for x in v])
    out = []
    for i, vs in q.items():
        if i % every == 0:
            v = min(vs)
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, ws in q.items() if j != i for w in ws)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 24).astype(np.float32).tolist()) for i in range(700)]
    rows[3:6] = [(3, None), (4, [float("nan")] * 24), (5, [1.0] * 23 + [None])]
    rows += [(800 + i, rows[100][1]) for i in range(8)] + [(None, rows[0][1]), (50, rows[50][1]), (900, [float("inf")] + [0.0] * 23)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert by_id(topk.top_k(df), "query_id", "rank", "vec_id", "score") == _top(rows)
    assert by_id(topk.top_k(df, query_block=4), "query_id", "rank", "vec_id", "score") == _top(rows)
    assert by_id(topk.top_k(df.filter("vec_id IN (0, 1, 2)")), "query_id", "rank", "vec_id", "score") == _top(rows[:3])
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.filter("vec_id = 50")).count() == 0


def test_lm(spark, small):
    docs = frame(spark).union(store.table(spark, small, "documents").withColumn("doc_id", F.col("doc_id") + 100).select("doc_id", "text", "lang", "source", "n_chars"))
    rows = [(r.doc_id, [*words(lower(r.text)), None]) for r in docs.collect()]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    c = collections.Counter(w for d, ws in rows if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    base = [(d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in rows]
    got = lm.lm_scores(docs).collect()
    key = lambda t: (t[0] is not None, t[0] or 0, t[2], t[5])
    for a, b in zip(sorted(base, key=key), sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert lm.lm_scores(docs.limit(0)).count() == 0


def _zipf(rng, n_words, n_texts, length=60):
    return [" ".join(rng.choices([f"w{i}" for i in range(n_words)], weights=[1 / (i + 1) for i in range(n_words)], k=length)) for _ in range(n_texts)]


@pytest.mark.parametrize("texts, listed", [(_zipf(random.Random(1), 700, 200), 300), (_zipf(random.Random(2), 700, 200), 1 << 16), (["a b c a b c a b c"] * 4, 1 << 16), (["x y z"], 1 << 16)])
def test_model_is_normalised(spark, texts, listed):
    """Over known words, the end and the unknown word, probabilities after any context sum to one.

    Also where every word is listed, and where none is.
    """
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = train.mapInArrow(lm._count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    model = lm.fit(train, counts, listed=listed, least=20_000)
    c = collections.Counter(w for t in texts for w in t.split())
    for context in (texts[0].split()[:3], ["never", "seen"], []):
        probes = [" ".join([*context, w]) for w in [*sorted(c), "unknown"]] + [" ".join(context)]
        total = 0.0
        for _, _, buf, off in textcore.slices(pa.array(probes)):
            t = model.tokens(buf, off)
            p = model.log_probs(t)
            for i, w in enumerate([*sorted(c), "unknown", None]):
                j = t.first[i] + len(context)
                more = 0.0  # a known word that the head does not hold was scored as unknown
                if w in c and t.place[j] < 0:
                    more = math.log10((1 - model.unknown) * c[w] / model.rest / model.unknown)
                total += 10 ** (p[j] + more)
        assert math.isclose(total, 1, rel_tol=1e-4)


def test_nce_learns_conditional_probabilities():
    """Twelve words in two classes, each drawn given the word before it."""
    rng = np.random.default_rng(2)
    true = rng.dirichlet(np.ones(12) * 0.3, size=12)
    words = np.zeros(60_000, np.int32)
    for i in range(1, len(words)):
        words[i] = rng.choice(12, p=true[words[i - 1]])
    seen = np.bincount(words, minlength=12)
    order = np.argsort(-seen, kind="stable")
    rank = np.argsort(order).astype(np.int32)
    v = lm.Vectors(seen[order], 0, 0, dim=12, distances=1, size=6)
    trainer = lm.Trainer(v, rate=0.3)
    ctx, w, no = rank[words[:-1], None], rank[words[1:]], np.zeros(len(words) - 1, bool)
    for _ in range(25):
        for lo in range(0, len(w), 1024):
            trainer.step(ctx[lo : lo + 1024], w[lo : lo + 1024], no[lo : lo + 1024])
    v.tables = trainer.tables
    a, b = np.repeat(np.arange(12), 12), np.tile(np.arange(12), 12)
    learned = np.exp(v.log_probs(rank[a, None], rank[b], np.zeros(144, bool))).reshape(12, 12)
    uniform = np.abs(true - true.mean(axis=0)).mean()
    assert np.abs(learned - true).mean() < 0.25 * uniform


def _plain_step(trainer, ctx, words, is_end):
    """A training step written token by token: the gradients of every row, as trainer._add gets them summed."""
    v, t, rng = trainer.v, trainer.tables, trainer.rng
    one = lambda x: 1 / (1 + math.exp(-min(max(float(x), -30), 30)))
    sums = {k: np.zeros(x.shape) for k, x in t.items()}
    met = {k: np.zeros(len(x), np.int64) for k, x in t.items()}
    y, noise = v.classes_of(words, is_end), rng.choice(len(v.p_class), lm.NOISE_CLASSES, p=v.p_class)
    mine, drawn = np.flatnonzero(words >= 0), []
    for _ in range(lm.NOISE):
        size = np.minimum(v.size, v.n_words - y[mine] * v.size)
        slot = y[mine] * v.size + (rng.random(len(mine), np.float32) * size).astype(np.int64)
        drawn.append(np.where(rng.random(len(mine), np.float32) < v.keep[slot], slot, v.alias[slot]))
    drawn = dict(zip(mine.tolist(), zip(*drawn)))
    for i in range(len(ctx)):
        wide = np.append(sum(t["context"][c].astype(float) * w for c, w in zip(ctx[i], t["weights"])), 1)
        back = np.zeros(v.dim + 1)
        pairs = [("classes", y[i], 1, trainer.lift_class)] + [("classes", x, 0, trainer.lift_class) for x in noise]
        pairs += [("words", x, k == 0, trainer.lift_word) for k, x in enumerate((words[i], *drawn[i]))] if i in drawn else []
        for name, row, real, lift in pairs:
            g = real - one(wide @ t[name][row] - lift[row])
            back += g * t[name][row]
            sums[name][row] += g * wide
            met[name][row] += name == "words" or bool(real)
        for k, c in enumerate(ctx[i]):
            sums["context"][c] += back[:-1] * t["weights"][k]
            sums["weights"][k] += 0.1 * back[:-1] * t["context"][c]
            met["context"][c] += 1
    met["classes"] += np.bincount(noise, minlength=len(v.p_class))  # shared by the batch: once each
    met["weights"] += 1
    return sums, met


@pytest.mark.parametrize("rows", [[1], [5, 1, 40, 3], [300]])
def test_step_is_the_plain_one_and_looks_for_few_rows(rows):
    """A token that is the context of four others is looked for once, which before was four times."""
    rng = np.random.default_rng(5)
    counts = np.sort(rng.integers(1, 500, 70))[::-1]
    v = lm.Vectors(counts, 40, 20, dim=6, size=16)
    for name in ("classes", "words"):
        v.tables[name] += rng.normal(0, 0.5, v.tables[name].shape).astype(np.float32)
    first = np.concatenate(([0], np.cumsum(rows)))
    words = rng.integers(-1, 70, first[-1]).astype(np.int32)
    is_end = np.zeros(len(words), bool)
    is_end[first[1:] - 1], words[first[1:] - 1] = True, -1
    ctx = lm.contexts(np.where(words >= 0, words, 70 + rng.integers(0, 9, len(words))).astype(np.int32), first, v.start)
    fast, plain = lm.Trainer(v, seed=3), lm.Trainer(v, seed=3)
    sums, met = _plain_step(plain, ctx, words, is_end)
    looked, add = {}, fast._add
    fast._add = lambda name, rows, *more: (looked.__setitem__(name, len(rows)), add(name, rows, *more))
    fast.step(ctx, words, is_end)
    assert looked["context"] <= len(words) + 8 * len(rows)
    for name, table in plain.tables.items():
        squares = lm.START + (sums[name] ** 2).mean(axis=1)
        want = table + plain.rate / np.sqrt(squares)[:, None] * sums[name]
        assert np.allclose(fast.tables[name], want, atol=1e-5)
        assert (fast.met[name] == met[name]).all()


def test_listed_words_are_found_from_their_leading_bits():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 1000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        crowded = np.unique(np.concatenate((keys, keys[:1] + np.arange(20, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64))))
        for k in (keys, crowded):
            head = lm.Head(k, np.full(len(k), lm.LEAST_COUNT))
            asked = np.concatenate((k, k + np.uint64(1), k - np.uint64(1), rng.integers(0, 1 << 64, 500, dtype=np.uint64)))
            known = {x: i for x, i in zip(head.keys.tolist(), head.ids.tolist())}
            assert head.find_listed(asked).tolist() == [known.get(x, -1) for x in asked.tolist()]
            assert [int(head.keys[i]) if i >= 0 else -1 for i in head.find(asked)] == [x if x in known else -1 for x in asked.tolist()]


def test_log_softmax_holds_large_scores():
    rng = np.random.default_rng(8)
    for scale in (0.3, 3.0):  # scores beyond any bound are cut at 80
        h, table, at = (scale * rng.normal(0, 2, (700, 5))).astype(np.float32), (scale * rng.normal(0, 2, (30, 5))).astype(np.float32), rng.integers(0, 30, 700)
        s = np.minimum(h.astype(float) @ table.T.astype(float), 80)
        want = s[np.arange(700), at] - np.log(np.exp(s).sum(axis=1))
        assert np.allclose(lm._log_softmax_at(h, table, at), want, atol=2e-4)


def test_contexts_beat_none_and_smoothed_pairs(spark):
    """On held-out texts, against the same model without contexts and against add-k pair counts."""
    docs = store.table(spark, "/root/testdata/sf0.01", "documents")
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    rows = [(r.doc_id, [*lower(r.text).split(), "<end>"]) for r in docs.collect()]
    train = [w for d, w in rows if not held(d)]
    one, two = collections.Counter(x for w in train for x in w), collections.Counter(p for w in train for p in zip(["<end>", *w], w))
    n, v = sum(one.values()), len(one) + 1
    pairs = tokens_ = 0.0
    for d, w in rows:
        if held(d):
            for a, b in zip(["<end>", *w], w):
                alone = (one[b] + 0.1) / (n + 0.1 * v)
                pairs += math.log10((two[a, b] + 2 * alone) / (one[a] + 2))
            tokens_ += len(w)
    score = lambda **k: lm.lm_scores(docs, **k).filter("held_out").agg(F.sum("score")).first()[0] / tokens_
    trained, untrained = score(), score(least=-1)
    assert trained > pairs / tokens_ and trained > untrained + 0.1


def test_pipeline(spark, small):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "mix_sources", "best_fit_packing"]
    docs = store.table(spark, small, "documents")
    step, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = store.materialize(stage(spark, step, small))
        assert step.columns == docs.columns, name
        sizes.append(step.count())
    assert sizes[0] < docs.count() and sizes[1] == sizes[0] and sizes[2] < sizes[1]
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, small).collect())
    last = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack_documents(step).collect())
    assert got == last
    assert len({r[0] for r in got}) <= sizes[2]


def test_top_k_of_huge_components(spark):
    """Scores past 2**53 are whole numbers still, and past 64 bits count as the nearest long."""
    rows = [(0, [3e7, 1.0]), (1, [3e7, 0.5]), (2, [3e7, 0.75]), (3, [3e7, 1.0]), (50, [1e30, 1.0]), (4, [1e30, 2.0]), (5, [-1e30, 0.0]), (6, None), (7, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = {i: [math.floor(256 * x) for x in v] for i, v in rows if v and all(map(math.isfinite, v))}
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    want = []
    for a in (0, 50):
        ranked = sorted((-clip(sum(x * y for x, y in zip(q[a], q[b]))), b) for b in q if b != a)[:5]
        want += [(a, n, b, -s) for n, (s, b) in enumerate(ranked, 1)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)


def test_mix_of_many_sources_and_hot_ids(spark):
    """50 000 sources end in time; rows without ids are taken in an order that their contents give."""
    sizes = {f"s{i:05}": i % 7 + 1 for i in range(50_000)}
    flow = mixing.routed({(s,): n for s, n in sizes.items()}, {s: 2 * n for s, n in sizes.items()})
    assert all(flow[s,] == {s: 2 * n} for s, n in sizes.items())
    rows = [(None, " ".join(f"w{j}" for j in range(i % 9 + 1)) + f" t{i}", "en", "a" if i % 4 else "b", 0) for i in range(400)]
    one, two = ([(r.size, r.taken, n) for r, n in collections.Counter(mixing.mix_sources(frame(spark, rows).repartition(p)).collect()).items()] for p in (1, 7))
    assert sorted(one) == sorted(two)

"""Hard negatives, clustering and url filters against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditflow.llm import clustering, negatives, queries, topk, urlfilter

VECTORS = "vec_id long, label int, embedding array<float>"


def _floors(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def _ok(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _clouds(n, dims, seed, first=0):
    """Vectors around a few centres, with ties and copies among them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.25, (6, dims))
    return [(first + i, int(i % 6), [float(np.float32(x)) for x in np.round(centres[i % 6] + rng.normal(0, 0.1, dims), 1 if i % 5 == 0 else 6)]) for i in range(n)]


def _odd(dims):
    return [
        (None, 1, [0.1] * dims), (9001, None, [0.1] * dims), (9002, 1, None), (9003, 1, [0.1] * (dims - 1) + [None]), (9004, 1, [float("nan")] * dims),
        (9005, 2, [float("inf")] * dims), (9006, 3, []), (9100, 4, [0.5] * (dims - 3)), (9101, 4, [0.0] * dims), (9102, -3, [0.2] * dims), (7, 3, [0.3] * dims),
    ]


def _mined(rows, every=100, k=5, n=10):
    kept = [(d, (label + 1) % 10 if d % 7 == 0 else label, _floors(v)) for d, label, v in rows if d is not None and label is not None and _ok(v)]
    kept = [(d, label if label >= 0 or d % 7 else -((-label) % 10), v) for d, label, v in kept]
    anchors = {}
    for d, label, v in kept:
        if d % every == 0:
            anchors[d] = min(anchors.get(d, (label, v)), (label, v))
    out = []
    for a, (label, q) in anchors.items():
        scored = sorted(((-sum(x * y for x, y in zip(q, v)), d, other) for d, other, v in kept if d != a))
        for p, positive, _ in [s for s in scored if s[2] == label][:k]:
            inside = [(s, d) for s, d, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(a, positive, rank, d, -p, -s) for rank, (s, d) in enumerate(inside[:n], 1)]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _got(df, columns=COLUMNS):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("cells", (2, 5, 256))
def test_negatives_are_exact_whatever_the_cells(spark, cells):
    rows = _clouds(500, 9, 3) + _odd(9) + [(100, 5, [0.4] * 9), (200, 2, _clouds(300, 9, 3)[200][2])]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    want = _mined(rows)
    assert _got(negatives.hard_negatives(negatives.with_noise(negatives.labelled(df)), cells=cells)) == want and len(want) > 100


def test_negatives_over_many_tiles(spark, monkeypatch):
    """Groups, blocks and batches of a few rows."""
    for name, size in (("GROUP", 60), ("BLOCK", 3), ("REQUESTS", 2), ("ROWS", 16)):
        monkeypatch.setattr(negatives, name, size)
    rows = _clouds(400, 6, 8)
    assert _got(negatives.hard_negatives(negatives.with_noise(negatives.labelled(spark.createDataFrame(rows, VECTORS))), every=20)) == _mined(rows, every=20)


def test_negatives_of_far_components(spark):
    """Scores past the whole numbers that doubles hold, and past 64 bits."""
    for size in (3e6, 3e17):
        rows = [(d, label, [float(np.float32(x * size)) for x in v]) for d, label, v in _clouds(260, 5, 4)]
        got = _got(negatives.hard_negatives(negatives.with_noise(negatives.labelled(spark.createDataFrame(rows, VECTORS)))))
        if size < 1e10:
            assert got == _mined(rows)
        else:
            assert all(abs(r[4]) < 1 << 63 and 30 * r[4] <= 100 * r[5] <= 90 * r[4] for r in got)


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(2)
    m = np.floor(rng.normal(0, 40, (16, 3000)))
    m[3, 5] = 1e9  # one far component widens one cell
    cells = negatives.Cells(m[:, :500], m.min(axis=1), m.max(axis=1), 256)
    q = m[:, 100:140]
    low, high = cells.bounds(q, cells.of(m))
    exact = q.T @ m
    assert (low <= exact).all() and (exact <= high).all()
    assert np.median(high - low) < np.std(exact) / 3
    tile = negatives.Tile(np.arange(40), np.zeros(40, int), np.full(40, -1 << 62), np.full(40, 1 << 62), q, cells, 5, True)
    tile.add(np.arange(100, 3100), np.zeros(3000, int), np.arange(3000), cells.of(m))
    at, row, *_ = tile.survivors()
    assert len(at) < 40 * 3000 / 20
    for a in range(40):
        others = np.where(np.arange(100, 3100) == a, -np.inf, exact[a])
        assert set(np.argsort(-others, kind="stable")[:5]) <= set(row[at == a].tolist()) | set(np.flatnonzero(others == np.sort(others)[-5]).tolist())


def test_no_negatives(spark):
    for rows in ([], _odd(4)[:6], [(100, 1, [0.5, 0.5]), (101, 1, [0.5, 0.5])], [(100, 1, [0.5]), (101, 1, [-0.5]), (102, 2, [0.4])]):
        df = spark.createDataFrame(rows, VECTORS)
        assert negatives.hard_negatives(negatives.with_noise(negatives.labelled(df))).count() == 0


def _clustered(rows, dims, k, rounds, seed="2"):
    far = 1 << 52
    kept = [(d, [min(max(math.floor(256 * float(x)), -far), far) for x in v]) for d, _, v in rows if d is not None and _ok(v) and len(v) == dims]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == i]
            if mine:
                centroids[i] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(d, *nearest(v)) for d, v in kept]
    total, most = {}, (1 << 63) - 1
    for _, x, i in found:
        total[i] = total.get(i, 0) + min(x, most)
    return sorted((d, i, min(x, most), min(total[i], most), min(sum(total.values()), most), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for d, x, i in found)


CLUSTER = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("k, rounds", ((1, 2), (7, 0), (7, 1), (7, 5), (7, 40)))
def test_clusters(spark, k, rounds):
    rows = _clouds(240, 8, 5) + _odd(8) + [(3, 1, [0.9] * 8), (3, 1, [0.9] * 8)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert _got(clustering.cluster(df, centroids=k, rounds=rounds, dimensions=8), CLUSTER) == _clustered(rows, 8, k, rounds)


def test_more_centroids_than_vectors_and_repeated_rows(spark):
    """Centroids that coincide: all but the first are empty and stay."""
    rows = [(1, 0, [0.5, 0.5])] * 9 + [(2, 0, [0.1, -0.3])] * 3
    df = spark.createDataFrame(rows, VECTORS)
    got = _got(clustering.cluster(df, centroids=40, dimensions=2), CLUSTER)
    assert got == _clustered(rows, 2, 40, 5) and len({r[1] for r in got}) == 2
    assert clustering.cluster(df, dimensions=3).count() == 0


def test_clusters_of_far_components(spark):
    rows = [(d, label, [float(x) * size for x in v]) for d, label, v in _clouds(90, 4, 6) for size in ((1.0, 1e7, 1e12, 1e30)[d % 4],)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert _got(clustering.cluster(df, centroids=6, dimensions=4), CLUSTER) == _clustered(rows, 4, 6, 5)


def test_unchanged_centroids_are_not_looked_at(monkeypatch):
    """What compare() computes: all vectors by changed centroids, and those left behind by all."""
    rng = np.random.default_rng(1)
    v, old = np.floor(rng.normal(0, 50, (400, 5))), np.floor(rng.normal(0, 50, (9, 5)))
    old[6] = old[2]
    full = clustering.distances(v, old)
    own, far = full.argmin(axis=1), full.min(axis=1)
    made, plain = [], clustering.distances
    monkeypatch.setattr(clustering, "distances", lambda a, c: made.append(len(a) * len(c)) or plain(a, c))
    for changed in ([0], [2, 5], [6], []):
        new = old.copy()
        new[changed] += rng.integers(-9, 9, (len(changed), 5))
        flags = np.isin(np.arange(9), changed)
        made.clear()
        a, b = clustering.compare(v, own, far, new, flags)
        want = plain(v, new)
        assert (a == want.argmin(axis=1)).all() and (b == want.min(axis=1)).all()
        assert sum(made) <= 400 * len(changed) + 9 * np.isin(own, changed).sum()


def test_only_moved_vectors_are_transferred(spark):
    state = spark.createDataFrame([(1, [5, 7], 0, -1, 1), (2, [1, -1], 1, 0, 1), (3, [100, 100], 1, 1, 1)], "vec_id long, v array<long>, own int, was int, far int")
    assert clustering.moved_sums(state, 2, 2) == [(0, 0, [4, 8]), (1, 1, [1, -1])]


def _judged(url, rules, default="allow"):
    url = url or ""
    if "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        h, p = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in h), slash + p
        if (host == h or host.endswith(f".{h}")) and path.startswith(p):
            best = max(best or (0,), (h.count(".") + 1, len(p), verdict == "block", rule, verdict))
    return host, path, best and best[3], best[4] if best else default


URLS = [
    None, "", "example.net/en/1", "http://", "http://net", "http://net/", "https://a.NET/x", "ftp://example.net/en/", "http://example.net/en", "http://www.Example.net/en/7?x=/de/", "http://example.com/de/#f",
    "http://example.com#/de/", "http://notexample.com/de/", "http://x.org/fr/a/b", "http://x.org/FR/", "http://org/fr/", "http://x.org:80/fr/", "http://u@x.org/fr/", "http://a://b.net/", "x\n://a.net/\n/y", "http://example.net.//en/",
    "http://.net/", "http://ÉX.net/é", "http://example.net//en/", "http://deep.a.b.c.example.com/de/x/y", "http://a.net/" + "s/" * 5000, "http://" + "l." * 5000 + "net/",
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:4])], "page_id long, url string, host string")
    got = [(r["_host"], r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, queries.URL_RULES).orderBy("page_id").collect()]
    assert got == [_judged(u, queries.URL_RULES) for u in URLS + URLS[:4]]
    kept = urlfilter.keep_allowed(df, queries.URL_RULES)
    assert kept.columns == df.columns and kept.count() == sum(g[3] == "allow" for g in got)
    assert {r.verdict for r in urlfilter.judge_urls(df, [], default="block").collect()} == {"block"}


@pytest.mark.parametrize("block", (10_000, 40))
def test_many_rules(spark, block):
    """Rules that overlap, as a list, and as a table in several tries."""
    rng = random.Random(5)
    part = lambda n, of: "".join(rng.choice(of) for _ in range(rng.randint(1, n)))
    host = lambda: ".".join(part(1, "ab") for _ in range(rng.randint(1, 3)))
    path = lambda: "/".join(["", *(part(2, "xy") for _ in range(rng.randint(0, 3)))])
    rules = [(rng.choice(("allow", "block")), host() + path() + rng.choice(("", "/"))) for _ in range(200)]
    urls = [f"http://{host()}{path()}" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "verdict string, rule string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, table if block == 40 else rules, block=block).orderBy("page_id").collect()]
    assert got == [_judged(u, rules) for u in urls] and sum(g[2] is not None for g in got) > 200


def test_faulty_rules():
    for verdict, rule in (("deny", "net/"), ("block", "/en/")):
        with pytest.raises(ValueError):
            urlfilter.Trie([(verdict, rule)])


TABLES = {"op5_exact_topk": "embeddings", "op11_hard_negatives": "embeddings", "op12_centroid_clustering": "embeddings", "op13_url_filter": "pages"}


@pytest.mark.parametrize("name", TABLES)
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", TABLES)
def test_clashing_columns_change_nothing(spark, tmp_path, name):
    rows = {"embeddings": spark.createDataFrame(_clouds(150, 64, 1), VECTORS), "pages": spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], "page_id long, url string, html string")}[TABLES[name]]
    extra = {c: F.lit("x") for c in ("v", "row", "g", "b", "own", "far", "score", "request", "lo", "host", "path", "rule", "best", "verdict", "rank", "query_id", "h", "cluster")}
    results = []
    for sub, df in (("plain", rows), ("wide", rows.withColumns(extra))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{sub}/{TABLES[name]}.parquet")
        out = queries.queries()[name](spark, f"{tmp_path}/{sub}")
        results.append(sorted((tuple(r[c] for c in sorted(out.columns)) for r in out.collect()), key=repr))
    assert results[0] == results[1] and results[0]


@pytest.mark.parametrize("name", [n for n in TABLES if n != "op5_exact_topk"])
def test_same_as_sql(spark, duck, small, same, name):
    same(queries.queries()[name](spark, small), duck, queries.oracle_sql()[name])


def test_top_k_shares_the_layout():
    """Both searches read vectors by the same exact layout."""
    assert negatives.exact_scores is topk.exact_scores

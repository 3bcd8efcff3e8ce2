"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern: the set of sources that they belong to.
A small network then routes words from patterns to source quotas: an arc from a pattern to
each of its sources, and arcs into a pattern of its size each, the first repetition free and
each further one dearer (a convex cost), so that no text is repeated while fresh text is left.
Only the patterns' totals come to the driver: one row per distinct set of sources, MOST_PATTERNS at
most.  A source that shares no document with others needs no search: its one pattern fills its
quota.  Only sources that do overlap are routed, each connected group of them for itself.

Within a pattern, what the flow takes is whole copies of all its documents plus a rest that
goes to documents in seeded hash order.  Their prefix sums need no sort of a source: sizes are
summed by hash bucket, the bucket where the rest runs out is found from the sums, and only its
documents are ordered.  Where that bucket is large, it is split again by further hash bits.

Order goes by the row's content besides its doc_id, so rows that share an id, or have none, spread
like others and reruns agree; rows equal in both are interchangeable.

Defined cases: null text has size 0 and null sources are a source of their own.  Documents of
size 0 take 0.  Repeated rows are separate documents.  An empty table has no rows.  Very long texts
are documents like others, taken in part only where a target runs out.  Other columns pass through
mixed(), whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .columns import quoted
from .store import materialize

CAP = 3
#: The weights of sources in order, repeating.
WEIGHTS = (1, 2, 3)
SEED = 42
BITS, ROUNDS = 10, 2
#: How many patterns' plans may be broadcast.
BROADCAST_PATTERNS = 20_000
#: How many distinct sets of sources a mix may have; more are an error.
MOST_PATTERNS = 2_000_000


def words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ of a text, 0 for null: each word made one letter, and the letters counted."""
    letters = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")
    return F.length(letters).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, cap=CAP, total: int | None = None) -> dict[str | None, float]:
    """Shares of all sizes by weight, none above cap times its source; the excess is reshared.

    Sources are weighted in code point order, null last.  total: all sizes, if documents that
    belong to several sources make it differ from the sources' sum.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = float(sum(sizes.values()) if total is None else total), {}, list(names)
    while free:
        left = total - sum(out.values())
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > cap * sizes[s]]
        if not over:
            out.update((s, weight[s] * share) for s in free)
            break
        out.update((s, float(cap * sizes[s])) for s in over)
        free = [s for s in free if s not in out]
    return out


def routed(patterns: dict[tuple, int], quotas: dict[str | None, int], cap=CAP) -> dict[tuple, dict]:
    """Words that each source takes of each pattern, by groups of sources that share documents."""
    group: dict = {q: q for q in quotas}

    def top(q):
        while group[q] != q:
            group[q] = group[group[q]]
            q = group[q]
        return q

    for p in patterns:
        for q in p[1:]:
            group[top(q)] = top(p[0])
    mine: dict = {}
    for p in patterns:
        mine.setdefault(top(p[0]), []).append(p)
    out: dict[tuple, dict] = {}
    for ps in mine.values():
        if len(ps) == 1 and len(ps[0]) == 1:
            out[ps[0]] = {ps[0][0]: min(quotas[ps[0][0]], cap * patterns[ps[0]])}
        else:
            out |= route({p: patterns[p] for p in ps}, {q: quotas[q] for p in ps for q in p}, cap)
    return out


def route(patterns: dict[tuple, int], quotas: dict[str | None, int], cap=CAP) -> dict[tuple, dict]:
    """Words that each source takes of each pattern: a min-cost flow by successive shortest paths.

    patterns: size of each set of sources; quotas: words that each source is to get.
    Repetition r (from 0) of a pattern's words costs r a word.
    """
    nodes: dict = {"s": 0, "t": 1}
    for p in patterns:
        nodes[("p", p)] = len(nodes)
    for q in quotas:
        nodes[("q", q)] = len(nodes)
    graph: list[list[list]] = [[] for _ in nodes]

    def arc(a, b, room, cost):
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, size in patterns.items():
        for r in range(cap):
            arc(0, nodes["p", p], size, r)
        for q in p:
            arc(nodes["p", p], nodes["q", q], cap * size, 0)
    for q, room in quotas.items():
        arc(nodes["q", q], 1, room, 0)
    price = [0] * len(nodes)
    while True:
        far: list = [None] * len(nodes)
        far[0], back, heap = 0, {}, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for i, (b, room, cost, _) in enumerate(graph[a]):
                if room > 0 and (far[b] is None or d + cost + price[a] - price[b] < far[b]):
                    far[b], back[b] = d + cost + price[a] - price[b], (a, i)
                    heapq.heappush(heap, (far[b], b))
        if far[1] is None:
            break
        top = max(x for x in far if x is not None)
        price = [p + (top if f is None else f) for p, f in zip(price, far)]
        room, b = None, 1
        while b:
            a, i = back[b]
            room = graph[a][i][1] if room is None else min(room, graph[a][i][1])
            b = a
        b = 1
        while b:
            a, i = back[b]
            graph[a][i][1] -= room
            graph[b][graph[a][i][3]][1] += room
            b = a
    out: dict[tuple, dict] = {}
    for p in patterns:
        mine = graph[nodes["p", p]]
        ends = {nodes["q", q]: q for q in p}
        out[p] = {ends[b]: cap * patterns[p] - room for b, room, _, _ in mine if b in ends}
    return out


def plan_mix(docs: DataFrame, weights=WEIGHTS, cap=CAP) -> DataFrame:
    """(pattern, source_size, target, copies, rest) per set of sources, from docs' totals.

    docs: pattern (sorted array of distinct sources) and size.  source_size and target are sums
    over the pattern's sources.  Every document is to be taken copies times, and rest words more
    of the pattern's documents; rest is under the pattern's size.
    """
    got = docs.groupBy("pattern").agg(F.sum("size").alias("n")).limit(MOST_PATTERNS + 1).collect()  # one row per set of sources
    if len(got) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} distinct sets of sources")
    patterns = {tuple(r.pattern): int(r.n or 0) for r in got}
    sizes: dict = {}
    for p, n in patterns.items():
        for q in p:
            sizes[q] = sizes.get(q, 0) + n
    share = targets(sizes, weights, cap, sum(patterns.values()))
    flow = routed(patterns, {q: round(v) for q, v in share.items()}, cap)
    rows = []
    for p, n in patterns.items():
        copies, rest = divmod(sum(flow[p].values()), n) if n else (0, 0)
        rows.append((list(p), sum(sizes[q] for q in p), float(sum(share[q] for q in p)), int(copies), int(rest)))
    return docs.sparkSession.createDataFrame(rows, "pattern array<string>, source_size long, target double, copies int, rest long")


def _beside(docs: DataFrame, plan: DataFrame, n_plan: int) -> DataFrame:
    plan = plan.withColumnRenamed("pattern", "plan_pattern")
    if n_plan <= BROADCAST_PATTERNS:
        plan = F.broadcast(plan)
    return docs.join(plan, F.col("pattern") == F.col("plan_pattern"), "left").drop("plan_pattern")


def select_words(docs: DataFrame, plan: DataFrame, identity: list[str], seed=SEED, split=True) -> DataFrame:
    """docs with source_size, target and taken added.

    docs holds pattern, size and the identity columns, and is read several times, so it should
    be written.  Order is by a seeded hash u of the identity, ties by the identity itself.
    split: the document at which the rest runs out gives the words that are due; else it is
    taken whole if at least half of it is due.
    """
    n_plan = plan.count()
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *map(quoted, identity)), 1)
    docs = docs.withColumn("u", u)
    plan = plan.withColumns({"cut": F.lit(0).cast("long"), "due": F.col("rest")})
    for i in range(1, ROUNDS + 1):
        at = F.shiftright("u", 63 - BITS * i)
        inside = _beside(docs, plan, n_plan).filter(F.shiftright("u", 63 - BITS * (i - 1)) == F.col("cut") if i > 1 else F.lit(True))
        sums = inside.groupBy("pattern", "due", at.alias("at")).agg(F.sum("size").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("pattern").orderBy("at")))  # 2**BITS rows each
        found = sums.filter((F.col("upto") > F.col("due")) & (F.col("upto") - F.col("n") <= F.col("due")))
        found = found.select(F.col("pattern").alias("p"), F.col("at").alias("new_cut"), (F.col("due") - F.col("upto") + F.col("n")).alias("new_due"))
        plan = plan.join(found, F.col("pattern") == F.col("p"), "left")
        plan = materialize(plan.select("pattern", "source_size", "target", "copies", "rest", F.coalesce("new_cut", F.lit(-1)).alias("cut"), F.coalesce("new_due", F.lit(0)).alias("due")))
    x = _beside(docs, plan, n_plan).withColumn("at", F.shiftright("u", 63 - BITS * ROUNDS))
    sure = x.filter(F.col("at") != F.col("cut")).withColumn("more", F.when(F.col("at") < F.col("cut"), F.col("size")).otherwise(0))
    w = Window.partitionBy("pattern").orderBy("u", *map(quoted, identity)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = x.filter(F.col("at") == F.col("cut"))  # of each pattern, one bucket in 2**(BITS*ROUNDS)
    due = F.least(F.col("size"), F.greatest(F.lit(0), F.col("due") - F.sum("size").over(w) + F.col("size")))
    more = due if split else F.when(2 * due >= F.col("size"), F.col("size")).otherwise(0)
    both = sure.unionByName(last.withColumn("more", more))
    return both.withColumn("taken", F.col("copies") * F.col("size") + F.col("more")).drop("u", "at", "cut", "due", "copies", "rest", "more")


def mix_sources(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, cap=CAP, seed=SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    source is a string, or an array of the sources that a document belongs to (null or empty:
    the null source).
    """
    base = materialize(docs.select(quoted(doc_id).alias("doc_id"), F.xxhash64(quoted(text)).alias("fp"), _pattern(docs, source).alias("pattern"), words(quoted(text)).alias("size")))
    return select_words(base, plan_mix(base, weights, cap), ["doc_id", "fp"], seed).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def _pattern(docs: DataFrame, source: str):
    col = quoted(source)
    if docs.schema[source].dataType.typeName() == "array":
        col = F.array_sort(F.array_distinct(col))
        return F.when(F.size(col) > 0, col).otherwise(F.array(F.lit(None).cast("string")))
    return F.array(col.cast("string"))


def mixed(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, cap=CAP, seed=SEED) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, columns unchanged.

    Documents are taken whole: one at which a target runs out comes in if half of it is due.
    """
    row = F.struct(*map(quoted, docs.columns)).alias("row")
    x = materialize(docs.select(row, quoted(doc_id).alias("id"), F.xxhash64(quoted(text)).alias("fp"), _pattern(docs, source).alias("pattern"), words(quoted(text)).alias("size")))
    taken = select_words(x, plan_mix(x, weights, cap), ["id", "fp"], seed, split=False)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    return taken.withColumn("copies", copies.cast("int")).filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")

"""Substring dedup by De Bruijn compaction of token k-mers.

A window of k words is an edge of a De Bruijn graph, from the node of its first k-1 words to the
node of its last k-1 words.  Only edges that several documents hold matter, and copies of an edge
share their minimiser, the smallest fingerprint of the w-grams inside: its seed.

1. Texts are dealt once into groups of bounded size; every later pass reads that one shuffle.
   Groups send their distinct seeds to buckets, which answer which of them other documents have.
2. Consecutive edges of a document with one shared seed are a run.  Groups send the distinct runs
   (seed, content) with their smallest document and its coordinate.  A seed with one content is
   one path for all its documents; where contents differ, groups send the single edges as well.
   Buckets answer the smallest document of each, its coordinate, and how many documents hold it.
3. The group of the smallest document emits each path and edge once, with its two end nodes.  A
   node's in- and out-degree come from an aggregation; where one path ends and one begins, both
   held equally often and adjacent in one document, the node does not branch.  Joins with such
   nodes compact the paths into unitigs, each a span of its smallest document's coordinates.
4. Every group asks for the words of the unitigs that its documents' spans touch, once each, and
   compares them with its own words at the spans' coordinates.  Spans that stand word by word are
   cut; a window that only looked alike by its fingerprints stays.

What is sent is distinct within a group, so a passage of a third of all documents is one entry a
group.  Groups are as many as the texts have bytes for, and buckets as many as groups.

Defined cases: null or short texts have no window and keep their words.  Null doc_ids are one
document before all others.  Rows that repeat a doc_id belong to one document: windows that only
it holds stay.  Equal rows are all cut alike.  An empty table has no rows.  Very long texts are
held one at a time.  Other columns pass through dedup_substrings, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import textcore as tc
from .columns import fresh, key, quoted, whole
from .store import materialize

WINDOW, GRAM = 13, 5
#: Bytes of text a group has on average.
GROUP_BYTES = 8 << 20
#: A place is a text's rank among those of its doc_id, and the number of a word.
WORD_BITS = 40
_WORD = (1 << WORD_BITS) - 1


def minimisers(hashes: np.ndarray, first: np.ndarray, k: int, g: int):
    """(first word, row, minimiser) of every window of k words; the minimiser's g-gram is one of
    the k-g+1 inside."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    if not len(rows):
        return np.zeros(0, np.int64), rows, np.zeros(0, np.uint64)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)
    all_at = np.arange(len(hashes) - g + 1)
    low = tc.rolling(hashes, all_at, all_at + g, 0x9FB21C651E98DF25 | 1)  # g-grams over row ends are in no window
    reach, width = low, k - g + 1
    step = 1
    while step * 2 <= width:
        reach = np.minimum(reach[:-step], reach[step:])
        step *= 2
    rest = width - step
    if rest:
        reach = np.minimum(reach[: len(reach) - rest], reach[rest:])
    return at, rows, reach[at]


# ---- groups of documents --------------------------------------------------------------------


def _squeeze(batches):
    """(d, fp, text, g) with the text compressed: what is dealt is as small as it can be."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    schema = pa.schema([("d", pa.int64()), ("fp", pa.int64()), ("z", pa.binary()), ("g", pa.int64())])
    for b in batches:
        z = pa.array([squeeze(t) for t in b.column(2).cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), z, b.column(3)], schema=schema)


def _group(d, groups: int):
    return F.pmod(F.xxhash64(d), F.lit(groups))


def _texts(table: pa.Table) -> pa.Array:
    expand = zstandard.ZstdDecompressor().decompress
    return pa.array([expand(z) for z in table["z"].to_pylist()], pa.large_binary())


def _ranks(table: pa.Table):
    """Of each row, the rank of its text's fingerprint among those of its doc_id (0 unless ids
    repeat), and whether it is the first row with both."""
    ids, prints = table["d"].to_numpy(), table["fp"].to_numpy()
    order = np.lexsort((prints, ids))
    d, f = ids[order], prints[order]
    new_d = _changes(d)
    new = new_d | _changes(f)
    at = np.cumsum(new) - 1
    rank, first = np.empty(len(ids), np.int64), np.empty(len(ids), bool)
    rank[order] = at - at[np.flatnonzero(new_d)][np.cumsum(new_d) - 1]
    first[order] = new
    return rank, first


def _changes(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


class _Windows:
    """The windows of a slice of a group's documents, equal rows once."""

    __slots__ = ("hashes", "at", "row", "seed", "d", "place")

    def __init__(self, hashes, at, row, seed, d, place):
        self.hashes, self.at, self.row, self.seed, self.d, self.place = hashes, at, row, seed, d, place

    def runs(self, inside: np.ndarray):
        """First window and end of every run of windows that are inside and have one seed."""
        head = inside & (_changes(self.seed) | _changes(self.row))
        head[1:] |= inside[1:] & ~inside[:-1]
        a = np.flatnonzero(head)
        ends = np.append(np.flatnonzero(~inside | head), len(inside))
        return a, ends[np.searchsorted(ends, a, side="right")]

    def spans(self, a: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Fingerprints of so many words from the first one of windows a."""
        return tc.sequence(self.hashes, self.at[a], self.at[a] + words)


def _windows(docs: pa.Table, k: int, gram: int):
    if not docs.num_rows:
        return
    ids = docs["d"].to_numpy()
    rank, first = _ranks(docs)
    for lo, _, buf, off in tc.slices(_texts(docs)):
        words = tc.words(buf, off)
        hashes = tc.fingerprints(buf, words.start, words.end)
        at, row, seed = minimisers(hashes, words.first, k, gram)
        one = first[lo + row]
        if not one.all():
            at, row, seed = at[one], row[one], seed[one]
        if len(at):
            yield _Windows(hashes, at, row, seed, ids[lo + row], (rank[lo + row] << WORD_BITS) | (at - words.first[row]))


# ---- what groups and buckets send -----------------------------------------------------------


def pack(arrays) -> bytes:
    """Equally long integer arrays as bytes, each as narrow as its range is."""
    parts = [np.int64(len(arrays[0])).tobytes()]
    for x in arrays:
        x = np.ascontiguousarray(x).view(np.int64)
        base = x.min() if len(x) else np.int64(0)
        y = (x - base).view(np.uint64)
        top = int(y.max()) if len(y) else 0
        width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        parts += [bytes((width,)), np.int64(base).tobytes(), y.astype(f"u{width}").tobytes()]
    return b"".join(parts)


def unpack(blobs: list[bytes]) -> list[np.ndarray]:
    """The arrays of several packs, each joined, as signed longs; none of no packs."""
    out: list[list] = []
    for blob in blobs:
        n, at, i = int(np.frombuffer(blob, np.int64, 1)[0]), 8, 0
        while at < len(blob):
            width, base = blob[at], np.frombuffer(blob[at + 1 : at + 9], np.int64)[0]
            y = np.frombuffer(blob, f"u{width}", n, at + 9)
            if i == len(out):
                out.append([])
            out[i].append(y.astype(np.uint64).view(np.int64) + base)
            at, i = at + 9 + n * width, i + 1
    return [np.concatenate(x) for x in out]


def _sizes(blobs: list[bytes]) -> np.ndarray:
    return np.array([int(np.frombuffer(b, np.int64, 1)[0]) for b in blobs], np.int64)


def _send(to: np.ndarray, arrays, **columns) -> pa.Table:
    """A table of packs of the arrays, one for each value of to, which is sorted."""
    start = np.flatnonzero(_changes(to)) if len(to) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(to)).astype(np.int64) if len(to) else start
    blobs = [pack([x[a:b] for x in arrays]) for a, b in zip(start.tolist(), end.tolist())]
    fixed = {n: pa.array(np.full(len(start), v, np.int64)) for n, v in columns.items()}
    return pa.table({"to": pa.array(to[start].astype(np.int64)), **fixed, "data": pa.array(blobs, pa.binary())})


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Sorted keys fall into buckets in order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


_SENT, _ANSWER = "to long, g long, data binary", "to long, kind long, data binary"


def _seeds(k: int, gram: int, buckets: int):
    """Of a group's documents, their seeds by bucket; those of several documents stand twice."""

    def run(docs: pa.Table) -> pa.Table:
        parts = [np.zeros((2, 0), np.uint64)]
        for w in _windows(docs, k, gram):
            new = _changes(w.seed) | _changes(w.row)
            parts.append(np.stack((w.seed[new], w.d[new].view(np.uint64))))
        seed, d = np.concatenate(parts, axis=1)
        order = np.lexsort((d, seed))
        seed, d = seed[order], d[order]
        seed = seed[_changes(seed) | _changes(d)]  # one row a document and seed
        keep = np.ones(len(seed), bool)
        keep[2:] = (seed[2:] != seed[1:-1]) | (seed[1:-1] != seed[:-2])
        seed = seed[keep]  # at most two rows a seed
        return _send(_bucket(seed, buckets), [seed], g=docs["g"][0].as_py())

    return run


def _shared(sent: pa.Table) -> pa.Table:
    """Of a bucket's seeds, those that stand twice or more, by group."""
    blobs = sent["data"].to_pylist()
    seed = unpack(blobs)[0].view(np.uint64)
    g = np.repeat(sent["g"].to_numpy(), _sizes(blobs))
    ordered = np.sort(seed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    hit = _among(seed, twice)
    g, seed = g[hit], seed[hit]
    order = np.lexsort((seed, g))
    g, seed = g[order], seed[order]
    new = _changes(g) | _changes(seed)
    return _send(g[new], [seed[new]], kind=0)


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which x are among the sorted values."""
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def _distinct(parts, g: int, buckets: int) -> pa.Table:
    """Packs by bucket of the distinct (k1, k2) of rows (k1, k2, d, place): with the smallest
    document, its first place, and the number of documents."""
    k1, k2, d, place = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.lexsort((place, d, k2, k1))
    k1, k2, d, place = k1[order], k2[order], d[order], place[order]
    new = _changes(k1) | _changes(k2)
    at = np.flatnonzero(new) if len(new) else np.zeros(0, np.int64)
    n = np.add.reduceat((new | _changes(d)).astype(np.int64), at) if len(at) else at
    return _send(_bucket(k1[at], buckets), [k1[at], k2[at], d[at], place[at], n], g=g)


def _runs(k: int, gram: int, buckets: int):
    """Of a group's shared seeds and its documents, the runs of windows with one of them."""

    def run(shared: pa.Table, docs: pa.Table) -> pa.Table:
        parts = []
        if shared.num_rows and docs.num_rows:
            hot = np.sort(unpack(shared["data"].to_pylist())[0].view(np.uint64))
            for w in _windows(docs, k, gram):
                a, b = w.runs(_among(w.seed, hot))
                parts.append((w.seed[a], w.spans(a, b - a + k - 1), w.d[a], w.place[a]))
        return _distinct(parts, docs["g"][0].as_py() if docs.num_rows else 0, buckets)

    return run


#: What an answer is about: a seed with one content or several, or a single edge.
SEEDS, EDGES = 1, 2


def _answers(kind: int):
    """Of what groups sent to a bucket, answers to each: (k1, k2, smallest document, place, documents).

    SEEDS: k1 is the seed; 0 documents say that its contents differ.  What one document alone
    holds gets no answer.
    """

    def run(sent: pa.Table) -> pa.Table:
        blobs = sent["data"].to_pylist()
        k1, k2, d, place, n = unpack(blobs)
        g = np.repeat(sent["g"].to_numpy(), _sizes(blobs))
        k1, k2 = k1.view(np.uint64), k2.view(np.uint64)
        order = np.lexsort((place, d, k2, k1))
        g, k1, k2, d, place, n = (x[order] for x in (g, k1, k2, d, place, n))
        new_key = _changes(k1)
        new = new_key | _changes(k2)
        at, of = np.flatnonzero(new), np.cumsum(new) - 1
        total = np.add.reduceat(n, at)[of]  # documents are in one group each
        d0, place0 = d[at][of], place[at][of]
        good = total > 1
        if kind == SEEDS:
            first, key_of = np.flatnonzero(new_key), np.cumsum(new_key) - 1
            differ = (np.add.reduceat(new.astype(np.int64), first) > 1)[key_of]
            alone = ((np.minimum.reduceat(d, first) == np.maximum.reduceat(d, first)) & (np.maximum.reduceat(n, first) == 1))[key_of]
            good = np.where(differ, ~alone, good)
            total, d0, place0, k2 = (np.where(differ, 0, x) for x in (total, d0, place0, np.zeros(len(k2), np.int64)))
            k2 = k2.view(np.uint64)
        g, k1, k2, d0, place0, total = (x[good] for x in (g, k1, k2, d0, place0, total))
        order = np.lexsort((k2, k1, g))
        g, k1, k2, d0, place0, total = (x[order] for x in (g, k1, k2, d0, place0, total))
        new = _changes(g) | _changes(k1) | _changes(k2)
        return _send(g[new], [x[new] for x in (k1, k2, d0, place0, total)], kind=kind)

    return run


def _edges(k: int, gram: int, buckets: int):
    """Of a group's answers on seeds and its documents, the edges whose seed's contents differ."""

    def run(answers: pa.Table, docs: pa.Table) -> pa.Table:
        parts = []
        if answers.num_rows and docs.num_rows:
            seed, _, _, _, n = unpack(answers["data"].to_pylist())
            mixed = np.sort(seed.view(np.uint64)[n == 0])
            for w in _windows(docs, k, gram):
                a = np.flatnonzero(_among(w.seed, mixed))
                parts.append((w.spans(a, k), w.seed[a], w.d[a], w.place[a]))
        return _distinct(parts, docs["g"][0].as_py() if docs.num_rows else 0, buckets)

    return run


# ---- the graph ------------------------------------------------------------------------------

#: kind PATH: a path from node a to node b, held by n documents, at its smallest document's place.
#: kind SPAN: windows of d at place that document a holds at its place b.  kind ASKED: distinct (a, b, windows) of a group.
PATH, SPAN, ASKED = 0, 1, 2
_FACTS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("d", pa.int64()), ("place", pa.int64()), ("windows", pa.int64()), ("n", pa.int64())])
_FACTS_SQL = "kind int, a long, b long, d long, place long, windows long, n long"


class _Table:
    """Answers, found by (k1, k2)."""

    def __init__(self, arrays):
        k1, k2, d, place, n = arrays or [np.zeros(0, np.int64)] * 5
        k1, k2 = k1.view(np.uint64), k2.view(np.uint64)
        order = np.lexsort((k2, k1))
        self.k1, self.k2, self.d, self.place, self.n = (x[order] for x in (k1, k2, d, place, n))

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Place in the table, or -1."""
        out = np.full(len(k1), -1)
        if not len(self.k1):
            return out
        at, todo = np.searchsorted(self.k1, k1), np.arange(len(k1))
        while len(todo):  # more than once only if k1 has several k2
            i = at[todo]
            same = (i < len(self.k1)) & (self.k1[np.minimum(i, len(self.k1) - 1)] == k1[todo])
            todo, i = todo[same], i[same]
            hit = self.k2[i] == k2[todo]
            out[todo[hit]] = i[hit]
            todo = todo[~hit]
            at[todo] += 1
        return out


def _facts(k: int, gram: int):
    """Of a group's answers and its documents: paths that it is the smallest holder of, and spans."""

    def run(answers: pa.Table, docs: pa.Table) -> pa.Table:
        paths, spans = [], []
        if answers.num_rows and docs.num_rows:
            kinds, blobs = answers["kind"].to_numpy(), answers["data"].to_pylist()
            seeds, edges = (_Table(unpack([b for b, x in zip(blobs, kinds) if x == kind])) for kind in (SEEDS, EDGES))
            for w in _windows(docs, k, gram):
                of = seeds.find(w.seed, np.zeros(len(w.seed), np.uint64))
                a, b = w.runs(of >= 0)
                owner, there, n = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
                i = np.flatnonzero(of >= 0)
                head = np.repeat(a, b - a)  # the run's first window, of each window i
                owner[i], n[i] = seeds.d[of[i]], seeds.n[of[i]]
                there[i] = seeds.place[of[i]] + i - head
                plain = n[a] > 0
                a, b = a[plain], b[plain]
                i = np.flatnonzero((of >= 0) & (n == 0))
                e = edges.find(w.spans(i, k), w.seed[i])
                i, e = i[e >= 0], e[e >= 0]
                owner[i], there[i], n[i] = edges.d[e], edges.place[e], edges.n[e]
                a, b = np.concatenate((a, i)), np.concatenate((b, i + 1))
                mine = (owner[a] == w.d[a]) & (there[a] == w.place[a])
                a, b = a[mine], b[mine]
                last = b - 1
                head_node, tail_node = w.spans(a, k - 1), tc.sequence(w.hashes, w.at[last] + 1, w.at[last] + k)
                paths.append((tc.long(head_node), tc.long(tail_node), w.d[a], w.place[a], b - a, n[a]))
                later = (n > 0) & (owner < w.d)
                head = later & (_changes(w.row) | _changes(owner) | _changes(there - np.arange(len(there))))
                head[1:] |= later[1:] & ~later[:-1]
                a = np.flatnonzero(head)
                ends = np.append(np.flatnonzero(~later | head), len(later))
                b = ends[np.searchsorted(ends, a, side="right")]
                spans.append((owner[a], there[a], w.d[a], w.place[a], b - a, np.zeros(len(a), np.int64)))
        if not paths:
            return _FACTS.empty_table()
        p, s = ([np.concatenate(x) for x in zip(*rows)] for rows in (paths, spans))
        order = np.lexsort((s[4], s[1], s[0]))
        one = order[_changes(s[0][order]) | _changes(s[1][order]) | _changes(s[4][order])]
        asked = [s[0][one], s[1][one], s[2][one], s[3][one], s[4][one], s[5][one]]
        kind = np.repeat(np.array([PATH, SPAN, ASKED], np.int32), [len(p[0]), len(s[0]), len(one)])
        return pa.Table.from_arrays([pa.array(kind), *(pa.array(np.concatenate(x)) for x in zip(p, s, asked))], schema=_FACTS)

    return run


def unitigs(paths: DataFrame) -> DataFrame:
    """(d, place, windows): paths (a, b, d, place, windows, n) compacted through nodes without branches.

    A node with one path in and one out, both held by equally many documents and adjacent in one
    document, joins them.  Runs of joined paths are one unitig at that document's coordinates.
    """
    end = lambda node, into, at: F.struct(F.col(node).alias("node"), F.lit(into).alias("into"), at.alias("at"))
    ends = paths.select(F.explode(F.array(end("b", 1, F.col("place") + F.col("windows")), end("a", 0, F.col("place")))).alias("e"), "d", "n").select("e.*", "d", "n")
    same = lambda c: F.min(c) == F.max(c)
    nodes = ends.groupBy("node").agg(F.sum("into").alias("ins"), F.count(F.lit(1)).alias("all"), (same("d") & same("n") & same("at")).alias("same"), F.min("d").alias("d"), F.min("at").alias("place"))
    inner = nodes.filter("ins = 1 AND all = 2 AND same").select("d", "place", F.lit(True).alias("inner"))
    joined = paths.select("d", "place", "windows").join(inner, ["d", "place"], "left")
    order = Window.partitionBy("d").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = joined.withColumn("unitig", F.count_if(F.col("inner").isNull()).over(order))
    return numbered.groupBy("d", "unitig").agg(F.min("place").alias("place"), F.sum("windows").alias("windows")).drop("unitig")


# ---- verified spans -------------------------------------------------------------------------


def _rows_of(docs: pa.Table) -> dict:
    """Rows by (doc_id, rank)."""
    out: dict = {}
    for i, x in enumerate(zip(docs["d"].to_pylist(), _ranks(docs)[0].tolist())):
        out.setdefault(x, []).append(i)
    return out


def _gathered(start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start[i] .. start[i] + lengths[i] - 1 of all i, in order."""
    ahead = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(start - ahead, lengths)


#: Words that are gathered at a time, which bounds the memory that a group's spans take.
AT_ONCE = 1 << 17


def _portions(sizes: np.ndarray):
    """(lo, hi) of runs of about AT_ONCE in all."""
    upto, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + AT_ONCE, side="right")))
        yield lo, hi
        lo = hi


def _before(d: np.ndarray, place: np.ndarray, at_d: np.ndarray, at_place: np.ndarray, equal: bool) -> np.ndarray:
    """How many of the pairs (d, place) are less than (equal: or the same as) each of the others."""
    n = len(d)
    late = np.concatenate((np.zeros(n, np.int8), np.full(len(at_d), 1 if equal else -1, np.int8)))
    order = np.lexsort((late, np.concatenate((place, at_place)), np.concatenate((d, at_d))))
    out = np.empty(n + len(at_d), np.int64)
    out[order] = np.cumsum(order < n)
    return out[n:]


def _words_of(k: int):
    """Of unitigs (to < 0), requests (to: the group that asks) and their documents, for each group
    that asks the words of all unitigs that its requests touch."""

    def run(asked: pa.Table, docs: pa.Table) -> pa.Table:
        to, d, place, windows = (asked[c].to_numpy() for c in ("to", "d", "place", "windows"))
        is_unitig = to < 0
        order = np.lexsort((place[is_unitig], d[is_unitig]))
        ud, up, un = (x[is_unitig][order] for x in (d, place, windows))
        if not len(ud) or is_unitig.all() or not docs.num_rows:
            return _send(np.zeros(0, np.int64), [])
        t, x, y, n = (c[~is_unitig] for c in (to, d, place, windows))
        lo = np.maximum(_before(ud, up, x, y, True) - 1, 0)
        n = np.maximum(_before(ud, up, x, y + n, False) - lo, 0)
        pairs = np.unique(np.stack((np.repeat(t, n), _gathered(lo, n))), axis=1)
        t, u = pairs
        start, stop = up[u], up[u] + un[u] + k - 1
        new = _changes(t) | _changes(ud[u])
        new[1:] |= start[1:] > stop[:-1]
        head = np.flatnonzero(new)
        t, x, start, n = t[head], ud[u][head], start[head], np.maximum.reduceat(stop, head) - start[head]
        rows = _rows_of(docs)
        row = np.array([rows[i, j][0] for i, j in zip(x.tolist(), (start >> WORD_BITS).tolist())], np.int64)
        (_, _, buf, off), = tc.slices(_texts(docs), 1 << 62)
        words = tc.words(buf, off)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        out_to, out = [], []
        for lo, hi in zip(np.flatnonzero(_changes(t)).tolist(), [*(np.flatnonzero(_changes(t))[1:]).tolist(), len(t)]):
            first, lengths, body = words.first[row[lo:hi]] + (start[lo:hi] & _WORD), [], []
            for i, j in _portions(n[lo:hi]):
                w = _gathered(first[i:j], n[lo + i : lo + j])
                lengths.append(words.end[w] - words.start[w])
                body.append(buf[_gathered(words.start[w], lengths[-1])].tobytes())
            head_ = pack([x[lo:hi], start[lo:hi], n[lo:hi]])
            sizes = pack([np.concatenate(lengths)])
            out_to.append(int(t[lo]))
            out.append(np.array([len(head_), len(sizes)], np.int64).tobytes() + head_ + sizes + squeeze(b"".join(body)))
        return pa.table({"to": pa.array(out_to, pa.int64()), "data": pa.array(out, pa.binary())})

    return run


class _Words:
    """Words of unitigs as other groups sent them."""

    def __init__(self, blobs: list[bytes]):
        heads, sizes, bodies = [], [], []
        for b in blobs:
            x, y = np.frombuffer(b, np.int64, 2).tolist()
            heads.append(b[16 : 16 + x])
            sizes.append(b[16 + x : 16 + x + y])
            bodies.append(zstandard.ZstdDecompressor().decompress(b[16 + x + y :]))
        d, place, n = unpack(heads) if heads else [np.zeros(0, np.int64)] * 3
        (lengths,) = unpack(sizes) if sizes else [np.zeros(0, np.int64)]
        self.buf = np.frombuffer(b"".join(bodies), np.uint8)
        self.end = np.cumsum(lengths)
        self.start = self.end - lengths
        first = np.cumsum(n) - n
        order = np.lexsort((place, d))
        self.d, self.place, self.first, self.n = d[order], place[order], first[order], n[order]

    def find(self, d: np.ndarray, place: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The first of n words of d from place on, or -1."""
        if not len(self.d):
            return np.full(len(d), -1)
        i = np.maximum(_before(self.d, self.place, d, place, True) - 1, 0)
        held = (self.d[i] == d) & (self.place[i] <= place) & (place + n <= self.place[i] + self.n[i])
        return np.where(held, self.first[i] + place - self.place[i], -1)


def equal_words(buf, start, end, other, other_start, other_end) -> np.ndarray:
    """Which words of two lists have the same bytes."""
    lengths = end - start
    same = lengths == other_end - other_start
    i = np.flatnonzero(same)
    n = lengths[i]
    differ = buf[_gathered(start[i], n)] != other[_gathered(other_start[i], n)]
    same[i[np.repeat(np.arange(len(i)), n)[differ]]] = False
    return same


def _cut(window: int):
    """Of a group's spans, the words sent to it and its documents: the texts without the spans."""
    schema = pa.schema([("d", pa.int64()), ("fp", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])

    def run(spans: pa.Table, docs: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        theirs = _Words([b for b in spans["data"].to_pylist() if b is not None])
        rows_of = _rows_of(docs)
        own: list[list] = [[] for _ in range(docs.num_rows)]
        own_spans = spans.filter(pa.compute.is_null(spans["data"]))
        a, b, d, place, n = (own_spans[c].to_numpy() for c in ("a", "b", "d", "place", "windows"))
        at = theirs.find(a, b, n + window - 1)
        found = at >= 0
        for x, y, z, m in zip(*(c[found].tolist() for c in (d, place, n, at))):
            for i in rows_of[x, y >> WORD_BITS]:
                own[i].append((y & _WORD, z, m))
        texts, n_words, n_removed = [], [], []
        for lo, hi, buf, off in tc.slices(_texts(docs)):
            words = tc.words(buf, off)
            total = np.zeros(len(words.start) + 1, np.int64)
            mine = [(words.first[i - lo] + s, n, at) for i in range(lo, hi) for s, n, at in own[i]]
            if mine:
                s, n, at = np.array(mine, np.int64).T
                for i, j in _portions(n + window - 1):
                    many = n[i:j] + window - 1
                    x, y = _gathered(s[i:j], many), _gathered(at[i:j], many)
                    wrong = np.concatenate(([0], np.cumsum(~equal_words(buf, words.start[x], words.end[x], theirs.buf, theirs.start[y], theirs.end[y]))))
                    first = _gathered(np.cumsum(many) - many, n[i:j])  # every window's first word, in x
                    stands = x[first[wrong[first + window] == wrong[first]]]
                    np.add.at(total, stands, 1)
                    np.add.at(total, stands + window, -1)
            gone = np.cumsum(total[:-1]) > 0
            texts += _joined(buf, words, ~gone)
            n_words.append(words.counts)
            n_removed.append(tc.segment_sum(gone.astype(np.int64), words.first))
        return pa.table([docs["d"].combine_chunks(), docs["fp"].combine_chunks(), pa.array(texts, pa.string()), pa.array(np.concatenate(n_words).astype(np.int64)), pa.array(np.concatenate(n_removed))], schema=schema)

    return run


def _joined(buf: np.ndarray, words: tc.Spans, keep: np.ndarray) -> list[str]:
    """Each row's kept words, joined by one space, by one gather over the bytes."""
    lengths = np.where(keep, words.end - words.start + 1, 0)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    source = _gathered(words.start, lengths)
    out = buf[np.minimum(source, len(buf) - 1)] if len(buf) else np.zeros(0, np.uint8)
    out[ends[1:][keep] - 1] = 32
    data = out.tobytes()
    at = ends[words.first]
    return [data[a : max(a, b - 1)].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def cut_texts(docs: DataFrame, doc_id="doc_id", text="text", window=WINDOW, gram=GRAM) -> DataFrame:
    """(d, fp, text, n_words, n_removed) of every row: d its key(doc_id), fp its text's fingerprint."""
    base = docs.select(key(quoted(doc_id)).alias("d"), whole(quoted(text)).alias("text"))
    n_bytes = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // GROUP_BYTES))
    small = base.select("d", F.xxhash64("text").alias("fp"), "text", _group(F.col("d"), groups).alias("g")).mapInArrow(_squeeze, "d long, fp long, z binary, g long")
    texts = small.repartition(groups, "g").groupBy("g")
    by = lambda sent: sent.groupBy("to")
    seeds = texts.applyInArrow(_seeds(window, gram, groups), _SENT)
    shared = by(seeds).applyInArrow(_shared, _ANSWER)
    runs = by(shared).cogroup(texts).applyInArrow(_runs(window, gram, groups), _SENT)
    answers = materialize(by(runs).applyInArrow(_answers(SEEDS), _ANSWER))
    edges = by(answers).cogroup(texts).applyInArrow(_edges(window, gram, groups), _SENT)
    more = by(edges).applyInArrow(_answers(EDGES), _ANSWER)
    facts = materialize(by(answers.unionByName(more)).cogroup(texts).applyInArrow(_facts(window, gram), _FACTS_SQL))
    of = lambda c: _group(F.col(c), groups)
    pieces = unitigs(facts.filter(F.col("kind") == PATH)).select(of("d").alias("g"), F.lit(-1).cast("long").alias("to"), "d", "place", "windows")
    asked = facts.filter(F.col("kind") == ASKED).select(of("a").alias("g"), of("d").alias("to"), F.col("a").alias("d"), F.col("b").alias("place"), "windows")
    words = pieces.unionByName(asked).groupBy("g").cogroup(texts).applyInArrow(_words_of(window), "to long, data binary")
    spans = facts.filter(F.col("kind") == SPAN).select(of("d").alias("to"), "a", "b", "d", "place", "windows")
    both = spans.unionByName(words, allowMissingColumns=True)
    return by(both).cogroup(texts).applyInArrow(_cut(window), "d long, fp long, text string, n_words long, n_removed long")


def dedup_texts(docs: DataFrame, doc_id="doc_id", text="text", window=WINDOW, gram=GRAM) -> DataFrame:
    """(doc_id, text, n_words, n_removed): dedup_substrings of two columns, by one shuffle of texts."""
    out = cut_texts(docs, doc_id, text, window, gram)
    return out.select("text", "n_words", "n_removed", F.when(F.col("d") != key(F.lit(None)), F.col("d")).alias("doc_id"))


def dedup_substrings(docs: DataFrame, doc_id="doc_id", text="text", window=WINDOW, gram=GRAM) -> DataFrame:
    """docs with repeated passages gone, and n_words and n_removed added.

    Every word covered by a window of `window` words that starts in a document with a smaller
    doc_id too is removed; kept words are joined by one space.
    """
    d, fp, body, n, m = fresh(docs, "join_d", "join_fp", "cut_text", "n_words", "n_removed")
    cut = cut_texts(docs, doc_id, text, window, gram).dropDuplicates(["d", "fp"]).select(F.col("d").alias(d), F.col("fp").alias(fp), F.col("text").alias(body), F.col("n_words").alias(n), F.col("n_removed").alias(m))
    keyed = docs.withColumns({d: key(quoted(doc_id)), fp: F.xxhash64(whole(quoted(text)))})
    joined = keyed.join(cut, [d, fp])
    return joined.select(*(quoted(body).alias(c) if c == text else quoted(c) for c in docs.columns), quoted(n), quoted(m))

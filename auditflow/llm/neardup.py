"""Near duplicates by SuperMinHash, banding, verification and union-find grouping.

One pass signs every text.  SuperMinHash gives each distinct shingle its own seeded random
permutation of the signature's slots and takes it step by step: at step j the shingle offers
j plus a fraction to its j-th slot.  Ranks of one shingle are thus correlated over the slots,
which lowers the estimate's variance, and a text is finished as soon as no slot can improve,
usually after a few steps for all of its shingles.

Texts with equal shingle sets (by 128-bit set fingerprints) form a class and go on as one.
Classes that share a band of their signatures are candidates; a bucket is never expanded into
all pairs.  First each member meets the bucket's smallest one.  Components of the confirmed
links follow, and only buckets that still hold several components are looked at again: their
strays meet the members of other components in blocks of bounded size, by signatures first.  Texts
go only to rows with a partner that could stand; there sets are intersected on the spot, best
estimates first, and only confirmed links come out, one for each stray and other component at most.  A pair counts only after its full sets were intersected.

Components come from alternating large-star and small-star contraction, all in joins and
aggregations; no task or driver holds the graph.

Defined cases: texts without words have empty sets and are linked with nothing.  Texts with
fewer words than a shingle have the whole sequence as their one shingle.  Rows without doc_id
are linked with nothing, get a null component and are kept.  Rows that repeat a doc_id with other
texts are one node of the graph, with the links of all its texts.  An empty table has no rows.  Very
long texts are signed one at a time.  Other columns pass through drop_near_copies, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from . import textcore as tc
from .columns import fresh, key, quoted, rekeyed, whole
from .store import materialize

SHINGLE, PERCENT = 4, 80
#: 24 bands of 4 slots: a pair at the bound shares none with probability 3e-6.
SLOTS, BANDS = 96, 24
#: Equal slots (of 96) under which a pair cannot stand for the bound: 6 deviations below 80 %.
LEAST_EQUAL = 52
BLOCK, PARTNERS = 512, 32

_SIGNED = pa.schema([("d", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int):
    """Distinct shingle fingerprints of every row, sorted within rows: (values, first of each row)."""
    low = tc.LOWER[buf]
    words = tc.words(low, off)
    hashes = tc.fingerprints(low, words.start, words.end)
    _, _, grams = tc.grams(hashes, words.first, k)
    counts = np.diff(words.first)
    short = (counts > 0) & (counts < k)
    n = np.maximum(counts - (k - 1), 0)
    bounds = np.concatenate(([0], np.cumsum(n)))
    sets = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    for i in np.flatnonzero(short).tolist():
        a, b = words.first[i : i + 1], words.first[i + 1 : i + 2]
        sets[i] = tc.sequence(hashes, a, b)
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    return np.concatenate(sets), first


def signatures(values: np.ndarray, first: np.ndarray, slots=SLOTS) -> np.ndarray:
    """SuperMinHash of every row: (rows, slots) of uint32, the step in the high byte."""
    n = len(first) - 1
    best = np.full((n, slots), 0xFFFFFFFF, np.uint32)
    row = np.repeat(np.arange(n), np.diff(first))
    e = values
    deck = np.tile(np.arange(slots, dtype=np.uint8), (len(e), 1))  # each element's permutation so far
    flat = best.reshape(-1)
    for j in range(slots):
        if not len(e):
            break
        r = tc.mix(e + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
        k = (j + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32))).astype(np.int64)
        at = np.arange(len(e))
        slot = deck[at, k]
        deck[at, k] = deck[:, j]
        offer = (np.uint32(j) << np.uint32(24)) | (r >> np.uint64(40)).astype(np.uint32)
        np.minimum.at(flat, row * slots + slot, offer)
        # a row is finished once every slot is below what the next step can offer
        going = (best.max(axis=1) > np.uint32((j + 1) << 24))[row] if j + 1 < slots else np.zeros(len(e), bool)
        if not going.all():
            e, row, deck = e[going], row[going], deck[going]
    return best


def band_keys(sig: np.ndarray, bands=BANDS) -> np.ndarray:
    n, slots = sig.shape
    wide = sig.reshape(n, bands, slots // bands).astype(np.uint64)
    out = np.zeros((n, bands), np.uint64)
    out += np.arange(bands, dtype=np.uint64)
    for i in range(wide.shape[2]):
        out = tc.mix(out * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, i])
    return out


def _sign(k: int):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in tc.slices(batch.column(2), tc.SLICE // 2):
                values, first = shingle_sets(buf, off, k)
                n = np.diff(first)
                sig = signatures(values, first)
                a = tc.segment_sum(tc.mix(values), first)
                b = tc.segment_sum(tc.mix(values ^ np.uint64(0x5851F42D4C957F2D)), first)
                keys = tc.long(band_keys(sig)).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
                low = np.ascontiguousarray((sig ^ (sig >> np.uint32(8)) ^ (sig >> np.uint32(16))).astype(np.uint8))
                text = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.arange(0, low.size + 1, SLOTS, dtype=np.int32)), pa.py_buffer(low)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(tc.long(a)), pa.array(tc.long(b)), lists, text], schema=_SIGNED)

    return tc.tidy(run)


def _lanes(column) -> np.ndarray:
    column = column.cast(pa.binary())
    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(len(column), SLOTS)


def _promising(batches):
    """Of (a, b, signature of a, signature of b), the pairs whose estimate could stand."""
    for batch in batches:
        if batch.num_rows:
            ok = (_lanes(batch.column(2)) == _lanes(batch.column(3))).sum(axis=1) >= LEAST_EQUAL
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])


def _confirm(k: int, percent: int):
    """Of (a, b, text of a, text of b), the pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            sets = []
            for c in (2, 3):
                own = []
                for _, _, buf, off in tc.slices(batch.column(c)):
                    values, first = shingle_sets(buf, off, k)
                    own += [values[x:y] for x, y in zip(first[:-1], first[1:])]
                sets.append(own)
            ok = []
            for x, y in zip(*sets):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return tc.tidy(run)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the smallest node it is connected with.

    Alternating large-star and small-star contraction, until every node points to one root that
    points to none.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        ends = e.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.lit(0)).unionByName(e.select(F.col("b").alias("a"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("r")).distinct())
        if not ends.groupBy("a").agg(F.max("n").alias("n"), F.max("r").alias("r")).filter("n > 1 OR (n = 1 AND r = 1)").take(1):
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(rekeyed(F.col("a")).alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, rekeyed(F.col("a")) == F.col("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.select(rekeyed(F.col("a")).alias("k"), "m"), rekeyed(F.col("a")) == F.col("k")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(small.unionByName(least.withColumnRenamed("m", "b")).filter("a <> b").distinct())
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.withColumn("root", F.col("node")))


def _linked(stray: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are similar enough to one: all counted by one search."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    hit = stray[np.minimum(np.searchsorted(stray, flat), len(stray) - 1)] == flat
    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(stray) + sizes - both)


def _across(k: int, percent: int):
    """Confirmed links (a, b) across components within the blocks of a bucket.

    Rows come sorted by (key, sb, rb), with d, comp, band, bands, sig, text, and side (0: stray,
    1: any member).  A pair is looked at in the first of its shared bands only.  Of each stray
    and other component one link is enough, so partners are taken best estimates first, until
    one stands or all that could stand have been intersected.
    """

    def compare(d, comp, side, band, bands, sig, sets):
        s, m = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for i in s.tolist():
            equal = (sig[m] == sig[i]).sum(axis=1)
            ok = (equal >= LEAST_EQUAL) & (comp[m] != comp[i])
            if band:
                ok &= ~(bands[m, :band] == bands[i, :band]).any(axis=1)
            ok = np.flatnonzero(ok)
            order = np.lexsort((d[m[ok]], -equal[ok]))
            todo = m[ok[order]]
            while len(todo):
                now = todo[:PARTNERS]
                good = now[_linked(sets[i], [sets[j] for j in now.tolist()], percent)]
                _, first = np.unique(comp[good], return_index=True)
                for j in good[first].tolist():
                    yield max(d[i], d[j]), min(d[i], d[j])
                todo = todo[PARTNERS:]
                todo = todo[~np.isin(comp[todo], comp[good])]

    def run(batches):
        for done, bounds in _blocks(batches):
            d, comp, side, band = (done[c].to_numpy() for c in ("d", "comp", "side", "band"))
            sig, bands = _signed_by(done)
            sets = []
            for _, _, buf, off in tc.slices(done["text"]):
                values, first = shingle_sets(buf, off, k)
                sets += [values[x:y] for x, y in zip(first[:-1], first[1:])]
            found = [p for x, y in zip(bounds[:-1], bounds[1:]) for p in compare(d[x:y], comp[x:y], side[x:y], int(band[x]), bands[x:y], sig[x:y], sets[x:y])]
            pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return tc.tidy(run)


def _signed_by(t: pa.Table):
    return _lanes(t["sig"].chunk(0)), pa.compute.list_flatten(t["bands"].chunk(0)).to_numpy().reshape(t.num_rows, BANDS)


def _blocks(batches):
    """(rows, bounds) of whole blocks, from rows sorted by (key, sb, rb)."""
    held = None
    for batch in _with_end(batches):
        if batch is not None:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        else:
            t = held
        if t is None or not t.num_rows:
            continue
        keys = np.stack([t[c].to_numpy() for c in ("key", "sb", "rb")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist()] + ([t.num_rows] if batch is None else [])
        held = None if batch is None else t.slice(bounds[-1])
        if len(bounds) > 1:
            yield t.slice(0, bounds[-1]).combine_chunks(), bounds


def _hopeful(batches):
    """Of the blocks' rows, without texts, those with a partner that could stand: a bucket of
    members that are not alike ends here."""
    for done, bounds in _blocks(batches):
        comp, side, band = (done[c].to_numpy() for c in ("comp", "side", "band"))
        sig, bands = _signed_by(done)
        keep = np.zeros(done.num_rows, bool)
        for x, y in zip(bounds[:-1], bounds[1:]):
            s, m = x + np.flatnonzero(side[x:y] == 0), x + np.flatnonzero(side[x:y] == 1)
            for i in s.tolist():
                ok = ((sig[m] == sig[i]).sum(axis=1) >= LEAST_EQUAL) & (comp[m] != comp[i])
                if band[x]:
                    ok &= ~(bands[m, : band[x]] == bands[i, : band[x]]).any(axis=1)
                keep[i] = ok.any()
                keep[m[ok]] = True
        yield from done.filter(pa.array(keep)).to_batches()


def _with_end(batches):
    yield from batches
    yield None


def _cross_links(members: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket of members (key, band, d)."""
    comp = members.join(labels, F.col("d") == F.col("node"), "left").select("key", "band", "d", F.coalesce("root", "d").alias("comp"))
    sizes = comp.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("most"))
    buckets = buckets.filter("comps > 1").select(rekeyed(F.col("key")).alias("k"), F.col("most.comp").alias("main"), F.greatest(F.lit(1), F.ceil(F.col("all") / BLOCK)).cast("long").alias("rs"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most.n")) / BLOCK)).cast("long").alias("ss"))
    x = materialize(comp.join(buckets, rekeyed(F.col("key")) == F.col("k")).drop("k"))
    place = lambda n: F.pmod(F.xxhash64("d"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    stray = x.filter("comp <> main").select("key", place("ss").alias("sb"), every("rs").alias("rb"), "band", "d", "comp", F.lit(0).alias("side"))
    others = x.select("key", every("ss").alias("sb"), place("rs").alias("rb"), "band", "d", "comp", F.lit(1).alias("side"))
    dealt = lambda df: df.repartition("key", "sb", "rb").sortWithinPartitions("key", "sb", "rb")
    signed = dealt(stray.unionByName(others).join(classes.select("d", "sig", "bands"), "d").select("key", "sb", "rb", "band", "d", "comp", "side", "sig", "bands"))
    hopeful = materialize(signed.mapInArrow(tc.tidy(_hopeful), "key long, sb long, rb long, band int, d long, comp long, side int, sig binary, bands array<long>"))
    both = dealt(hopeful.join(texts, "d"))  # texts only for rows with a partner that could stand
    return materialize(both.mapInArrow(_across(k, percent), "a long, b long").distinct())


def near_groups(docs: DataFrame, doc_id="doc_id", text="text", shingle=SHINGLE, percent=PERCENT) -> DataFrame:
    """(d, fp, n, component): of every row its key(doc_id), text fingerprint, set size, component."""
    base = docs.select(key(quoted(doc_id)).alias("d"), F.xxhash64(whole(quoted(text))).alias("fp"), whole(quoted(text)).alias("text"))
    signed = materialize(base.mapInArrow(_sign(shingle), "d long, fp long, n long, s1 long, s2 long, bands array<long>, sig binary"))
    linked = signed.filter((F.col("n") > 0) & (F.col("d") != key(F.lit(None))))
    # a class is a node with a number of its own, as a doc_id may stand on several texts
    found = linked.groupBy("n", "s1", "s2").agg(F.min(F.struct("d", "fp", "sig", "bands")).alias("r"))
    classes = materialize(found.select(F.monotonically_increasing_id().alias("d"), "n", "s1", "s2", F.col("r.d").alias("doc"), "r.fp", "r.sig", "r.bands"))
    sigs = classes.select("d", "sig")
    buckets = classes.select(F.posexplode("bands").alias("band", "key"), "d")
    pivots = buckets.groupBy("key").agg(F.min("d").alias("p"), F.max("d").alias("q")).filter("p <> q").select(rekeyed(F.col("key")).alias("k"), "p")
    members = materialize(buckets.join(pivots, rekeyed(F.col("key")) == F.col("k")).select("key", "band", "d", "p"))
    sig_of = lambda c: sigs.select(F.col("d").alias(c), F.col("sig").alias(f"sig_{c}"))
    pairs = members.filter("d <> p").select(F.col("d").alias("a"), F.col("p").alias("b")).distinct()
    pairs = pairs.join(sig_of("a"), "a").join(sig_of("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(tc.tidy(_promising), "a long, b long")
    # the texts of all candidates, fetched once
    wanted = members.select("d").distinct().join(classes.select("d", "doc", "fp"), "d").withColumnRenamed("d", "class")
    texts = base.withColumnRenamed("d", "doc").join(wanted, ["doc", "fp"])
    texts = materialize(texts.groupBy(F.col("class").alias("d")).agg(F.min("text").alias("text")))
    text_of = lambda c: texts.select(F.col("d").alias(c), F.col("text").alias(f"text_{c}"))

    def confirmed(pairs):
        return pairs.join(text_of("a"), "a").join(text_of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(shingle, percent), "a long, b long")

    links = materialize(confirmed(pairs))
    more = _cross_links(members.select("key", "band", "d"), components(links), classes, texts, shingle, percent)
    # rows of one doc_id are one node of the graph: its classes are linked
    key_of = F.struct("n", "s1", "s2")
    several = linked.groupBy("d").agg(F.min(key_of).alias("x"), F.max(key_of).alias("y")).filter("x <> y").select("d")
    own = linked.join(several, "d", "left_semi").select("d", "n", "s1", "s2").distinct()
    own = materialize(own.join(classes.select("n", "s1", "s2", F.col("d").alias("class")), ["n", "s1", "s2"]).select("d", "class"))
    least = own.groupBy("d").agg(F.min("class").alias("b")).select(rekeyed(F.col("d")).alias("k"), "b")
    same = own.join(least, rekeyed(F.col("d")) == F.col("k")).filter("class <> b").select(F.col("class").alias("a"), "b")
    labels = components(links.unionByName(more).unionByName(same))
    rooted = materialize(classes.join(labels, F.col("d") == F.col("node"), "left").select("n", "s1", "s2", "doc", F.coalesce("root", "d").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("doc").alias("component")).select(rekeyed(F.col("root")).alias("k"), "component")
    named = rooted.join(lowest, rekeyed(F.col("root")) == F.col("k")).select("n", "s1", "s2", "component")
    done = linked.drop("bands", "sig").join(named, ["n", "s1", "s2"]).select("d", "fp", "n", "component")
    rest = signed.filter(~((F.col("n") > 0) & (F.col("d") != key(F.lit(None))))).select("d", "fp", "n", F.when(F.col("d") != key(F.lit(None)), F.col("d")).alias("component"))
    return done.unionByName(rest)


def near_components(docs: DataFrame, doc_id="doc_id", text="text", shingle=SHINGLE, percent=PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    g = near_groups(docs, doc_id, text, shingle, percent)
    own = F.when(F.col("d") != key(F.lit(None)), F.col("d"))
    return g.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(own == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, doc_id="doc_id", text="text", shingle=SHINGLE, percent=PERCENT) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; columns unchanged."""
    gone = near_groups(docs, doc_id, text, shingle, percent).filter("component <> d").select("d", "fp").distinct()
    a, b = fresh(docs, "join_d", "join_fp")
    keyed = docs.withColumns({a: key(quoted(doc_id)), b: F.xxhash64(whole(quoted(text)))})
    return keyed.join(gone.toDF(a, b).hint("shuffle_hash"), [a, b], "left_anti").select(*map(quoted, docs.columns))

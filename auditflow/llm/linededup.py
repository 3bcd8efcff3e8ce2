"""Line dedup over range-partitioned line fingerprints.

Every line of at least ``min_chars`` code points becomes a row (128-bit key, document,
text fingerprint, position).  Rows are range-partitioned by (key, document) and sorted
within partitions by position too, so that equal lines stand together in document order
and a very common line spreads over as many partitions as it needs.  One pass streams each
partition and holds back no more than the lines of the first few documents of a run and of
its latest document.  A run that touches the edge of a partition may go on in the next one;
what it leaves undecided (the lines of at most ``min_docs`` documents) is settled by the
joined counts of such runs, two a partition at most.

Decisions come back as one compressed keep bitmap per document; text never takes part in
the sort, and is read again only where the bitmaps are applied.

Defined cases: null or empty text is one empty line.  Null doc_ids are one document before
all others.  Rows that repeat a doc_id belong to one document; each row has its own bitmap
by its text.  An empty table has no rows.  Very long texts are split one at a time, their lines are
rows like others.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textcore as tc
from .columns import fresh, key, quoted, whole
from .store import materialize

MIN_CHARS, MIN_DOCS = 40, 5

_LINES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("d", pa.int64()), ("fp", pa.int64()), ("pos", pa.int32())])


def line_keys(buf: np.ndarray, off: np.ndarray):
    """Lines, the bounds of their stripped keys, the keys' code points, and low-case bytes."""
    low = tc.LOWER[buf]
    lines = tc.lines(buf, off)
    ink = np.flatnonzero(~tc.SPACE[buf])
    a, b = np.searchsorted(ink, lines.start), np.searchsorted(ink, lines.end)
    some = b > a
    start, end = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    start[some], end[some] = ink[a[some]], ink[b[some] - 1] + 1
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    return lines, start, end, points[end] - points[start], low


def _extract(min_chars: int):
    def run(batches):
        for batch in batches:
            ids, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, buf, off in tc.slices(batch.column(2)):
                lines, start, end, chars, low = line_keys(buf, off)
                pick = np.flatnonzero(chars >= min_chars)
                if not len(pick):
                    continue
                rows = lines.rows[pick]
                k = [tc.long(tc.fingerprints(low, start[pick], end[pick], w)) for w in (0, 1)]
                pos = (pick - lines.first[rows]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*k, ids[lo:hi][rows], prints[lo:hi][rows], pos)], schema=_LINES)

    return tc.tidy(run)


#: state: 1 a line to drop, 0 a line that is undecided, 2 counts of a run at an edge
_STATES = pa.schema([*_LINES, ("state", pa.int8()), ("docs", pa.int64())])


def _stream(min_docs: int):
    """Stream sorted lines; see the module's text."""

    def rows(x, state):
        n = len(x[0])
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in x), pa.array(np.full(n, state, np.int8)), pa.array(np.zeros(n, np.int64))], schema=_STATES)

    def run(batches):
        held = [np.zeros(0, t) for t in (np.int64,) * 4 + (np.int32,)]  # undecided lines of the open run
        seen, latest, head, first = 0, 0, None, True  # documents of the open run, its last one, its key

        def edge():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((head[0], head[1], latest, 0, 0, 2, seen), _STATES.types)], schema=_STATES)

        for batch in batches:
            if not batch.num_rows:
                continue
            x = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
            k1, k2, d = x[:3]
            carried = len(held[0])
            new_key = np.ones(len(d), bool)
            new_key[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            new_doc = new_key.copy()
            new_doc[1:] |= d[1:] != d[:-1]
            run_of = np.cumsum(new_key) - 1
            starts = np.flatnonzero(new_key)
            # documents of each run, counting those of the open run that were decided before
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            if head is not None and (k1[0], k2[0]) == head:
                docs[0] += seen - int(new_doc[:carried].sum())
            elif head is not None and not carried:
                raise AssertionError("an open run always holds its latest document")
            ends = np.append(starts[1:], len(d)) - 1
            last = d[ends][run_of]
            drop = (docs[run_of] >= min_docs) & (d != last)
            open_from = starts[-1]
            if first and len(starts) > 1:  # the first run is over, at an edge
                rest = (run_of == 0) & ~drop
                yield rows([c[rest] for c in x], 0)
                head, latest, seen, first = (int(k1[0]), int(k2[0])), int(d[ends[0]]), int(docs[0]), False
                yield edge()
            if drop.any():
                yield rows([c[drop] for c in x], 1)
            keep = ~drop
            keep[:open_from] = False
            held = [c[keep] for c in x]
            head, latest, seen = (int(k1[-1]), int(k2[-1])), int(d[-1]), int(docs[-1])
        if head is not None:
            yield rows(held, 0)
            yield edge()

    return tc.tidy(run)


def _bitmaps(batches):
    schema = pa.schema([("d", pa.int64()), ("fp", pa.int64()), ("keep_bitmap", pa.binary())])
    for batch in batches:
        out = []
        for at in batch.column(2):
            at = at.values.to_numpy()
            bits = np.ones((int(at.max()) // 8 + 1) * 8, np.uint8)  # whole bytes, so that padding keeps lines
            bits[at] = 0
            out.append(zlib.compress(np.packbits(bits).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], schema=schema)


def keep_bitmaps(docs: DataFrame, doc_id="doc_id", text="text", min_chars=MIN_CHARS, min_docs=MIN_DOCS) -> DataFrame:
    """(d, fp, keep_bitmap) of each document that loses lines.

    d is the doc_id (NULL_ID for null), fp xxhash64 of the text, keep_bitmap zlib over packed
    bits, 0 where the line goes; lines past its end stay.
    """
    body = whole(quoted(text))
    lines = docs.select(key(quoted(doc_id)).alias("d"), F.xxhash64(body).alias("fp"), body.alias("t")).mapInArrow(_extract(min_chars), "k1 long, k2 long, d long, fp long, pos int")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["k1", "k2", "d", "fp", "pos"]
    states = materialize(lines.repartitionByRange(n, "k1", "k2", "d").sortWithinPartitions(*order).mapInArrow(_stream(min_docs), "k1 long, k2 long, d long, fp long, pos int, state byte, docs long"))
    edges = states.filter("state = 2").groupBy("k1", "k2").agg(F.sum("docs").alias("n"), F.max("d").alias("last")).filter(F.col("n") >= min_docs)
    settled = states.filter("state = 0").join(edges, ["k1", "k2"]).filter("d <> last")
    drops = states.filter("state = 1").select("d", "fp", "pos").unionByName(settled.select("d", "fp", "pos"))
    return drops.groupBy("d", "fp").agg(F.collect_set("pos").alias("at")).mapInArrow(_bitmaps, "d long, fp long, keep_bitmap binary")


def _apply(names: list[str], text: str, more: list[str]):
    def run(batches):
        for batch in batches:
            maps = batch.column(batch.num_columns - 1)
            body = batch.column(names.index(text))
            texts = body.to_pylist()
            n_lines, n_dropped = np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64)
            changed = False
            for i, t in enumerate(texts):
                if t is not None:
                    n_lines[i] = t.count("\n") + 1
                if (m := maps[i].as_py()) is not None:
                    parts = (t or "").split("\n")
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(m), np.uint8))[: len(parts)]
                    keep = np.concatenate((keep, np.ones(len(parts) - len(keep), np.uint8)))
                    texts[i] = "\n".join(p for p, k in zip(parts, keep) if k)
                    n_dropped[i] = len(parts) - int(keep.sum())
                    changed = True
            columns = [*batch.columns[:-1]]
            if changed:
                columns[names.index(text)] = pa.array(texts, body.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_dropped)], names=[*names, *more])

    return tc.tidy(run)


def dedup_lines(docs: DataFrame, doc_id="doc_id", text="text", min_chars=MIN_CHARS, min_docs=MIN_DOCS) -> DataFrame:
    """docs with the repeated lines gone from the text, and n_lines and n_dropped added.

    The key of a line is the line stripped of white space, A-Z in lower case.  Keys of at
    least min_chars code points that min_docs documents hold lose their lines except in the
    largest doc_id.  A text that loses no line is unchanged (null stays null).
    """
    a, b, c = fresh(docs, "join_d", "join_fp", "keep_bitmap")
    maps = keep_bitmaps(docs, doc_id, text, min_chars, min_docs).toDF(a, b, c)
    keyed = docs.withColumns({a: key(quoted(doc_id)), b: F.xxhash64(whole(quoted(text)))})
    joined = keyed.join(maps.hint("shuffle_hash"), [a, b], "left").select(*map(quoted, docs.columns), quoted(c))
    more = fresh(docs, "n_lines", "n_dropped")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return joined.mapInArrow(_apply(docs.columns, text, more), ", ".join([*fields, *(f"`{m}` long" for m in more)]))

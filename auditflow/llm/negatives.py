"""Hard-negative mining with a vector-approximation file.

Each dimension is cut into cells, and every vector is kept twice: whole, and as one cell number a
dimension.  Of a cell, a table knows the least and the greatest component in it; so the table
gives a lower and an upper bound of any inner product from the approximation alone.  The bounds
decide which vectors could enter a request's window; the whole vectors of those, and of no
others, are fetched by a join and scored exactly.

A request asks for the k best rows of one label, or of all others, with a score between two
numbers.  Requests meet rows in tiles: rows are dealt into groups, requests into blocks, and each
pair of a group and a block is one group of a cogrouped Arrow function, all of them in one job.
No tile grows with the input.  Within a tile a row survives if its upper bound reaches the k-th
largest lower bound of the rows that are surely in the window; over all tiles the same threshold
is taken once more before whole vectors are fetched.  Bounds only rule out what cannot win, so
results are exact whatever the cells are; they are fitted on a bounded sample.

Mining asks twice: first for each anchor's positives, the best rows of its label, then for each
positive's negatives, rows of other labels whose score is a given share of the positive's.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no
part; the shorter of two vectors counts as padded with zeros.  Rows that share the anchor's id are
the anchor's own and neither positive nor negative; of repeated anchors the one with the smallest
label and components stands for the id.  Other repeated rows are rows of their own, and take a rank
each.  Positives with a negative score have no window and no rows.  A score past 64 bits counts as
the nearest long, a component past 1e150 as 1e150.  No rows, no labels but one, or no anchors give
no rows.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .columns import quoted
from .store import materialize
from .topk import EXACT, SCALE, _matrix, exact_scores

ANCHOR_EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: Cells a dimension, one byte each.
CELLS = 256
#: Random rows, about this many, whose components the cells are fitted on.
SAMPLE = 4096
#: Rows in a group and requests in a block, on average; small tables make at least so many groups.
GROUP, BLOCK, GROUPS = 32_768, 2048, 12
#: Within a tile, so many requests meet so many rows at a time.
REQUESTS, ROWS = 128, 4096
_LONG, _CUT = (1 << 63) - 1, float(1 << 63)
#: Components past this count as this, so that no bound is infinite.
_FAR = 1e150

_FOUND = pa.schema([("request", pa.int64()), ("anchor_id", pa.int64()), ("row", pa.int64()), ("low", pa.float64()), ("sure", pa.bool_()), ("high", pa.float64())])
_SQL_FOUND = "request long, anchor_id long, row long, low double, sure boolean, high double"


def labelled(df: DataFrame, vec_id="vec_id", label="label", embedding="embedding", scale=SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; the floors of v are the components."""
    x = F.transform(quoted(embedding), lambda c: c.cast("double"))
    ok = quoted(embedding).isNotNull() & quoted(vec_id).isNotNull() & quoted(label).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.filter(ok).select(quoted(vec_id).cast("long").alias("vec_id"), quoted(label).cast("long").alias("label"), F.transform(x, lambda c: F.greatest(F.least(c * scale, F.lit(_FAR)), F.lit(-_FAR))).alias("v"))


def with_noise(x: DataFrame, every=7, labels=10) -> DataFrame:
    """x with the label of each row whose id `every` divides moved on to the next."""
    return x.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


class Cells:
    """Cuts of each dimension, and the least and greatest component of each cell."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, cells: int):
        self.cuts, self.low, self.high = [], np.zeros((len(least), cells)), np.zeros((len(least), cells))
        for d, (lo, hi) in enumerate(zip(least, most)):
            a, b = np.quantile(sample[d], (0.01, 0.99)) if sample.shape[1] else (lo, hi)
            reach = (b - a) / 2
            cuts = np.unique(np.ceil(np.linspace(max(a - reach, lo), min(b + reach, hi), cells - 1)))
            self.cuts.append(cuts)
            edges = np.concatenate(([lo], np.clip(cuts, lo, hi + 1), [hi + 1]))
            n = len(edges) - 1
            self.low[d, :n], self.high[d, :n] = edges[:-1], np.maximum(edges[1:] - 1, edges[:-1])
            self.high[d, n - 1] = hi

    def of(self, m: np.ndarray) -> np.ndarray:
        """Cell numbers, (dimensions, rows) as bytes."""
        return np.stack([np.searchsorted(c, x, side="right") for c, x in zip(self.cuts, m)]).astype(np.uint8) if len(m) else np.zeros(m.shape, np.uint8)

    def bounds(self, q: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of columns of q with approximated rows.

        A component q meets a cell from lo to hi: q * (lo + hi) / 2 give or take |q| * (hi - lo) / 2.
        Both halves come out of the table by the cell's number.
        """
        d = np.arange(len(cells))[:, None]
        lo, hi = self.low[d, cells], self.high[d, cells]
        middle, give = q.T @ ((lo + hi) / 2), np.abs(q).T @ ((hi - lo) / 2)
        give += (np.abs(q).T @ np.maximum(np.abs(lo), np.abs(hi))) * 1e-9 + 1e-6  # rounding of the sums
        return np.clip(middle - give, -_CUT, _CUT), np.clip(middle + give, -_CUT, _CUT)


def _spans(width: int):
    """Least and greatest component of each dimension in a task's rows."""

    def run(batches):
        least, most, n = np.full(width, np.inf), np.full(width, -np.inf), 0
        for batch in batches:
            m = _matrix(batch.column(0), width)
            if m.size:
                least, most = np.minimum(least, m.min(axis=1)), np.maximum(most, m.max(axis=1))
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(least), pa.array(most)], names=["d", "least", "most"])

    return run


def fit(x: DataFrame, n: int, cells=CELLS, sample=SAMPLE) -> Cells:
    """Cells for the n vectors of x."""
    width = x.agg(F.max(F.size("v"))).first()[0]
    spans = x.select("v").mapInArrow(_spans(width), "d int, least double, most double").groupBy("d").agg(F.min("least").alias("least"), F.max("most").alias("most")).orderBy("d").collect()  # a row a dimension
    some = x.filter(F.rand(11) < sample / n).limit(2 * sample).select("v").toArrow().column(0)
    some = _matrix(some.combine_chunks(), width) if len(some) else np.zeros((width, 0))
    return Cells(some, np.array([r.least for r in spans]), np.array([r.most for r in spans]), cells)


def _approximate(shared):
    """Cell numbers beside the vectors."""

    def run(batches):
        cells = shared.value
        for batch in batches:
            m = _matrix(batch.column(2), len(cells.cuts))
            code = np.ascontiguousarray(cells.of(m).T)
            v = pa.ListArray.from_arrays(pa.array(np.arange(m.shape[1] + 1, dtype=np.int32) * len(m)), pa.array(m.T.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), v, pa.array([row.tobytes() for row in code], pa.binary())], names=["vec_id", "label", "v", "code"])

    return run


def va_file(x: DataFrame, shared, groups: int) -> DataFrame:
    """(row, g, vec_id, label, v, code), written: every row with a number of its own and its group."""
    coded = x.mapInArrow(_approximate(shared), "vec_id long, label long, v array<double>, code binary")
    return materialize(coded.withColumn("row", F.monotonically_increasing_id()).withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")))


class Tile:
    """Rows that may win, for a block of requests; rows come a batch at a time."""

    def __init__(self, anchors, labels, low, high, q, cells: Cells, k: int, same: bool):
        self.anchors, self.labels, self.lo, self.hi = anchors, labels, low, high
        self.q, self.cells, self.k, self.same = q, cells, k, same
        self.best = np.full((len(anchors), k), -np.inf)  # largest lower bounds of rows surely in the window
        self.found: list[tuple] = []

    def add(self, ids, labels, rows, code):
        for at in range(0, len(self.anchors), REQUESTS):
            part = slice(at, at + REQUESTS)
            _, one, back = np.unique(self.anchors[part], return_index=True, return_inverse=True)
            low, high = (b[back] for b in self.cells.bounds(self.q[:, part][:, one], code))
            fits = (self.labels[part, None] == labels[None, :]) == self.same
            fits &= self.anchors[part, None] != ids[None, :]
            lo, hi = self.lo[part, None], self.hi[part, None]
            may = fits & (high >= lo) & (low <= hi)
            sure = may & (low >= lo) & (high <= hi)
            known = np.concatenate((self.best[part], np.where(sure, low, -np.inf)), axis=1)
            self.best[part] = np.partition(known, -self.k, axis=1)[:, -self.k :]
            r, c = np.nonzero(may & (high >= self.best[part].min(axis=1)[:, None]))
            self.found.append((r + at, rows[c], low[r, c], sure[r, c], high[r, c]))

    def survivors(self):
        parts = [np.concatenate(x) for x in zip(*self.found)] if self.found else [np.zeros(0, np.int64)] * 5
        keep = parts[4] >= self.best.min(axis=1)[parts[0]] if len(parts[0]) else slice(0)
        return [x[keep] for x in parts]


def _tiled(shared, k: int, same: bool):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return _FOUND.empty_table()
        cells = shared.value
        width = len(cells.cuts)
        asked = asked.sort_by("anchor_id").combine_chunks()  # an anchor's requests side by side
        tile = Tile(*(asked[c].to_numpy() for c in ("anchor_id", "label", "lo", "hi")), _matrix(asked["v"].chunk(0), width), cells, k, same)
        number = asked["request"].to_numpy()
        for batch in rows.combine_chunks().to_batches(ROWS):
            by = dict(zip(batch.schema.names, batch.columns))
            code = np.frombuffer(b"".join(by["code"].to_pylist()), np.uint8).reshape(-1, width).T
            tile.add(by["vec_id"].to_numpy(), by["label"].to_numpy(), by["row"].to_numpy(), code)
        at, row, low, sure, high = tile.survivors()
        return pa.Table.from_arrays([pa.array(number[at]), pa.array(tile.anchors[at]), pa.array(row), pa.array(low), pa.array(sure), pa.array(high)], schema=_FOUND)

    return run


_SCORED = pa.schema([("request", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of columns, exact, cut to 64 bits."""
    if float((np.abs(a) * np.abs(b)).sum(axis=0).max(initial=0)) < EXACT:
        return (a * b).sum(axis=0).astype(np.int64)
    return exact_scores(a, b).astype(np.int64)


def _score(batches):
    """Exact scores of fetched pairs."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            width = max(int(np.diff(np.asarray(batch.column(i).offsets)).max(initial=0)) for i in (2, 3))
            score = products(_matrix(batch.column(2), width), _matrix(batch.column(3), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], schema=_SCORED)


def answer(file: DataFrame, requests: DataFrame, shared, groups: int, k: int, same: bool) -> DataFrame:
    """(request, rank, vec_id, score): each request's k best rows in its window.

    requests: request, anchor_id, label, v, lo, hi; written, since they are read twice.
    """
    n = requests.count()
    blocks = max(1, -(-n // BLOCK))
    anchors = requests.withColumn("b", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int"))  # all of an anchor's requests in one block
    rows = file.select("row", "g", "vec_id", "label", "code").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = rows.groupBy("g", "b").cogroup(asked.groupBy("g", "b")).applyInArrow(_tiled(shared, k, same), _SQL_FOUND)
    found = materialize(found)
    w = Window.partitionBy("request").orderBy(F.desc("low"))
    floor = found.filter("sure").select("request", "low", F.row_number().over(w).alias("n")).filter(F.col("n") == k).select("request", F.col("low").alias("floor"))
    some = found.join(floor, "request", "left").filter(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).select("request", "row")
    pairs = some.join(file.select("row", "vec_id", "v"), "row").join(requests.select("request", "lo", "hi", F.col("v").alias("q")), "request")
    scored = pairs.select("request", "vec_id", "v", "q").mapInArrow(_score, "request long, vec_id long, score long")
    inside = scored.join(requests.select("request", "lo", "hi"), "request").filter((F.col("score") >= F.col("lo")) & (F.col("score") <= F.col("hi")))
    best = Window.partitionBy("request").orderBy(F.desc("score"), "vec_id")
    return inside.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("request", "rank", "vec_id", "score")


def share(score: Column, percent: int, up: bool) -> Column:
    """percent of a score in hundredths, to the next whole number up or down, exact."""
    x = score.cast("decimal(20,0)") * F.lit(percent)
    return (F.ceil(x / 100) if up else F.floor(x / 100)).cast("long")


def hard_negatives(x: DataFrame, every=ANCHOR_EVERY, positives=POSITIVES, negatives=NEGATIVES, window=(30, 90), cells=CELLS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of labelled() rows.

    window: per cent of the positive's score, both ends included.
    """
    spark = x.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n = x.count()
    if not n:
        return spark.createDataFrame([], schema)
    groups = max(-(-n // GROUP), min(GROUPS, -(-n // 512)))
    shared = spark.sparkContext.broadcast(fit(x, n, cells))
    file = va_file(x, shared, groups)
    one = F.min(F.struct("label", "v")).alias("one")
    anchors = materialize(file.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(one).select("anchor_id", "one.label", "one.v"))
    everything = anchors.withColumns({"request": F.col("anchor_id"), "lo": F.lit(-_LONG - 1), "hi": F.lit(_LONG)})
    near = answer(file, everything, shared, groups, positives, True)
    near = materialize(near.select(F.col("request").alias("anchor_id"), F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    low, high = window
    ranges = near.join(anchors, "anchor_id").withColumns({"lo": share(F.col("positive_score"), low, True), "hi": share(F.col("positive_score"), high, False)}).filter("lo <= hi")
    ranges = materialize(ranges.withColumn("request", F.monotonically_increasing_id()))
    far = answer(file, ranges.select("request", "anchor_id", "label", "v", "lo", "hi"), shared, groups, negatives, False)
    asked = ranges.select("request", "anchor_id", "positive_id", "positive_score")
    return far.join(asked, "request").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

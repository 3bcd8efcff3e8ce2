"""Exact top-k search by inner product: columnar branch and bound.

Vectors are quantised to integers and laid out vertically, one array a dimension.  A block of
queries meets a batch of candidates dimension block by dimension block: partial products
accumulate, and a candidate goes on only if its partial score plus the most that the remaining
dimensions could add (the product of the remaining norms) can still reach the query's k-th
best so far.  Survivors are compacted between blocks, so that later dimensions are read for few
candidates.  Bounds only rule out what cannot win, so results are exact.

Queries are broadcast in blocks of at most ``query_block`` rows, a bounded size; more queries
make more rounds over the candidates.  Each task keeps k candidates a query and the rounds'
results merge by a partial top-k per query.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor
do rows without an id; the shorter of two vectors counts as padded with zeros.  Rows that share
the query's id are the query's own and no candidates of it; repeated query rows are answered
once for each different vector, of which the smallest stands for the id.  No candidates: no rows.
Components of any finite size count exactly; a score past 64 bits counts as the nearest long.
Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .columns import quoted
from .store import materialize

SCALE, K, QUERY_EVERY = 256, 5, 50
QUERY_BLOCK, TILE, CANDIDATES, DIMENSIONS = 4096, 128, 2048, 16

_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(df: DataFrame, vec_id: str, embedding: str, scale=SCALE) -> DataFrame:
    """(vec_id, v) of the rows that take part; v: scale * x, whose floors are the components."""
    x = F.transform(quoted(embedding), lambda c: c.cast("double"))  # 256 times a double is exact, and so is its floor
    ok = quoted(embedding).isNotNull() & quoted(vec_id).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.filter(ok).select(quoted(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: c * scale).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Vertical layout: (width, rows) of doubles, whole numbers, each exact."""
    off = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False)
    n = len(off) - 1
    sizes = np.diff(off)
    out = np.zeros((n, width))
    if (sizes == width).all():
        out[:] = flat[off[0] : off[-1]].reshape(n, width)
    else:
        row = np.repeat(np.arange(n), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seen = at < width
        out[row[seen], at[seen]] = flat[off[0] : off[-1]][seen]
    return np.ascontiguousarray(np.floor(out).T)


#: Up to here every sum of products is exact in doubles.
EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of columns, in integers of any size, cut to 64 bits, as objects."""
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(x, y)), -_LONG - 1), _LONG) for x, y in zip(q.T.tolist(), c.T.tolist())], object)


class Search:
    """The k best candidates of a block of queries, over candidates that come in batches."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, step=DIMENSIONS):
        self.ids, self.k, self.step = query_ids, k, step
        self.order = np.var(queries, axis=1).argsort()[::-1]  # most spread first, so bounds get tight early
        self.q = np.ascontiguousarray(queries[self.order])
        self.tails = self._tails(self.q)
        self.scores = np.full((len(query_ids), k), -np.inf, object)  # whole numbers once they are found
        self.big = False
        self.best = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def _tails(self, m):
        """Norms of what remains from each dimension block on."""
        cuts = range(0, len(m), self.step)
        return [np.sqrt((m[c:] ** 2).sum(axis=0)) for c in cuts] + [np.zeros(m.shape[1])]

    def add(self, ids: np.ndarray, candidates: np.ndarray):
        c = np.ascontiguousarray(candidates[self.order])
        tails = self._tails(c)
        self.big = bool(len(self.q)) and float(np.abs(self.q).sum(axis=0).max(initial=0)) * float(np.abs(c).max(initial=0)) >= EXACT
        for lo in range(0, len(self.ids), TILE):
            self._tile(slice(lo, lo + TILE), ids, c, tails)

    def _tile(self, part: slice, ids, c, tails):
        """One block of queries against a batch; candidates that no query needs are compacted away."""
        floor = self.scores[part, -1][:, None].astype(float)
        alive = np.arange(len(ids))
        score = np.zeros((len(floor), len(ids)))
        for b, at in enumerate(range(0, len(c), self.step)):
            block = c[at : at + self.step]
            score += self.q[at : at + self.step, part].T @ (block if len(alive) == len(ids) else block[:, alive])
            room = np.outer(self.tails[b + 1][part], tails[b + 1][alive]) * (1 + 1e-9) + 1e-6
            if self.big:
                room = room + np.outer(self.tails[0][part], tails[0][alive]) * 1e-9
            needed = (score + room >= floor).any(axis=0)
            if needed.mean() < 0.7:
                alive, score = alive[needed], score[:, needed]
        score[self.ids[part, None] == ids[alive][None, :]] = -np.inf
        if self.big:
            score = np.where(score > -np.inf, np.clip(score, -float(1 << 63), float(1 << 63)), score)
        if score.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(score, -self.k, axis=1)[:, -self.k :].min(axis=1, keepdims=True))
        if self.big:  # sums may be off: let all pass that rounding could keep out, and score them exactly
            floor = floor - np.abs(floor) * 1e-9 - np.outer(self.tails[0][part], np.ones(1)) * tails[0].max(initial=0) * 1e-9
        row, col = np.nonzero((score >= floor) & (score > -np.inf))
        if self.big and len(row):
            found = exact_scores(self.q[:, part][:, row], c[:, alive[col]])
            self._keep(np.arange(len(self.ids))[part][row], ids[alive[col]], found)
            return
        if len(row):
            self._keep(np.arange(len(self.ids))[part][row], ids[alive[col]], score[row, col])

    def _keep(self, row, ids, score):
        """Merge pairs into the best of their rows, ties to the smaller id."""
        old_row, old = np.nonzero(self.scores[: row.max() + 1] != -np.inf)
        mine = np.isin(old_row, row)
        old_row, old = old_row[mine], old[mine]
        r = np.concatenate((row, old_row))
        i = np.concatenate((ids, self.best[old_row, old]))
        s = np.concatenate((score.astype(object), self.scores[old_row, old]))
        order = sorted(range(len(r)), key=lambda j: (r[j], -s[j], i[j])) if s.dtype == object and self.big else np.lexsort((i, -s.astype(float), r))
        r, i, s = r[order], i[order], s[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        top = rank < self.k
        self.scores[r[top], rank[top]], self.best[r[top], rank[top]] = s[top], i[top]


def _search(shared, k: int, step: int):
    def run(batches):
        ids, q = shared.value
        search = Search(ids, q, k, step)
        for batch in batches:
            for lo in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(lo, CANDIDATES)
                search.add(part.column(0).to_numpy(), _matrix(part.column(1), len(q)))
        found = search.scores != -np.inf
        row = np.nonzero(found)[0]
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(search.best[found]), pa.array([int(s) for s in search.scores[found]], pa.int64())], schema=_OUT)

    return run


def top_k(vectors: DataFrame, vec_id="vec_id", embedding="embedding", k=K, every=QUERY_EVERY, scale=SCALE, query_block=QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each row whose id `every` divides."""
    spark = vectors.sparkSession
    x = quantised(vectors, vec_id, embedding, scale)
    asked = x.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialize(asked)
    blocks = max(1, -(-asked.count() // (query_block // 2)))  # hash blocks of half that size on average
    if blocks > 1:
        x = materialize(x)
    found = []
    for b in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        if not got.num_rows:
            continue
        ids = got["vec_id"].to_numpy()
        v = got["v"].combine_chunks()
        for lo in range(0, len(ids), query_block):
            mine = v.slice(lo, query_block)
            width = int(np.diff(np.asarray(mine.offsets)).max(initial=0))
            shared = spark.sparkContext.broadcast((ids[lo : lo + query_block], _matrix(mine, width)))
            part = x.mapInArrow(_search(shared, k, DIMENSIONS), "query_id long, vec_id long, score long")
            found.append(materialize(part) if blocks > 1 else part)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    both = reduce(DataFrame.unionByName, found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

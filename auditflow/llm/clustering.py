"""Centroid clustering: Lloyd's rounds on what changed.

Vectors become whole numbers.  The state of a round is a table of vectors with their owner and the
distance to it; beside it the driver holds the sums and counts of all clusters (k x dimensions
numbers, a size that is checked, whatever the number of vectors).  A round reads the last state
and compares every vector with the centroids that changed only; a vector whose own centroid moved
away from it is compared with all.  The new state is written, and the vectors whose owner moved,
and they alone, are read back: each takes its components from the sums of one cluster and gives
them to those of another.  Tasks add up these signed transfers before they are shuffled, so a
round sends k rows a task, however full a cluster is.  All sums are of whole numbers and exact, in
any order.  A round's state goes once the next one is written and counted.

Defined cases: vectors that are null, of another number of components, or with null or non-finite
ones take no part, nor do rows without an id.  Rows that repeat others are vectors of their own;
among rows of one id, that with the smallest components comes first as a start.  Fewer vectors
than centroids make as many centroids as vectors; no vectors give no rows.  A tie goes to the
centroid of the smaller number; a centroid without vectors stays where it is.  Components past
2**52 either way count as 2**52 that way.  Distances past 63 bits are compared as they are, and
count as the largest long in the result and its sums.  Other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

import decimal
import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .columns import quoted
from .store import discard, materialize

SCALE, DIMENSIONS, CENTROIDS, ROUNDS, SEED = 256, 64, 40, 5, "2"
#: Numbers of all centroids together, which driver and workers hold.
MOST_NUMBERS = 1 << 22
#: Vectors compared at a time by a worker.
ROWS = 4096
_FAR, _LONG = 1 << 52, (1 << 63) - 1

_STATE = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("own", pa.int32()), ("was", pa.int32()), ("far", pa.decimal128(38, 0))])
_SQL_STATE = "vec_id long, v array<long>, own int, was int, far decimal(38,0)"
_TRANSFER = "own int, n long, sums array<decimal(38,0)>"


def integers(df: DataFrame, vec_id: str, embedding: str, dimensions: int, scale=SCALE) -> DataFrame:
    """(vec_id, v) of the rows that take part, components as whole numbers."""
    x = F.transform(quoted(embedding), lambda c: c.cast("double"))
    ok = quoted(vec_id).isNotNull() & (F.size(quoted(embedding)) == dimensions) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def whole(c: Column) -> Column:
        return F.when(c >= float(_FAR), F.lit(_FAR)).when(c <= -float(_FAR), F.lit(-_FAR)).otherwise(F.floor(c))

    return df.filter(ok).select(quoted(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: whole(c * scale)).alias("v"))


def starts(x: DataFrame, centroids: int, seed: str) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id, in order of the hash."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    few = materialize(x.select("v", h.alias("h")).orderBy("h", "v").limit(centroids))  # tasks' shares meet in a task, not on the driver
    return [r.v for r in few.orderBy("h", "v").collect()]


def small(width: int) -> int:
    """Components below this have distances that doubles hold exactly, all sums on the way included."""
    return math.isqrt((1 << 51) // max(width, 1))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of whole numbers: doubles where they are small(), else Python's own."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    return flat.astype(float) if np.abs(flat).max(initial=0) < small(width) else flat.astype(object)


def _exact(m: np.ndarray) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(m) if m.size else m.astype(object)


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact."""
    if v.dtype == object or c.dtype == object:
        v, c = _exact(v), _exact(c)
    return (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]


def compare(v: np.ndarray, own: np.ndarray, far: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after centroids changed; own is -1 for vectors without an owner yet.

    A centroid that stayed was no nearer than the owner before.  So it matters again only to
    vectors whose owner has moved away from them.
    """
    own, far = own.copy(), far.copy()
    if not changed.any():
        return own, far
    at = np.flatnonzero(changed)
    near = distances(v, centroids[at])
    place = np.full(len(centroids) + 1, -1)
    place[at] = np.arange(len(at))
    slot = place[own]  # of the owner among the changed; -1 if it stayed or there is none
    moved = slot >= 0
    now = np.where(moved, near[np.arange(len(v)), slot], far)
    everything = (own < 0) | (moved & (now > far))
    first = near.argmin(axis=1)  # the smallest number of those at the least distance
    least = near[np.arange(len(v)), first]
    better = (least < now) | ((least == now) & (at[first] < own))
    own, far = np.where(better, at[first], own), np.where(better, least, now)
    if everything.any() and not changed.all():
        full = distances(v[everything], centroids)
        own[everything] = full.argmin(axis=1)
        far[everything] = full.min(axis=1)
    elif everything.any():
        own[everything], far[everything] = at[first[everything]], least[everything]
    return own, far


def _numbers(far: pa.Array) -> np.ndarray:
    """Decimals as doubles where all are exact, else as Python's whole numbers."""
    if (pc.max(far).as_py() or 0) < 1 << 53:
        return far.cast(pa.int64()).to_numpy().astype(float)
    return np.array([int(x) for x in far.to_pylist()], object)


def _decimals(numbers: np.ndarray) -> pa.Array:
    if numbers.dtype != object:
        return pa.array(numbers.astype(np.int64)).cast(pa.decimal128(38, 0))
    return pa.array([decimal.Decimal(int(x)) for x in numbers], pa.decimal128(38, 0))


def _assign(shared):
    """State of the next round, from that of the last or from vectors alone."""

    def run(batches):
        centroids, changed = shared.value
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(lo, ROWS)
                v = _rows(batch.column(1), centroids.shape[1])
                if batch.num_columns > 2:
                    own, far = batch.column(2).to_numpy(), _numbers(batch.column(4))
                else:
                    own, far = np.full(len(v), -1, np.int32), np.full(len(v), np.inf)
                now, near = compare(v, own, far, centroids, changed)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(_STATE.field("v").type), pa.array(now.astype(np.int32)), pa.array(own.astype(np.int32)), _decimals(near)], schema=_STATE)

    return run


def _transfers(clusters: int, width: int):
    """What a task's vectors take from their old clusters and give to their new ones."""

    def run(batches):
        total, count = np.zeros((clusters, width), object), np.zeros(clusters, np.int64)
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            v = v if np.abs(v).max(initial=0) < 1 << 40 else v.astype(object)  # a batch's sums fit longs
            for sign, owners in ((1, batch.column(1).to_numpy()), (-1, batch.column(2).to_numpy())):
                for k in np.unique(owners[owners >= 0]):
                    mine = v[owners == k]
                    total[k] += sign * mine.sum(axis=0).astype(object)
                    count[k] += sign * len(mine)
        used = [k for k in range(clusters) if count[k] or any(total[k])]
        if used:
            sums = pa.array([[decimal.Decimal(int(x)) for x in total[k]] for k in used], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), sums], names=["own", "n", "sums"])

    return run


def moved_sums(state: DataFrame, clusters: int, width: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, change of its count, changes of its sums), from the vectors whose owner moved."""
    part = state.filter("own <> was").select("v", "own", "was").mapInArrow(_transfers(clusters, width), _TRANSFER)
    flat = part.select("own", "n", F.posexplode("sums").alias("at", "s")).groupBy("own", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in flat.collect():  # clusters x dimensions at most, whatever the number of vectors
        found.setdefault(r.own, (r.n, [0] * width))[1][r["at"]] = int(r.s)
    return [(k, n, s) for k, (n, s) in sorted(found.items())]


def _matrix(centroids: list[list[int]]) -> np.ndarray:
    exact = all(abs(x) < small(len(c)) for c in centroids for x in c)
    return np.array(centroids, float if exact else object)


class Lloyd:
    """Centroids with the exact sums and counts of their clusters."""

    def __init__(self, first: list[list[int]]):
        self.centroids = [list(map(int, c)) for c in first]
        self.sums = [[0] * len(c) for c in self.centroids]
        self.counts = [0] * len(self.centroids)

    def transfer(self, changes) -> None:
        for k, n, s in changes:
            self.counts[k] += n
            self.sums[k] = [a + b for a, b in zip(self.sums[k], s)]

    def move(self) -> list[bool]:
        """Every centroid with vectors goes to the floor of their mean; which ones changed."""
        new = [[s // n for s in sums] if n else c for sums, n, c in zip(self.sums, self.counts, self.centroids)]
        changed = [a != b for a, b in zip(new, self.centroids)]
        self.centroids = new
        return changed


def assignments(x: DataFrame, first: list[list[int]], rounds: int) -> tuple[DataFrame, Lloyd]:
    """The written state after so many rounds and a last assignment, and the centroids."""
    spark, model = x.sparkSession, Lloyd(first)
    width = len(first[0])
    if len(first) * width > MOST_NUMBERS:
        raise ValueError(f"centroids of {len(first) * width} numbers; at most {MOST_NUMBERS} are held")
    changed, state = [True] * len(first), x
    for r in range(rounds + 1):
        if r and not any(changed):
            break  # nothing moves any more: every further round gives the same
        shared = spark.sparkContext.broadcast((_matrix(model.centroids), np.array(changed)))
        last, state = state, materialize(state.mapInArrow(_assign(shared), _SQL_STATE))
        if r < rounds:
            model.transfer(moved_sums(state, len(first), width))
            changed = model.move()
        if r:
            discard(last)
    return state, model


def cluster(vectors: DataFrame, vec_id="vec_id", embedding="embedding", centroids=CENTROIDS, rounds=ROUNDS, seed=SEED, dimensions=DIMENSIONS, scale=SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector that takes part."""
    spark = vectors.sparkSession
    x = integers(vectors, vec_id, embedding, dimensions, scale)
    first = starts(x, centroids, seed)
    if not first:
        return x.select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    state, model = assignments(x, first, rounds)
    near = F.least("far", F.lit(_LONG).cast("decimal(38,0)"))
    inertia = {r.own: int(r.s) for r in state.groupBy("own").agg(F.sum(near).alias("s")).collect()}
    total = sum(inertia.values())
    facts = [(k, min(inertia.get(k, 0), _LONG), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(model.centroids)]
    table = spark.createDataFrame(facts, "own int, cluster_inertia long, centroid_sha256 string")  # a row for each centroid
    return state.join(F.broadcast(table), "own").select("vec_id", F.col("own").alias("cluster"), near.cast("long").alias("distance"), "cluster_inertia", F.lit(min(total, _LONG)).cast("long").alias("inertia"), "centroid_sha256")

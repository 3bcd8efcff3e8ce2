"""Scoring texts by a log-bilinear language model beside a smoothed unigram base.

Word counts come from all training texts, combined in each task and summed by Spark.  The model
predicts each token from the few before it: the context is the sum of its tokens' vectors, each
weighted by its distance, h = sum_d c_d * r(w_-d), and a token scores h . q_w + b_w.  Listed words
(the most frequent ones) and the end have vectors of their own; a context word off the list has
that of its last two bytes, so that it still tells of its language.

A token is predicted in two steps, its class and itself in the class; listed words are classed by
rank.  Both steps are trained by noise-contrastive estimation with sampled noise: classes against
noise classes shared by a batch, words against noise words of their class, both from the unigram
distribution.  A softmax over the classes and one over the class's words, each a batched matrix
product, give normalised probabilities.

Training goes over all training texts where they lie.  Each round, every task starts from the
broadcast parameters, learns from its texts batch by batch, and sends what changed, weighted by
how often; the weighted changes are added up by blocks of rows, and come to the driver as a table
of the parameters' own size.  Rounds take halves of the texts by turns; small corpora are gone
through more often, so that at least ``least`` tokens are learned from.

All words off the list are one class.  A word's share of it is its count's; the one unknown word
has the share of words seen once (what leaving a text out makes unknown).  So the model spreads
one unit over the same tokens as the base: the known words, the end and one unknown word.

The ``head`` most frequent words' counts and the model are broadcast, which bounds them; the counts
of all other words reach the texts by a join.

Defined cases: null or empty text is the end token alone; a null doc_id counts as the empty text
for the split.  Repeated rows are scored each for itself.  An empty table has no rows; without
training texts the model is the untrained one.  Very long texts are held one at a time.  Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textcore as tc
from .columns import quoted, whole
from .store import materialize

FOLDS, ADD = 10, 0.1
#: Words whose counts are broadcast, words with vectors of their own, and words a class.
HEAD, LISTED, CLASS = 1 << 19, 1 << 16, 256
#: Words seen less often are off the list at any size of corpus: they stand for those never seen.
LEAST_COUNT = 3
DIM, DISTANCES, BATCH, NOISE_CLASSES, NOISE = 12, 4, 16384, 64, 3
RATE, START = 0.1, 120.0
#: Tokens that are learned from at least, and bytes of text a training task has on average.
LEAST, TASK_BYTES = 4_000_000, 16 << 20
#: How often a small corpus is gone through at most.
MOST_PASSES = 12
#: Vectors of context words off the list, by their last two bytes.
ENDINGS = 1024
BLOCK = 4096
FLUSH = 2_000_000

END_PRINT = np.uint64(0x1B873593CC9E2D51)


def _tokens(buf, off):
    """Words, fingerprints of all tokens, the first token of every row, and each word's token."""
    low = tc.LOWER[buf]
    words = tc.words(low, off)
    prints = tc.fingerprints(low, words.start, words.end)
    n = len(off) - 1
    first = words.first + np.arange(n + 1)
    out = np.full(first[-1], END_PRINT, np.uint64)
    at = np.arange(len(prints)) + words.rows
    out[at] = prints
    return words, out, first, at


def _count_words(batches):
    held, size = [], 0

    def flush():
        keys = np.concatenate([h for h, _ in held])
        counts = np.concatenate([c for _, c in held])
        keys, back = np.unique(keys, return_inverse=True)
        return keys, np.bincount(back, weights=counts).astype(np.int64)

    def batch_of(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(tc.long(keys)), pa.array(counts)], names=["h", "c"])

    for batch in batches:
        for _, _, buf, off in tc.slices(batch.column(0)):
            keys, counts = np.unique(_tokens(buf, off)[1], return_counts=True)
            held.append((keys, counts))
            size += len(keys)
            if size > FLUSH:
                held = [flush()]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield batch_of(*held[0])
                    held, size = [], 0
    if held:
        yield batch_of(*flush())


class Head:
    """Frequent words: sorted fingerprints, counts, and places on the list (-1: off it)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, listed: int = LISTED):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.ids = np.full(len(keys), -1, np.int32)
        best = np.lexsort((self.keys, -self.counts))
        best = best[(self.keys[best] != END_PRINT) & (self.counts[best] >= LEAST_COUNT)][:listed]
        self.ids[best] = np.arange(len(best))
        self.listed = self.counts[best]
        at = np.sort(best)
        self.listed_keys, self.listed_ids, self.listed_at = self.keys[at], self.ids[at], at

    @cached_property
    def _starts(self) -> tuple[np.ndarray, np.uint64]:
        """Where the listed keys with each leading bits begin, and by how much a print is shifted to them."""
        bits = len(self.listed_keys).bit_length() + 1
        shift = np.uint64(64 - bits)
        return np.searchsorted(self.listed_keys, np.arange(1 << bits, dtype=np.uint64) << shift), shift

    def _search_listed(self, prints: np.ndarray) -> np.ndarray:
        """np.searchsorted(listed_keys, prints), the last place at most; prints are spread evenly, so it is few steps from a start."""
        starts, shift = self._starts
        keys, last = self.listed_keys, len(self.listed_keys) - 1
        at = np.minimum(np.take(starts, prints >> shift), last)
        rest = np.flatnonzero((np.take(keys, at) < prints) & (at < last))
        while len(rest):
            at[rest] += 1
            rest = rest[(keys[at[rest]] < prints[rest]) & (at[rest] < last)]
        return at

    def find(self, prints: np.ndarray) -> np.ndarray:
        """Place in keys, or -1; the short list of most words is searched first."""
        out, rest = np.full(len(prints), -1), np.arange(len(prints))
        for keys, places in ((self.listed_keys, self.listed_at), (self.keys, None)):
            if len(keys) and len(rest):
                at = np.minimum(np.searchsorted(keys, prints[rest]), len(keys) - 1) if places is None else self._search_listed(prints)
                hit = keys[at] == prints[rest]
                out[rest[hit]] = at[hit] if places is None else places[at[hit]]
                rest = rest[~hit]
        return out

    def find_listed(self, prints: np.ndarray) -> np.ndarray:
        """Places on the list, -1 for words off it and the end, without looking at the others."""
        if not len(self.listed_keys):
            return np.full(len(prints), -1, np.int32)
        at = self._search_listed(prints)
        return np.where(np.take(self.listed_keys, at) == prints, np.take(self.listed_ids, at), np.int32(-1))

    def words(self, place: np.ndarray) -> np.ndarray:
        """Places on the list, -1 for words off it and the end, of places in keys."""
        out = np.full(len(place), -1, np.int32)
        out[place >= 0] = self.ids[place[place >= 0]]
        return out


def contexts(tokens: np.ndarray, first: np.ndarray, start: int, distances=DISTANCES) -> np.ndarray:
    """(tokens, distances): the tokens before each one in its row, `start` before the first."""
    out = np.full((len(tokens), distances), start, np.int32)
    row_first = np.repeat(first[:-1], np.diff(first))
    at = np.arange(len(tokens))
    for d in range(1, distances + 1):
        inside = at[d:][at[d:] - d >= row_first[d:]] if d < len(at) else at[:0]
        out[inside, d - 1] = tokens[inside - d]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.clip(x, -30, 30)
    np.negative(out, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _alias(p: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Alias tables of each `size` probabilities: a slot stays with chance keep, else it is another."""
    keep, alias = np.ones(len(p), np.float32), np.arange(len(p))
    for lo in range(0, len(p), size):
        q = p[lo : lo + size].astype(np.float64)
        q = q / q.sum() * len(q)
        small, large = [i for i in range(len(q)) if q[i] < 1], [i for i in range(len(q)) if q[i] >= 1]
        while small and large:
            a, b = small.pop(), large[-1]
            keep[lo + a], alias[lo + a] = q[a], lo + b
            q[b] -= 1 - q[a]
            if q[b] < 1:
                small.append(large.pop())
    return keep, alias


class Vectors:
    """The model's parameters, by name: tables of rows, biases last in a row where there are any."""

    def __init__(self, word_counts: np.ndarray, other: int, ends: int, dim=DIM, distances=DISTANCES, size=CLASS, seed=7):
        rng = np.random.default_rng(seed)
        n = len(word_counts)
        self.dim, self.size, self.n_words = dim, size, n
        self.n_groups = -(-n // size)  # classes of listed words
        self.other, self.end = self.n_groups, self.n_groups + 1
        self.start = n + ENDINGS  # the context before a text
        of = np.arange(n) // size
        mass = np.bincount(of, weights=word_counts, minlength=self.n_groups) if n else np.zeros(0)
        classes = np.concatenate((mass, [other, ends])) + 0.5
        self.p_class = classes / classes.sum()
        self.p_word = (word_counts / mass[of] if n else np.zeros(0)).astype(np.float32)
        self.keep, self.alias = _alias(self.p_word, size)
        f = np.float32
        self.tables = {
            "context": rng.normal(0, 0.1, (n + ENDINGS + 1, dim)).astype(f),
            "weights": np.full((distances, dim), 1 / distances, f),
            "classes": np.concatenate((np.zeros((len(classes), dim)), np.log(self.p_class)[:, None]), axis=1).astype(f),
            "words": np.concatenate((np.zeros((n, dim)), np.log(self.p_word)[:, None]), axis=1).astype(f),
        }

    def classes_of(self, words: np.ndarray, is_end: np.ndarray) -> np.ndarray:
        out = np.where(words >= 0, words // self.size, self.other)
        out[is_end] = self.end
        return out

    def hidden(self, ctx: np.ndarray) -> np.ndarray:
        """The sum of the context's vectors, each weighted by its distance, and a one."""
        t = self.tables
        weighted = [np.zeros((len(t["context"]), self.dim + 1), np.float32) for _ in t["weights"]]
        for table, by in zip(weighted, t["weights"]):
            np.multiply(t["context"], by, out=table[:, : self.dim])
        weighted[0][:, self.dim] = 1  # a one for the biases
        out = np.empty((len(ctx), self.dim + 1), np.float32)
        for lo in range(0, len(ctx), BLOCK):
            part, at = out[lo : lo + BLOCK], ctx[lo : lo + BLOCK]
            part[:] = np.take(weighted[0], at[:, 0], axis=0)
            for k in range(1, ctx.shape[1]):
                part += np.take(weighted[k], at[:, k], axis=0)
        return out

    def log_probs(self, ctx: np.ndarray, words: np.ndarray, is_end: np.ndarray) -> np.ndarray:
        """Natural log of each token's class, and of a listed word in its class."""
        t = self.tables
        h, y = self.hidden(ctx), self.classes_of(words, is_end)
        out = _log_softmax_at(h, t["classes"], y)
        order = np.argsort(y.astype(np.min_scalar_type(self.end)), kind="stable")  # small numbers sort in linear time
        cuts = np.searchsorted(y[order], np.arange(self.n_groups + 1))
        order = order[: cuts[-1]]  # listed words
        h, at, more = np.take(h, order, axis=0), words[order] - y[order] * self.size, np.empty(len(order))
        for c in range(self.n_groups):
            mine = slice(cuts[c], cuts[c + 1])
            if cuts[c] < cuts[c + 1]:
                more[mine] = _log_softmax_at(h[mine], t["words"][c * self.size : (c + 1) * self.size], at[mine])
        out[order] += more
        return out


#: Rows of scores at a time, so that they stay in a core's cache.
ROWS = 256


def _log_softmax_at(h: np.ndarray, table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log softmax of h times the table's rows, at one row each."""
    across, ones = np.ascontiguousarray(table.T), np.ones(len(table), np.float32)
    room, total = np.empty((min(ROWS, len(h)), len(table)), np.float32), np.empty(len(h), np.float32)
    most = np.float32(80)  # so that no shift by the greatest is needed
    small = _longest(h) * _longest(table) < most  # then no score can be greater
    mine = np.minimum(np.einsum("bd,bd->b", h, np.take(table, at, axis=0)), most)
    for lo in range(0, len(h), ROWS):
        part = h[lo : lo + ROWS]
        s = np.matmul(part, across, out=room[: len(part)])
        if not small:
            np.minimum(s, most, out=s)
        np.exp(s, out=s)
        np.matmul(s, ones, out=total[lo : lo + ROWS])
    return mine.astype(np.float64) - np.log(total.astype(np.float64))


def _longest(rows: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("bd,bd->b", rows, rows).max(initial=0)))


def _across(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of a table as (numbers, rows), so that steps are passes over whole arrays."""
    return np.ascontiguousarray(np.take(table, rows, axis=0).T)


class Trainer:
    """Noise-contrastive steps on a copy of the parameters, with the number of times each row was met."""

    def __init__(self, vectors: Vectors, rate=RATE, seed=0):
        self.v, self.rate = vectors, rate
        self.base = vectors.tables
        self.tables = {k: x.copy() for k, x in vectors.tables.items()}
        self.met = {k: np.zeros(len(x), np.int64) for k, x in vectors.tables.items()}
        self.squares = {k: np.full(len(x), START, np.float32) for k, x in vectors.tables.items()}
        self.rng = np.random.default_rng(seed)
        self.lift_class = np.log(NOISE_CLASSES * vectors.p_class).astype(np.float32)
        self.lift_word = np.log(NOISE * vectors.p_word).astype(np.float32)

    def _add(self, name: str, rows: np.ndarray, grads: np.ndarray, times: np.ndarray | None = None) -> None:
        """An adaptive step up the gradient (numbers, rows), summed by row.

        times: how often each row of the table was met, where rows are fewer.
        """
        table, n = self.tables[name], len(self.tables[name])
        times = np.bincount(rows, minlength=n) if times is None else times
        some = np.flatnonzero(times)
        rank = np.empty(n, np.int64)
        rank[some] = np.arange(len(some))
        rows = np.take(rank, rows)
        total = np.empty((len(grads), len(some)), np.float32)
        for d, grad in enumerate(grads):
            total[d] = np.bincount(rows, weights=grad, minlength=len(some))
        squares = self.squares[name][some] + (total**2).mean(axis=0)
        self.squares[name][some] = squares
        total *= self.rate / np.sqrt(squares)
        table[some] = np.take(table, some, axis=0) + total.T
        self.met[name] += times

    def step(self, ctx: np.ndarray, words: np.ndarray, is_end: np.ndarray) -> None:
        v, d, n, rng = self.v, self.v.dim, len(ctx), self.rng
        t = self.tables
        weights = t["weights"].T.copy()
        wide = np.ones((d + 1, n), np.float32)  # a one for the biases
        h = wide[:d]
        e = [_across(t["context"], ctx[:, k]) for k in range(ctx.shape[1])]
        np.multiply(e[0], weights[:, :1], out=h)
        for k in range(1, len(e)):
            h += e[k] * weights[:, k : k + 1]
        y = v.classes_of(words, is_end)
        noise = rng.choice(len(v.p_class), NOISE_CLASSES, p=v.p_class)
        q = t["classes"]
        qy, qn = _across(q, y), _across(q, noise)
        right = 1 - _sigmoid(np.einsum("db,db->b", wide, qy) - self.lift_class[y])
        back = right * qy  # the gradient by h
        class_grads = np.zeros((d + 1, n + NOISE_CLASSES), np.float32)
        np.multiply(right, wide, out=class_grads[:, :n])
        lift = self.lift_class[noise][:, None]
        for lo in range(0, n, 4 * ROWS):
            part = wide[:, lo : lo + 4 * ROWS]
            wrong = _sigmoid(qn.T @ part - lift)
            back[:, lo : lo + 4 * ROWS] -= qn @ wrong
            class_grads[:, n:] -= part @ wrong.T
        mine = np.flatnonzero(words >= 0)
        if len(mine):
            w, hw, q = words[mine], np.take(wide, mine, axis=1), t["words"]
            top = w // v.size * v.size
            size = np.minimum(v.size, v.n_words - top)
            rows, more = np.empty((NOISE + 1, len(mine)), np.int64), np.zeros((d + 1, len(mine)), np.float32)
            parts = np.empty((d + 1, NOISE + 1, len(mine)), np.float32)
            for k in range(NOISE + 1):
                if k:  # a noise word of the same class, by the alias table
                    slot = top + (rng.random(len(mine), np.float32) * size).astype(np.int64)
                    rows[k] = np.where(rng.random(len(mine), np.float32) < np.take(v.keep, slot), slot, np.take(v.alias, slot))
                else:
                    rows[k] = w
                qk = _across(q, rows[k])
                g = (k == 0) - _sigmoid(np.einsum("db,db->b", hw, qk) - np.take(self.lift_word, rows[k]))
                np.multiply(g, hw, out=parts[:, k])
                more += np.multiply(g, qk, out=qk)
            back[:, mine] += more
            self._add("words", rows.ravel(), parts.reshape(d + 1, -1))
        self._add("classes", np.concatenate((y, noise)), class_grads)
        back = back[:d]
        by_distance = np.stack([np.einsum("db,db->d", back, x) for x in e], axis=1)
        # a token is the context of the next ones: what it gets from them is added up before its row is looked for
        at, parts, carried = [], [], None
        for k in reversed(range(len(e))):
            part = back * weights[:, k : k + 1]
            if carried is not None:
                part[:, :-1] += carried
            if k:
                same = ctx[1:, k] == ctx[:-1, k - 1]
                carried = part[:, 1:] * same
                alone = np.append(0, np.flatnonzero(~same) + 1)
                at.append(ctx[alone, k])
                parts.append(np.take(part, alone, axis=1))
        at.append(ctx[:, 0])
        parts.append(part)
        self._add("context", np.concatenate(at), np.concatenate(parts, axis=1), np.bincount(ctx.ravel(), minlength=len(t["context"])))
        self._add("weights", np.arange(len(e)), by_distance * 0.1)

    def changes(self):
        """(table, block, rows' numbers in it, times met, change) of what was met."""
        for name, table in self.tables.items():
            for lo in range(0, len(table), BLOCK):
                some = np.flatnonzero(self.met[name][lo : lo + BLOCK])
                if len(some):
                    yield name, lo // BLOCK, some, self.met[name][lo + some], table[lo + some] - self.base[name][lo + some]


_CHANGES = "name string, block int, data binary"


def _pack(rows: np.ndarray, weights: np.ndarray, values: np.ndarray, kind) -> bytes:
    return np.array([len(rows), values.shape[1]], np.int64).tobytes() + rows.astype(np.int16).tobytes() + weights.astype(np.float64).tobytes() + values.astype(kind).tobytes()


def _unpack(data: bytes, kind):
    n, d = np.frombuffer(data, np.int64, 2).tolist()
    at = 16 + 2 * n
    return np.frombuffer(data, np.int16, n, 16), np.frombuffer(data, np.float64, n, at), np.frombuffer(data, kind, n * d, at + 8 * n).reshape(n, d)


def _learn(shared, seed: int, again: int):
    """Learn from a task's texts, and send the changes.

    again: how often to go through them; they are held for it, which only small corpora are.
    """

    def run(batches):
        model = shared.value
        trainer, held = Trainer(model.vectors, seed=seed), []

        def learn(ctx, words, is_end):
            for lo in range(0, len(words), BATCH):
                trainer.step(ctx[lo : lo + BATCH], words[lo : lo + BATCH], is_end[lo : lo + BATCH])

        for batch in batches:
            for _, _, buf, off in tc.slices(batch.column(0)):
                t = model.tokens(buf, off, counted=False)
                learn(t.ctx, t.words, t.is_end)
                if again > 1:
                    held.append((t.ctx, t.words, t.is_end))
        for _ in range(again - 1):
            for x in held:
                learn(*x)
        out = [(n, b, _pack(rows, met, change, np.float16)) for n, b, rows, met, change in trainer.changes()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["name", "block", "data"])

    return run


def _merged(table: pa.Table) -> pa.Table:
    """Changes of a block, averaged over tasks by how often each met a row."""
    total = weight = None
    for data in table["data"].to_pylist():
        rows, met, change = _unpack(data, np.float16)
        if total is None:
            total, weight = np.zeros((BLOCK, change.shape[1])), np.zeros(BLOCK)
        total[rows] += met[:, None] * change.astype(np.float64)
        weight[rows] += met
    some = np.flatnonzero(weight)
    data = _pack(some, weight[some], total[some] / weight[some, None], np.float32)
    return pa.table({"name": table["name"].slice(0, 1), "block": table["block"].slice(0, 1), "data": pa.array([data], pa.binary())})


class Tokens:
    """What the model sees of a slice's tokens."""

    __slots__ = ("spans", "prints", "first", "at", "place", "words", "is_end", "ctx")


class Model:
    """Probabilities over the known words, the end and one unknown word, as the base has them."""

    def __init__(self, head: Head, n: int, v: int, once: int, dim=DIM):
        self.head, self.n, self.v = head, n, v
        self.log_all = np.log10(n + ADD * (v + 1))
        ends = int(head.counts[head.keys == END_PRINT].sum())
        self.rest = n - int(head.listed.sum()) - ends  # training tokens off the list
        # a training token that occurs once would be unknown if its text were held out
        self.unknown = min(max(once / self.rest, 0.01), 0.99) if self.rest else 1.0
        self.vectors = Vectors(head.listed, self.rest, ends, dim)

    def tokens(self, buf, off, counted=True) -> Tokens:
        """counted: whether counts of words off the list are wanted too."""
        t = Tokens()
        t.spans, t.prints, t.first, t.at = _tokens(buf, off)
        if counted:
            t.place = self.head.find(t.prints)
            t.words = self.head.words(t.place)
        else:
            t.words = self.head.find_listed(t.prints)
        t.is_end = t.prints == END_PRINT
        low = tc.LOWER[buf] if len(buf) else np.zeros(1, np.uint8)
        last = low[t.spans.end - 1].astype(np.int64)
        second = np.where(t.spans.end - t.spans.start > 1, low[np.maximum(t.spans.end - 2, 0)], 0).astype(np.int64)
        seen = np.full(len(t.prints), self.vectors.start, np.int32)  # an end is no context: rows end there
        seen[t.at] = self.vectors.n_words + (second * 257 + last) % ENDINGS
        seen[t.words >= 0] = t.words[t.words >= 0]
        t.ctx = contexts(seen, t.first, self.vectors.start)
        return t

    def log_probs(self, t: Tokens) -> np.ndarray:
        """log10 of each token's probability; words off the list that the head does not know count as unknown."""
        out = self.vectors.log_probs(t.ctx, t.words, t.is_end) / np.log(10)
        other = (t.words < 0) & ~t.is_end
        counted = other & (t.place >= 0)
        out[other & ~counted] += np.log10(self.unknown)
        out[counted] += np.log10((1 - self.unknown) * self.head.counts[t.place[counted]] / max(1, self.rest))
        return out

    def score(self, buf, off):
        """Per row: tokens, tokens that the head knows, base score and score with others as unknown,
        and the others' prints and rows."""
        t = self.tokens(buf, off)
        known = t.place >= 0
        counts = np.zeros(len(t.words))
        counts[known] = self.head.counts[t.place[known]]
        base = np.log10(counts + ADD) - self.log_all
        other = np.flatnonzero(~known[t.at])
        return np.diff(t.first), tc.segment_sum(known.astype(np.int64), t.first), _row_sums(base, t.first), _row_sums(self.log_probs(t), t.first), t.prints[t.at[other]], t.spans.rows[other]


def _row_sums(x, first):
    return np.add.reduceat(x, first[:-1])  # every row has its end token


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<int>"


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for lo, hi, buf, off in tc.slices(batch.column(2)):
                n, known, base, score, prints, rows = model.score(buf, off)
                order = np.lexsort((prints, rows))
                prints, rows = prints[order], rows[order]
                new = np.ones(len(rows), bool)
                new[1:] = (prints[1:] != prints[:-1]) | (rows[1:] != rows[:-1])
                a = np.flatnonzero(new)
                times = np.diff(np.append(a, len(rows))).astype(np.int32)
                cuts = pa.array(np.searchsorted(rows[a], np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(known), pa.array(base), pa.array(score),
                    pa.ListArray.from_arrays(cuts, pa.array(tc.long(prints[a]))), pa.ListArray.from_arrays(cuts, pa.array(times)),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"])

    return run


def trained(model: Model, train: DataFrame, least=LEAST, task_bytes=TASK_BYTES) -> Model:
    """The model, trained on all texts of train (one column) in rounds of half of them each."""
    spark = train.sparkSession
    n_bytes = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not n_bytes:
        return model
    passes = min(MOST_PASSES, 1 + int(least // max(1, model.n))) if least > 0 else 0
    rounds, again = 2 * min(passes, 4), -(-passes // 4)
    tasks = max(1, -(-n_bytes // (2 * task_bytes)))
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        sent = train.filter(half == r % 2).coalesce(tasks).mapInArrow(_learn(shared, r, again), _CHANGES)
        got = sent.groupBy("name", "block").applyInArrow(_merged, _CHANGES).toArrow()  # as large as the model
        for name, block, data in zip(*(got[c].to_pylist() for c in ("name", "block", "data"))):
            rows, _, change = _unpack(data, np.float32)
            model.vectors.tables[name][block * BLOCK + rows.astype(np.int64)] += change
        shared.unpersist()
    return model


def fit(train: DataFrame, counts: DataFrame, head_size=HEAD, listed=LISTED, least=LEAST) -> Model:
    """The model of texts (one column) and their word counts (h, c)."""
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    level = F.floor(F.log2("c") * 16).cast("int")
    found, lowest = 0, 1 << 30
    is_end = F.col("h") == int(END_PRINT.view(np.int64))
    frequent = counts.filter((F.col("c") >= LEAST_COUNT) & ~is_end)
    for r in sorted(frequent.groupBy(level.alias("l")).count().collect(), reverse=True):  # under 16 rows a doubling of counts
        if found + r["count"] > head_size:
            break
        found, lowest = found + r["count"], r["l"]
    got = frequent.filter(level >= lowest).unionByName(counts.filter(is_end)).toArrow()  # head_size + 1 rows at most
    head = Head(got["h"].to_numpy().view(np.uint64), got["c"].to_numpy(), listed)
    return trained(Model(head, int(totals.n or 0), int(totals.v), int(totals.once or 0)), train, least)


def lm_scores(docs: DataFrame, doc_id="doc_id", text="text", folds=FOLDS, head_size=HEAD, listed=LISTED, least=LEAST) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Texts whose doc_id's crc32 leaves 0 modulo folds are held out; all others are learned from.
    """
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(quoted(doc_id).cast("string"), F.lit(""))) % folds == 0
    base = docs.select(quoted(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), whole(quoted(text)).alias("text"))
    train = base.filter(~F.col("held_out")).select("text")
    counts = materialize(train.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    model = fit(train, counts, head_size, listed, least)
    shared = spark.sparkContext.broadcast(model)
    scored = base.mapInArrow(_score(shared), _SCORED)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    gain = F.log10(F.col("c") + ADD) - F.log10(F.lit(ADD))
    # a known rare word: its share of the class in the unknown word's place
    likelier = F.log10(F.col("c")) + float(np.log10(max(1 - model.unknown, 1e-12) / max(1, model.rest) / model.unknown))
    more = rare.join(counts, "h").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * gain).alias("gain"), F.sum(F.col("times") * likelier).alias("likelier"))
    out = scored.drop("rare", "times").join(more, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("likelier", F.lit(0.0))).alias("score"))

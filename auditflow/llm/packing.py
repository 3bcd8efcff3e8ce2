"""Best-fit packing of token sequences.

Texts become token ids once; what goes on are the pieces' bounds and checksums.  Pieces are
dealt at random over as many tasks as their number asks for, and each task packs its own by
bounded-space online best-fit: a fixed number of open bins, found through a bitset with one
bit per amount of free space, so that the tightest bin that fits is the lowest set bit at or
above the piece's length; when too many bins are open, the fullest closes.  Pieces come in
batches, longest first, which leaves the short ones to fill gaps.

The bound on open bins works at the scale of a batch (LOOKAHEAD pieces): sorted longest first, a
batch needs few bins open for its short pieces.

Defined cases: null or empty text is the end token alone.  Repeated rows are packed each for
itself.  Sequences are numbered by task and bin; the same input gives the same packing.  An empty
table has no rows.  Very long texts are cut into pieces, in time that goes with their length.  Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import textcore as tc
from .columns import quoted
from .store import materialize
from .tokens import byte_encoder, byte_units, memo

SIZE, END = 1024, 2
OPEN_BINS, LOOKAHEAD = 8192, 8192
#: Pieces a packing task gets.
TASK_PIECES = 100_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def slice_ids(table, buf, off, end=END):
    """Ids of every row of a slice, each closed by the end token: (ids, first id of each row)."""
    units = byte_units(buf, off)
    entries = table.lookup(buf, units.start, units.end)
    lengths = table.length[entries].astype(np.int64)
    total = int(lengths.sum())
    ahead = np.cumsum(lengths) - lengths
    ids = table.pool[np.repeat(table.offset[entries] - ahead, lengths) + np.arange(total)]
    per_row = tc.segment_sum(lengths, units.first)
    first = np.concatenate(([0], np.cumsum(per_row + 1)))
    out = np.full(first[-1], end, np.uint32)
    out[np.arange(total) + np.repeat(np.arange(len(per_row)), per_row)] = ids
    return out, first


def cut_pieces(lengths: np.ndarray, size: int):
    """(row, piece, start, length) of all pieces; in a longer row the first may be shorter."""
    counts = np.maximum(-(-lengths // size), 1)
    row = np.repeat(np.arange(len(lengths)), counts)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    head = lengths - size * (counts - 1)
    start = np.where(piece == 0, 0, head[row] + size * (piece - 1))
    return row, piece, start, np.where(piece == 0, head[row], size)


def _tokenise(size: int, end: int, json_path, ranks_path):
    def run(batches):
        table = memo(f"byte {json_path} {ranks_path}", lambda: byte_encoder(json_path, ranks_path))
        for batch in batches:
            doc = batch.column(0)
            for lo, hi, buf, off in tc.slices(batch.column(1)):
                ids, first = slice_ids(table, buf, off, end)
                row, piece, start, length = cut_pieces(np.diff(first), size)
                data = memoryview(ids.astype("<u4")).cast("B")
                at = (first[row] + start) * 4
                crc = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())), np.int64, len(at))
                yield pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], schema=_PIECES)

    return tc.tidy(run)


class BestFit:
    """Bounded-space online best-fit of lengths into bins of one size."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free: list[list[int]] = [[] for _ in range(size + 1)]  # open bins by free space
        self.bits = self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next piece."""
        fits = self.bits >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(room)
        else:
            if self.open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            room, bin_, self.made = self.size, self.made, self.made + 1
        if left := room - length:
            self.free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.size - room

    def _take(self, room: int) -> int:
        bin_ = self.free[room].pop()
        if not self.free[room]:
            self.bits &= ~(1 << room)
        self.open -= 1
        return bin_


def _pack(size: int, open_bins: int, lookahead: int):
    def run(batches):
        fit, base = BestFit(size, open_bins), TaskContext.get().partitionId() << 40
        held, n = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            length = table["length"].to_numpy()
            order = np.argsort(-length, kind="stable")
            placed = np.array([fit.put(x) for x in length[order].tolist()], np.int64).reshape(-1, 2)
            table = table.take(pa.array(order)).append_column("sequence_id", pa.array(placed[:, 0] + base)).append_column("offset", pa.array(placed[:, 1]))
            return table.to_batches()

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= lookahead:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return tc.tidy(run)


def pack_documents(docs: DataFrame, doc_id="doc_id", text="text", size=SIZE, end=END, open_bins=OPEN_BINS, json_path=None, ranks_path=None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    base = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    pieces = materialize(base.mapInArrow(_tokenise(size, end, json_path, ranks_path), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    tasks = max(1, -(-pieces.count() // TASK_PIECES))
    deal = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.withColumn("deal", deal).repartition(tasks, "deal").sortWithinPartitions("deal", "doc_id", "piece").drop("deal")
    return dealt.mapInArrow(_pack(size, open_bins, LOOKAHEAD), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

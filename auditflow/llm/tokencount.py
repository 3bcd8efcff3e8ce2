"""Token counts of whole texts, huge ones by overlap resynchronisation.

Texts up to ``huge`` bytes are counted by their words, which the tokenizer encodes independently
(it drops white space), through a bounded memo.  A longer text is encoded in overlapping chunks
with offsets.  Two neighbours are spliced at a boundary in their overlap that is proven: a token
that ends one of the tokenizer's own pre-tokens stands at the same place in both, and after it
both have the same tokens at the same places for a while.  The tokenizer finds pre-tokens from
left to right and looks at nothing before the one at hand, so from such a boundary on the later
chunk's tokens are the whole text's.  No white space is needed.

Where no such boundary is found, the overlap is widened, and the later chunk with it: a single
pre-token of any length costs a constant number of encodings of itself.

Defined cases: null or empty text has 0 bytes and 0 tokens.  Repeated rows are counted each
for itself.  An empty table has no rows.  Very long texts take time in proportion to their length.
Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textcore as tc
from .columns import quoted
from .tokens import _public, memo

MODEL = "word_bpe_49k.json"
LIMIT, HUGE, CHUNK, OVERLAP, AGREE = 2048, 65_536, 16_384, 512, 8
#: Fixed value: how the vocabulary marks a token that ends a pre-token.
WORD_END = "</w>"


def library(path: str | None = None):
    """(counts of a list of texts, Encoded of one text), by the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path or _public(MODEL))
    model.no_truncation()
    model.no_padding()
    special = set(model.get_added_tokens_decoder())
    ends = frozenset(i for t, i in model.get_vocab(with_added_tokens=True).items() if t.endswith(WORD_END) or i in special)

    def counts(texts):
        return [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    def with_offsets(text):
        e = model.encode(text, add_special_tokens=False)
        return e.ids, e.offsets, ends

    return counts, with_offsets


class Encoded:
    """Tokens of text[base:upto]: ids, offsets from base, and the ids that end a pre-token."""

    __slots__ = ("base", "ids", "offsets", "ends", "first")

    def __init__(self, text: str, base: int, upto: int, encode):
        self.ids, self.offsets, self.ends = encode(text[base:upto])
        self.base, self.first = base, 0  # tokens before first are counted already

    def token(self, i: int) -> tuple[int, int, int]:
        a, b = self.offsets[i]
        return a + self.base, b + self.base, self.ids[i]


def splice_point(text: str, left: Encoded, right: Encoded, upto: int, agree: int) -> tuple[int, int] | None:
    """(tokens of left before, tokens of right before) the last proven common boundary, or None.

    A boundary is proven if a token that ends a pre-token stands before it at the same place in
    both, and the next `agree` tokens of both are the same ones at the same places.  It lies
    between characters (one may make two tokens), and not before a combining one, which might
    belong to the last.  left ends at upto.
    """
    at: dict = {}
    for j in range(len(right.ids)):
        token = right.token(j)
        if token[0] >= upto:
            break
        at[token] = j
    for i in range(len(left.ids) - agree, left.first, -1):
        token = left.token(i - 1)
        if token[0] < right.base:
            return None
        cut = token[1]
        if token[2] not in left.ends or left.offsets[i][0] + left.base < cut or unicodedata.combining(text[cut]):
            continue
        j = at.get(token)
        if j is not None and j + agree < len(right.ids) and all(left.token(i + n) == right.token(j + 1 + n) for n in range(agree)):
            return i, j + 1
    return None


def resync_count(text: str, encode, chunk=CHUNK, overlap=OVERLAP, agree=AGREE) -> int:
    """Number of tokens of text; encode: text -> (ids, offsets, ids that end a pre-token)."""
    done, start, b = 0, 0, min(chunk, len(text))  # tokens counted, the boundary after them, the end of left
    left = Encoded(text, 0, b, encode)
    while b < len(text):
        wide, point = overlap, None
        while True:
            a = max(start, b - wide)
            c = min(b + max(chunk - overlap, wide), len(text))
            right = Encoded(text, a, c, encode)
            if a > start:
                point = splice_point(text, left, right, b, agree)
            if point or a == start:
                break
            wide *= 2
        if point:
            done += point[0] - left.first
            right.first = point[1]
            start = right.token(point[1] - 1)[1]
        # else the overlap has grown to all that is undecided: right, from the same start, replaces left
        left, b = right, c
    return done + len(left.ids) - left.first


def _count(path, limit: int, huge: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        table = memo(f"words {path}", lambda: library(path)[0], with_ids=False)
        encode = None
        for batch in batches:
            doc = batch.column(0)
            for lo, hi, buf, off in tc.slices(batch.column(1)):
                n_bytes = np.diff(off)
                n_tokens = np.zeros(hi - lo, np.int64)
                big = n_bytes > huge
                for i in np.flatnonzero(big).tolist():
                    encode = encode or library(path)[1]
                    n_tokens[i] = resync_count(buf[off[i] : off[i + 1]].tobytes().decode(), encode)
                if not big.all():
                    words = tc.words(buf, off)
                    mine = ~big[words.rows]
                    lengths = np.zeros(len(mine), np.int64)
                    entries = table.lookup(buf, words.start[mine], words.end[mine])  # may grow table.length
                    lengths[mine] = table.length[entries]
                    n_tokens[~big] = tc.segment_sum(lengths, words.first)[~big]
                yield pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], schema=schema)

    return run


def count_tokens(docs: DataFrame, doc_id="doc_id", text="text", path=None, limit=LIMIT, huge=HUGE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; path: the tokenizer's file."""
    base = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    return base.mapInArrow(_count(path, limit, huge), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

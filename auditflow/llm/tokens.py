"""Token ids of texts with a bounded memo of encoded units.

A tokenizer that never lets a token reach over the edge between a character and the white
space after it encodes the parts between such edges independently.  Parts recur, so each
worker keeps those that it has met in a table of fixed size, keyed by 128-bit fingerprints
and looked up for a whole slice of text at once; only new parts reach the tokenizer.  The
table is cleared when it is full, so memory is bounded whatever the corpus holds.
"""

from __future__ import annotations

import base64
import os

import numpy as np

from . import textcore as tc

SLOTS = 1 << 21


class Memo:
    """Fingerprints -> token ids; open addressing over numpy arrays."""

    def __init__(self, encode, slots=SLOTS, with_ids=True):
        self.encode, self.slots, self.with_ids = encode, slots, with_ids
        self.clear()

    def clear(self):
        self.keys = np.zeros(self.slots, np.uint64)
        self.checks = np.zeros(self.slots, np.uint64)
        self.entry = np.zeros(self.slots, np.int32)
        self.length = np.zeros(1 << 16, np.int32)
        self.offset = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.n = self.used = 0

    def _find(self, k: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.full(len(k), -1, np.int32)
        pending = np.arange(len(k))
        slot = (k >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        while len(pending):
            at = slot[pending]
            seen = self.keys[at]
            hit = (seen == k[pending]) & (self.checks[at] == c[pending])
            out[pending[hit]] = self.entry[at[hit]]
            pending = pending[~hit & (seen != 0)]
            slot[pending] = (slot[pending] + 1) & (self.slots - 1)
        return out

    def _add(self, k: np.ndarray, c: np.ndarray, entries: np.ndarray):
        pending = np.arange(len(k))
        slot = (k >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        while len(pending):
            at = slot[pending]
            free = self.keys[at] == 0
            mine, place = pending[free], at[free]
            owner = np.full(0, 0)
            if len(place):
                place, first = np.unique(place, return_index=True)
                owner = mine[first]
                self.keys[place], self.checks[place], self.entry[place] = k[owner], c[owner], entries[owner]
            done = np.zeros(len(k), bool)
            done[owner] = True
            pending = pending[~done[pending]]
            slot[pending] = (slot[pending] + 1) & (self.slots - 1)

    def _grow(self, name: str, need: int):
        have = getattr(self, name)
        if len(have) < need:
            more = np.zeros(max(need, 2 * len(have)), have.dtype)
            more[: len(have)] = have
            setattr(self, name, more)

    def lookup(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Entry number of every unit buf[start:end]."""
        k = tc.fingerprints(buf, start, end, 0) | np.uint64(1)
        c = tc.fingerprints(buf, start, end, 1)
        out = self._find(k, c)
        new = np.flatnonzero(out < 0)
        if len(new):
            _, one, back = np.unique(k[new], return_index=True, return_inverse=True)
            one = new[one]
            if self.n + len(one) > self.slots * 6 // 10 and self.n:
                self.clear()
                return self.lookup(buf, start, end)
            while self.n + len(one) > self.slots * 6 // 10:  # one slice of more units than the table is for
                self.slots *= 2
                self.clear()
            data = buf.tobytes()
            ids = self.encode([data[a:b].decode("utf-8", "replace") for a, b in zip(start[one].tolist(), end[one].tolist())])
            entries = np.arange(self.n, self.n + len(one), dtype=np.int32)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) if self.with_ids else np.asarray(ids, np.int64)
            self._grow("length", self.n + len(one))
            self.length[entries] = lengths
            if self.with_ids:
                total = int(lengths.sum())
                self._grow("offset", self.n + len(one))
                self._grow("pool", self.used + total)
                self.offset[entries] = self.used + np.cumsum(lengths) - lengths
                self.pool[self.used : self.used + total] = np.fromiter((x for i in ids for x in i), np.uint32, total)
                self.used += total
            self._add(k[one], c[one], entries)
            self.n += len(one)
            out[new] = entries[back]
        return out


def byte_units(buf: np.ndarray, off: np.ndarray) -> tc.Spans:
    """Parts of every row that byte-level BPE with the usual pattern encodes independently.

    A part is a run of white space and the word after it: a cut stands where ASCII white space
    follows a character that is no white space of any kind.  White space beyond ASCII, and the
    separators 1C-1F, end no part, as the pattern joins them with what follows.
    """
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return tc.Spans(z, z, np.zeros(len(off), np.int64))
    space = tc.SPACE[buf]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[0] = False
    cut[off[:-1][off[:-1] < n]] = False
    at = np.flatnonzero(cut)
    pad = np.concatenate((np.zeros(3, np.uint8), buf))
    a, b, c = pad[at], pad[at + 1], pad[at + 2]  # the three bytes before at
    wide = ((a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    odd = wide | ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((c >= 0x1C) & (c <= 0x1F))
    start = np.union1d(at[~odd], off[:-1][off[:-1] < off[1:]])
    return tc.Spans(start, np.append(start[1:], n), np.searchsorted(start, off))


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed value: the pattern that goes with the rank file, and the special string of the vocabulary.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def byte_encoder(json_path: str | None = None, ranks_path: str | None = None):
    """list of texts -> list of ids, those of the tokenizers library for json_path.

    Plain parts go to the rank file of the same vocabulary, which is several times faster; parts
    with special strings or characters past U+07FF, where the libraries' character classes might
    differ, go to the tokenizers library.
    """
    json_path, ranks_path = json_path or _public("byte_bpe_50k.json"), ranks_path or _public("byte_bpe_50k.tiktoken")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    exact.no_truncation()
    exact.no_padding()
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(texts):
        return [fast(t) if "<|" not in t and (t.isascii() or max(t) < "ࠀ") else exact.encode(t, add_special_tokens=False).ids for t in texts]

    return encode


def memo(kind: str, make, **options) -> Memo:
    """One memo a worker and kind."""
    if kind not in _LOADED:
        _LOADED[kind] = Memo(make(), **options)
    return _LOADED[kind]

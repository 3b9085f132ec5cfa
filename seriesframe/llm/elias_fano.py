"""Elias-Fano sequences and an n-gram trie over them, read in place from one buffer.

A sequence of ascending integers keeps the low bits of each value packed and
the high bits in unary. ``find`` looks a value up in its bucket of high bits,
for arrays of values at once. A buffer may be bytes or a memory-mapped file;
besides running counts over the unary bits, nothing of it is copied.
"""

from __future__ import annotations

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(1).astype(np.int64)
#: Place of the k-th one of a byte.
_SELECT = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.int64)
PAD = bytes(8)


def _packed(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each value, one after the other."""
    out, step = [], 1 << 16  # a multiple of 8, so parts end at whole bytes
    for at in range(0, len(values) if width else 0, step):
        raw = values[at:at + step].astype("<u8").view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def encode(values: np.ndarray) -> bytes:
    """Buffer of a strictly ascending sequence of non-negative integers."""
    n, top = len(values), int(values[-1]) + 1 if len(values) else 1
    width = max(0, (top // max(n, 1)).bit_length() - 1)
    bits = np.zeros(n + (top >> width) + 2, np.uint8)
    bits[(values >> width) + np.arange(n)] = 1
    low, high = _packed(values, width) + PAD, np.packbits(bits, bitorder="little").tobytes()
    return np.array([n, width, len(low), len(high)], "<i8").tobytes() + low + high


class Sequence:
    """View of a buffer made by ``encode``."""

    def __init__(self, buffer, at: int = 0):
        n, width, n_low, n_high = np.frombuffer(buffer, "<i8", 4, at).tolist()
        self.n, self.width, self.mask = n, np.int64(width), np.int64((1 << width) - 1)
        self.low_words = np.ndarray(n_low - 7, "<i8", buffer, at + 32, (1,))
        self.high = np.frombuffer(buffer, np.uint8, n_high, at + 32 + n_low)
        self.end = at + 32 + n_low + n_high
        self.ones = np.concatenate([np.zeros(1, np.int64), np.cumsum(_ONES[self.high])])
        self.zeros = 8 * np.arange(len(self.ones)) - self.ones
        self.buckets = int(self.zeros[-1])

    def _low(self, at):
        place = at * self.width
        return (self.low_words[place >> 3] >> (place & 7)) & self.mask

    def _bucket_start(self, h):
        """Number of values whose high bits are below h."""
        k = np.maximum(h - 1, 0)
        byte = np.searchsorted(self.zeros, k, side="right") - 1
        place = 8 * byte + _SELECT[255 - self.high[byte], k - self.zeros[byte]]
        return np.where(h > 0, place - k, 0)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        byte = np.searchsorted(self.ones, at, side="right") - 1
        place = 8 * byte + _SELECT[self.high[byte], at - self.ones[byte]]
        return ((place - at) << self.width) | self._low(at)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each x in the sequence, -1 where it is not there: the successor of x, if equal."""
        out = np.full(len(x), -1, np.int64)
        live = np.flatnonzero((x >= 0) & ((x >> self.width) < self.buckets - 1))
        h, want = x[live] >> self.width, x[live] & self.mask
        low, high = self._bucket_start(h), self._bucket_start(h + 1)
        end = high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            less = self._low(mid) < want[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
            open_ = open_[low[open_] < high[open_]]
        hit = np.flatnonzero(low < end)
        hit = hit[self._low(low[hit]) == want[hit]]
        out[live[hit]] = low[hit]
        return out


#: A value v is stored as 1 + STEPS times -log10 v, rounded; 0 is none. Sixteen bits reach below 1e-31.
STEPS = 2048


def quantised(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, 1 + np.minimum(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEPS), 65_534), 0).astype("<u2")


def restored(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, np.power(10.0, (1.0 - code.astype(np.float64)) / STEPS), 0.0)


def _below(children: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Children's ids made ascending over all parents: each parent's start above the last id of the one before."""
    ends = np.cumsum(children)
    last = ids[ends[children > 0] - 1]
    base = np.concatenate([np.zeros(1, np.int64), np.cumsum(last)])[:-1]
    return ids + np.repeat(base, children[children > 0])


def build(first, n_second, second, p_second, rest_second, n_third, third, p_third) -> bytes:
    """Buffer of a trie of three levels.

    ``first`` are ascending ids, ``second`` and ``third`` the ids (1 at least,
    ascending under each parent) of their children, ``n_second`` and
    ``n_third`` the children of each node. ``p_second`` and ``p_third`` are
    the probabilities kept at the nodes, ``rest_second`` the weight that a
    second-level node leaves to the lower order.
    """
    starts = lambda n: np.concatenate([np.zeros(1, np.int64), np.cumsum(n)]) + np.arange(len(n) + 1)
    return b"".join([
        encode(first), encode(starts(n_second)), encode(_below(n_second, second)), encode(starts(n_third)), encode(_below(n_third, third)),
        quantised(p_second).tobytes(), quantised(rest_second).tobytes(), quantised(p_third).tobytes()])


class Trie:
    """View of a buffer made by ``build``."""

    def __init__(self, buffer):
        self.first = Sequence(buffer)
        self.to_second = Sequence(buffer, self.first.end)
        self.second = Sequence(buffer, self.to_second.end)
        self.to_third = Sequence(buffer, self.second.end)
        self.third = Sequence(buffer, self.to_third.end)
        at, n, m = self.third.end, self.second.n, self.third.n
        self.p_second, self.rest_second = np.frombuffer(buffer, "<u2", n, at), np.frombuffer(buffer, "<u2", n, at + 2 * n)
        self.p_third = np.frombuffer(buffer, "<u2", m, at + 4 * n)

    @staticmethod
    def _children(pointers: Sequence, level: Sequence, node: np.ndarray, ids: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Node of each id among the children of node[parent]; -1 where the node or the child is not there."""
        known = np.maximum(node, 0)
        start, end = (pointers[known + k] - known - k for k in (0, 1)) if pointers.n > 1 else (known * 0, known * 0)
        base = np.where(start > 0, level[np.maximum(start - 1, 0)], 0) if level.n else start
        found = level.find(base[parent] + ids)
        inside = (node[parent] >= 0) & (found >= start[parent]) & (found < end[parent])
        return np.where(inside, found, -1)

    def search(self, first, second, parent_second, third, parent_third):
        """Codes for ids of a query trie: of the second level (probability, rest) and of the third."""
        a = self.first.find(first)
        b = self._children(self.to_second, self.second, a, second, parent_second)
        c = self._children(self.to_third, self.third, b, third, parent_third)
        pick = lambda codes, at: np.where(at >= 0, codes[np.maximum(at, 0)], 0) if len(codes) else np.zeros(len(at), "<u2")
        return pick(self.p_second, b), pick(self.rest_second, b), pick(self.p_third, c)

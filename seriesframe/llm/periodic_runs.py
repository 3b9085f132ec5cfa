"""Periodic runs of words: difference-cover suffix samples and a harmonic grid.

A run is a stretch of words with smallest period q, at least ``LEAST`` words and
``TIMES`` periods long, that no neighbouring word extends. For each period p the
places i and i + p are compared on a grid; where they match, longest common
extensions forwards and backwards give the stretch. The grid step for p is the
least number of matches that a run of period p has, so no run lies between two
grid places; all steps together are a harmonic series, n log n places a text.

Extensions use a difference cover modulo ``V``: places whose remainder is in
``COVER`` are sampled, and any two places reach a pair of samples after fewer
than ``V`` common steps. Those few words are compared; only sampled suffixes are
sorted (prefix doubling over the samples of each remainder class), with a table
of minima over their common prefixes for the rest. The sorting is done only
once a pair gets as far as its samples, which in most texts none does.

Each text is one row's work, in numpy within Arrow batches; grid places are
handled ``CHUNK`` at a time, so that memory grows with the text alone.

Defined results: null and empty texts have no words, runs or kept words.
Repeated rows are all returned. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cmp_to_key, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.common import read

LEAST, TIMES = 24, 3
#: A perfect difference cover: every remainder is the difference of two of its members.
V, COVER = 13, (0, 1, 3, 9)
CHUNK = 1 << 20


def _steps() -> np.ndarray:
    """For remainders (a, b), the least t such that a + t and b + t are both in the cover."""
    out = np.zeros((V, V), np.int64)
    for a in range(V):
        for b in range(V):
            out[a, b] = next(t for t in range(V) if (a + t) % V in COVER and (b + t) % V in COVER)
    return out


SYNC = _steps()


class Extensions:
    """Longest common extensions of pairs of places of a sequence of word numbers."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.ranks = None

    def _sort(self):
        """Ranks of the sampled suffixes in sorted order, and the minima over common prefixes of neighbours.

        Samples of one remainder are a sequence of their own, each followed by the
        one V words on; round k sorts them by their first V * 2^k words.
        """
        n = len(self.words)
        places = [np.arange(r, n, V) for r in COVER]
        starts = np.cumsum([0, *map(len, places)])
        at = np.concatenate(places)
        m = len(at)
        self.number = np.full(n, -1, np.int64)
        self.number[at] = np.arange(m)
        ends = np.repeat(starts[1:], [len(p) for p in places])
        padded = np.concatenate([self.words, np.full(V, -1, self.words.dtype)])
        blocks = np.stack([padded[at + k] for k in range(V)], axis=1)
        order = np.lexsort(blocks.T[::-1])
        sorted_blocks = blocks[order]
        fresh = np.concatenate([np.zeros(1, bool), (sorted_blocks[1:] != sorted_blocks[:-1]).any(1)])
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(fresh)
        levels, hop = [rank], 1
        while rank.max() < m - 1:
            after = np.arange(m) + hop
            second = np.where(after < ends, rank[np.minimum(after, m - 1)], -1)
            order = np.lexsort((second, rank))
            a, b = rank[order], second[order]
            fresh = np.concatenate([np.zeros(1, bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(fresh)
            levels.append(rank)
            hop *= 2
        self.ranks = rank
        order = np.argsort(rank, kind="stable")
        common = self._common(order[:-1], order[1:], at, ends, levels, padded)
        self.minima = [common]
        while 2 << (len(self.minima) - 1) <= len(common):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _common(self, a, b, at, ends, levels, padded):
        """Common prefixes of the suffixes numbered a and b, from the ranks of every round.

        Equal ranks of round k stand for V * 2^k equal words: blocks of two
        different suffixes that reach the text's end are never equal.
        """
        last_a, last_b, total, m = ends[a], ends[b], np.zeros(len(a), np.int64), len(at) - 1
        for k in range(len(levels) - 1, -1, -1):
            rank = levels[k]
            same = (a < last_a) & (b < last_b) & (rank[np.minimum(a, m)] == rank[np.minimum(b, m)])
            total[same] += V << k
            a, b = a + (same << k), b + (same << k)
        live = (a < last_a) & (b < last_b)
        i, j = at[np.minimum(a, m)], at[np.minimum(b, m)]
        for k in range(V):
            live &= (padded[i + k] == padded[j + k]) & (padded[i + k] >= 0)
            total[live] += 1
        return total

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words that are the same from i and from j on, for places i < j."""
        words, n = self.words, len(self.words)
        reach = SYNC[i % V, j % V]
        out = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for t in range(V):
            live = live[(reach[live] > t) & (j[live] + t < n)]
            live = live[words[i[live] + t] == words[j[live] + t]]
            if not len(live):
                break
            out[live] = t + 1
        ready = np.flatnonzero((out == reach) & (j + reach < n))
        if len(ready):
            # one more word, so that few pairs need the sorted samples
            x, y = i[ready] + reach[ready], j[ready] + reach[ready]
            hit = words[x] == words[y]
            ready, x, y = ready[hit], x[hit], y[hit]
        if len(ready):
            if self.ranks is None:
                self._sort()
            a, b = self.ranks[self.number[x]], self.ranks[self.number[y]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            for k in np.unique(level):
                own = level == k
                table = self.minima[k]
                out[ready[own]] += np.minimum(table[low[own]], table[high[own] - (1 << int(k))])
        return out


def _step(p):
    """Least number of places i of a run of period p whose word is also at i + p."""
    return np.maximum(LEAST - p, (TIMES - 1) * p)


@lru_cache(maxsize=20)
def _short_grid(size: int):
    """Grid places (i, i + p) for texts of up to ``size`` words, by i + p."""
    p, i = _places(1, size // TIMES, size)
    order = np.argsort(i + p, kind="stable")
    i, p = i[order], p[order]
    return i.astype(np.int32), (i + p).astype(np.int32)


def _places(low: int, high: int, n: int):
    """Periods and grid places for the periods from low to high in a text of n words."""
    p = np.arange(low, high + 1)
    counts = np.maximum(0, -(-(n - p) // _step(p)))
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    p = np.repeat(p, counts)
    return p, k * _step(p)


def _grid(n: int):
    """Grid places (i, j) of a text of n words, in parts of about ``CHUNK``."""
    if n < LEAST:
        return
    size = 1 << (n - 1).bit_length()
    if size <= 1 << 16:
        i, j = _short_grid(size)
        end = np.searchsorted(j, n)
        yield i[:end], j[:end]
        return
    low, top = 1, n // TIMES
    while low <= top:
        high = min(top, max(low, int(low * np.exp(2.0 * CHUNK / n)) if low > 8 else 8))
        p, i = _places(low, high, n)
        yield i, i + p
        low = high + 1


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers, by start, then period."""
    n = len(words)
    forward = Extensions(words)
    backward = Extensions(words[::-1])
    found: dict = {}
    for i, j in _grid(n):
        hit = np.flatnonzero(words[i] == words[j])
        hit = hit[TIMES * (j[hit] - i[hit]) <= n]
        if not len(hit):
            continue
        i, j = i[hit].astype(np.int64), j[hit].astype(np.int64)
        ahead = forward(i, j)
        # the words before i and j, read backwards from the text's end
        p = j - i
        behind = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        behind[inner] = backward(n - j[inner], n - i[inner])
        start, length = i - behind, behind + ahead + p
        good = length >= np.maximum(LEAST, TIMES * p)
        for s, size, q in set(zip(start[good].tolist(), length[good].tolist(), p[good].tolist())):
            found[s, size] = min(q, found.get((s, size), q))
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def best_run(found: list):
    """The run of the greatest length over period; ties: smallest start, then period."""
    def order(a, b):
        return b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2]

    return min(found, key=cmp_to_key(order)) if found else None


def kept(n: int, found: list) -> np.ndarray:
    """Which words no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def numbers(words: list[bytes]) -> np.ndarray:
    seen: dict = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def periodised(doc_id, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, chosen by the id's checksum, repeated from some word on.

    This is the query's test input; the checksum of a null id is that of an empty text.
    """
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[:n - a]


#: Outputs of ``detect`` and their types.
OUTPUTS = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string",
           "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}
_ARROW = {"long": pa.int64(), "string": pa.string(),
          OUTPUTS["runs"]: pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))}
DIGEST = tuple(OUTPUTS)[:7]


def describe(words: list[bytes], outputs) -> dict:
    """The named outputs for the words of one text."""
    found = runs(numbers(words))
    best = best_run(found) or (None, None, None)
    out = {"n_runs": len(found), "start": best[0], "length": best[1], "period": best[2],
           "exponent_milli": 1000 * best[1] // best[2] if found else None,
           "runs": [dict(zip(("start", "length", "period"), r)) for r in found]}
    if "runs_sha256" in outputs:
        out["runs_sha256"] = hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest()
    if "collapsed_sha256" in outputs or "collapsed" in outputs:
        left = b" ".join(words if not found else [w for w, k in zip(words, kept(len(words), found).tolist()) if k])
        out["collapsed_sha256"] = hashlib.sha256(left).hexdigest()
        out["collapsed"] = left.decode()
    return out


def detect(docs: DataFrame, outputs=("runs", "collapsed"), text: str = "text", key: str = "doc_id", change=None) -> DataFrame:
    """The key and the named outputs for each row of ``docs``.

    ``runs`` are all runs, ``collapsed`` the text with each run cut to its first
    period. ``change(key, words)`` may replace the words before they are searched.
    """
    outputs = tuple(outputs)

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for own, t in zip(part.column(0), part.column(1)):
                    words = (t.as_py() or "").encode().split()  # splits bytes at the six ASCII separators only
                    rows.append(describe(change(own.as_py(), words) if change else words, outputs))
                made = [pa.array([r[o] for r in rows], _ARROW[OUTPUTS[o]]) for o in outputs]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=[key, *outputs])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(work, f"`{key}` {kind}, " + ", ".join(f"`{o}` {OUTPUTS[o]}" for o in outputs))


def query(spark, sf_dir: str) -> DataFrame:
    return detect(read(spark, sf_dir, "documents"), DIGEST, change=periodised)

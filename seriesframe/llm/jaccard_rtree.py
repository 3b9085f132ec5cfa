"""Near-duplicate join on word shingles by a count-vector R-tree; exact.

Two documents link when their sets of five-word shingles have a Jaccard
similarity of at least ``percent``. The steps:

1. One pass over the texts gives each document its set (64-bit hashes), the
   set's 128-bit digest, a count vector and a prefix. Equal sets are one class
   from here on, so that copies are neither compared nor expanded.
2. Count vectors: shingles are hashed into ``G`` groups (a power of two near a
   quarter of the set's size); the counts are a point. The overlap of two sets
   is at most the sum of the coordinate minima (with at most ``MAX_GROUPS``
   coordinates, as a class has a row in each of its blocks). Vectors of different lengths
   are folded to the shorter.
3. Points are searched in blocks of classes that share a prefix shingle. In
   any fixed order of all shingles, sets that link share at least l of their
   first n - ceil(0.8 n) + l shingles, with l by the smaller set. Classes with
   fewer shared prefix shingles than a partner would need are dropped, and so
   are blocks left with one class. Shingles frequent in a sample of documents
   come last in the order: that keeps common passages out of the blocks and,
   as any order is right, changes no result.
4. Each block is searched with an R-tree over its points (bounding boxes of
   counts and sizes), which prunes by the summed minima; a tree of up to ``LEAF``
   points is one leaf, whose pairs are all bounded. The search goes from point to
   point: what is reached leaves the tree, so a block sends a spanning forest of
   the pairs that the bound lets through, fewer rows than it has classes.
5. The forests' components are clusters; every link lies inside one. Each text
   of a cluster goes once to the cluster's task, which searches a tree again in
   the same way, but goes on only to points whose whole sets link, and sends a
   spanning forest of verified links. Their components are the result.

``pairs`` gives every link: all pairs of each block, verified by joins.

Blocks and clusters larger than ``SLICE`` rows (clusters also by their shingles)
are dealt to several tasks by pairs of slices. Everything between the steps is
written to the shared folder. Words and shingles are compared by 64-bit hashes.

Defined results: null texts are empty; empty documents link with nothing and
are their own component. Repeated and null ids are rows of their own;
``component_id`` is the smallest id of the component, null where it has none.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.common import free, read, shared, text_of
from seriesframe.llm.components import components
from seriesframe.llm.url_cascade import _hits, _level

WORDS = 5
SAMPLE_DOCS = 5_000
MAX_FREQUENT = 200_000
MAX_GROUPS = 128
FILTER_BITS = 1 << 25
SLICE = 4096
SLICE_SHINGLES = 1 << 22
LEAF = SCAN = 16
SEEN = 1 << 18
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def least_overlap(n, percent: int):
    """Shingles that a set of n must share with any set it links with."""
    return -(-percent * n // 100)


#: A-Z to a-z and every separator to a space, in UTF-8.
_PLAIN = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


CHUNK = 1 << 18
_BYTES = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64)


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(CHUNK, base, np.uint64)]))


_POWERS, _INVERSE = _powers(int(_M1)), _powers(pow(int(_M1), -1, 1 << 64))


def _chunk_hashes(chunk: bytes) -> np.ndarray:
    """Hash of each word: its bytes as digits of a number to the base ``_M1``, taken from running sums."""
    b = np.frombuffer(chunk, np.uint8)
    edge = np.flatnonzero(np.diff(b != 32, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[b] * _POWERS[:len(b)])])
        return (sums[end] - sums[start]) * _INVERSE[start]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word of a text with plain separators, in chunks cut between words.

    A word longer than a chunk is hashed by itself.
    """
    found, at = [], 0
    while at < len(data):
        end = len(data) if len(data) - at <= CHUNK else data.rfind(b" ", at, at + CHUNK + 1)
        if end >= 0:
            found.append(_chunk_hashes(data[at:end]))
        else:
            end = data.find(b" ", at)
            end = len(data) if end < 0 else end
            found.append(np.array([xxhash.xxh3_64_intdigest(data[at:end])], np.uint64))
        at = end + 1
    return found[0] if len(found) == 1 else np.concatenate([np.empty(0, np.uint64), *found])


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, its A-Z lower-cased."""
    h = word_hashes(text.encode().translate(_PLAIN))
    if not len(h):
        return h
    size = min(WORDS, len(h))
    mixed = np.full(len(h) - size + 1, size if size < WORDS else 0, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            mixed = (mixed ^ h[k:k + len(mixed)]) * _M1
            mixed ^= mixed >> np.uint64(29)
        mixed *= _M2
        mixed ^= mixed >> np.uint64(32)
    mixed.sort()
    return mixed[np.concatenate([np.ones(1, bool), mixed[1:] != mixed[:-1]])]


def groups_of(n: int) -> int:
    return min(MAX_GROUPS, 1 << max(4, (n // 4 - 1).bit_length() if n > 4 else 0))


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """Counts by group in bytes; 255 stands for any number from there on."""
    g = groups_of(len(shingles))
    return np.minimum(np.bincount((shingles & np.uint64(g - 1)).astype(np.int64), minlength=g), 255).astype(np.uint8)


def counts_of(vector: bytes) -> np.ndarray:
    v = np.frombuffer(vector, np.uint8).astype(np.int64)
    v[v == 255] = 1 << 40  # no bound
    return v


def _prefix(shingles: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    n = len(shingles)
    at = np.searchsorted(frequent, shingles)
    common = frequent[np.minimum(at, len(frequent) - 1)] == shingles if len(frequent) else np.zeros(n, bool)
    length = n - int(least_overlap(n, percent)) + 1 + n // 10
    return np.concatenate([shingles[~common], shingles[common]])[:length] >> np.uint64(24)


def _python(docs: DataFrame, schema: str, arrow: pa.Schema, make) -> DataFrame:
    """Rows made of each text by ``make(row id, text)``."""

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [r for key, text in zip(part.column(0), part.column(1)) for r in make(key.as_py(), text.as_py() or "")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return docs.mapInArrow(work, schema)


def _frequent(docs: DataFrame, sample_docs: int) -> np.ndarray:
    """Shingles found in several documents of a sample; only the order of shingles depends on it."""
    total = docs.count()
    step = max(1, total // max(1, sample_docs))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "_text"), F.lit(step)) == 0).select("doc_id", "_text")
    found = _python(sample, "h array<long>", pa.schema([("h", pa.list_(pa.int64()))]), lambda _, t: [(shingle_set(t).view(np.int64),)])
    top = (found.select(F.explode("h").alias("h")).groupBy("h").count().where("count >= 3")
           .orderBy(F.desc("count"), "h").limit(MAX_FREQUENT).select("h").collect())
    return np.sort(np.array([r.h for r in top], np.int64).view(np.uint64))


def _points(docs: DataFrame, percent: int, sample_docs: int) -> DataFrame:
    """A row for each document: size, digest and, where not empty, vector and prefix."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, sample_docs))
    arrow = pa.schema([("doc_id", docs.schema["doc_id"].dataType.simpleString() == "int" and pa.int32() or pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()),
                       ("digest", pa.binary()), ("vector", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def make(key, text):
        s = shingle_set(text)
        if not len(s):
            return [(key["doc_id"], key["text_hash"], 0, None, None, None)]
        return [(key["doc_id"], key["text_hash"], len(s), xxhash.xxh3_128_digest(s.tobytes()), count_vector(s).tobytes(), _prefix(s, frequent.value, percent).view(np.int64))]

    keyed = docs.select(F.struct("doc_id", F.xxhash64("_text").alias("text_hash")).alias("key"), "_text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _python(keyed, f"doc_id {kind}, text_hash long, n long, digest binary, vector binary, prefix array<long>", arrow, make)


def _blocks(classes: DataFrame, percent: int) -> DataFrame:
    """``h``, ``id``, ``pos``: classes that share a prefix shingle and enough of them to have a partner."""
    spark = classes.sparkSession
    own = lambda: {"_h1": F.xxhash64(F.lit(3), F.col("h")), "_h2": F.xxhash64(F.lit(4), F.col("h"))}
    signs = classes.select("id", F.posexplode("prefix").alias("pos", "h"))
    many = shared(signs.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "shared-shingles")
    bits = min(FILTER_BITS, max(64, -(-many.count() * 10 // 64) * 64))
    bloom = shared(_level(many.select("h").withColumns(own()), 1, bits, 4), "shared-filter")
    near = signs.withColumns(own()).where(_hits(bloom.select("words").scalar(), bits, 4)).select("h", "id", "pos")
    out = shared(near.join(many, "h"), "blocks")
    need = 1 + F.floor(F.ceil(F.col("n") * percent / 100) / 10)
    for _ in range(2):
        enough = out.groupBy("id").agg(F.count("*").alias("shares")).join(classes.select("id", "n"), "id").where(F.col("shares") >= need)
        left = out.join(enough.select("id"), "id", "left_semi").select("h", "id", "pos")
        several = left.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
        out = shared(left.join(several, "h"), "blocks")
    return out


class Tree:
    """R-tree over the count vectors of one block, packed in the order of its rows."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        self.levels = [(vectors, sizes, sizes, comps, np.ones(len(sizes), bool))]
        while len(self.levels[-1][1]) > LEAF:
            v, low, high, comp, one = self.levels[-1]
            at = np.arange(0, len(low), LEAF)
            same = np.minimum.reduceat(comp, at) == np.maximum.reduceat(comp, at)
            self.levels.append((np.maximum.reduceat(v, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), comp[at], same & np.logical_and.reduceat(one, at)))

    def search(self, vector, size: int, comp: int, percent: int):
        """Rows of other components that the bound lets through, and their bounds."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            v, low, high, own, one = (x[at] for x in self.levels[depth])
            fits = (100 * low <= size * 10000 // percent) & (100 * high >= percent * size) & ~(one & (own == comp))
            at, v, low = at[fits], v[fits], low[fits]
            bound = np.minimum(np.minimum(v, vector).sum(1), size)
            good = bound * (100 + percent) >= percent * (size + np.maximum(low, -(-percent * size // 100)))
            at, bound = at[good], bound[good]
            if depth == 0 or not len(at):
                return at, bound
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < len(self.levels[depth - 1][1])]


def _fold(vector: np.ndarray, g: int) -> np.ndarray:
    return vector.reshape(-1, g).sum(0) if len(vector) > g else vector


FEW = 6


def _bounds(rows: list, pairs: list) -> list:
    """The bound on the overlap for each (i, j) of ``pairs``, by vectors folded to the shorter of the two."""
    out = [min(rows[i][2], rows[j][2]) for i, j in pairs]
    if len(pairs) <= FEW:
        known = {i: counts_of(rows[i][3]) for i in set(sum(pairs, ()))}
        for k, (i, j) in enumerate(pairs):
            g = min(len(known[i]), len(known[j]))
            out[k] = min(out[k], int(np.minimum(_fold(known[i], g), _fold(known[j], g)).sum()))
        return out
    place, by_length, by_lengths, folded = [], {}, {}, {}
    for r in rows:
        place.append(len(by_length.setdefault(len(r[3]), [])))
        by_length[len(r[3])].append(r[3])
    for k, (i, j) in enumerate(pairs):
        by_lengths.setdefault((len(rows[i][3]), len(rows[j][3])), []).append(k)
    for both, ks in by_lengths.items():
        g = min(both)
        for n in both:
            if (n, g) not in folded:
                folded[n, g] = counts_of(b"".join(by_length[n])).reshape(-1, n // g, g).sum(1)
        for at in range(0, len(ks), 4096):
            part = ks[at:at + 4096]
            left, right = (folded[n, g][[place[pairs[k][side]] for k in part]] for side, n in enumerate(both))
            for k, v in zip(part, np.minimum(left, right).sum(1).tolist()):
                out[k] = min(out[k], v)
    return out


class Index:
    """Trees over the count vectors of some rows, one for each length of vector.

    ``open`` marks the rows not yet reached. A tree is built anew from its open
    rows when half of it has been reached.
    """

    def __init__(self, vectors: list, sizes: np.ndarray, percent: int):
        self.vectors, self.sizes, self.percent = vectors, sizes, percent
        self.open = np.ones(len(sizes), bool)
        lengths = np.array([len(v) for v in vectors])
        left = np.array([v[:len(v) // 2].sum() for v in vectors])
        order = np.lexsort((left, np.log(sizes) // 0.06))
        self.rows = {g: order[lengths[order] == g] for g in np.unique(lengths).tolist()}
        self.trees: dict = {}

    def near(self, q: int) -> np.ndarray:
        """Open rows that the bound on the overlap with row ``q`` lets through."""
        found = [np.empty(0, np.int64)]
        for g, rows in self.rows.items():
            alive = self.open[rows]
            count = np.count_nonzero(alive)
            if not count:
                continue
            if 2 * count <= len(rows):
                rows = self.rows[g] = rows[alive]
                self.trees = {k: t for k, t in self.trees.items() if k[0] != g}
            step = min(g, len(self.vectors[q]))
            if (g, step) not in self.trees:
                self.trees[g, step] = Tree(np.stack([_fold(self.vectors[r], step) for r in rows]), self.sizes[rows], np.zeros(len(rows), np.int64))
            at = rows[self.trees[g, step].search(_fold(self.vectors[q], step), int(self.sizes[q]), -1, self.percent)[0]]
            found.append(at[self.open[at]])
        return np.concatenate(found)


def _forest(index: Index, seeds, near):
    """Edges (q, row) of a spanning forest; ``near`` gives the open neighbours of a row."""
    for seed in seeds:
        if index.open[seed]:
            index.open[seed] = False
            reached = [seed]
            for q in reached:
                if not index.open.any():
                    return
                new = near(q).tolist()
                index.open[new] = False
                reached.extend(new)
                yield from ((q, j) for j in new)


class Joined:
    """Union-find over the edges that a task has sent; it starts anew when full, which only repeats edges."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        while (y := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(y, y)
            x = y
        return x

    def join(self, a, b) -> bool:
        """Whether the edge joins what was apart."""
        if len(self.parent) > SEEN:
            self.parent.clear()
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[a] = b
        return a != b


def _search_leaf(rows: list, percent: int):
    """Candidate pairs of a block of one leaf: every pair that sizes and components allow is bounded."""
    across = rows[0][6][0] != rows[0][6][1]

    def fits(q, r):
        low, high = (q[2], r[2]) if q[2] < r[2] else (r[2], q[2])
        return q[1] != r[1] and 100 * low >= percent * high and not (across and q[5] == r[5])

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if fits(rows[i], rows[j])]
    for (i, j), bound in zip(pairs, _bounds(rows, pairs)):
        q, r = rows[i], rows[j]
        if bound * (100 + percent) >= percent * (q[2] + r[2]):
            yield min(q[0], r[0]), max(q[0], r[0])


def _search_block(rows: list, mode: str, percent: int):
    """Candidate pairs of one block; rows are (id, comp, n, vector, central, slice, pair of slices).

    ``forest`` gives a spanning forest of them, from the most central row on; ``all`` every pair.
    """
    m = len(rows)
    if m <= SCAN:
        yield from _search_leaf(rows, percent)
        return
    vectors = [counts_of(r[3]) for r in rows]
    if mode == "forest":
        index = Index(vectors, np.array([r[2] for r in rows], np.int64), percent)
        seeds = sorted(range(m), key=lambda i: (-rows[i][4], rows[i][0]))
        for q, j in _forest(index, seeds, index.near):
            yield min(rows[q][0], rows[j][0]), max(rows[q][0], rows[j][0])
        return
    count: dict = {}
    for r in rows:
        count[r[1]] = count.get(r[1], 0) + 1
    order = sorted(range(m), key=lambda i: (len(vectors[i]), rows[i][1] if count[rows[i][1]] >= LEAF else -1, rows[i][2], rows[i][0]))
    rows, vectors = [rows[i] for i in order], [vectors[i] for i in order]
    ids, comps, sizes = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
    slices = np.array([r[5] for r in rows], np.int64)
    across = rows[0][6][0] != rows[0][6][1]
    lengths = np.array([len(v) for v in vectors])
    trees: dict = {}
    for q in range(m):
        g = lengths[q]
        lo = int(np.searchsorted(lengths, g))
        step = min(int(lengths[lo]), int(g))
        if (lo, step) not in trees:
            trees[lo, step] = Tree(np.stack([_fold(v, step) for v in vectors[lo:]]), sizes[lo:], comps[lo:])
        at, _ = trees[lo, step].search(_fold(vectors[q], step), int(sizes[q]), int(comps[q]), percent)
        at = at + lo
        keep = (at != q) & (comps[at] != comps[q]) & ((lengths[at] > g) | (at > q))
        if across:
            keep &= slices[at] != slices[q]
        yield from ((min(int(ids[q]), j), max(int(ids[q]), j)) for j in ids[at[keep]].tolist())


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _groups(batches, width: int, make):
    """Lists of ``make(row)`` for each run of rows with equal first ``width`` columns; runs of one row are left out."""
    key, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            for r in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                if r[:width] != key:
                    if len(rows) > 1:
                        yield rows
                    key, rows = r[:width], []
                rows.append(make(r))
    if len(rows) > 1:
        yield rows


def _sent(pairs):
    """Batches of pairs."""
    while part := list(islice(pairs, 1 << 14)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _PAIRS)], schema=_PAIRS)


def _candidates(blocks: DataFrame, vectors: DataFrame, mode: str, percent: int, slice_rows: int) -> DataFrame:
    """Distinct pairs (a, b) of classes in one block and not in one component that the bound lets through.

    ``blocks`` has h, id, comp, n and central, ``vectors`` id and vector. Modes: ``forest``
    gives pairs that connect whatever all pairs would, ``all`` every pair.
    """
    sizes = blocks.groupBy("h").agg(F.count("*").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    sizes = sizes.where((F.col("lo") != F.col("hi")) & ((F.col("rows") > 2) | (100 * F.col("least") >= percent * F.col("most"))))
    dealt = blocks.join(sizes.select("h", F.ceil(F.col("rows") / slice_rows).cast("int").alias("slices")), "h")
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    dealt = dealt.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    near = dealt.join(vectors, "id").select(
        "h", F.least("slice", "t").alias("i"), F.greatest("slice", "t").alias("j"), "id", "comp", "n", "vector", "central", "slice")

    def found_in(batches):
        joined = Joined()
        for rows in _groups(batches, 3, lambda r: (*r[3:9], r[1:3])):
            for a, b in _search_block(rows, mode, percent):
                if mode == "all" or joined.join(a, b):
                    yield a, b

    near = near.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "id")
    return near.mapInArrow(lambda batches: _sent(found_in(batches)), "a long, b long").distinct()


def _linked_with(sets: list, q: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``others`` whose sets link with that of ``q``, counted whole."""
    own, out, at = sets[q], [np.empty(0, np.int64)], 0
    while at < len(others):
        end, held = at, 0
        while end < len(others) and held < SLICE_SHINGLES // 4:
            held += len(sets[others[end]])
            end += 1
        part = others[at:end]
        sizes = np.array([len(sets[i]) for i in part])
        values = np.concatenate([sets[i] for i in part])
        same = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        common = np.add.reduceat(same, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
        out.append(part[100 * common >= percent * (len(own) + sizes - common)])
        at = end
    return np.concatenate(out)


def _links_of(rows: list, percent: int):
    """A spanning forest of the links between (id, central, set); repeated ids stand together."""
    rows = [r for k, r in enumerate(rows) if not k or r[0] != rows[k - 1][0]]
    sets = [r[2] for r in rows]
    index = Index([counts_of(count_vector(s).tobytes()) for s in sets], np.array([len(s) for s in sets], np.int64), percent)
    seeds = sorted(range(len(rows)), key=lambda i: (-rows[i][1], rows[i][0]))
    for q, j in _forest(index, seeds, lambda q: _linked_with(sets, q, index.near(q), percent)):
        yield min(rows[q][0], rows[j][0]), max(rows[q][0], rows[j][0])


def _links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, central: DataFrame, percent: int, slice_rows: int) -> DataFrame:
    """Links (a, b) that connect what links inside each cluster; ``clusters`` has id and comp."""
    placed = shared(clusters.join(central.select("id", "n", (F.col("shares") / F.col("n")).alias("central")), "id"), "clusters")
    slices = F.greatest(F.ceil(F.count("*") / slice_rows), F.ceil(F.sum("n") / SLICE_SHINGLES)).cast("int")
    dealt = placed.join(placed.groupBy("comp").agg(slices.alias("slices")), "comp")
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    dealt = dealt.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).where("slices = 1 OR t <> slice")
    owners = dealt.join(classes.select("id", "owner"), "id").select(
        "comp", F.least("slice", "t").alias("i"), F.greatest("slice", "t").alias("j"), "id", "central", "owner.*")
    held = _texts(docs, shared(owners, "owners")).select("comp", "i", "j", "id", "central", "_text")

    def found_in(batches):
        for rows in _groups(batches, 3, lambda r: (r[3], r[4], shingle_set(r[5]))):
            yield from _links_of(rows, percent)

    held = held.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "id")
    return held.mapInArrow(lambda batches: _sent(found_in(batches)), "a long, b long")


def _texts(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """``owners`` (doc_id and text_hash of a document) with its ``_text``, once for each equal row of ``docs``."""
    own = lambda: {"_h1": F.xxhash64(F.lit(5), F.col("doc_id"), F.col("text_hash")), "_h2": F.xxhash64(F.lit(6), F.col("doc_id"), F.col("text_hash"))}
    bits = min(FILTER_BITS, max(64, -(-owners.count() * 10 // 64) * 64))
    bloom = shared(_level(owners.withColumns(own()), 1, bits, 4), "owners-filter")
    texts = docs.withColumn("text_hash", F.xxhash64("_text")).withColumns(own()).where(_hits(bloom.select("words").scalar(), bits, 4))
    texts = texts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_text")
    return owners.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))


def _sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id`` and the whole ``shingles`` of the classes in ``pairs``, from their owners' texts."""
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    owners = shared(classes.join(needed, "id", "left_semi").select("id", "owner.*"), "owners")
    held = _texts(docs, owners).select("id", "_text").dropDuplicates(["id"])
    arrow = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    return _python(held, "id long, shingles array<long>", arrow, lambda key, text: [(key, shingle_set(text).view(np.int64))])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    whole = F.size("x") + F.size("y") - common
    return pairs.join(left, "a").join(right, "b").where(100 * common >= percent * whole).select("a", "b")


def _prepared(docs: DataFrame, percent: int, sample_docs: int):
    """Points of all rows, classes, classes in blocks with their sizes, and the blocks' rows."""
    points = shared(_points(docs, percent, sample_docs), "points")
    classes = (points.where("n > 0").groupBy("digest")
               .agg(F.min("doc_id").alias("first"), F.min(F.struct("text_hash", "doc_id")).alias("owner"), F.any_value("n").alias("n"),
                    F.any_value("vector").alias("vector"), F.any_value("prefix").alias("prefix")))
    classes = shared(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    blocks = _blocks(classes, percent)
    central = blocks.groupBy("id").agg(F.count("*").alias("shares")).join(classes.select("id", "n"), "id")
    rows = blocks.join(central.select("id", "n", (F.col("shares") / F.col("n")).alias("central")), "id")
    # the count is known to suffice, so the search needs the prefix for one shared shingle only
    plain = F.col("pos") < F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rows = shared(rows.where(plain).drop("pos"), "block-rows")
    return points, classes, central, rows


def pairs(docs: DataFrame, percent: int = 80, sample_docs: int = SAMPLE_DOCS, slice_rows: int = SLICE) -> DataFrame:
    """Every pair of classes that link, also inside a component.

    Columns: class_a, class_b, doc_a, doc_b (their least ids) and n_links, the
    number of pairs of rows of ``docs`` that the pair of classes stands for. A
    class of several rows is a pair with itself.
    """
    docs = docs.select("doc_id", text_of("text").alias("_text"))
    points, classes, _, rows = _prepared(docs, percent, sample_docs)
    found = shared(_candidates(rows.withColumn("comp", F.col("id")), classes.select("id", "vector"), "all", percent, slice_rows), "all-pairs")
    linked = _verified(found, _sets(docs, classes, found), percent)
    copies = points.where("n > 0").groupBy("digest").agg(F.count("*").alias("copies"))
    sized = shared(classes.join(copies, "digest").select("id", "first", "copies"), "class-sizes")
    left, right = (sized.select(*[F.col(c).alias(f"{c}_{side}") for c in sized.columns]) for side in "ab")
    across = linked.join(left, F.col("a") == F.col("id_a")).join(right, F.col("b") == F.col("id_b")).select(
        "id_a", "id_b", "first_a", "first_b", (F.col("copies_a") * F.col("copies_b")).alias("n_links"))
    within = sized.where("copies > 1").select("id", F.col("id").alias("_id"), "first", F.col("first").alias("_first"), F.expr("copies * (copies - 1) div 2"))
    return across.union(within).toDF("class_a", "class_b", "doc_a", "doc_b", "n_links")


def link(docs: DataFrame, percent: int = 80, sample_docs: int = SAMPLE_DOCS, slice_rows: int = SLICE) -> DataFrame:
    """A row for every row of ``docs`` (doc_id, text).

    Columns: doc_id, text_hash, n_shingles, class_id
    (equal sets), comp (linked classes) and component_id.
    """
    docs = docs.select("doc_id", text_of("text").alias("_text"))
    points, classes, central, rows = _prepared(docs, percent, sample_docs)
    near = _candidates(rows.withColumn("comp", F.col("id")), classes.select("id", "vector"), "forest", percent, slice_rows)
    comps = components(_links(docs, classes, components(near), central, percent, slice_rows))
    least = classes.join(comps, "id", "left").select("id", "digest", "first", F.coalesce("comp", "id").alias("comp"))
    first = least.groupBy("comp").agg(F.min("first").alias("component_id"), F.min("id").alias("_"))
    named = least.join(first, "comp").select(F.col("digest").alias("_digest"), F.col("id").alias("class_id"), "comp", "component_id")
    out = points.select("doc_id", "text_hash", "n", "digest").join(named, F.col("digest") == F.col("_digest"), "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "class_id", "comp",
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id, then of the least text hash.

    Documents without words are in no group and are all kept.
    """
    hashed = F.xxhash64(text_of("text"))
    found = shared(link(docs, **options).where("n_shingles > 0").groupBy("doc_id", "text_hash", "comp").agg(F.count("*").alias("n")), "linked-docs")
    best = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("m"))
    first = F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("text_hash") == F.col("m.text_hash"))
    own, other, text = (free(docs, c) for c in ("_id", "_other", "_hash"))
    ranked = found.join(best, "comp").select(F.col("doc_id").alias(own), F.col("text_hash").alias(other), "n", first.alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(text) == F.col(other))
    left = docs.withColumn(text, hashed).join(ranked.where("NOT first"), same, "left_anti")
    repeated = ranked.where("first AND n > 1").select(own, other)
    if not repeated.isEmpty():
        once = left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", text])
        left = left.join(repeated, same, "left_anti").unionByName(once)
    return left.drop(text)


def query(spark, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")

"""Random forest with several targets in one tree (K4, K5, K8).

A split's gain is the fall of the weighted squared error summed over all
targets, so one forest replaces one for each target. Features are cut into at
most ``BINS`` bins at quantiles of the training rows; the binned rows are
written once and every later pass reads them.

Nodes with more than ``local_rows`` rows are split level by level: each
partition adds its rows up by (tree, node, feature, bin), the sums are added
over the partitions, and the best split of each node comes back to the driver.
Smaller nodes are sent whole to one task each, which grows the rest of the tree
there. Both ways choose the same split from the same sums.

Rows that are few from the start are held by all tasks instead (``Held``), and
a task grows many trees side by side. Such a forest scores few rows in the
tasks that grow it, and its trees are written only when they are asked for.

Row weights (Poisson bootstrap) and feature subsets come from hashes of the
row's values, the tree and the node, so they do not depend on how the data are
dealt. Equal rows share a weight.

``importance_by_target`` grows single-target trees instead, all targets' in the
same jobs: targets share the samples, so a sample's rows are sent once.

The model is a table with a row for each subtree. Scoring reads it in groups of
trees of at most ``MODEL_BYTES`` and adds the groups up.
"""

from __future__ import annotations

import io
import json
import math
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.session import table

BINS = 32
LOCAL_ROWS = 20_000
MODEL_BYTES = 64 << 20
#: Sums of (row, feature) pairs that are held at once, rows of nodes that are split at once, rows of a block of running sums.
ROOM, SIDE_ROWS, BLOCK = 400_000, 2048, 32
#: Rows of trees that grow side by side; bytes of rows that every task may hold.
GROUP_ROWS, HELD_BYTES = 65_536, 64 << 20
#: Bytes of sums that a partition holds for one group of nodes.
SUM_BYTES = 256 << 20
DEFAULTS = {"numTrees": 100, "maxDepth": 10, "featureSubsetStrategy": "sqrt",
            "minInstancesPerNode": 1, "minInstancesToSplit": 2, "bootstrap": True, "subsamplingRate": 1.0}
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _uniform(*parts) -> np.ndarray:
    """Numbers in [0, 1) from integers, by broadcasting."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * _M1
            h = (h ^ (h >> np.uint64(29))) * _M2
            h = h ^ (h >> np.uint64(32))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def subset_size(strategy: str, n: int) -> int:
    sizes = {"all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3)}
    return min(n, sizes[strategy] if strategy in sizes else max(1, math.ceil(float(strategy) * n)))


@dataclass(frozen=True)
class Rules:
    """How trees are grown."""

    max_depth: int
    subset: int
    least: int
    to_split: int
    bootstrap: bool
    rate: float
    seed: int

    def weights(self, rows: np.ndarray, tree: int) -> np.ndarray:
        """Times that each row is in the tree's sample."""
        u = _uniform(self.seed, tree, rows.view(np.uint64))
        if not self.bootstrap:
            return (u < self.rate).astype(np.float64)
        term, total, out = math.exp(-self.rate), 0.0, np.zeros(len(u))
        for k in range(1, 40):
            total += term
            out += u >= total
            term *= self.rate / k
        return out

    def features(self, tree: int, nodes: np.ndarray, n: int) -> np.ndarray:
        """The features that each node may split on, ascending; one row a node."""
        if self.subset == n:
            return np.broadcast_to(np.arange(n), (len(nodes), n))
        u = _uniform(self.seed + 1, tree, nodes[:, None], np.arange(n)[None, :])
        return np.sort(np.argpartition(u, self.subset - 1, axis=1)[:, :self.subset], axis=1)


def split_gains(left: np.ndarray, total: np.ndarray, least: int) -> np.ndarray:
    """Fall of the squared error for sums (weight, weighted targets) of the left side and of the node."""
    right = total - left
    ok = (left[..., 0] >= least) & (right[..., 0] >= least)
    part = lambda s: (s[..., 1:] ** 2).sum(-1) / np.maximum(s[..., 0], 1e-300)
    return np.where(ok, part(left) + part(right) - part(total), -np.inf)


def _rounded(gain, squares):
    """Gains to a billionth of the node's squares: cuts that part the rows alike tie, and the first feature and bin win."""
    unit = 1e-9 * squares + 1e-300
    return np.rint(gain / unit) * unit


def _worth(gain, squares):
    """A gain above rounding, for nodes whose targets have this sum of squares."""
    return gain > 1e-10 * squares + 1e-300


class Subtree:
    """Nodes as arrays: feature (-1 for a leaf), bin, left child, mean targets, gain."""

    FIELDS = ("feature", "bin", "left", "value", "gain")

    def __init__(self, feature, bin, left, value, gain):
        self.feature, self.bin, self.left, self.value, self.gain = feature, bin, left, value, gain

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        live = np.arange(len(bins))
        while len(live):
            live = live[self.feature[at[live]] >= 0]
            node = at[live]
            at[live] = self.left[node] + (bins[live, self.feature[node]] > self.bin[node])
        return at

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Subtree":
        with np.load(io.BytesIO(data)) as z:
            return cls(*(z[f] for f in cls.FIELDS))


def _sorted_rows(flat, src, feature, node, m):
    """Rows by node and value for each feature: their places and codes, node x BINS + bin."""
    n = len(node)
    low = (n - 1).bit_length()
    kind = np.uint32 if m * BINS << low <= 1 << 32 else np.uint64
    key = flat.take(feature[:, node] + src).astype(kind)
    key <<= kind(low)
    key += node.astype(kind) * kind(BINS << low) + np.arange(n, dtype=kind)
    key.sort(axis=1)
    return (key & kind((1 << low) - 1)).astype(np.int64), key >> kind(low)


def _running(columns, order, room):
    """Running sums of the rows' columns in the order of each feature.

    The order is dealt into blocks; equal places of all blocks are added at
    once. Gives the sums inside the blocks, as rows (place in block, feature,
    block), and those before each block, as rows (feature, block).
    """
    c, n = order.shape
    blocks = -(-n // BLOCK)
    padded = np.full((c, blocks * BLOCK), len(columns) - 1)
    padded[:, :n] = order
    x = columns.take(padded.reshape(c, blocks, BLOCK).transpose(2, 0, 1).ravel(), axis=0, out=room[:padded.size], mode="clip").reshape(BLOCK, c, blocks, -1)
    for k in range(1, BLOCK):
        x[k] += x[k - 1]
    before = np.zeros(x.shape[1:])
    np.cumsum(x[-1, :, :-1], axis=1, out=before[:, 1:])
    return x.reshape(-1, x.shape[-1]), before.reshape(-1, x.shape[-1])


def _best_cuts(flat, src, sums, squares, node, m, subsets, widths, least):
    """Best cut of each node in each of its features, as the gain in billionths of the node's squares x BINS + BINS - 1 - bin.

    The largest of these numbers has the first bin of those whose rounded gains
    are equal. Node k has the first ``widths[k]`` features of its row, no more
    than the node before it has; the rows come in the order of their nodes.

    With targets taken from the node's mean, the right side's sums are the left
    side's with the other sign, so a cut's gain needs the left side alone.
    """
    n = len(node)
    sizes = np.bincount(node, minlength=m)
    ends = np.cumsum(sizes)
    total = np.add.reduceat(sums, ends - sizes, axis=0)
    columns = np.zeros((n + 1, sums.shape[1]))
    columns[:n, 0] = sums[:, 0]
    columns[:n, 1:] = sums[:, 1:] - sums[:, :1] * (total[:, 1:] / np.maximum(total[:, :1], 1e-300))[node]
    squared = np.ones(sums.shape[1])
    squared[0] = 0.0
    whole = total[node, 0]
    earlier = (np.cumsum(total[:, 0]) - total[:, 0])[node]
    scale = whole / (1e-9 * squares + 1e-300)[node]
    inside = np.zeros(n, bool)
    inside[:-1] = node[1:] == node[:-1]
    step = max(1, ROOM // (n * sums.shape[1]))
    room = np.empty((step * (n + BLOCK), sums.shape[1]))
    out = np.full((m, subsets.shape[1]), -np.inf)
    for at in range(0, int(widths[0]), step):
        k = int(np.searchsorted(-widths, -at))
        r = int(ends[k - 1])
        feature = np.ascontiguousarray(subsets[:k, at:at + step].T)
        order, code = _sorted_rows(flat, src[:r], feature, node[:r], k)
        x, before = _running(columns if r == n else np.vstack([columns[:r], columns[n:]]), order, room)
        differs = np.zeros((len(feature), r), bool)
        np.logical_and(code[:, 1:] != code[:, :-1], inside[:r - 1], out=differs[:, :-1])
        places = np.flatnonzero(differs)
        if not len(places):
            continue
        j = np.repeat(np.arange(len(feature)), np.count_nonzero(differs, axis=1))
        i = places - j * r
        block = j * (len(before) // len(feature)) + i // BLOCK
        left = x.take(i % BLOCK * len(before) + block, axis=0, mode="clip")
        left += before.take(block, axis=0, mode="clip")
        weight = left[:, 0] - earlier.take(i)
        right = whole.take(i) - weight
        left *= left
        cut = left @ squared
        cut *= scale.take(i)
        weak = (weight < least) | (right < least)
        weight *= right
        np.copyto(weight, 1.0, where=weak)
        cut /= weight
        np.rint(cut, out=cut)
        cut *= BINS
        cut += BINS - 1 - code.ravel().take(places) % BINS
        np.copyto(cut, -np.inf, where=weak)
        # cuts are in order of feature, node and bin, so each (feature, node) is one stretch
        owner = node.take(i)
        first = np.flatnonzero(np.concatenate([np.ones(1, bool), (owner[1:] != owner[:-1]) | (j[1:] != j[:-1])]))
        out[owner[first], at + j[first]] = np.maximum.reduceat(cut, first)
    return out


def _best_splits(bins, sums, squares, node, m, subsets, least, src=None, same=None):
    """Best (gain, feature, bin) of each of m nodes whose rows are all here, in the order of their nodes.

    ``node`` numbers the rows' nodes, ``squares`` and ``subsets`` have the sum
    of squares and the features of each node; row i has the bins ``bins[src[i]]``.
    Nodes of equal rows and weights have equal numbers in ``same``; what several
    of them ask for is computed once.
    """
    sizes = np.bincount(node, minlength=m)
    starts = np.cumsum(sizes) - sizes
    total = np.add.reduceat(sums, starts, axis=0)
    flat, src = np.ascontiguousarray(bins).ravel(), (np.arange(len(node)) if src is None else src) * bins.shape[1]
    heads, group, asked, widths, slots = np.arange(m), np.arange(m), subsets, np.full(m, subsets.shape[1]), np.arange(subsets.shape[1])[None, :]
    if same is not None:
        first, of = np.unique(same, return_index=True, return_inverse=True)[1:]
        twin = first[of]
        if len(first) < m and (sizes == sizes[twin]).all():
            place = np.arange(len(node)) + (starts[twin] - starts)[node]
            if (src == src[place]).all() and (sums[:, 0] == sums[place, 0]).all():
                wanted = np.zeros((len(first), bins.shape[1]), bool)
                wanted[of[:, None], subsets] = True
                wide = np.argsort(-wanted.sum(1), kind="stable")
                heads, wanted, group = first[wide], wanted[wide], np.argsort(wide)[of]
                widths = wanted.sum(1)
                asked = np.argsort(~wanted, axis=1, kind="stable")[:, :widths[0]]
                slots = (np.cumsum(wanted, axis=1) - 1)[group[:, None], subsets]
    cuts = np.empty((len(heads), asked.shape[1]))
    many = sizes[heads]
    part = (np.cumsum(many) - many) // SIDE_ROWS
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
    for a, b in zip(edges, edges[1:]):
        own = np.repeat(np.arange(b - a), many[a:b])
        rows = np.arange(len(own)) + (starts[heads[a:b]] - np.cumsum(many[a:b]) + many[a:b])[own]
        cuts[a:b] = _best_cuts(flat, src[rows], sums[rows], squares[heads[a:b]], own, b - a, asked[a:b], widths[a:b], least)
    each = cuts[group[:, None], slots]
    pick = np.floor(each / BINS).argmax(1)
    best = each[np.arange(m), pick]
    found = np.isfinite(best)
    best = np.where(found, best, 0.0)
    gain = np.where(found, np.floor(best / BINS) * (1e-9 * squares + 1e-300), -np.inf)
    return (gain, np.where(found, subsets[np.arange(m), pick], -1), np.where(found, BINS - 1 - best % BINS, 0).astype(np.int64)), total


def grow_all(bins: np.ndarray, targets: np.ndarray, items: list, rules: Rules) -> list:
    """The subtrees of several (tree, root, depth, rows, weights of the rows), level by level side by side.

    ``root`` is numbered as in a heap; its rows are places in ``bins`` and ``targets``.
    """
    count = len(items)
    trees = np.array([i[0] for i in items], np.int64)
    deep = np.array([i[2] for i in items], np.int64)
    src, weight = np.concatenate([i[3] for i in items]), np.concatenate([i[4] for i in items])
    node = np.repeat(np.arange(count), [len(i[3]) for i in items])
    sums = np.column_stack([weight, targets[src] * weight[:, None]])
    squares = (targets[src] ** 2).sum(1) * weight
    # trees of the same rows share many nodes if they choose among many features; equal rows have equal sums of these
    marks = None if rules.bootstrap or 4 * rules.subset < bins.shape[1] else np.random.default_rng(0).integers(0, 1 << 64, len(bins), np.uint64)
    names, own, first = np.array([i[1] for i in items], np.int64), np.arange(count), np.zeros(count, np.int64)
    levels = []
    while len(names):
        m = len(names)
        sizes = np.bincount(node, minlength=m)
        total = np.add.reduceat(sums, np.cumsum(sizes) - sizes, axis=0)
        here = np.bincount(node, squares, m)
        feature, cut, gains, left = np.full(m, -1), np.zeros(m, np.int64), np.zeros(m), np.full(m, -1)
        able = (total[:, 0] >= max(rules.to_split, 2 * rules.least)) & (sizes > 1) & (deep[own] < rules.max_depth) & (here > 0) & np.isfinite(total).all(1)
        keep = able[node]
        src, sums, squares, node = src[keep], sums[keep], squares[keep], node[keep]
        if len(src):
            open_ = np.flatnonzero(able)
            subsets = rules.features(trees[own[open_], None], names[open_], bins.shape[1])
            small = (np.cumsum(able) - 1)[node]
            same = None if marks is None else np.add.reduceat(marks[src], np.flatnonzero(np.diff(small, prepend=-1)))
            (gain, chosen, at), _ = _best_splits(bins, sums, here[open_], small, len(open_), subsets, rules.least, src, same)
            good = _worth(gain, here[open_])
            feature[open_], cut[open_], gains[open_] = np.where(good, chosen, -1), at, np.where(good, gain, 0.0)
        split = feature >= 0
        rank = np.cumsum(split) - 1
        nodes_of, splits_of = np.bincount(own, minlength=count), np.bincount(own[split], minlength=count)
        left[split] = ((first + nodes_of - 2 * (np.cumsum(splits_of) - splits_of))[own] + 2 * rank)[split]
        levels.append((own, feature, cut, left, total[:, 1:] / np.maximum(total[:, :1], 1e-300), gains))
        keep = split[node]
        src, sums, squares, node = src[keep], sums[keep], squares[keep], node[keep]
        node = 2 * rank[node] + (bins[src, feature[node]] > cut[node])
        order = np.argsort(node, kind="stable")
        src, sums, squares, node = src[order], sums[order], squares[order], node[order]
        names = np.column_stack([2 * names[split], 2 * names[split] + 1]).ravel()
        own, first, deep = np.repeat(own[split], 2), first + nodes_of, deep + 1
    owner, *fields = (np.concatenate(v) for v in zip(*levels))
    order = np.argsort(owner, kind="stable")
    feature, cut, left, value, gains = (v[order] for v in fields)
    ends = np.cumsum(np.bincount(owner, minlength=count))[:-1]
    return [Subtree(*v) for v in zip(*(np.split(v, ends) for v in (
        feature.astype(np.int32), cut.astype(np.uint8), left.astype(np.int32), value, gains)))]


def grow(bins: np.ndarray, targets: np.ndarray, weight: np.ndarray, tree: int, root: int, depth: int, rules: Rules) -> Subtree:
    """The subtree below node ``root`` (numbered as in a heap) at ``depth``, from all of its rows."""
    return grow_all(bins, targets, [(tree, root, depth, np.arange(len(bins)), weight)], rules)[0]


class Top:
    """Splits found level by level: (tree, node) to (feature, bin, gain); nodes are numbered as in a heap."""

    def __init__(self, splits: dict):
        self.splits = splits
        self.by_tree: dict = {}
        for (t, n), s in splits.items():
            self.by_tree.setdefault(t, {})[n] = s

    def route(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """The node of each row, below all splits known."""
        at = np.ones(len(bins), np.int64)
        own = self.by_tree.get(tree)
        if not own:
            return at
        names = np.array(sorted(own))
        feature, cut = (np.array([own[n][k] for n in names.tolist()]) for k in (0, 1))
        live = np.arange(len(bins))
        while len(live):
            k = np.minimum(np.searchsorted(names, at[live]), len(names) - 1)
            live, k = live[names[k] == at[live]], k[names[k] == at[live]]
            at[live] = 2 * at[live] + (bins[live, feature[k]] > cut[k])
        return at


def _cuts(df: DataFrame, features) -> list[np.ndarray]:
    """Bin edges of each feature: a value is in the first bin whose edge is not below it."""
    probs = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    pairs = ", ".join(f"{k}, CAST(`{c}` AS DOUBLE)" for k, c in enumerate(features))
    long = df.selectExpr(f"stack({len(features)}, {pairs}) AS (k, v)")
    found = {r.k: r.e for r in long.groupBy("k").agg(F.percentile_approx("v", probs, 2000).alias("e")).collect()}
    return [np.unique(np.array(found.get(k) or [], np.float64)) for k in range(len(features))]


def binned(batch_columns, cuts) -> np.ndarray:
    out = np.empty((len(batch_columns[0]), len(cuts)), np.uint8)
    for k, (c, edges) in enumerate(zip(batch_columns, cuts)):
        out[:, k] = np.searchsorted(edges, c.cast(pa.float64()).to_numpy(zero_copy_only=False), side="left")
    return out


def _bin_table(df: DataFrame, features, targets, cuts) -> DataFrame:
    """Rows as (row, bins, y): a hash of the values, a byte for each feature, the targets."""
    names = [f"`{c}`" for c in [*features, *targets]]
    wide = df.select(F.xxhash64(*names).alias("_row"), *names)

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                b = binned(batch.columns[1:1 + len(features)], cuts)
                y = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[1 + len(features):]])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in b], pa.binary()), pa.array(list(y), pa.list_(pa.float64()))], names=["row", "bins", "y"])

    return table(wide.mapInArrow(work, "row long, bins binary, y array<double>"), "forest-rows")


def _arrays(batch, n_features):
    rows = batch.column(0).to_numpy()
    bins = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, n_features)
    return rows, bins, batch.column(2).flatten().to_numpy().reshape(len(rows), -1)


@dataclass
class Forest:
    """Subtrees (tree, root, data), the splits above them, bin edges and names."""

    parts: DataFrame
    splits: dict
    cuts: list
    features: list
    targets: list
    params: dict

    def importance(self) -> np.ndarray:
        """Share of each feature in a tree's gains, averaged over the trees (and over targets, if each has its own)."""
        n = len(self.features)
        first = [(t, s[0], s[2]) for (t, _), s in self.splits.items()]

        def work(batches):
            for batch in batches:
                for tree, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    s = Subtree.load(data)
                    inner = s.feature >= 0
                    by = np.bincount(s.feature[inner], s.gain[inner], n)
                    used = np.flatnonzero(by)
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([tree] * len(used), pa.int32()), "feature": pa.array(used, pa.int32()), "gain": pa.array(by[used], pa.float64())})

        got = self.parts.select("tree", "data").mapInArrow(work, "tree int, feature int, gain double")
        if first:
            got = got.union(got.sparkSession.createDataFrame(first, "tree int, feature int, gain double"))
        share = got.groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
        whole = share.groupBy("tree").agg(F.sum("g").alias("all"))
        out = np.zeros(n)
        for r in share.join(whole, "tree").where("all > 0").groupBy("feature").agg(F.sum(F.col("g") / F.col("all")).alias("s")).collect():
            out[r.feature] = r.s
        return out / out.sum() if out.sum() > 0 else out

    def groups(self):
        """Trees in groups of at most ``MODEL_BYTES``, as lists of (tree, root, subtree bytes)."""
        sizes = self.parts.groupBy("tree").agg(F.sum(F.length("data")).alias("n")).orderBy("tree").collect()
        group, held = [], 0
        for r in sizes:
            if group and held + r.n > MODEL_BYTES:
                yield self.parts.where(F.col("tree").isin(group)).collect()
                group, held = [], 0
            group.append(r.tree)
            held += r.n
        if group:
            yield self.parts.where(F.col("tree").isin(group)).collect()

    def transform(self, df: DataFrame, fmt: str = "{}_pred") -> DataFrame:
        """Add the mean prediction of all trees for each target."""
        features, cuts, top, trees = self.features, self.cuts, Top(self.splits), self.params["numTrees"]
        out = df.withColumn("_sum", F.array(*[F.lit(0.0)] * len(self.targets)))
        for group in self.groups():
            held = df.sparkSession.sparkContext.broadcast([(r.tree, r.root, bytes(r.data)) for r in group])

            def work(batches, held=held):
                by_tree = {t: [(root, Subtree.load(d)) for _, root, d in g] for t, g in groupby(sorted(held.value, key=lambda r: r[:2]), key=lambda r: r[0])}
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    b = binned([batch.column(c) for c in features], cuts)
                    total = batch.column("_sum").flatten().to_numpy().reshape(batch.num_rows, -1).copy()
                    for t, parts in by_tree.items():
                        node = top.route(t, b)
                        for root, s in parts:
                            own = np.flatnonzero(node == root)
                            total[own] += s.value[s.leaf_of(b[own])]
                    at = batch.schema.get_field_index("_sum")
                    yield batch.set_column(at, "_sum", pa.array(list(total), pa.list_(pa.float64())))

            out = out.mapInArrow(work, out.schema)
        return out.withColumns({fmt.format(t): F.col("_sum")[k] / trees for k, t in enumerate(self.targets)}).drop("_sum")

    def save(self, path: str):
        """The subtrees as Parquet, all else as one JSON row."""
        spark = self.parts.sparkSession
        self.parts.write.mode("overwrite").parquet(f"{path}/trees")
        rest = {"splits": [[*k, *v] for k, v in self.splits.items()], "cuts": [c.tolist() for c in self.cuts],
                "features": self.features, "targets": self.targets, "params": self.params}
        spark.createDataFrame([(json.dumps(rest),)], "model string").coalesce(1).write.mode("overwrite").json(f"{path}/rest")

    @classmethod
    def load(cls, path: str, spark) -> "Forest":
        rest = json.loads(spark.read.json(f"{path}/rest").first()["model"])
        splits = {(t, n): (f, b, g) for t, n, f, b, g in rest["splits"]}
        return cls(spark.read.parquet(f"{path}/trees"), splits, [np.array(c) for c in rest["cuts"]], rest["features"], rest["targets"], rest["params"])


class Held:
    """Binned rows that every task holds, ordered by their hash."""

    def __init__(self, rows: DataFrame, n_features: int, n_targets: int):
        got = [_arrays(b, n_features) for b in rows.toArrow().to_batches() if b.num_rows]
        got = [np.concatenate(c) for c in zip(*got)] or [np.empty(0, np.int64), np.empty((0, n_features), np.uint8), np.empty((0, n_targets))]
        order = np.argsort(got[0], kind="stable")
        self.spark, self.n = rows.sparkSession, len(order)
        self.data = self.spark.sparkContext.broadcast(tuple(c[order] for c in got))


def held(rows: DataFrame, n_rows: int, n_features: int, n_targets: int, local_rows: int = LOCAL_ROWS):
    """The rows as ``Held``, if they are few enough to be split in one task and small enough to be sent to all."""
    few = n_rows <= local_rows and n_rows * (n_features + 8 * n_targets + 8) <= HELD_BYTES
    return Held(rows, n_features, n_targets) if few else rows


class HeldForest(Forest):
    """A forest of held rows. A table of its trees is written when it is first asked for; till then
    tasks grow the trees and score few rows at once, and no tree leaves its task."""

    def __init__(self, rows: Held, rules: Rules, single: bool, cuts, features, targets, params):
        self.rows, self.rules, self.single, self.splits = rows, rules, single, {}
        self.cuts, self.features, self.targets, self.params = list(cuts), list(features), list(targets), dict(params)

    def _grown(self, use, schema: str) -> DataFrame:
        """``use`` of (task, (tree, subtree) pairs) in every task."""
        data, rules, count, single, least = self.rows.data, self.rules, int(self.params["numTrees"]), self.single, self.rows.n
        spark = self.rows.spark
        cores = spark.sparkContext.defaultParallelism
        # trees that share nodes gain by a task of many trees
        busy = max(2 * cores if rules.bootstrap else cores // 2, count * least * (len(self.targets) if single else 1) // GROUP_ROWS, 1)
        tasks = min(count, busy, 2000)

        def grown(task):
            ids, bins, y = data.value

            def side_by_side(items):
                if items:
                    for k in range(y.shape[1] if single else 1):
                        for item, s in zip(items, grow_all(bins, y[:, [k]] if single else y, items, rules)):
                            yield item[0] + k * count, s

            items, held_rows = [], 0
            for t in range(task, count, tasks):
                w = rules.weights(ids, t)
                own = np.flatnonzero(w > 0)
                if len(own):
                    items.append((t, 1, 0, own, w[own]))
                    held_rows += len(own)
                if held_rows >= (SIDE_ROWS * 4 if rules.bootstrap else GROUP_ROWS):
                    yield from side_by_side(items)
                    items, held_rows = [], 0
            yield from side_by_side(items)

        def work(batches):
            for batch in batches:
                for task in batch.column(0).to_pylist():
                    yield from use(task, grown(task))

        return spark.range(0, tasks, 1, tasks).mapInArrow(work, schema)

    @cached_property
    def parts(self) -> DataFrame:
        def use(task, trees):
            for t, s in trees:
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "root": pa.array([1], pa.int64()), "data": pa.array([s.dump()])})

        return table(self._grown(use, "tree int, root long, data binary"), "forest")

    def transform(self, df: DataFrame, fmt: str = "{}_pred") -> DataFrame:
        few = None if "parts" in self.__dict__ else df.limit(LOCAL_ROWS + 1).toArrow()
        if few is None or not 0 < few.num_rows <= LOCAL_ROWS or few.nbytes > HELD_BYTES:
            return super().transform(df, fmt)
        shape, n_trees = (few.num_rows, len(self.targets)), self.params["numTrees"]
        sent = self.rows.spark.sparkContext.broadcast(binned([few.column(c) for c in self.features], self.cuts))

        def use(task, trees):
            total = np.zeros(shape)
            for _, s in trees:
                total += s.value[s.leaf_of(sent.value)]
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

        got = sorted(self._grown(use, "task long, sums binary").collect())
        sent.destroy()
        total = sum(np.frombuffer(r.sums).reshape(shape) for r in got) / n_trees
        for k, t in enumerate(self.targets):
            few = few.append_column(fmt.format(t), pa.array(total[:, k]))
        # one partition: sums over so few rows need no shuffle
        return self.rows.spark.createDataFrame(few).coalesce(1)


def _level(rows: DataFrame, nodes: list, top: Top, rules: Rules, n_features: int, n_targets: int) -> dict:
    """Best split and the rows of both sides for nodes (tree, node), from sums over all partitions."""
    wanted: dict = {}
    for t, n in nodes:
        wanted.setdefault(t, []).append(n)
    width = n_targets + 3  # weight, targets, sum of squares, rows
    shape = (BINS, width)

    def add(batches):
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, bins, y = _arrays(batch, n_features)
            for t, own in wanted.items():
                w, node = rules.weights(ids, t), top.route(t, bins)
                for n, fs in zip(own, rules.features(t, np.array(own), n_features)):
                    r = np.flatnonzero((node == n) & (w > 0))
                    cols = np.column_stack([w[r], y[r] * w[r, None], (y[r] ** 2).sum(1) * w[r], np.ones(len(r))])
                    for f in fs.tolist():
                        h = sums.setdefault((t, n, f), np.zeros(shape))
                        for k in range(width):
                            h[:, k] += np.bincount(bins[r, f], cols[:, k], BINS)
        keys = sorted(sums)
        for at in range(0, len(keys), 256):
            part = keys[at:at + 256]
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([k[0] for k in part], pa.int32()), "node": pa.array([k[1] for k in part], pa.int64()),
                "feature": pa.array([k[2] for k in part], pa.int32()), "sums": pa.array([sums[k].tobytes() for k in part], pa.binary())})

    def choose(batches):
        def each():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for (t, n, f), group in groupby(each(), key=lambda r: r[:3]):
            h = sum(np.frombuffer(r[3]).reshape(shape) for r in group)
            left, total = np.cumsum(h, axis=0), h.sum(0)
            gain = _rounded(split_gains(left[:-1, :-2], total[None, :-2], rules.least), total[-2])
            b = int(gain.argmax())
            good = bool(_worth(gain[b], total[-2])) and total[0] >= rules.to_split
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([t], pa.int32()), "node": pa.array([n], pa.int64()), "feature": pa.array([f], pa.int32()), "bin": pa.array([b], pa.int32()),
                "gain": pa.array([float(gain[b]) if good else -1.0]), "left": pa.array([int(left[b, -1])], pa.int64()), "rows": pa.array([int(total[-1])], pa.int64())})

    summed = rows.mapInArrow(add, "tree int, node long, feature int, sums binary").repartition("tree", "node", "feature").sortWithinPartitions("tree", "node", "feature")
    each = summed.mapInArrow(choose, "tree int, node long, feature int, bin int, gain double, left long, rows long")
    best = each.groupBy("tree", "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("minus"), "bin", "left", "rows")).alias("m")).collect()
    return {(r.tree, r.node): (r.m.gain, -r.m.minus, r.m.bin, r.m.left, r.m.rows) for r in best}


def train(df: DataFrame, features, targets, params=None, seed: int = 42, local_rows: int = LOCAL_ROWS) -> Forest:
    """A forest of ``targets`` on ``features``; ``params`` as in ``DEFAULTS``."""
    p = {**DEFAULTS, **(params or {})}
    if int(p["maxDepth"]) > 30:
        raise ValueError("maxDepth: at most 30 is supported")
    features, targets = list(features), list(targets)
    df = table(df.select(*[f"`{c}`" for c in [*features, *targets]]), "forest-input")
    cuts = _cuts(df, features)
    rows = _bin_table(df, features, targets, cuts)
    return train_binned(rows, rows.count(), cuts, features, targets, p, seed, local_rows)


def importance_by_target(df: DataFrame, features, targets, params=None, seed: int = 42, local_rows: int = LOCAL_ROWS) -> np.ndarray:
    """Mean over the targets of the importances of a forest for each."""
    p = {**DEFAULTS, **(params or {})}
    features, targets = list(features), list(targets)
    df = table(df.select(*[f"`{c}`" for c in [*features, *targets]]), "forest-input")
    cuts = _cuts(df, features)
    rows = _bin_table(df, features, targets, cuts)
    n = rows.count()
    if n <= local_rows:
        return train_binned(rows, n, cuts, features, targets, p, seed, local_rows, single=True).importance()
    each = [train_binned(rows.select("row", "bins", F.slice("y", k + 1, 1).alias("y")), n, cuts, features, [t], p, seed, local_rows).importance()
            for k, t in enumerate(targets)]
    return np.mean(each, axis=0)


def train_binned(rows: DataFrame | Held, n_rows: int, cuts, features, targets, p: dict, seed: int = 42, local_rows: int = LOCAL_ROWS, single: bool = False) -> Forest:
    """As ``train``, from binned rows. ``single`` grows a tree for each target on each sample (rows within ``local_rows``).

    The forest of ``Held`` rows is grown when it is used.
    """
    n_features, n_targets = len(features), len(targets)
    rules = Rules(int(p["maxDepth"]), subset_size(str(p["featureSubsetStrategy"]), n_features), int(p["minInstancesPerNode"]), int(p["minInstancesToSplit"]), bool(p["bootstrap"]), float(p["subsamplingRate"]), seed)
    splits: dict = {}
    trees = range(int(p["numTrees"]))
    if isinstance(rows, Held):
        return HeldForest(rows, rules, single, cuts, features, targets, p)
    if isinstance(own := held(rows, n_rows, n_features, n_targets, local_rows), Held):
        return Forest(HeldForest(own, rules, single, cuts, features, targets, p).parts, splits, list(cuts), list(features), list(targets), dict(p))
    frontier = [(t, 1) for t in trees] if n_rows > local_rows else []
    depth = 0
    per_group = max(1, SUM_BYTES // (rules.subset * BINS * (n_targets + 3) * 8))
    while frontier and depth < rules.max_depth:
        found: dict = {}
        for at in range(0, len(frontier), per_group):
            found |= _level(rows, frontier[at:at + per_group], Top(splits), rules, n_features, n_targets)
        frontier = []
        for (t, n), (gain, f, b, left, here) in found.items():
            if gain > 0:
                splits[t, n] = (f, b, gain)
                frontier += [(t, c) for c, size in ((2 * n, left), (2 * n + 1, here - left)) if size > local_rows]
        depth += 1
    top = Top(splits)

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, bins, y = _arrays(batch, n_features)
            for t in trees:
                w, node = rules.weights(ids, t), top.route(t, bins)
                for n in np.unique(node[w > 0]).tolist():
                    r = np.flatnonzero((node == n) & (w > 0))
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([t], pa.int32()), "root": pa.array([n], pa.int64()), "ids": pa.array([ids[r].tobytes()]),
                        "bins": pa.array([bins[r].tobytes()]), "y": pa.array([y[r].tobytes()]), "w": pa.array([w[r].tobytes()])})

    def finish(batches):
        def each():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for (t, root), group in groupby(each(), key=lambda r: r[:2]):
            ids, bins, y, w = (np.concatenate([np.frombuffer(r[k], kind) for r in part]) for part in [list(group)]
                               for k, kind in ((2, np.int64), (3, np.uint8), (4, np.float64), (5, np.float64)))
            order = np.argsort(ids, kind="stable")
            bins, y = bins.reshape(-1, n_features)[order], y.reshape(-1, n_targets)[order]
            for k in range(n_targets if single else 1):
                s = grow(bins, y[:, [k]] if single else y, w[order], t, root, root.bit_length() - 1, rules)
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t + k * len(trees)], pa.int32()), "root": pa.array([root], pa.int64()), "data": pa.array([s.dump()])})

    dealt = rows.mapInArrow(deal, "tree int, root long, ids binary, bins binary, y binary, w binary")
    # trees of few rows share a task, as a task costs more than such a tree
    busy = max(4 * rows.sparkSession.sparkContext.defaultParallelism, len(trees) * n_rows * (n_targets if single else 1) // LOCAL_ROWS)
    n = min(len(trees) + 2 * len(splits), 2000, busy)
    parts = dealt.repartition(n, "tree", "root").sortWithinPartitions("tree", "root").mapInArrow(finish, "tree int, root long, data binary")
    return Forest(table(parts, "forest"), splits, list(cuts), list(features), list(targets), dict(p))

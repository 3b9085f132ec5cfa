"""Embedding whitening by shifted Cholesky QR.

The rows, less their mean, are orthogonalised by triangular factors of Gram
matrices: each pass sums the Gram matrix of the rows over all partitions,
factors it, and the next pass solves the rows against all factors found so
far. The first Gram matrix is shifted by a small multiple of its trace, so that
it can be factored whatever the rows' condition; ``PASSES`` passes give
orthogonal rows to working precision. The product of the factors is the R of
the centred rows, and its singular values and right vectors are the components.
The rows themselves are read again in each pass and never stored or collected;
a partition sends one Gram matrix, whose size is that of the dimension squared.

Entries become whole numbers, x = floor(1024 c) + 100000, held within 2^53 on
either side. The sums are exact, so a centred entry n x - S is exact too.

Defined results: rows whose vector is null, or holds null or non-finite
entries, have no result. The dimension is the commonest length of the others
(ties: the longest); vectors of other lengths have no result either. Repeated
and null ids are rows of their own. A component without variance (constant
columns, fewer rows than components) has a null ``whitened`` and is left out of
``identity_error``, which is null if no component has any variance, as is
``explained``. A ``deviation`` beyond 64 bits is null. Empty tables and vectors
give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.llm.common import read

PASSES = 3
COMPONENTS = 8
MAX_DIM = 4096
SCALE, SHIFT, WHOLE = 1024.0, 100_000, float(1 << 53)
#: Singular values below this share of the largest count as zero.
RANK = 1e-12


def usable(table: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has finite entries only and the commonest length."""
    good = F.col(vector).isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    rows = table.where(good)
    lengths = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0].d if lengths else 0
    if d > MAX_DIM:
        raise ValueError(f"vectors of {d} entries; at most {MAX_DIM} are supported")
    return rows.where((F.size(vector) == d) & (F.size(vector) > 0))


def whole(column: pa.Array) -> np.ndarray:
    """The x-vectors of a batch, one in each row."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.clip(np.floor(values * SCALE) + SHIFT, -WHOLE, WHOLE)
    return scaled.astype(np.int64).reshape(len(column), -1)


def _sums(rows: DataFrame, make, width: int) -> np.ndarray:
    """Sum over all rows of the matrix that ``make(x-vectors)`` gives for a batch; ``width`` is its number of columns."""

    def work(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + make(whole(batch.column(0)))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total)), pa.int32()), "v": pa.array(list(total), pa.list_(pa.float64()))})

    parts = rows.mapInArrow(work, "i int, v array<double>")
    added = parts.groupBy("i").agg(*[F.sum(F.get("v", F.lit(k))).alias(f"c{k}") for k in range(width)]) if width <= 64 else (
        parts.select("i", F.posexplode("v").alias("k", "v")).groupBy("i", "k").agg(F.sum("v").alias("v"))
        .groupBy("i").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("v")).select("i", F.transform("v", lambda e: e["v"]).alias("v")))
    got = sorted(added.collect(), key=lambda r: r.i)
    return np.array([list(r[1:]) if width <= 64 else r.v for r in got])


def _exact_sums(rows: DataFrame, vector: str):
    """Number of rows and the exact sum of each dimension, as integers of any size."""
    held = lambda c, top: F.greatest(F.least(c, F.lit(top)), F.lit(-top))
    x = held(F.floor(held(F.col("c").cast("double") * SCALE, WHOLE + 2 * SHIFT)) + SHIFT, int(WHOLE))
    got = (rows.select(F.posexplode(vector).alias("k", "c")).groupBy("k")
           .agg(F.count("*").alias("n"), F.sum(x.cast("decimal(19,0)")).alias("s")).collect())
    return (got[0].n if got else 0), [int(r.s) for r in sorted(got, key=lambda r: r.k)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, from the exact n x - S where it fits 64 bits."""
    big = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums)) if len(x) else 0
    if big < 1 << 62:
        return (x * n - np.array(sums, np.int64)) / n
    return np.array([[(int(c) * n - s) / n for c, s in zip(r, sums)] for r in x])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list:
    """Sum over the dimensions of (n x - S) squared for each row; None beyond 64 bits."""
    big = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums))
    if big < 1 << 62:
        away = x * n - np.array(sums, np.int64)
        top = int(np.abs(away).max())
        if top * top * len(sums) < 1 << 63:
            return (away * away).sum(1).tolist()
    out = [sum((int(c) * n - s) ** 2 for c, s in zip(r, sums)) for r in x]
    return [v if v < 1 << 63 else None for v in out]


def solve_rows(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverse of each upper triangular factor in turn, by forward substitution over the columns."""
    for r in factors:
        q = np.empty_like(y)
        for j in range(len(r)):
            q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        y = q
    return y


def triangular(rows: DataFrame, n: int, sums: list[int], passes: int = PASSES) -> np.ndarray:
    """The R factor of the centred rows, composed of one Cholesky factor a pass."""
    d = len(sums)
    factors: list[np.ndarray] = []
    for k in range(passes):
        done = list(factors)

        def gram(x, done=done):
            q = solve_rows(centred(x, n, sums), done)
            return q.T @ q

        g = _sums(rows, gram, d)
        unit = np.finfo(np.float64).eps * np.trace(g)
        if unit == 0.0:
            return np.zeros((d, d))
        # the shift that keeps the factorisation of an ill-conditioned first matrix from breaking down
        shift = 11 * (n * d + d * (d + 1.0)) ** 0.5 * unit if k == 0 else 0.0
        while True:
            try:
                factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
                break
            except np.linalg.LinAlgError:  # columns without variance: no row has a part in them
                shift = max(10 * shift, unit)
    out = np.eye(d)
    for r in factors:
        out = r @ out
    return out


@dataclass
class Whitening:
    """Sums, components (in rows, by falling eigenvalue), eigenvalues and the trace of the covariance."""

    n: int
    sums: list
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; columns without variance are NaN."""
        width = np.where(self.values > 0, self.values, np.nan) ** 0.5
        return centred(x, self.n, self.sums) @ self.vectors.T / width


def fit(rows: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of ``usable`` rows, or None without any."""
    n, sums = _exact_sums(rows, vector)
    if not n:
        return None
    r = triangular(rows.select(vector), n, sums)
    _, s, v = np.linalg.svd(r)
    values = np.where(s > RANK * max(s[0], 1e-300), s * s / n, 0.0)
    k = min(components, len(sums))
    return Whitening(n, sums, v[:k], values[:k], float((s * s).sum() / n))


def identity_error(rows: DataFrame, vector: str, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    live = np.flatnonzero(model.values > 0)
    if not len(live):
        return None

    def gram(x):
        z = model.project(x)[:, live]
        return np.vstack([z.T @ z, z.sum(0)])

    g = _sums(rows.select(vector), gram, len(live)) / model.n
    cov = g[:-1] - np.outer(g[-1], g[-1])
    return float(np.abs(cov - np.eye(len(live))).max())


def whiten(table: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row and component.

    Columns: the key, component, n, deviation, whitened, explained, identity_error.
    """
    rows = usable(table.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, "vector", components)
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, "vector", model)

    def work(batches):
        k = len(model.values)
        share = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = whole(part.column(1))
                z, m = model.project(x).ravel(), len(x)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n), pa.int64()), pa.array([v for v in deviations(x, model.n, model.sums) for _ in range(k)], pa.int64()),
                    pa.array(z, pa.float64(), mask=np.isnan(z)), pa.array(share * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("key", "vector").mapInArrow(work, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))

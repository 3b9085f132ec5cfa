import math

import numpy as np
import pytest

from seriesframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string"


def plain(rows, components=8):
    """Whitening by the singular values of all centred rows at once, the eigenvalues' roots to double precision."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in good], np.int64)
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    _, s1, vectors = np.linalg.svd(y / n ** 0.5, full_matrices=False)
    z = y @ vectors[:components].T / s1[:components]
    dev = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s)) for r in x]
    return [i for i, _ in good], n, dev, z, (s1 ** 2 / (s1 ** 2).sum())[:components]


def held(got, rows, components=8):
    ids, n, dev, z, share = plain(rows, components)
    assert len(got) == len(ids) * len(share)
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(len(share)):
        mine = np.array([by[i, k + 1].whitened for i in ids])
        sign = np.sign(mine @ z[:, k])
        assert np.abs(mine - sign * z[:, k]).max() < 1e-7
        for i, d in zip(ids, dev):
            r = by[i, k + 1]
            assert (r.n, r.deviation) == (n, d)
            assert r.explained == pytest.approx(share[k], rel=1e-9)
            assert r.identity_error < 1e-8


def test_like_a_decomposition_of_all_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) * np.linspace(2, 0.05, 12) @ rng.normal(size=(12, 12))
    rows = [(i, list(map(float, v))) for i, v in enumerate(base)]
    bad = [(900, None), (901, [None] + [0.0] * 11), (902, [math.nan] * 12), (903, [math.inf] + [0.0] * 11), (904, []), (905, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], SCHEMA).repartition(5)
    got = whitening.whiten(table).collect()
    assert {r.vec_id for r in got} == {i for i, _ in rows}
    held(got, rows)


def test_nearly_dependent_columns(spark):
    """Columns that differ by a rounding step: the first Gram matrix is as good as singular."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 1)) * 500
    rows = [(i, [float(np.float32(c)) for c in (*r, *(r + e), *(r * 2))]) for i, (r, e) in enumerate(zip(v, rng.integers(0, 2, (400, 1)) / 1024))]
    got = whitening.whiten(spark.createDataFrame([(i, r, "x") for i, r in rows], SCHEMA), components=2).collect()
    held(got, rows, 2)


def test_constant_columns_and_repeated_rows(spark):
    rows = [(None, [1.0, float(k % 5), 7.0]) for k in range(50)] + [(7, [1.0, 2.0, 7.0])] * 2
    got = whitening.whiten(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)).collect()
    assert len(got) == 52 * 3
    first = [r for r in got if r.component == 1]
    assert np.var([r.whitened for r in first]) == pytest.approx(1) and first[0].explained == pytest.approx(1)
    assert all(r.whitened is None and r.explained == 0 for r in got if r.component > 1)
    assert got[0].identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_without_usable_rows(spark, rows):
    assert whitening.whiten(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)).count() == 0


def test_a_single_row_and_huge_entries(spark):
    (a, b) = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "x")], SCHEMA)).collect()
    assert (a.deviation, a.whitened, a.explained, a.identity_error) == (0, None, None, None)
    got = whitening.whiten(spark.createDataFrame([(1, [1e30, 2.0], "x"), (2, [-1e30, 5.0], "x")], SCHEMA)).collect()
    assert {r.deviation for r in got} == {None} and len(got) == 4


def test_wide_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in r]) for i, r in enumerate(rng.normal(size=(200, 80)) * np.linspace(3, 1, 80))]
    held(whitening.whiten(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)).collect(), rows)


def test_the_whole_query(spark):
    got = whitening.query(spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    held(got, [(r.vec_id, r.embedding) for r in table])

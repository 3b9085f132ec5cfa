"""Range-dealt positions and quantiles, and two-level carries, against plain computations."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesframe.operators import frames as FR
from seriesframe.operators import ranks as RK
from seriesframe.operators import stats as ST
from seriesframe.operators import windows as WN

DAY = dt.datetime(2021, 5, 4)


@pytest.fixture(scope="module")
def hot_day(spark):
    """20,000 rows of three series, 90 % of them on one day of one series; some keys null."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(20_000):
        hot = rng.random() < 0.9
        ts = DAY + dt.timedelta(seconds=int(rng.integers(0, 86_400)) if hot else int(rng.integers(-10**7, 10**7)))
        rows.append((i, "a" if hot else [None, "a", "b"][i % 3], ts, float(rng.integers(0, 50)) if rng.random() < 0.3 else None))
    return spark.createDataFrame(rows, "id int, station string, ts timestamp, v double").repartition(6).cache()


@pytest.mark.parametrize("keys", [[], ["station"]])
def test_positions_like_a_plain_window(hot_day, keys):
    got = RK.positions(hot_day, keys, ["ts", "id"], "pos", "n", parts=16)
    w = Window.partitionBy(*keys)
    want = hot_day.withColumns({"pos": F.row_number().over(w.orderBy("ts", "id")) - 1, "n": F.count("*").over(w)})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_no_partition_holds_over_twice_its_share(hot_day):
    placed = RK.place(hot_day, ["station"], ["ts", "id"], parts=16)
    sizes = [r["count"] for r in placed.groupBy(RK.PART).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 2 * 20_000 / 16


@pytest.mark.parametrize("keys", [[], ["station"]])
@pytest.mark.parametrize("method", ["interpolate", "forward_fill", "backward_fill"])
def test_carries_over_many_runs_of_buckets(hot_day, monkeypatch, keys, method):
    options = dict(keys=keys, order=["ts", "id"], limit=3, block=None)
    want = WN.fill(hot_day, ["v"], method, bucket_rows=1 << 20, **options)
    monkeypatch.setattr(FR, "FAN", 4)
    got = WN.fill(hot_day, ["v"], method, bucket_rows=7, **options)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_no_single_task_window(hot_day):
    plan = WN.fill(hot_day, ["v"], "interpolate", order=["ts", "id"], block=None)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "percentile" not in plan


def test_quantiles_like_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": [5.0] * 900 + list(rng.normal(size=100)), "one": [2.5], "two": [1.0, 4.0], "none": [], "even": list(rng.random(500)), None: [1.0, 2.0]}
    rows = [(k, float(v), None) for k, vs in groups.items() for v in vs] + [(k, None, None) for k in groups]
    df = spark.createDataFrame(rows, "station string, x double, y double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.station: r for r in RK.exact_quantiles(df, ["x", "y"], probs, ["station"], parts=9).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert (got[k]._n_x, got[k]._n_y, got[k]._q_y) == (len(vs), 0, None)
        if vs:
            np.testing.assert_allclose(got[k]._q_x, np.quantile(vs, probs), rtol=1e-12)
    everything = [v for vs in groups.values() for v in vs]
    (row,) = ST.quantiles(df, ["x", "y"], (0.25, 0.75)).collect()
    np.testing.assert_allclose([row.x_q25, row.x_q75], np.quantile(everything, [0.25, 0.75]), rtol=1e-12)
    assert row.y_q25 is None
    assert ST.quantiles(df.limit(0), ["x"]).count() == 0


def test_quantiles_do_not_go_through_one_task(spark):
    df = spark.range(1000).select(F.rand(1).alias("x"))
    plan = ST.quantiles(df, ["x"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "percentile" not in plan

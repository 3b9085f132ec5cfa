"""Window operators against pandas on random gappy series, and the blocked
form against a plain window."""
import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seriesframe.operators import windows as WN


def _series(spark, n=300, seed=7, gaps=True):
    rng = np.random.default_rng(seed)
    dates = pd.date_range("2020-01-01", periods=n, freq="D")
    keep = rng.random(n) > 0.1  # uneven dates
    dates = dates[keep]
    v = rng.normal(50, 10, len(dates))
    if gaps:
        v[rng.random(len(dates)) < 0.25] = np.nan
        v[:3] = np.nan
        v[-4:] = np.nan
        v[100:115] = np.nan  # gap longer than 7
    pdf = pd.DataFrame({"Date": dates.date, "x": v})
    sdf = spark.createDataFrame([(d, None if np.isnan(x) else float(x)) for d, x in zip(pdf.Date, pdf.x)],
                                "Date date, x double")
    return pdf, sdf


def _got(sdf, col="x"):
    return np.array([np.nan if r[col] is None else r[col] for r in sdf.orderBy("Date").collect()])


def test_fills_match_pandas(spark):
    pdf, sdf = _series(spark)
    s = pdf.set_index(pd.to_datetime(pdf.Date))["x"]
    cases = {
        "forward_fill": s.ffill(limit=7),
        "backward_fill": s.bfill(limit=7),
        "interpolate": s.interpolate(method="time", limit_direction="both", limit_area="inside"),
        "linear": s.interpolate(method="linear", limit_direction="both", limit_area="inside"),
    }
    for method, exp in cases.items():
        got = _got(WN.fill(sdf, ["x"], method, bucket_rows=40))
        np.testing.assert_allclose(got, exp.values, rtol=1e-12, atol=1e-9, equal_nan=True,
                                   err_msg=method)
    # the final unlimited forward then backward fill (Q3)
    got = _got(WN.fill(sdf, ["x"], "backward_fill", final_fill=True, bucket_rows=40))
    exp = s.bfill(limit=7).ffill().bfill()
    np.testing.assert_allclose(got, exp.values, rtol=1e-12, equal_nan=True)


def test_rolling_and_lags_match_pandas(spark):
    pdf, sdf = _series(spark)
    out = WN.create_rolling_features(sdf, ["x"], windows=[3, 7], stats=["mean", "std", "min", "max",
                                                                       "median"], bucket_rows=16)
    out = WN.create_lag_features(out, ["x"], lag_steps=[1, 7], bucket_rows=16)
    rows = out.orderBy("Date").toPandas()
    for n in (3, 7):
        r = pdf.x.rolling(n, min_periods=1)
        for st, exp in (("mean", r.mean()), ("std", r.std()), ("min", r.min()), ("max", r.max()),
                        ("median", r.median())):
            np.testing.assert_allclose(rows[f"x_rolling_{st}_{n}"].astype(float).values, exp.values,
                                       rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=f"{st}{n}")
    for k in (1, 7):
        np.testing.assert_allclose(rows[f"x_lag_{k}"].astype(float).values, pdf.x.shift(k).values,
                                   equal_nan=True)


def test_sequences_count(spark):
    pdf, sdf = _series(spark, gaps=False)
    seq = WN.create_sequences(sdf, ["x"], seq_length=14, bucket_rows=20)
    assert seq.count() == len(pdf) - 14
    first = seq.orderBy("Date").first()
    np.testing.assert_allclose([r[0] for r in first["seq"]], pdf.x.values[:14])
    assert first["target"][0] == pdf.x.values[14]


def test_blocked_equals_plain_per_key(spark):
    ev = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), i % 3, float((i * 37) % 101))
         for i in range(600)], "event_id long, ts timestamp, user_id long, value double")
    blocked = WN.create_rolling_features(ev, ["value"], windows=[10], stats=["mean", "max"],
                                         keys=["user_id"], order=["ts", "event_id"],
                                         bucket_rows=16, block="hour")
    from pyspark.sql import Window
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    plain = ev.select("event_id", F.avg("value").over(w).alias("m"), F.max("value").over(w).alias("x"))
    j = blocked.join(plain, "event_id")
    bad = j.where((F.abs(F.col("m") - F.col("value_rolling_mean_10")) > 1e-9) |
                  (F.col("x") != F.col("value_rolling_max_10"))).count()
    assert bad == 0 and j.count() == 600

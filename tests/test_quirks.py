"""Edge tables for the quirks of the original pipeline (FIXTURES §4)."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesframe import schema as S
from seriesframe.functions import aqi as A
from seriesframe.functions.scalar import np_round, strip_units, to_date_safe, to_numeric
from seriesframe.operators import clean as CL
from seriesframe.operators import relational as R
from seriesframe.operators import stats as ST
from seriesframe.sources import readers as RD


def test_edge_cast(spark):
    df = spark.createDataFrame([("",), (" ",), (" 12 ",), ("-",), ("nan",), ("7.5",)], "v string")
    out = [r[0] for r in df.select(to_numeric("v")).collect()]
    assert out == [None, None, 12.0, None, None, 7.5]
    d = spark.createDataFrame([("2024/1/5",), ("2024-01-06",), ("bad",), (None,)], "d string")
    got = [r[0] for r in d.select(to_date_safe("d")).collect()]
    assert got == [dt.date(2024, 1, 5), dt.date(2024, 1, 6), None, None]


def test_edge_units(spark):
    rows = [("25 °c", "1.2\nmm", "80%", "1012 mb", "14 km/h", None)]
    df = spark.createDataFrame(rows, "Temp string, Rain string, Cloud string, Pressure string, "
                                     "Wind string, Gust string")
    out = df.select(*[to_numeric(strip_units(c, S.UNIT_SUFFIXES[c])).alias(c)
                      for c in S.WEATHER]).first()
    assert tuple(out) == (25.0, 1.2, 80.0, 1012.0, 14.0, None)


def test_every_white_space_is_stripped(spark):
    white = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace() and c not in range(0x1C, 0x20)]
    rows = [(w + "7 5" + w + "\n" + w,) for w in white] + [("\x1f7",), ("7\u200b",), ("\u180e7",), ("",), ("".join(white),), (None,)]
    df = spark.createDataFrame(rows, "v string").coalesce(1)
    got = [tuple(r) for r in df.select(strip_units("v", []), F.regexp_replace("v", r"(?U)^\s+|\s+$", "")).collect()]
    assert all(a == b for a, b in got)
    assert [a for a, _ in got] == ["7 5"] * len(white) + ["\x1f7", "7\u200b", "\u180e7", "", "", None]


def test_weather_texts_are_parsed_once(spark, tmp_path):
    from seriesframe import queries as Q
    orders = [(k, k % 50, 1000.0 * (k % 90), dt.datetime(2024, 1, 1 + k % 28), "1-URGENT" if k % 5 == 0 else "5-LOW") for k in range(400)]
    schema = "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(orders, schema).write.parquet(str(tmp_path / "orders.parquet"))
    one = RD.coerce_weather_rows(spark.createDataFrame([("2024-01-01", "25 °c")], "Date string, Temp string"))
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("°C") == 1 and one.first().Temp == 25.0
    for name in ("weather_daily_mean", "weather_rows_masked"):
        plan = Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "rlike" not in plan.lower()


def test_edge_round(spark):
    vals = [0.125, 2.675, 302.335, 71.025, 0.5, 1.5, 2.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(np_round("x", 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]
    got0 = [r[0] for r in df.select(np_round("x", 0)).collect()]
    assert got0 == [float(np.round(v, 0)) for v in vals]


def _py_sub_index(c, bps):
    for c_lo, c_hi, i_lo, i_hi in bps:
        if c is not None and c_lo <= c <= c_hi:
            return ((i_hi - i_lo) / (c_hi - c_lo)) * (c - c_lo) + i_lo
    return None


def _py_aqi(vals):
    sub = {p: _py_sub_index(vals[p], S.BREAKPOINTS[p]) for p in S.AQI_ORDER}
    valid = {k: v for k, v in sub.items() if v is not None}
    if not valid:
        return 0, "unknown"
    return round(max(valid.values())), max(valid, key=valid.get)


def test_edge_aqi(spark):
    cases = [
        dict(pm25=12.0, pm10=None, o3=None, no2=None, so2=None, co=None),
        dict(pm25=12.05, pm10=None, o3=None, no2=None, so2=None, co=None),   # gap
        dict(pm25=12.1, pm10=54.0, o3=None, no2=None, so2=None, co=None),
        dict(pm25=500.5, pm10=None, o3=201.0, no2=None, so2=None, co=None),  # all invalid
        dict(pm25=None, pm10=None, o3=None, no2=None, so2=None, co=None),
        dict(pm25=35.4, pm10=154.0, o3=None, no2=None, so2=None, co=None),   # tie 100/100
        dict(pm25=None, pm10=None, o3=None, no2=None, so2=35.0, co=4.4),     # tie -> so2 first
        dict(pm25=3.0, pm10=None, o3=None, no2=None, so2=None, co=None),     # 12.5 -> 12
        dict(pm25=9.0, pm10=None, o3=None, no2=None, so2=None, co=None),     # 37.5 -> 38
    ]
    df = spark.createDataFrame([tuple(c[p] for p in S.AQI_ORDER) for c in cases],
                               ", ".join(f"{p} double" for p in S.AQI_ORDER))
    got = A.with_aqi(df).select("aqi", "main_pollutant", "category").collect()
    for c, r in zip(cases, got):
        exp = _py_aqi(c)
        assert (r["aqi"], r["main_pollutant"]) == exp, (c, r, exp)
    assert got[4]["category"] == "Good"


def test_health_category(spark):
    df = spark.createDataFrame([(v,) for v in [0, 50, 51, 100, 150, 200, 201, 300, 301]], "aqi int")
    got = [r[0] for r in df.select(A.health_category("aqi")).collect()]
    assert got == ["Good", "Good", "Moderate", "Moderate", "Poor", "Bad", "Very bad", "Very bad",
                   "Hazardous"]


def test_edge_dupes_and_high_water(spark):
    hist = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 2), 2.0)],
                                 "Date date, co double")
    new = spark.createDataFrame([(dt.date(2024, 1, 2), 9.0), (dt.date(2024, 1, 3), 3.0),
                                 (dt.date(2030, 1, 1), 4.0), (None, 5.0)], "Date date, co double")
    kept = R.not_future(R.newer_than(new, hist), "2025-01-01")
    assert [r["Date"] for r in kept.collect()] == [dt.date(2024, 1, 3)]
    empty = spark.createDataFrame([], "Date date, co double")
    assert R.newer_than(new, empty).count() == 4
    null_hist = spark.createDataFrame([(None, 1.0)], "Date date, co double")
    assert R.newer_than(new, null_hist).count() == 0
    both = R.append(hist.withColumn("_src", F.lit(0)), new.withColumn("_src", F.lit(1)))
    dd = ST.dedupe_keep_last(both.where(F.col("Date").isNotNull()), ["Date"], ["_src", "co"])
    got = {r["Date"]: r["co"] for r in dd.collect()}
    assert got[dt.date(2024, 1, 2)] == 9.0 and len(got) == 4


def test_zero_and_clip(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 7)]
    temp = [5.0, 0.0, -3.0, 7.0, 0.0, 9.0]
    rain = [0.0, 1.0, 0.0, 0.0, 2.0, 0.0]
    df = spark.createDataFrame(list(zip(days, temp, rain)), "Date date, Temp double, Rain double")
    out = CL.impute(df, ["Temp", "Rain"], method="interpolate").orderBy("Date").collect()
    # zeros of Temp are missing and interpolated; negative Temp clipped to 0; Rain zeros kept
    assert [r["Temp"] for r in out] == [5.0, 1.0, 0.0, 7.0, 8.0, 9.0]
    assert [r["Rain"] for r in out] == rain


def test_outlier_gate_and_constant(spark):
    n21 = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 5)) for i in range(20)]
    n21.append((dt.date(2024, 2, 1), 1000.0))
    df = spark.createDataFrame(n21, "Date date, co double")
    # 21 valid values > 20: the IQR stage runs and removes 1000
    m = CL.mask_outliers(df, ["co"], limits={}, z_threshold=None)
    assert m.where(F.col("co").isNull()).count() == 1
    # 20 valid values: gate closed
    m20 = CL.mask_outliers(df.where(F.col("Date") > dt.date(2024, 1, 1)), ["co"], limits={},
                           z_threshold=None)
    assert m20.where(F.col("co").isNull()).count() == 0
    const = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), 3.0)
                                   for i in range(30)], "Date date, co double")
    z = CL.mask_outliers(const, ["co"], limits={}, iqr_factor=None, z_threshold=0.1)
    assert z.where(F.col("co").isNull()).count() == 0


def test_rain_mostly_dry_iqr(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), 0.0 if i % 5 else 3.0) for i in range(40)]
    df = spark.createDataFrame(rows, "Date date, Rain double")
    m = CL.mask_weather_outliers(df, ["Rain"])
    # Q5: Q1 = Q3 = 0, every wet value is an outlier
    assert m.where(F.col("Rain").isNull()).count() == 8


@pytest.mark.parametrize("n", [4, 5, 6, 15, 31])
def test_edge_split(spark, n):
    from seriesframe.plans import learn as L
    df = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i))
                                for i in range(n)], "Date date, co double")
    s = L.chrono_split(df).orderBy("Date").collect()
    n_test = int(0.2 * n)
    assert [r["split"] for r in s] == ["train"] * (n - n_test) + ["test"] * n_test
    folds = L.time_series_folds(df, n_splits=3).collect()
    t = n // 4
    for f in range(3):
        te = sorted(r["_pos"] for r in folds if r["fold"] == f and r["role"] == "test")
        tr = sorted(r["_pos"] for r in folds if r["fold"] == f and r["role"] == "train")
        start = n - (3 - f) * t
        assert te == list(range(start, start + t)) and tr == list(range(0, start))

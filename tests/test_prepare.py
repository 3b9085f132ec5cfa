"""Targets of a later day, counted drops and a forecast that names the day."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from seriesframe import schema as S
from seriesframe.plans import forecast as FC
from seriesframe.plans import learn as L
from seriesframe.plans import prepare as PR

DAY = dt.date(2024, 1, 1)


def _series(spark, days, station=None):
    rows = [(DAY + dt.timedelta(days=i), *[10.0 + j + 5 * math.sin(i / 4 + j) for j in range(12)]) for i in days]
    df = spark.createDataFrame(rows, S.SERIES_SCHEMA)
    return df if station is None else df.withColumn("station", F.lit(station))


def test_targets_skip_no_gap(spark):
    df = spark.createDataFrame([("a", DAY, 1.0), ("a", DAY + dt.timedelta(1), 2.0), ("a", DAY + dt.timedelta(3), 4.0),
                                ("b", DAY + dt.timedelta(2), 9.0), (None, DAY, 5.0), (None, DAY + dt.timedelta(1), 6.0), ("b", None, 3.0)],
                               "station string, Date date, x double")
    one = {(r.station, r.x): r.x_next for r in PR.later_targets(df, ["x"], 1, ["station"]).collect()}
    assert one == {("a", 1.0): 2.0, ("a", 2.0): None, ("a", 4.0): None, ("b", 9.0): None, (None, 5.0): None, (None, 6.0): None, ("b", 3.0): None}
    two = {r.x: r.x_next for r in PR.later_targets(df, ["x"], 2, ["station"]).where("station = 'a'").collect()}
    assert two == {1.0: None, 2.0: 4.0, 4.0: None}
    with pytest.raises(ValueError):
        PR.later_targets(df, ["x"], 0)
    with pytest.raises(ValueError):
        PR.later_targets(df, ["y"], 1)


def test_prepared_rows_and_counts(spark):
    both = _series(spark, range(80), "a").unionByName(_series(spark, range(20, 90), "b"))
    prepared = PR.prepare_features(both, horizon=1, keys=["station"])
    assert "station" not in prepared.features and "pm25" in prepared.features and len(prepared.features) == 342
    rows = prepared.rows.select("station", "Date", "pm25_next").collect()
    counts = prepared.counts()
    assert counts["rows_in"] == 150 and counts["rows_out"] == len(rows) and counts["dropped"] == 150 - len(rows)
    last = {s: max(r.Date for r in rows if r.station == s) for s in "ab"}
    assert last == {"a": DAY + dt.timedelta(78), "b": DAY + dt.timedelta(88)}
    truth = {(r.station, r.Date): r.pm25 for r in both.collect()}
    assert all(r.pm25_next == truth[r.station, r.Date + dt.timedelta(1)] for r in rows)
    same = PR.prepare_features(_series(spark, range(80)))
    assert "pm25" not in same.features and len(same.features) == 330 and same.targets == list(S.TARGETS)


def test_next_day_model_and_forecast(spark):
    series = _series(spark, range(140))
    prepared = PR.prepare_features(series, horizon=1)
    model = L.train_forest(prepared.rows, prepared.features, prepared.targets, {"numTrees": 10, "maxDepth": 6})
    got = FC.forecast(model, series, horizon=1).collect()
    assert len(got) == 1 and got[0].Date == DAY + dt.timedelta(140)
    truth = _series(spark, [140]).first()
    stays = _series(spark, [139]).first()
    error = [abs(got[0][t] - truth[t]) for t in S.TARGETS]
    assert sum(error) < sum(abs(stays[t] - truth[t]) for t in S.TARGETS)
    assert got[0].aqi is not None

"""Casts take whole texts only."""
import datetime as dt

import pytest

from seriesframe.functions import scalar as F
from seriesframe.plans import learn as L


def test_dates_and_numbers(spark):
    dates = {"3/4/2024": dt.date(2024, 3, 4), "13/4/2024": dt.date(2024, 4, 13), "2024-01-05 foo": None, "2024-01-05": dt.date(2024, 1, 5),
             "2024-01-05 10:11:12": dt.date(2024, 1, 5), "2024/1/5": dt.date(2024, 1, 5), "x": None, None: None}
    numbers = {"1.5d": None, "1f": None, "1.5": 1.5, " 2 ": 2.0, "-1e3": -1000.0, ".5": 0.5, "5.": 5.0, "nan": None, "1,5": None, None: None}
    got = spark.createDataFrame([(k,) for k in dates], "c string").select("c", F.to_date_safe("c").alias("d")).collect()
    assert {r.c: r.d for r in got} == dates
    got = spark.createDataFrame([(k,) for k in numbers], "c string").select("c", F.to_numeric("c").alias("d")).collect()
    assert {r.c: r.d for r in got} == numbers


def test_depth_beyond_the_library_is_an_error(spark):
    with pytest.raises(ValueError):
        L.train_forest(spark.createDataFrame([(1.0, 2.0)], "a double, y double"), ["a"], ["y"], {"maxDepth": 31})

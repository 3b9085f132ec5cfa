"""Statistics merged over batches equal those over all rows."""
import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesframe.operators import clean as CL
from seriesframe.operators import merged as MG
from seriesframe.operators import stats as ST
from seriesframe.sources import versioned as V

COLS = ["co", "pm25"]
CUT = dt.date(2021, 3, 1)


@pytest.fixture(scope="module")
def days(spark):
    """Three years of two stations and one without a name; outliers, zeros, gaps and a column out of its domain."""
    rng = np.random.default_rng(4)
    rows = []
    for station, n in (("a", 1000), ("b", 900), (None, 6)):
        for i in range(n):
            day = dt.date(2019, 1, 1) + dt.timedelta(days=i)
            value = [round(float(v), 1) for v in rng.normal(20, 5, 2)]
            for k in range(2):
                pick = rng.random()
                value[k] = None if pick < 0.1 else 0.0 if pick < 0.15 else 1e6 if pick < 0.16 else value[k] * 4 if pick < 0.2 else value[k]
            rows.append((station, day, *value))
    return spark.createDataFrame(rows, "station string, Date date, co double, pm25 double").repartition(5).cache()


def _rows(df):
    return sorted(([None if v is None else round(v, 9) if isinstance(v, float) else str(v) for v in r] for r in df.collect()), key=str)


def _counts(days, keys):
    old, new = days.where(F.col("Date") < F.lit(CUT)), days.where(F.col("Date") >= F.lit(CUT))
    return MG.merge_counts(MG.value_counts(old, COLS, keys), MG.value_counts(new, COLS, keys))


def test_a_batch_is_masked_as_with_all_rows(days):
    statistics = MG.mask_statistics(_counts(days, []), COLS)
    batch = days.where(F.col("Date") >= F.lit(CUT))
    want = CL.mask_outliers(days, COLS).where(F.col("Date") >= F.lit(CUT))
    got = MG.mask_batch(batch, statistics, COLS)
    assert got.columns == days.columns and _rows(got) == _rows(want)
    assert got.where("co IS NULL").count() > batch.where("co IS NULL").count()


def test_by_station(days):
    named = days.where("station IS NOT NULL")
    statistics = MG.mask_statistics(_counts(days, ["station"]), COLS, ["station"])
    got = MG.mask_batch(days, statistics, COLS, ["station"])
    assert _rows(got.where("station IS NOT NULL")) == _rows(CL.mask_outliers(named, COLS, ["station"]))
    # a series of too few values has no fences; the domain rule alone masks it
    few = days.where("station IS NULL")
    assert _rows(got.where("station IS NULL")) == _rows(CL.mask_outliers(few, COLS, iqr_factor=None, z_threshold=None))


@pytest.mark.parametrize("keys", [[], ["station"]])
def test_rates_and_seasonal_means(days, keys):
    days = days.where("station IS NOT NULL")
    counts = _counts(days, keys)
    after = MG.masked_counts(counts, MG.mask_statistics(counts, COLS, keys), keys)
    masked = CL.mask_outliers(days, COLS, keys).cache()
    assert _rows(MG.missing_rates(after, COLS, keys)) == _rows(ST.missing_rates(masked, COLS, keys))
    zeros = masked.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in COLS})
    for got, want in zip(MG.seasonal_means(after, COLS, keys), ST.seasonal_means(zeros, COLS, keys)):
        assert _rows(got.select(want.columns)) == _rows(want)


def test_batches_are_added_once(spark, days):
    path = tempfile.mkdtemp(prefix="sf-counts-") + "/counts"
    parts = [days.where(F.col("Date") < F.lit(CUT)), days.where(F.col("Date") >= F.lit(CUT))]
    assert [MG.add_batch(p, path, COLS, ["station"], base=i) for i, p in enumerate(parts)] == [1, 2]
    with pytest.raises(V.ConflictError):
        MG.add_batch(parts[1], path, COLS, ["station"], base=1)
    held = V.read_version(spark, path)
    assert _rows(held.select("station", "column", "month", "doy", "value", "n")) == _rows(
        MG.value_counts(days, COLS, ["station"]).select("station", "column", "month", "doy", "value", "n"))
    assert held.agg(F.sum("n")).first()[0] == 2 * days.count()


def test_empty(spark, days):
    counts = MG.value_counts(days.limit(0), COLS)
    statistics = MG.mask_statistics(counts, COLS)
    assert _rows(MG.mask_batch(days, statistics, COLS)) == _rows(CL.mask_outliers(days, COLS, iqr_factor=None, z_threshold=None))
    assert MG.missing_rates(counts, COLS).first().co_missing is None

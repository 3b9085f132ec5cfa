"""Scaler fitted on the training part: bounds, units, round trip and pipeline."""
import tempfile

import pytest
from pyspark.ml import Pipeline, PipelineModel

from seriesframe.plans.scaling import SeriesScaler, SeriesScalerModel


def _rows(spark):
    return spark.createDataFrame(
        [("a", "train", 1.0, 5.0), ("a", "train", 3.0, 5.0), ("a", "test", 9.0, 7.0), ("a", "test", None, 5.0),
         ("b", "train", 10.0, None), ("b", "train", 20.0, None), ("b", "val", 15.0, 2.0), ("c", "test", 4.0, 4.0)],
        "station string, split string, x double, y double")


def _by(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_train_rows_alone_set_the_bounds(spark):
    model = SeriesScaler(inputCols=["x"]).fit(_rows(spark))
    got = dict(zip([1.0, 3.0, 9.0, 10.0, 20.0, 15.0, 4.0], [0.0, 2 / 19, 8 / 19, 9 / 19, 1.0, 14 / 19, 3 / 19]))
    out = _rows(spark).withColumnRenamed("y", "z").selectExpr("*", "x AS raw")
    for r in model.transform(out).where("raw IS NOT NULL").collect():
        assert r.x == pytest.approx(got[r.raw])
    every = SeriesScaler(inputCols=["y"], fitOn="all").fit(_rows(spark)).bounds.first()
    assert tuple(every) == (2.0, 7.0)


def test_series_constant_null_and_unseen(spark):
    model = SeriesScaler(inputCols=["x", "y"], keys=["station"]).fit(_rows(spark))
    out = model.transform(_rows(spark))
    assert out.columns.count("x") == 1 and len(out.columns) == 4
    got = _by(out, "station", "split", "x", "y")
    assert got == sorted([("a", "train", 0.0, 0.0), ("a", "train", 1.0, 0.0), ("a", "test", 4.0, 0.0), ("a", "test", None, 0.0),
                          ("b", "train", 0.0, None), ("b", "train", 1.0, None), ("b", "val", 0.5, None), ("c", "test", None, None)], key=str)


def test_inverse_gives_units_back(spark):
    model = SeriesScaler(inputCols=["x"], keys=["station"]).fit(_rows(spark))
    scaled = model.transform(_rows(spark)).withColumnRenamed("x", "x_pred")
    back = model.inverse_transform(scaled, "_pred").where("station <> 'c'")
    want = _rows(spark).where("station <> 'c'")
    assert _by(back, "station", "split", "x_pred") == _by(want, "station", "split", "x")


def test_round_trip_alone_and_in_a_pipeline(spark):
    base = tempfile.mkdtemp(prefix="sf-scaler-")
    scaler = SeriesScaler(inputCols=["x"], keys=["station"], fitOn="train")
    scaler.write().save(base + "/estimator")
    assert SeriesScaler.load(base + "/estimator").getOrDefault("keys") == ["station"]
    model = scaler.fit(_rows(spark))
    model.write().save(base + "/model")
    want = _by(model.transform(_rows(spark)), "station", "split", "x")
    assert _by(SeriesScalerModel.load(base + "/model").transform(_rows(spark)), "station", "split", "x") == want
    Pipeline(stages=[scaler]).fit(_rows(spark)).write().save(base + "/pipeline")
    assert _by(PipelineModel.load(base + "/pipeline").transform(_rows(spark)), "station", "split", "x") == want


def test_absent_columns_are_named(spark):
    with pytest.raises(ValueError, match="part"):
        SeriesScaler(inputCols=["x"], splitCol="part").fit(_rows(spark))
    with pytest.raises(ValueError, match="q"):
        SeriesScaler(inputCols=["q"]).fit(_rows(spark))
    empty = SeriesScaler(inputCols=["x"]).fit(_rows(spark).limit(0))
    assert [r.x for r in empty.transform(_rows(spark)).collect()] == [None] * 8

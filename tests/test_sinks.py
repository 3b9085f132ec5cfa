"""Sinks and model persistence (A5-A9): written tables read back equal."""
import datetime as dt
import tempfile

from pyspark.sql import functions as F

from seriesframe import schema as S
from seriesframe.plans import forecast as FC
from seriesframe.plans import learn as L
from seriesframe.sources import readers as RD


def test_write_read_series_and_empty(spark):
    base = tempfile.mkdtemp(prefix="sf-sink-")
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), *[float(i + j) for j in range(12)])
            for i in range(10)]
    df = spark.createDataFrame(rows, S.SERIES_SCHEMA)
    FC.write_series(df, base + "/final")
    back = RD.read_series(spark, base + "/final")
    assert back.exceptAll(df).count() == 0 and back.count() == 10
    FC.write_series(df, base + "/final_csv", fmt="csv")
    back_csv = RD.read_series(spark, base + "/final_csv", fmt="csv")
    assert back_csv.select(*df.columns).exceptAll(df).count() == 0
    empty = RD.read_or_empty(spark, base + "/missing", S.POLLUTANT_SCHEMA)
    assert empty.count() == 0 and empty.columns == S.POLLUTANT_SCHEMA.names
    assert RD.read_or_empty(spark, base + "/fin*l", df.schema).count() == 10


def test_model_roundtrip_and_metrics(spark):
    base = tempfile.mkdtemp(prefix="sf-model-")
    rows = [(float(i), float(i % 7), 2.0 * i + 1.0) for i in range(80)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model = L.train_forest(df, ["a", "b"], ["y"], {"numTrees": 5, "maxDepth": 4})
    FC.save_model(model, base)
    loaded = FC.load_model(base, spark)
    assert loaded.features == ["a", "b"] and loaded.targets == ["y"]
    p1 = L.predict(model, df).select("a", "y_pred").collect()
    p2 = L.predict(loaded, df).select("a", "y_pred").collect()
    assert sorted(p1) == sorted(p2)
    m = L.evaluate(L.predict(loaded, df), ["y"])
    r = m.first()
    assert r["feature"] == "y" and r["r2"] > 0.5
    FC.write_metrics(m, base + "/metrics", {"numTrees": 5})
    assert spark.read.json(base + "/metrics/metrics").count() == 1
    imp = L.feature_importance(loaded, spark)
    FC.write_importance(imp, base + "/importance")
    assert spark.read.option("header", True).csv(base + "/importance").count() == 2

"""Scoring and persistence.

The forecast builds the
features over the whole series, keeps each series' latest complete row and scores it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe import schema as S
from seriesframe.functions import aqi as A
from seriesframe.operators import relational as R
from seriesframe.operators import windows as WN
from seriesframe.plans import forest as FO
from seriesframe.plans import learn as L
from seriesframe.plans import prepare as PR


def forecast(model: FO.Forest, series: DataFrame, keys=(), horizon: int = 0):
    """Values of the 12 targets from the latest complete row, with AQI, main
    pollutant and health band (J6). Lags count rows, so the whole series is
    read; series without a complete row are in ``unscorable``. ``horizon`` is
    that of the model's targets (``prepare``): with it ``Date`` is the day forecast,
    else the scored row's own."""
    keys = list(keys)
    feats = R.drop_incomplete(WN.create_all_features(series, keys=keys))
    last = R.latest_row(feats, keys)
    aligned = R.align_features(last, model.features, keep=keys + ["Date"])
    pred = L.predict(model, aligned)
    day = F.date_add("Date", horizon).alias("Date") if horizon else F.col("Date")
    out = pred.select(*keys, day, *[F.col(f"{t}_pred").alias(t.removesuffix(PR.NEXT) if horizon else t) for t in model.targets])
    return A.with_aqi(out, keep_sub_indices=False)


def unscorable(series: DataFrame, keys) -> DataFrame:
    """Keys, rows and days of the series that no complete feature row can score."""
    keys = list(keys)
    done = R.drop_incomplete(WN.create_all_features(series, keys=keys)).select(*keys).distinct()
    every = series.groupBy(*keys).agg(F.count("*").alias("rows"), F.min("Date").alias("first_day"),
                                      F.max("Date").alias("last_day"))
    return every.join(done, keys, "left_anti")


def forecast_report(pred: DataFrame, spark, keys=()):
    """Predictions unpivoted with units and formatted text, plus AQI fields and health advice."""
    keys = list(keys)
    long = R.unpivot_metrics(A.with_advice(pred), [t for t in S.TARGETS if t in pred.columns],
                             keys + ["Date", "aqi", "main_pollutant", "category", "advice"])
    return R.with_units(long, spark).withColumn("text", R.format_value())


def write_series(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None):
    """Replace a stored table in place (A6); never the table being read in the same
    plan. ``sources.versioned`` keeps the old table until the new one is whole."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def write_metrics(metrics: DataFrame, path: str, params: dict | None = None):
    """Metrics (and run parameters) as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    if params is not None:
        spark = metrics.sparkSession
        spark.createDataFrame([(json.dumps(params),)], "params string") \
            .coalesce(1).write.mode("overwrite").json(f"{path}/params")


def write_importance(importance: DataFrame, path: str):
    """Feature importance as CSV with header."""
    importance.orderBy(F.col("importance").desc(), "feature").coalesce(1) \
        .write.mode("overwrite").option("header", True).csv(path)


def save_model(model: FO.Forest, path: str):
    """Persist a forest with its features, targets and bin edges."""
    model.save(path)


def load_model(path: str, spark) -> FO.Forest:
    """Load a forest; fails when absent."""
    return FO.Forest.load(path, spark)

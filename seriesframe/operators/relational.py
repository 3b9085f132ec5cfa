"""Filters, joins, set operations and top-k of the series (B9-B15, B19, C1,
C4, C6, F1-F4, G1, G2, H9, H10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesframe import schema as S
from seriesframe.operators import stats as ST


def newer_than(df: DataFrame, history: DataFrame, keys=(), date_col: str = S.DATE) -> DataFrame:
    """Rows after the newest stored date of their series.

    Empty history keeps every row; a history whose dates are all missing
    keeps none. With series keys, a series absent from the history keeps all
    its rows.
    """
    keys = list(keys)
    hw = history.groupBy(*keys).agg(F.max(date_col).alias("_hw"), F.count(F.lit(1)).alias("_hn"))
    d = ST.attach(df, hw, keys)
    keep = F.coalesce(F.col("_hn"), F.lit(0)) == 0
    keep = keep | (F.col(date_col) > F.col("_hw"))
    return d.where(F.coalesce(keep, F.lit(False))).drop("_hw", "_hn")


def not_future(df: DataFrame, now, date_col: str = S.DATE) -> DataFrame:
    """``Date < now``; missing dates are dropped as well."""
    return df.where(F.col(date_col) < F.lit(now).cast("date"))


def date_range(df: DataFrame, start, end, date_col: str = S.DATE) -> DataFrame:
    """Inclusive date range; pushed into the parquet scan."""
    return df.where(F.col(date_col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def select_metric(df: DataFrame, category: str, date_col: str = S.DATE) -> DataFrame:
    """``Date`` and one metric; error if the metric is absent."""
    if category not in df.columns:
        raise ValueError(f"category {category!r} not in data")
    return df.select(date_col, category)


def split_xy(df: DataFrame, targets=S.TARGETS, date_col: str = S.DATE):
    """Feature names = all columns except targets and date."""
    excl = set(targets) | {date_col}
    feats = [c for c in df.columns if c not in excl]
    if not feats:
        raise ValueError("no feature columns left after removing the targets")
    return feats


def require_columns(df: DataFrame, cols) -> None:
    """Fail on absent columns (B14); metadata only, no job."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def require_rows(df: DataFrame) -> None:
    """Fail on empty input (B14); runs a one-row probe, use at sinks only."""
    if df.isEmpty():
        raise ValueError("input is empty")


def drop_incomplete(df: DataFrame, cols=None) -> DataFrame:
    """Rows with any missing value are dropped."""
    return df.dropna("any", subset=cols)


def align_features(df: DataFrame, names, fill: float = 0.0, keep=()) -> DataFrame:
    """Fixed feature order; absent features as ``fill``."""
    have = set(df.columns)
    return df.select(*keep, *[(F.col(n) if n in have else F.lit(float(fill))).alias(n) for n in names])


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of history and new rows by column name (G1)."""
    return old.unionByName(new, allowMissingColumns=True)


def join_on_date(aqi: DataFrame, weather: DataFrame, keys=(), date_col: str = S.DATE) -> DataFrame:
    """Inner equi-join on series keys and date (C1); AQE picks the strategy."""
    return aqi.join(weather, list(keys) + [date_col], "inner")


def dates_to_load(history: DataFrame, now, start: str = S.HISTORY_START, keys=(),
                  series: DataFrame | None = None, date_col: str = S.DATE) -> DataFrame:
    """Days from the newest stored day + 1 (or ``start``) up to yesterday.

    Per series when ``keys`` are given; ``series`` lists the series to
    consider (defaults to the ones in the history). One ``sequence`` per
    series, exploded — the work is the number of missing days.
    """
    keys = list(keys)
    hw = history.groupBy(*keys).agg(F.max(date_col).alias("_hw"))
    if keys and series is not None:
        hw = series.select(*keys).distinct().join(hw, keys, "left")
    elif not keys:
        hw = hw.select(F.col("_hw"))
    first = F.coalesce(F.date_add(F.col("_hw"), 1), F.lit(start).cast("date"))
    last = F.date_sub(F.lit(now).cast("date"), 1)
    return hw.select(*keys, F.explode(F.when(first <= last, F.sequence(first, last))
                                      .otherwise(F.array().cast("array<date>"))).alias(date_col))


def top_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """k largest by ``by``, name as tie-breaker (F2, F4): TakeOrderedAndProject."""
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(k)


def latest_row(df: DataFrame, keys=(), date_col: str = S.DATE) -> DataFrame:
    """Last row of each series (F3) as a map-side-combined ``max_by``."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.col(date_col)).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("_r").getField(c).alias(c) for c in rest])


def units_table(spark) -> DataFrame:
    return spark.createDataFrame(list(S.UNITS.items()), "metric string, unit string")


def with_units(long_df: DataFrame, spark, metric_col: str = "metric") -> DataFrame:
    """Attach the display unit of each metric (C4); the 12-row table is broadcast."""
    return long_df.join(F.broadcast(units_table(spark)).withColumnRenamed("metric", metric_col),
                        metric_col, "left")


def format_value(value_col: str = "value", unit_col: str = "unit"):
    """Value with 3 decimals and its unit."""
    return F.concat(F.format_string("%.3f", F.col(value_col)), F.lit(" "), F.col(unit_col))


def unpivot_metrics(df: DataFrame, cols, keys=(), name: str = "metric", value: str = "value"):
    """Wide metrics to long rows (J8, D11 inputs)."""
    return df.unpivot(list(keys), list(cols), name, value)


def union_locations(frames: dict, spark=None) -> tuple[DataFrame, DataFrame]:
    """Union of per-location frames with a ``station`` column; failed loads
    (``None``) are left out and reported (G2). Returns (data, status)."""
    ok = {k: v for k, v in frames.items() if v is not None}
    data = None
    for name, df in ok.items():
        d = df.withColumn("station", F.lit(name))
        data = d if data is None else data.unionByName(d, allowMissingColumns=True)
    if spark is None:
        spark = next(iter(ok.values())).sparkSession if ok else None
    status = spark.createDataFrame([(k, v is not None) for k, v in frames.items()],
                                   "station string, success boolean")
    return data, status


def sort_by_date(df: DataFrame, keys=(), date_col: str = S.DATE) -> DataFrame:
    """Ascending date order at an output (F1)."""
    return df.orderBy(*keys, date_col)


def series_window(keys, date_col: str = S.DATE):
    return Window.partitionBy(*keys).orderBy(date_col) if keys else Window.orderBy(date_col)

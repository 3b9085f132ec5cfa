"""Aggregations of the series (D1-D14 without the model ones).

Statistics are computed per series with one ``groupBy(keys).agg`` for all
columns (partial + final hash aggregation: a hot series is reduced
map-side), then attached back to the rows: by a key join when there are
series keys (broadcast by AQE while the table is small, shuffle join
beyond), or as one scalar subquery when the whole table is one series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe import schema as S
from seriesframe.functions.scalar import np_round
from seriesframe.operators import ranks


def attach(df: DataFrame, stats: DataFrame, keys) -> DataFrame:
    """Attach per-series statistics to the rows of ``df``."""
    keys = list(keys)
    if keys:
        return df.join(stats, keys, "left")
    cols = stats.columns
    one = stats.select(F.struct(*cols).alias("_st")).scalar()
    # one subquery column, fields projected from it: the subquery plan is
    # analysed and run once instead of once per field
    d = df.withColumn("_st", one)
    return d.withColumns({c: F.col("_st").getField(c) for c in cols}).drop("_st")


def max_date(df: DataFrame, keys=(), date_col: str = S.DATE) -> DataFrame:
    """High-water mark per series."""
    return df.groupBy(*keys).agg(F.max(date_col).alias("max_date"))


def quantiles(df: DataFrame, cols, probs=(0.25, 0.75), keys=(), exact: bool = True,
              accuracy: int = 10000) -> DataFrame:
    """Linear-interpolated quantiles per series and column.

    ``exact`` reads the two ranks of each quantile from counted, range-dealt
    values (equal to pandas' default); ``exact=False`` uses the bounded-memory
    ``percentile_approx``.
    """
    keys, name = list(keys), lambda c, p: f"{c}_q{int(round(p * 100))}"
    if exact:
        st = ranks.exact_quantiles(df, cols, probs, keys)
        return st.select(*keys, *[F.col(f"_q_{c}")[i].alias(name(c, p)) for c in cols for i, p in enumerate(probs)])
    return df.groupBy(*keys).agg(*[
        F.percentile_approx(c, F.lit(p), accuracy).cast("double").alias(name(c, p)) for c in cols for p in probs])


def mean_std(df: DataFrame, cols, keys=()) -> DataFrame:
    """Mean and sample standard deviation per column (D3)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(*keys).agg(*aggs)


def missing_rate_exprs(cols) -> list[Column]:
    return [(F.avg(F.col(c).isNull().cast("double")) * F.lit(100.0)).alias(f"{c}_missing")
            for c in cols]


def missing_rates(df: DataFrame, cols, keys=()) -> DataFrame:
    """Percent missing per column (D4), one row per series."""
    return df.groupBy(*keys).agg(*missing_rate_exprs(cols))


def daily_mean(df: DataFrame, cols, keys=(), date_col: str = S.DATE, digits: int | None = 2,
               agg: dict | None = None) -> DataFrame:
    """Mean per day (D7), NumPy-rounded; ``agg`` may name another function per column."""
    fns = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    out = []
    for c in cols:
        e = fns[(agg or {}).get(c, "mean")](c)
        out.append((np_round(e, digits) if digits is not None else e).alias(c))
    return df.groupBy(*keys, date_col).agg(*out)


def distinct_dates(df: DataFrame, keys=(), date_col: str = S.DATE) -> DataFrame:
    """Distinct days (D8), used when no value column is present."""
    return df.select(*keys, date_col).distinct()


def dedupe_keep_last(df: DataFrame, key, order_desc) -> DataFrame:
    """One row per key; the row with the greatest ``order_desc`` tuple wins.

    ``max_by`` over a struct is a hash aggregate with map-side combine, so a
    key holding a third of all rows is reduced before the shuffle instead of
    being sorted in one task.
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    ordering = F.struct(*[F.col(c) for c in order_desc])
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), ordering).alias("_row"))
    return picked.select(*key, *[F.col("_row").getField(c).alias(c) for c in rest])


def seasonal_means(df: DataFrame, cols, keys=(), date_col: str = S.DATE):
    """Mean per (month, day of year) and per month."""
    keys = list(keys)
    d = df.withColumns({"_m": F.month(date_col), "_doy": F.dayofyear(date_col)})
    by_day = d.groupBy(*keys, "_m", "_doy").agg(*[F.avg(c).alias(f"_sd_{c}") for c in cols])
    by_month = d.groupBy(*keys, "_m").agg(*[F.avg(c).alias(f"_sm_{c}") for c in cols])
    return by_day, by_month


def with_seasonal_fill(df: DataFrame, cols, keys=(), date_col: str = S.DATE,
                       out_name: str = "{c}") -> DataFrame:
    """``coalesce(value, mean of (month, day of year), mean of month)``."""
    keys = list(keys)
    by_day, by_month = seasonal_means(df, cols, keys, date_col)
    d = df.withColumns({"_m": F.month(date_col), "_doy": F.dayofyear(date_col)})
    d = d.join(by_day, keys + ["_m", "_doy"], "left").join(by_month, keys + ["_m"], "left")
    d = d.withColumns({out_name.format(c=c): F.coalesce(F.col(c), F.col(f"_sd_{c}"), F.col(f"_sm_{c}"))
                       for c in cols})
    return d.drop("_m", "_doy", *[f"_sd_{c}" for c in cols], *[f"_sm_{c}" for c in cols])


def regression_metrics(long_df: DataFrame, keys=("feature",), y="y", yhat="yhat") -> DataFrame:
    """R², MAE and RMSE per target from a long ``(feature, y, yhat)`` table.

    R² = 1 - SSE/SST with SST = n·var_pop(y); for a constant target R² is 1
    for a perfect fit and 0 otherwise (the usual finite convention).
    """
    err = F.col(y) - F.col(yhat)
    sse = F.sum(err * err)
    sst = F.var_pop(y) * F.count(y)
    r2 = (F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - sse / sst))
    return long_df.groupBy(*keys).agg(
        r2.alias("r2"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"))


def multi_rmse(long_df: DataFrame, fold_col="fold", feature_col="feature", y="y", yhat="yhat"):
    """sqrt(mean over targets of MSE) per fold, then the mean over folds."""
    err = F.col(y) - F.col(yhat)
    per = long_df.groupBy(fold_col, feature_col).agg(F.avg(err * err).alias("_mse"))
    per_fold = per.groupBy(fold_col).agg(F.sqrt(F.avg("_mse")).alias("rmse"))
    return per_fold, per_fold.agg(F.avg("rmse").alias("cv_rmse"))


def minmax_fit(df: DataFrame, cols, keys=()) -> DataFrame:
    """Per-column minimum and maximum (D14 fit)."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*keys).agg(*aggs)


def minmax_transform(df: DataFrame, fitted: DataFrame, cols, keys=()) -> DataFrame:
    """Scale to 0..1; a constant column maps to 0 (D14 transform)."""
    d = attach(df, fitted, keys)
    out = {}
    for c in cols:
        lo, hi = F.col(f"{c}_min"), F.col(f"{c}_max")
        rng = hi - lo
        out[c] = F.when(rng == 0, F.lit(0.0)).otherwise((F.col(c) - lo) / rng)
    return d.withColumns(out).drop(*[f"{c}_{s}" for c in cols for s in ("min", "max")])

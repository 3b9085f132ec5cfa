"""Cleaning: outlier masks, imputation, quality and outlier reports.

Each masking stage needs statistics of the survivors of the stage before,
so a stage is: one aggregate for all columns per series, attached back
(key join or scalar subquery, see ``stats.attach``), then a projection.
Quartiles are exact and distributed (``ranks``): computing them writes the
counted values into the shared folder. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe import schema as S
from seriesframe.functions.scalar import limit_expr, zero_to_missing
from seriesframe.operators import frames as FR
from seriesframe.operators import ranks as RK
from seriesframe.operators import stats as ST
from seriesframe.operators import windows as WN


# ---------------------------------------------------------------------------
# outlier predicates (I1, I2): functions of the attached statistics
# ---------------------------------------------------------------------------
def iqr_stats(df, cols, keys=(), exact=True) -> DataFrame:
    """Number of values and quartiles of each column per series; ``exact=False`` by sketches."""
    if exact:
        return RK.exact_quantiles(df, cols, (0.25, 0.75), keys)
    aggs = []
    for c in cols:
        q = F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)), 10000)
        aggs += [F.count(c).alias(f"_n_{c}"), q.alias(f"_q_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def iqr_flag(c: str, factor: float) -> Column:
    """Outside ``[Q1 - f·IQR, Q3 + f·IQR]``; NULL values are not outliers."""
    q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
    iqr = q3 - q1
    lo, hi = q1 - F.lit(factor) * iqr, q3 + F.lit(factor) * iqr
    return F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False))


def z_stats(df, cols, keys=()) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"_n_{c}"), F.avg(c).alias(f"_mu_{c}"),
                 F.stddev_samp(c).alias(f"_sd_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def z_flag(c: str, threshold: float) -> Column:
    """``|x - mean| / std > t``; std = 0 or undefined flags nothing."""
    sd = F.col(f"_sd_{c}")
    z = F.abs((F.col(c) - F.col(f"_mu_{c}")) / sd)
    return F.coalesce(F.when(sd != 0, z > F.lit(threshold)), F.lit(False))


def _gate(c: str, min_valid: int) -> Column:
    return F.col(f"_n_{c}") > F.lit(min_valid)


def _stage(df, cols, keys, stats_fn, flag_fn, min_valid):
    st = stats_fn(df, cols, keys)
    d = ST.attach(df, st, keys)
    d = d.withColumns({c: F.when(_gate(c, min_valid) & flag_fn(c), F.lit(None).cast("double"))
                       .otherwise(F.col(c)) for c in cols})
    return d.drop(*[x for x in st.columns if x not in keys])


def detect_outliers_iqr(df, col, factor=S.REPORT_IQR_FACTOR, keys=()) -> DataFrame:
    """Add ``<col>_outlier`` (boolean) by the IQR rule."""
    st = iqr_stats(df, [col], keys)
    d = ST.attach(df, st, keys)
    return d.withColumn(f"{col}_outlier", iqr_flag(col, factor)).drop(
        *[x for x in st.columns if x not in keys])


def detect_outliers_zscore(df, col, threshold=3.0, keys=()) -> DataFrame:
    """Add ``<col>_outlier`` (boolean) by the z-score rule."""
    st = z_stats(df, [col], keys)
    d = ST.attach(df, st, keys)
    return d.withColumn(f"{col}_outlier", z_flag(col, threshold)).drop(
        *[x for x in st.columns if x not in keys])


def mask_outliers(df, cols=None, keys=(), limits=None, iqr_factor=S.POLLUTANT_IQR_FACTOR,
                  z_threshold=S.POLLUTANT_Z_THRESHOLD, min_valid=S.MIN_VALID_FOR_STATS):
    """Domain limits, then IQR, then z-score; each stage sees the survivors of
    the one before and only runs on series with more than ``min_valid``
    values (I3; I4 with ``z_threshold=None`` and the weather limits)."""
    cols = [c for c in (cols or S.POLLUTANTS) if c in df.columns]
    limits = S.POLLUTANT_LIMITS if limits is None else limits
    keys = list(keys)
    d = df.withColumns({c: limit_expr(c, limits) for c in cols if c in limits})
    if iqr_factor is not None:
        d = _stage(d, cols, keys, iqr_stats, lambda c: iqr_flag(c, iqr_factor), min_valid)
    if z_threshold is not None:
        d = _stage(d, cols, keys, z_stats, lambda c: z_flag(c, z_threshold), min_valid)
    return d


def mask_weather_outliers(df, cols=None, keys=()):
    """Weather variant: domain (Rain clamped) then IQR with factor 3 (I4)."""
    return mask_outliers(df, cols or S.WEATHER, keys, S.WEATHER_LIMITS,
                         iqr_factor=S.WEATHER_IQR_FACTOR, z_threshold=None)


def outlier_report(df, cols=None, keys=(), limits=None, iqr_factor=S.POLLUTANT_IQR_FACTOR,
                   z_threshold=S.POLLUTANT_Z_THRESHOLD, min_valid=S.MIN_VALID_FOR_STATS):
    """Count of values removed per column and method (D6): long table
    ``keys…, column, method, removed``."""
    cols = [c for c in (cols or S.POLLUTANTS) if c in df.columns]
    limits = S.POLLUTANT_LIMITS if limits is None else limits
    keys = list(keys)
    before = {c: F.col(c).isNotNull() for c in cols}
    d0 = df.withColumns({f"_v0_{c}": before[c].cast("int") for c in cols})
    d1 = d0.withColumns({c: limit_expr(c, limits) for c in cols if c in limits})
    d1 = d1.withColumns({f"_v1_{c}": F.col(c).isNotNull().cast("int") for c in cols})
    stages = ["domain"]
    d = d1
    if iqr_factor is not None:
        d = _stage(d, cols, keys, iqr_stats, lambda c: iqr_flag(c, iqr_factor), min_valid)
        d = d.withColumns({f"_v2_{c}": F.col(c).isNotNull().cast("int") for c in cols})
        stages.append("iqr")
    if z_threshold is not None:
        d = _stage(d, cols, keys, z_stats, lambda c: z_flag(c, z_threshold), min_valid)
        d = d.withColumns({f"_v3_{c}": F.col(c).isNotNull().cast("int") for c in cols})
        stages.append("zscore")
    aggs = []
    for c in cols:
        for i, _ in enumerate(stages):
            aggs.append((F.sum(f"_v{i}_{c}") - F.sum(f"_v{i + 1}_{c}")).alias(f"_r{i}_{c}"))
    wide = d.groupBy(*keys).agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(m).alias("method"),
                     F.col(f"_r{i}_{c}").cast("long").alias("removed"))
            for c in cols for i, m in enumerate(stages)]
    return wide.select(*keys, F.inline(F.array(*rows)))


# ---------------------------------------------------------------------------
# imputation
# ---------------------------------------------------------------------------
def _clip_lower(c: Column, lo) -> Column:
    return c if lo is None else F.when(c < F.lit(float(lo)), F.lit(float(lo))).otherwise(c)


def impute(df, cols, keys=(), order=(S.DATE,), method="auto",
           seasonal_above=S.POLLUTANT_SEASONAL_ABOVE,
           zero_missing_except=tuple(S.ZERO_IS_MISSING_EXCEPT), clip_lower=0.0,
           final_fill=True, limit=S.FORWARD_FILL_LIMIT, bucket_rows=FR.DEFAULT_BUCKET_ROWS,
           block="month"):
    """Fill missing values of ``cols`` per series.

    Zero counts as missing except for ``zero_missing_except`` (Q1). With
    ``method='auto'`` (I7) a column whose missing rate — measured *before*
    zeros become missing (Q4) — exceeds ``seasonal_above`` % uses seasonal
    means, otherwise time interpolation. Every method ends with the unlimited
    forward then backward fill (Q3) and the clip at ``clip_lower`` (Q2).
    """
    keys = list(keys)
    cols = [c for c in cols if c in df.columns]
    d = df
    if method == "auto":
        rates = ST.missing_rates(d, cols, keys)
        d = ST.attach(d, rates, keys)
    d = d.withColumns({c: zero_to_missing(c) for c in cols if c not in zero_missing_except})
    fill_method = method
    seasonal = method in ("auto", "seasonal")
    s_cols = [f"_seas_{c}" for c in cols]
    if seasonal:
        d = ST.with_seasonal_fill(d, cols, keys, order[0], out_name="_seas_{c}")
    carry_cols = ([] if method == "seasonal" else cols) + (s_cols if seasonal else [])
    d = FR.with_row_index(d, keys, list(order), block)
    d = FR.with_carries(d, keys, carry_cols, time_col=order[0], bucket_rows=bucket_rows)
    dtype = dict(df.dtypes)[order[0]]
    d = d.withColumn("_t", (F.unix_date(F.col(order[0])) if dtype == "date"
                            else F.unix_micros(F.col(order[0]).cast("timestamp")) / F.lit(1e6))
                     .cast("double"))
    out = {}
    for c, s in zip(cols, s_cols):
        if method == "seasonal":
            v = WN.fill_exprs(s, "none", final_fill=final_fill)
        elif method == "auto":
            base = WN.fill_exprs(c, "interpolate", final_fill=final_fill)
            seas = WN.fill_exprs(s, "none", final_fill=final_fill)
            v = F.when(F.col(f"{c}_missing") > F.lit(seasonal_above), seas).otherwise(base)
        else:
            v = WN.fill_exprs(c, fill_method, limit=limit, final_fill=final_fill)
        out[c] = _clip_lower(v, clip_lower)
    d = d.withColumns(out)
    drop = ["_t", FR.IDX] + (s_cols if seasonal else []) + \
        ([f"{c}_missing" for c in cols] if method == "auto" else [])
    return FR.drop_carries(d, carry_cols).drop(*drop)


# ---------------------------------------------------------------------------
# quality report
# ---------------------------------------------------------------------------
NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")


def quality_report(df, cols=None, keys=(), factor=S.REPORT_IQR_FACTOR,
                   min_valid=S.MIN_VALID_FOR_STATS) -> DataFrame:
    """One row per (series, column): total rows, missing %, type, min, max,
    mean, std of the valid values, and the IQR outlier count (only with more
    than ``min_valid`` values)."""
    keys = list(keys)
    types = dict(df.dtypes)
    cols = [c for c in (cols or S.TARGETS) if c in df.columns]
    num = [c for c in cols if types[c] in NUMERIC]
    st = iqr_stats(df, num, keys)
    d = ST.attach(df, st, keys)
    aggs = [F.count(F.lit(1)).alias("_total")]
    for c in cols:
        aggs.append((F.avg(F.col(c).isNull().cast("double")) * 100).alias(f"_miss_{c}"))
    for c in num:
        aggs += [F.min(c).cast("double").alias(f"_min_{c}"), F.max(c).cast("double").alias(f"_max_{c}"),
                 F.avg(c).alias(f"_mean_{c}"), F.stddev_samp(c).alias(f"_std_{c}"),
                 F.count(c).alias(f"_cnt_{c}"),
                 F.sum(iqr_flag(c, factor).cast("long")).alias(f"_out_{c}")]
    wide = d.groupBy(*keys).agg(*aggs)
    rows = []
    for c in cols:
        isnum = c in num
        na = F.lit(None).cast("double")
        rows.append(F.struct(
            F.lit(c).alias("column"), F.col("_total").alias("total_rows"),
            F.col(f"_miss_{c}").alias("missing_rate"), F.lit(types[c]).alias("dtype"),
            (F.col(f"_min_{c}") if isnum else na).alias("min"),
            (F.col(f"_max_{c}") if isnum else na).alias("max"),
            (F.col(f"_mean_{c}") if isnum else na).alias("mean"),
            (F.col(f"_std_{c}") if isnum else na).alias("std"),
            (F.when(F.col(f"_cnt_{c}") > min_valid, F.col(f"_out_{c}")) if isnum
             else F.lit(None).cast("long")).alias("outliers")))
    return wide.select(*keys, F.inline(F.array(*rows)))

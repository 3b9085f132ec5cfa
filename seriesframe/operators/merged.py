"""Statistics that batches add to: counts of values instead of rows.

All statistics of the cleaning steps follow from one table: how often each
value of each column occurs on each day of the year. Counts of two batches add
up, so an update counts its own rows only and merges them into the stored
table; the stored rows are not read again. Fences, means and rates then come
from the merged counts and equal those over all rows:

* ``mask_statistics``: quartile fences and, from the values inside them, mean
  and standard deviation, as ``clean.mask_outliers`` takes them;
* ``missing_rates`` and ``seasonal_means`` of the masked values;
* ``mask_batch``: the rows of a batch masked by the statistics of everything.

The table has a row for each distinct (series, column, day of the year, value):
never more than there are values, and far fewer where values are rounded.
``add_batch`` keeps it as a versioned table, where a batch that is added again
for the same base version is an error instead of being counted twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe import schema as S
from seriesframe.functions.scalar import limit_expr
from seriesframe.operators import ranks as RK
from seriesframe.operators import stats as ST
from seriesframe.sources import versioned as V

STATISTICS = ["lo", "hi", "mean", "sd"]


def value_counts(df: DataFrame, cols=None, keys=(), limits=None, date_col: str = S.DATE) -> DataFrame:
    """``keys…, column, month, doy, value, n`` of the values inside the domain limits; others count as missing (null)."""
    cols = [c for c in (cols or S.POLLUTANTS) if c in df.columns]
    limits = S.POLLUTANT_LIMITS if limits is None else limits
    d = df.withColumns({c: limit_expr(c, limits) for c in cols if c in limits})
    values = d.select(*keys, F.month(date_col).alias("month"), F.dayofyear(date_col).alias("doy"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])))
    return values.groupBy(*keys, "column", "month", "doy", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """The counts of all rows behind ``counts``."""
    both = reduce(DataFrame.unionByName, counts)
    return both.groupBy(*[c for c in both.columns if c != "n"]).agg(F.sum("n").alias("n"))


def add_batch(batch: DataFrame, path: str, cols=None, keys=(), limits=None, base: int | None = None) -> int:
    """Merge the counts of ``batch`` into the versioned table at ``path``; returns the new version.

    ``base`` is the version that the batch comes after (0: none yet); where the
    table is at another one, it is a ``ConflictError`` and nothing is counted.
    """
    spark = batch.sparkSession
    newest = max(V.versions(spark, path), default=0)
    new = value_counts(batch, cols, keys, limits)
    if newest:
        new = merge_counts(V.read_version(spark, path, newest), new)
    return V.commit(new, path, newest if base is None else base)


def _masked(value: Column, lo: Column, hi: Column, mean=None, sd=None, z_threshold=None) -> Column:
    out = (value < lo) | (value > hi)
    kept = F.when(F.coalesce(out, F.lit(False)), F.lit(None)).otherwise(value)
    if z_threshold is None:
        return kept
    far = F.abs((kept - mean) / sd) > F.lit(z_threshold)
    return F.when(F.coalesce(F.when(sd != 0, far), F.lit(False)), F.lit(None)).otherwise(kept)


def mask_statistics(counts: DataFrame, cols=None, keys=(), iqr_factor=S.POLLUTANT_IQR_FACTOR,
                    min_valid=S.MIN_VALID_FOR_STATS) -> DataFrame:
    """``keys…, column, lo, hi, mean, sd``: fences over all values, mean and deviation over those inside.

    A series with no more than ``min_valid`` values at a stage has nulls there, which mask nothing.
    """
    keys, cols = list(keys), list(cols or S.POLLUTANTS)
    number = F.array_position(F.array(*map(F.lit, cols)), F.col("column")).cast("int") - 1
    known = counts.where(F.col("column").isin(cols))
    counted = known.groupBy(*keys, number.alias("_c"), F.col("value").alias("_v")).agg(
        F.sum(F.when(F.col("value").isNull(), 0).otherwise(F.col("n"))).alias("_w"))
    wide = RK.quantiles_of_counts(counted, cols, (0.25, 0.75), keys)
    quartiles = wide.select(*keys, F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.when(F.col(f"_n_{c}") > min_valid, F.col(f"_q_{c}")).alias("_q")) for c in cols])))
    spread = F.lit(float(iqr_factor)) * (F.col("_q")[1] - F.col("_q")[0])
    fences = quartiles.select(*keys, "column", (F.col("_q")[0] - spread).alias("lo"), (F.col("_q")[1] + spread).alias("hi"))
    series = [*keys, "column"]
    inside = RK.join_on(known, fences, series, how="left")
    inside = inside.withColumn("value", _masked(F.col("value"), F.col("lo"), F.col("hi"))).where("value IS NOT NULL")
    inside = inside.groupBy(*series, "value").agg(F.sum("n").alias("n"))
    means = inside.groupBy(*series).agg(F.sum("n").alias("_n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    off = F.col("value") - F.col("mean")
    spreads = RK.join_on(inside, means, series).groupBy(*series, "_n", "mean").agg(F.sum(off * off * F.col("n")).alias("_ss"))
    z = spreads.where(F.col("_n") > max(1, min_valid)).select(*series, "mean", F.sqrt(F.col("_ss") / (F.col("_n") - 1)).alias("sd"))
    return RK.join_on(fences, z, series, how="left").select(*series, *STATISTICS)


def masked_counts(counts: DataFrame, statistics: DataFrame, keys=(), z_threshold=S.POLLUTANT_Z_THRESHOLD) -> DataFrame:
    """``counts`` with the values that the statistics mask counted as missing."""
    joined = RK.join_on(counts, statistics, [*keys, "column"], how="left")
    return joined.withColumn("value", _masked(*[F.col(c) for c in ("value", *STATISTICS)], z_threshold)).select(*counts.columns)


def missing_rates(counts: DataFrame, cols=None, keys=()) -> DataFrame:
    """Percent missing per column (D4) from counts, one row per series."""
    own = lambda c, cond=True: F.sum(F.when((F.col("column") == c) & cond, F.col("n")))
    return counts.groupBy(*keys).agg(*[
        F.try_divide(F.coalesce(own(c, F.col("value").isNull()), F.lit(0)) * F.lit(100.0), own(c)).alias(f"{c}_missing")
        for c in (cols or S.POLLUTANTS)])


def seasonal_means(counts: DataFrame, cols=None, keys=(), zero_missing_except=tuple(S.ZERO_IS_MISSING_EXCEPT)):
    """Mean per (month, day of year) and per month (D10) from counts, zeros missing as in ``clean.impute``."""
    keys, cols = list(keys), list(cols or S.POLLUTANTS)
    valid = F.col("value").isNotNull() & ((F.col("value") != 0) | F.col("column").isin(list(zero_missing_except)))
    days = counts.withColumnsRenamed({"month": "_m", "doy": "_doy"})
    own = lambda c, v: F.sum(F.when(valid & (F.col("column") == c), v))
    mean = lambda c: F.try_divide(own(c, F.col("value") * F.col("n")), own(c, F.col("n")))
    by_day = days.groupBy(*keys, "_m", "_doy").agg(*[mean(c).alias(f"_sd_{c}") for c in cols])
    by_month = days.groupBy(*keys, "_m").agg(*[mean(c).alias(f"_sm_{c}") for c in cols])
    return by_day, by_month


def mask_batch(df: DataFrame, statistics: DataFrame, cols=None, keys=(), limits=None,
               z_threshold=S.POLLUTANT_Z_THRESHOLD) -> DataFrame:
    """Rows of a batch with their outliers masked (I3) by the statistics of all rows."""
    keys, cols = list(keys), [c for c in (cols or S.POLLUTANTS) if c in df.columns]
    limits = S.POLLUTANT_LIMITS if limits is None else limits
    wide = statistics.groupBy(*keys).agg(*[
        F.first(F.when(F.col("column") == c, F.struct(*STATISTICS)), ignorenulls=True).alias(f"_s_{c}") for c in cols])
    d = df.withColumns({c: limit_expr(c, limits) for c in cols if c in limits})
    d = RK.join_on(d, wide, keys, how="left") if keys else ST.attach(d, wide, keys)
    return d.withColumns({c: _masked(F.col(c), *[F.col(f"_s_{c}")[s] for s in STATISTICS], z_threshold) for c in cols}).select(*df.columns)

"""Pipelines composed from the operators.

Each returns one lazy DataFrame; the plan holds a few small statistics
aggregates attached back to the rows and shuffles only at the dedupe, the
daily mean, the bucketed windows and the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe import schema as S
from seriesframe.functions.scalar import np_round, to_numeric
from seriesframe.operators import clean as CL
from seriesframe.operators import relational as R
from seriesframe.operators import stats as ST
from seriesframe.session import materialize
from seriesframe.sources import readers as RD


def process_pollutants(new_raw: DataFrame, history: DataFrame | None = None, now="2100-01-01",
                       keys=(), seasonal_above=S.POLLUTANT_SEASONAL_ABOVE, digits=2,
                       persist: str = "checkpoint") -> DataFrame:
    """Clean and impute the pollutant history with a new batch.

    B1-B5 on the batch, B9 (newer than the stored days), B10 (not in the
    future), G1 (append), D9 (one row per day, new beats old), B7, I3
    (domain, IQR 3, z 4), I7 + I5 (seasonal above 30 % missing, else time
    interpolation, final fill, clip at 0), H7 (2 decimals).

    The deduplicated table and the masked table are each read by several
    statistics passes; ``persist`` materializes them once (see
    ``session.materialize``) instead of recomputing the upstream per pass.
    """
    keys = list(keys)
    new = RD.coerce_pollutants(new_raw, keys)
    if history is not None:
        hist = history.select(*keys, "Date", *[to_numeric(c).alias(c) if c in history.columns
                                                else F.lit(None).cast("double").alias(c)
                                                for c in S.POLLUTANTS])
        new = R.newer_than(new, hist, keys)
        new = R.not_future(new, now)
        both = R.append(hist.withColumn("_src", F.lit(0)), new.withColumn("_src", F.lit(1)))
    else:
        both = R.not_future(new, now).withColumn("_src", F.lit(1))
    both = both.where(F.col("Date").isNotNull())
    both = ST.dedupe_keep_last(both, keys + ["Date"], ["_src"] + S.POLLUTANTS).drop("_src")
    both = materialize(both, persist)
    masked = materialize(CL.mask_outliers(both, S.POLLUTANTS, keys), persist)
    filled = CL.impute(masked, S.POLLUTANTS, keys, method="auto", seasonal_above=seasonal_above)
    return filled.withColumns({c: np_round(c, digits) for c in S.POLLUTANTS})


def process_weather(rows: DataFrame, keys=(), seasonal_above=S.WEATHER_SEASONAL_ABOVE,
                    context: DataFrame | None = None, persist: str = "checkpoint",
                    after: DataFrame | None = None) -> DataFrame:
    """Clean sub-daily weather rows into an imputed daily table.

    B6, B4, B7, B8, B3, B5, I4 (domain or clamp, IQR 3 on the rows), D7
    (daily mean, 2 decimals), I7 + I5 (seasonal above 20 % missing, else
    time interpolation). ``context`` (optional daily history) takes part in
    the imputation statistics but is not emitted (quirk Q18). With ``after``
    only rows newer than that table's last day count, in every statistic too.
    """
    keys = list(keys)
    parsed = RD.coerce_weather_rows(rows, keys)
    if after is not None:
        parsed = R.newer_than(parsed, after, keys)
    parsed = materialize(parsed, persist)
    masked = CL.mask_weather_outliers(parsed, S.WEATHER, keys)
    daily = materialize(ST.daily_mean(masked, S.WEATHER, keys), persist)
    if context is not None:
        ctx = context.select(*keys, "Date", *S.WEATHER).withColumn("_ctx", F.lit(True))
        daily = R.newer_than(daily, ctx, keys).withColumn("_ctx", F.lit(False)).unionByName(ctx)
    out = CL.impute(daily, S.WEATHER, keys, method="auto", seasonal_above=seasonal_above)
    if context is not None:
        out = out.where(~F.col("_ctx")).drop("_ctx")
    return out


def update_dataset(final: DataFrame | None, weather_rows: DataFrame, pollutants_raw: DataFrame,
                   pollutant_history: DataFrame | None = None, now="2100-01-01", keys=(),
                   persist: str = "checkpoint"):
    """Incremental update of the final table (J3): weather rows newer than the
    final table (J2) and pollutants (J1) processed, pollutant days after the newest final day and before
    ``now`` kept, inner-joined with weather on the day, appended.

    Returns ``(final_table, cleaned_pollutants)``; stored days are never
    revised (Q20). An empty weather batch leaves the table unchanged (Q19).
    """
    keys = list(keys)
    weather = process_weather(weather_rows, keys, persist=persist, after=final)
    pol = process_pollutants(pollutants_raw, pollutant_history, now, keys, persist=persist)
    new = pol
    if final is not None:
        new = R.newer_than(new, final, keys)
    new = R.not_future(new, now)
    merged = R.join_on_date(new, weather, keys)
    cols = keys + ["Date"] + S.TARGETS
    merged = merged.select(*cols)
    out = merged if final is None else R.append(final.select(*cols), merged)
    return RD.drop_columns(out, ["Day of Year"]), pol


def chart_series(series: DataFrame, category: str, start, end) -> DataFrame:
    """Date and one metric in a date range, ordered."""
    R.require_columns(series, [category])
    d = series.select("Date", to_numeric(category).alias(category))
    return R.sort_by_date(R.select_metric(R.date_range(d, start, end), category))

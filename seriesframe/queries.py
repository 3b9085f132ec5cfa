"""Registered queries and their SQL twins (the DuckDB oracle).

Every query reads the driver tables of ``sf_dir`` in full. Double outputs are
quantized to multiples of 2^-20 on both sides (``scalar.quantize`` / ``oracle.rnd``)
so that engines with a different summation order compare equal.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesframe import schema as S
from seriesframe.functions import aqi as A
from seriesframe.functions.scalar import limit_expr, round_doubles
from seriesframe import oracle as O
from seriesframe.sources import testdata as TD

QUERIES: dict = {}
SQL: dict = {}


def register(name, sql=None):
    def deco(fn):
        def run(spark, sf_dir):
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def sql_round(select_sql: str, cols_double: list[str], other: list[str]) -> str:
    """Wrap SQL so that the listed double columns are rounded like ``round_doubles``."""
    parts = [f"{O.rnd(c)} AS {c}" for c in cols_double]
    parts += other
    return f"SELECT {', '.join(parts)} FROM ({select_sql}) q_"


def dlit(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


# ---------------------------------------------------------------------------
# SQL helpers for the AQI
# ---------------------------------------------------------------------------
def sub_index_sql(col: str, pollutant: str) -> str:
    whens = []
    for c_lo, c_hi, i_lo, i_hi in S.BREAKPOINTS[pollutant]:
        slope = (i_hi - i_lo) / (c_hi - c_lo)
        whens.append(f"WHEN {col} >= {dlit(c_lo)} AND {col} <= {dlit(c_hi)} "
                     f"THEN {dlit(slope)} * ({col} - {dlit(c_lo)}) + {dlit(i_lo)}")
    return "CASE " + " ".join(whens) + " END"


def aqi_sql_select(src: str, keep: list[str]) -> str:
    """SQL computing si_*, aqi, main_pollutant, category over ``src``."""
    si = ", ".join(f"{sub_index_sql(p, p)} AS si_{p}" for p in S.AQI_ORDER)
    names = [f"si_{p}" for p in S.AQI_ORDER]
    top = f"greatest({', '.join(names)})"
    main = "CASE " + " ".join(f"WHEN si_{p} = {top} THEN '{p}'" for p in S.AQI_ORDER) \
        + " ELSE 'unknown' END"
    aqi = f"CAST(coalesce(round_even({top}, 0), 0.0) AS INTEGER)"
    cat_parts = []
    for upper, name, _ in S.HEALTH_BANDS:
        if upper is None:
            cat_parts.append(f"ELSE '{name}' END")
        else:
            cat_parts.append(f"WHEN aqi <= {upper} THEN '{name}'")
    cat = "CASE " + " ".join(cat_parts)
    keep_s = ", ".join(keep)
    return f"""
SELECT *, {cat} AS category FROM (
  SELECT {keep_s}, {', '.join(names)}, {aqi} AS aqi, {main} AS main_pollutant FROM (
    SELECT {keep_s}, {si} FROM ({src}) s_
  ) t_
) u_
"""


def masked_pollutants_sql(src: str, keys: list[str]) -> str:
    parts = list(keys)
    for c in S.POLLUTANTS:
        lo, hi, _ = S.POLLUTANT_LIMITS[c]
        parts.append(f"CASE WHEN {c} >= {dlit(lo)} AND {c} <= {dlit(hi)} THEN {c} END AS {c}")
    return f"SELECT {', '.join(parts)} FROM ({src}) m_"


# ---------------------------------------------------------------------------
# Q: flagship — daily AQI with domain masking
# ---------------------------------------------------------------------------
def _masked(df, keys):
    return df.select(*keys, *[limit_expr(c, S.POLLUTANT_LIMITS).alias(c) for c in S.POLLUTANTS])


def aqi_daily_df(spark, sf_dir):
    daily = TD.pollutants(spark, sf_dir)
    return A.with_aqi(_masked(daily, ["Date"]))


_AQI_DOUBLES = S.POLLUTANTS + [f"si_{p}" for p in S.AQI_ORDER]
_AQI_OTHER = ["aqi", "main_pollutant", "category"]

register("aqi_daily", sql_round(
    aqi_sql_select(masked_pollutants_sql(TD.POLLUTANTS_SQL, ["Date"]), ["Date"] + S.POLLUTANTS),
    _AQI_DOUBLES, ["Date"] + _AQI_OTHER))(aqi_daily_df)


# ---------------------------------------------------------------------------
# window features
# ---------------------------------------------------------------------------
from seriesframe import oracle as O  # noqa: E402
from seriesframe.operators import windows as WN  # noqa: E402

_BASE = ["Date"] + S.TARGETS
_BASE_ST = ["station", "Date"] + S.TARGETS


def _feature_query(name, spark_fn, sql_exprs, station=False, extra_other=()):
    src_sql = TD.SERIES_STATION_SQL if station else TD.SERIES_SQL
    keys = ["station"] if station else []
    base = _BASE_ST if station else _BASE
    exprs = sql_exprs(keys, ["Date"])
    others = [c for c in base if c not in S.TARGETS] + list(extra_other)
    doubles = S.TARGETS + [n for n in exprs if n not in extra_other]
    register(name, O.wrap_round(O.select_with(src_sql, base, exprs), doubles, others))(spark_fn)


def _series(spark, sf_dir, station=False):
    return TD.series(spark, sf_dir, by_station=station)


_feature_query(
    "lag_features",
    lambda spark, d: WN.create_lag_features(_series(spark, d)),
    lambda k, o: O.lag_sql(S.TARGETS, S.LAG_STEPS, k, o))
_feature_query(
    "lag_features_station",
    lambda spark, d: WN.create_lag_features(_series(spark, d, True), keys=["station"]),
    lambda k, o: O.lag_sql(S.TARGETS, S.LAG_STEPS, k, o), station=True)
_feature_query(
    "rolling_features",
    lambda spark, d: WN.create_rolling_features(_series(spark, d)),
    lambda k, o: O.rolling_sql(S.TARGETS, S.ROLLING_WINDOWS, S.ROLLING_STATS, k, o))
_feature_query(
    "rolling_median",
    lambda spark, d: WN.create_rolling_features(_series(spark, d), stats=["median"]),
    lambda k, o: O.rolling_sql(S.TARGETS, S.ROLLING_WINDOWS, ["median"], k, o))
_feature_query(
    "trend_features",
    lambda spark, d: WN.create_trend_features(_series(spark, d)),
    lambda k, o: O.trend_sql(S.POLLUTANTS, S.TREND_WINDOWS, k, o))
_feature_query(
    "calendar_ratio_interaction",
    lambda spark, d: WN.create_interaction_features(WN.create_ratio_features(
        WN.create_seasonal_features(_series(spark, d)))),
    lambda k, o: {**O.seasonal_sql(), **O.ratio_sql(S.TARGETS), **O.interaction_sql(S.TARGETS)},
    extra_other=("dayofweek", "month"))
_feature_query(
    "all_features",
    lambda spark, d: WN.create_all_features(_series(spark, d)),
    lambda k, o: O.all_features_sql(S.TARGETS, k, o),
    extra_other=("dayofweek", "month"))
_feature_query(
    "all_features_station",
    lambda spark, d: WN.create_all_features(_series(spark, d, True), keys=["station"]),
    lambda k, o: O.all_features_sql(S.TARGETS, k, o), station=True,
    extra_other=("dayofweek", "month"))


def _simple_lags_sql():
    exprs = O.lag_sql(S.TARGETS, list(range(1, 13)), [], ["Date"], name="{c}_t-{k}", col_major=False)
    inner = O.select_with(
        f"SELECT *, row_number() OVER (ORDER BY Date) - 1 AS idx_, count(*) OVER () AS n_ "
        f"FROM ({TD.SERIES_SQL}) z_", _BASE + ["idx_", "n_"], exprs)
    trimmed = f"SELECT * EXCLUDE (idx_, n_) FROM ({inner}) t_ WHERE idx_ >= 12 AND idx_ < n_ - 1"
    return O.wrap_round(trimmed, S.TARGETS + list(exprs), ["Date"])


register("simple_lags", _simple_lags_sql())(
    lambda spark, d: WN.create_simple_lags(_series(spark, d)))


def _events(spark, d):
    return TD.table(spark, d, "events").select("event_id", "ts", "user_id", "value")


register("row_index_events", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_idx
FROM events""")(lambda spark, d: WN.row_index(
    _events(spark, d), keys=["user_id"], order=["ts", "event_id"], block=None).select(
        "event_id", "user_id", "row_idx"))


def _events_rolling(spark, d):
    ev = _events(spark, d)
    out = WN.create_rolling_features(ev, ["value"], windows=[30], stats=["mean", "min"],
                                     order=["ts", "event_id"], bucket_rows=500, block=None)
    out = WN.create_lag_features(out, ["value"], lag_steps=[30], order=["ts", "event_id"],
                                 bucket_rows=500, block=None)
    return out.select("event_id", "value", "value_rolling_mean_30", "value_rolling_min_30",
                      "value_lag_30")


register("events_blocked_window", O.wrap_round("""
SELECT event_id, value,
  avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS value_rolling_mean_30,
  min(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS value_rolling_min_30,
  lag(value, 30) OVER (ORDER BY ts, event_id) AS value_lag_30
FROM events""", ["value", "value_rolling_mean_30", "value_rolling_min_30", "value_lag_30"],
    ["event_id"]))(_events_rolling)

# readings at any time of the day, known for clicks only
_READINGS_SQL = "SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN value END AS value FROM events"


def _readings(spark, d):
    ev = TD.table(spark, d, "events")
    return ev.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "click", F.col("value")).alias("value"))


register("fill_events_time", O.wrap_round(
    O.fill_sql(_READINGS_SQL, ["value"], "interpolate", [], ["ts", "event_id"], ["event_id"], seconds=True),
    ["value"], ["event_id"]))(lambda spark, d: WN.fill(
        _readings(spark, d), ["value"], "interpolate", order=["ts", "event_id"], block=None).select("event_id", "value"))
register("fill_events_forward_user", O.wrap_round(
    O.fill_sql(_READINGS_SQL, ["value"], "forward_fill", ["user_id"], ["ts", "event_id"], ["event_id", "user_id"], seconds=True),
    ["value"], ["event_id", "user_id"]))(lambda spark, d: WN.fill(
        _readings(spark, d), ["value"], "forward_fill", keys=["user_id"], order=["ts", "event_id"], block=None).select(
            "event_id", "user_id", "value"))


# ---------------------------------------------------------------------------
# fills and interpolation (E6-E8) on a series with outages; so2 zeros = missing
# ---------------------------------------------------------------------------
from seriesframe.functions.scalar import zero_to_missing  # noqa: E402

_FILL_COLS = ["co", "no2", "so2"]


def _outages(spark, d):
    return TD.pollutants_with_outages(spark, d).withColumn("so2", zero_to_missing("so2"))


_OUTAGES_Z_SQL = (f"SELECT Date, co, no2, o3, pm10, pm25, CASE WHEN so2 = 0 THEN NULL ELSE so2 END AS so2 "
                  f"FROM ({TD.OUTAGES_SQL}) g_")


def _fill_query(name, method, final=False, limit=S.FORWARD_FILL_LIMIT):
    def fn(spark, d):
        return WN.fill(_outages(spark, d), _FILL_COLS, method, limit=limit, final_fill=final)
    sql = O.fill_sql(_OUTAGES_Z_SQL, _FILL_COLS, method, [], ["Date"],
                     ["Date", "o3", "pm10", "pm25"], limit=limit, final=final)
    register(name, O.wrap_round(sql, S.POLLUTANTS, ["Date"]))(fn)


_fill_query("fill_interpolate_time", "interpolate")
_fill_query("fill_interpolate_linear", "linear")
_fill_query("fill_forward_limit", "forward_fill")
_fill_query("fill_backward_limit", "backward_fill")
_fill_query("fill_interpolate_final", "interpolate", final=True)
_fill_query("fill_backward_then_final", "backward_fill", final=True)


# ---------------------------------------------------------------------------
# statistics and cleaning
# ---------------------------------------------------------------------------
from seriesframe.operators import clean as CL  # noqa: E402
from seriesframe.operators import stats as ST  # noqa: E402
from seriesframe.plans import pipelines as PL  # noqa: E402
from seriesframe.sources import readers as RD  # noqa: E402

_POL = ["Date"] + S.POLLUTANTS


def _q_names():
    return [f"{c}_q{p}" for c in S.POLLUTANTS for p in (25, 75)]


register("quantiles", O.wrap_round(
    "SELECT " + ", ".join(f"quantile_cont({c}, {p / 100}) AS {c}_q{p}" for c in S.POLLUTANTS
                          for p in (25, 75)) + f" FROM ({TD.OUTAGES_SQL}) a_",
    _q_names(), []))(lambda spark, d: ST.quantiles(TD.pollutants_with_outages(spark, d), S.POLLUTANTS))

register("quantiles_station", O.wrap_round(
    "SELECT station, " + ", ".join(f"quantile_cont({c}, {p / 100}) AS {c}_q{p}" for c in S.POLLUTANTS
                                   for p in (25, 75)) + f" FROM ({TD.POLLUTANTS_STATION_SQL}) a_ GROUP BY station",
    _q_names(), ["station"]))(
    lambda spark, d: ST.quantiles(TD.pollutants(spark, d, True), S.POLLUTANTS, keys=["station"]))

register("missing_rates", O.wrap_round(
    "SELECT " + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS {c}_missing"
                          for c in S.POLLUTANTS) + f" FROM ({TD.OUTAGES_SQL}) a_",
    [f"{c}_missing" for c in S.POLLUTANTS], []))(
    lambda spark, d: ST.missing_rates(TD.pollutants_with_outages(spark, d), S.POLLUTANTS))

register("mean_std", O.wrap_round(
    "SELECT " + ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in S.POLLUTANTS)
    + f" FROM ({TD.OUTAGES_SQL}) a_",
    [f"{c}_{s}" for c in S.POLLUTANTS for s in ("mean", "std")], []))(
    lambda spark, d: ST.mean_std(TD.pollutants_with_outages(spark, d), S.POLLUTANTS))

register("mask_outliers", O.wrap_round(
    O.mask_sql(TD.POLLUTANTS_SQL, _POL, S.POLLUTANTS, [], S.POLLUTANT_LIMITS, 3.0, 4.0),
    S.POLLUTANTS, ["Date"]))(lambda spark, d: CL.mask_outliers(TD.pollutants(spark, d)))

register("mask_outliers_station", O.wrap_round(
    O.mask_sql(TD.POLLUTANTS_STATION_SQL, ["station"] + _POL, S.POLLUTANTS, ["station"],
               S.POLLUTANT_LIMITS, 3.0, 4.0),
    S.POLLUTANTS, ["station", "Date"]))(
    lambda spark, d: CL.mask_outliers(TD.pollutants(spark, d, True), keys=["station"]))


def _iqr_detect(spark, d):
    out = CL.detect_outliers_iqr(TD.pollutants(spark, d), "pm25", factor=1.5)
    return CL.detect_outliers_zscore(out.withColumnRenamed("pm25_outlier", "pm25_iqr"), "pm25",
                                     threshold=3.0).withColumnRenamed("pm25_outlier", "pm25_z") \
        .select("Date", "pm25", "pm25_iqr", "pm25_z")


register("detect_outliers", O.wrap_round(f"""
SELECT Date, pm25, {O.iqr_flag_sql('pm25', 1.5)} AS pm25_iqr, {O.z_flag_sql('pm25', 3.0)} AS pm25_z
FROM ({TD.POLLUTANTS_SQL}) a_,
     (SELECT quantile_cont(pm25, 0.25) AS q1_pm25, quantile_cont(pm25, 0.75) AS q3_pm25,
             avg(pm25) AS mu_pm25, stddev_samp(pm25) AS sd_pm25 FROM ({TD.POLLUTANTS_SQL}) b_) s_
""", ["pm25"], ["Date", "pm25_iqr", "pm25_z"]))(_iqr_detect)


def _outlier_report_sql():
    stages = []
    src = TD.POLLUTANTS_SQL
    s1 = O.mask_sql(src, _POL, S.POLLUTANTS, [], S.POLLUTANT_LIMITS, None, None)
    s2 = O.mask_sql(src, _POL, S.POLLUTANTS, [], S.POLLUTANT_LIMITS, 3.0, None)
    s3 = O.mask_sql(src, _POL, S.POLLUTANTS, [], S.POLLUTANT_LIMITS, 3.0, 4.0)
    for c in S.POLLUTANTS:
        for m, a, b in (("domain", src, s1), ("iqr", s1, s2), ("zscore", s2, s3)):
            stages.append(f"SELECT '{c}' AS \"column\", '{m}' AS method, "
                          f"CAST((SELECT count({c}) FROM ({a}) x_) - (SELECT count({c}) FROM ({b}) y_) AS BIGINT) AS removed")
    return " UNION ALL ".join(stages)


register("outlier_report", _outlier_report_sql())(lambda spark, d: CL.outlier_report(TD.pollutants(spark, d)))


def _quality_sql(src, cols, keys=()):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS "column", count(*) AS total_rows,
  avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS missing_rate, 'double' AS dtype,
  min({c}) AS min, max({c}) AS max, avg({c}) AS mean, stddev_samp({c}) AS std,
  CASE WHEN count({c}) > 20 THEN CAST(sum(CASE WHEN {O.iqr_flag_sql(c, 1.5)} THEN 1 ELSE 0 END) AS BIGINT) END AS outliers
FROM ({src}) a_, (SELECT quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c} FROM ({src}) b_) s_""")
    return O.wrap_round(" UNION ALL ".join(parts), ["missing_rate", "min", "max", "mean", "std"],
                        ["column", "total_rows", "dtype", "outliers"])


register("quality_report", _quality_sql(TD.OUTAGES_SQL, S.POLLUTANTS))(
    lambda spark, d: CL.quality_report(TD.pollutants_with_outages(spark, d), S.POLLUTANTS))


def _impute_query(name, method, above, cols=("co", "no2", "so2")):
    cols = list(cols)

    def fn(spark, d):
        return CL.impute(TD.pollutants_with_outages(spark, d), cols, method=method,
                         seasonal_above=above)
    register(name, O.wrap_round(
        O.impute_sql(TD.OUTAGES_SQL, _POL, cols, [], ["Date"], method=method, seasonal_above=above),
        S.POLLUTANTS, ["Date"]))(fn)


_impute_query("impute_auto", "auto", S.POLLUTANT_SEASONAL_ABOVE)
_impute_query("impute_auto_weather_threshold", "auto", S.WEATHER_SEASONAL_ABOVE)
_impute_query("impute_seasonal", "seasonal", S.POLLUTANT_SEASONAL_ABOVE)
_impute_query("impute_forward_fill", "forward_fill", S.POLLUTANT_SEASONAL_ABOVE)
_impute_query("impute_backward_fill", "backward_fill", S.POLLUTANT_SEASONAL_ABOVE)


def _seasonal_means_df(spark, d):
    by_day, by_month = ST.seasonal_means(TD.pollutants_with_outages(spark, d), ["co", "no2"])
    return by_day.join(by_month, "_m").select(
        F.col("_m").alias("month"), F.col("_doy").alias("dayofyear"),
        F.col("_sd_co").alias("co_day_mean"), F.col("_sd_no2").alias("no2_day_mean"),
        F.col("_sm_co").alias("co_month_mean"), F.col("_sm_no2").alias("no2_month_mean"))


register("seasonal_means", O.wrap_round(f"""
SELECT d.month, d.dayofyear, d.co_day_mean, d.no2_day_mean, m.co_month_mean, m.no2_month_mean
FROM (SELECT month(Date) AS month, dayofyear(Date) AS dayofyear, avg(co) AS co_day_mean,
             avg(no2) AS no2_day_mean FROM ({TD.OUTAGES_SQL}) a_ GROUP BY 1, 2) d
JOIN (SELECT month(Date) AS month, avg(co) AS co_month_mean, avg(no2) AS no2_month_mean
      FROM ({TD.OUTAGES_SQL}) b_ GROUP BY 1) m ON d.month = m.month
""", ["co_day_mean", "no2_day_mean", "co_month_mean", "no2_month_mean"], ["month", "dayofyear"]))(
    _seasonal_means_df)


def _dedupe(spark, d):
    ev = TD.table(spark, d, "events").select(
        "user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type", "value")
    return ST.dedupe_keep_last(ev, ["user_id", "day"], ["ts", "event_id"])


register("dedupe_keep_last", O.wrap_round("""
SELECT user_id, day, ts, event_id, event_type, value FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn_
  FROM events) e_ WHERE rn_ = 1""", ["value"], ["user_id", "day", "ts", "event_id", "event_type"]))(_dedupe)


# ---------------------------------------------------------------------------
# ingest and pipelines
# ---------------------------------------------------------------------------
register("weather_rows_parsed", O.wrap_round(
    O.coerce_weather_rows_sql(TD.WEATHER_ROWS_SQL), S.WEATHER, ["Date"]))(
    lambda spark, d: RD.coerce_weather_rows(TD.weather_rows(spark, d)))

register("pollutants_raw_parsed", O.wrap_round(
    O.coerce_pollutants_sql(TD.POLLUTANTS_RAW_SQL), S.POLLUTANTS, ["Date"]))(
    lambda spark, d: RD.coerce_pollutants(TD.pollutants_raw(spark, d)))

_W = ["Date"] + S.WEATHER


def _weather_masked_sql(where="true"):
    parsed = f"SELECT * FROM ({O.coerce_weather_rows_sql(TD.WEATHER_ROWS_SQL)}) c_ WHERE {where}"
    return O.mask_sql(parsed, _W, S.WEATHER, [], S.WEATHER_LIMITS, 3.0, None)


register("weather_rows_masked", O.wrap_round(_weather_masked_sql(), S.WEATHER, ["Date"]))(
    lambda spark, d: CL.mask_weather_outliers(materialize(RD.coerce_weather_rows(TD.weather_rows(spark, d)))))


def _daily_mean_sql(where="true"):
    aggs = [f"{O.np_round_sql(f'avg({c})')} AS {c}" for c in S.WEATHER]
    return O.group_sql(_weather_masked_sql(where), ["Date"], aggs)


register("weather_daily_mean", O.wrap_round(_daily_mean_sql(), S.WEATHER, ["Date"]))(
    lambda spark, d: ST.daily_mean(CL.mask_weather_outliers(
        materialize(RD.coerce_weather_rows(TD.weather_rows(spark, d)))), S.WEATHER))

register("process_weather", O.wrap_round(
    O.impute_sql(_daily_mean_sql(), _W, S.WEATHER, [], ["Date"], method="auto",
                 seasonal_above=S.WEATHER_SEASONAL_ABOVE), S.WEATHER, ["Date"]))(
    lambda spark, d: PL.process_weather(TD.weather_rows(spark, d)))


def _process_pollutants_sql():
    parsed = O.coerce_pollutants_sql(TD.POLLUTANTS_RAW_SQL)
    kept = f"SELECT * FROM ({parsed}) k_ WHERE Date IS NOT NULL AND Date < DATE '2100-01-01'"
    masked = O.mask_sql(kept, _POL, S.POLLUTANTS, [], S.POLLUTANT_LIMITS, 3.0, 4.0)
    filled = O.impute_sql(masked, _POL, S.POLLUTANTS, [], ["Date"], method="auto",
                          seasonal_above=S.POLLUTANT_SEASONAL_ABOVE)
    rounded = O.replace_cols(filled, _POL, {c: O.np_round_sql(c) for c in S.POLLUTANTS})
    return O.wrap_round(rounded, S.POLLUTANTS, ["Date"])


register("process_pollutants", _process_pollutants_sql())(
    lambda spark, d: PL.process_pollutants(TD.pollutants_raw(spark, d), None, "2100-01-01"))


# ---------------------------------------------------------------------------
# splits, folds, metrics, scaling, sequences
# ---------------------------------------------------------------------------
from seriesframe.plans import learn as LN  # noqa: E402
from seriesframe.plans import prepare as PR  # noqa: E402
from seriesframe.plans import scaling as SC  # noqa: E402

_POS_SQL = (f"SELECT *, row_number() OVER (ORDER BY Date) - 1 AS pos_, count(*) OVER () AS n_ "
            f"FROM ({TD.SERIES_SQL}) s0_")

register("chrono_split", f"""
SELECT Date, CASE WHEN pos_ < n_ - CAST(floor(n_ * 0.2) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM ({_POS_SQL}) p_""")(lambda spark, d: LN.chrono_split(_series(spark, d)).select("Date", "split"))

register("chrono_split3", f"""
SELECT Date, CASE WHEN pos_ < CAST(floor(n_ * 0.6) AS BIGINT) THEN 'train'
                  WHEN pos_ < CAST(floor(n_ * 0.6) AS BIGINT) + CAST(floor(n_ * 0.2) AS BIGINT) THEN 'val'
                  ELSE 'test' END AS split
FROM ({_POS_SQL}) p_""")(lambda spark, d: LN.chrono_split3(_series(spark, d)).select("Date", "split"))


register("chrono_split_events", """
SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1
  < count(*) OVER (PARTITION BY user_id) - CAST(floor(count(*) OVER (PARTITION BY user_id) * 0.2) AS BIGINT)
  THEN 'train' ELSE 'test' END AS split FROM events""")(
    lambda spark, d: LN.chrono_split(_events(spark, d), keys=["user_id"], order=["ts", "event_id"], block=None).select(
        "event_id", "split"))


def _folds_df(spark, d):
    f = LN.time_series_folds(_series(spark, d), n_splits=5)
    return f.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("Date").alias("first_date"),
                                         F.max("Date").alias("last_date"))


register("time_series_folds", f"""
SELECT fold, role, count(*) AS rows, min(Date) AS first_date, max(Date) AS last_date FROM (
  SELECT p_.Date, f.fold,
         CASE WHEN pos_ < n_ - (5 - f.fold) * (n_ // 6) THEN 'train'
              WHEN pos_ < n_ - (5 - f.fold) * (n_ // 6) + (n_ // 6) THEN 'test' END AS role
  FROM ({_POS_SQL}) p_, (SELECT unnest(range(0, 5)) AS fold) f) x_
WHERE role IS NOT NULL GROUP BY fold, role""")(_folds_df)


def _with_naive(spark, d):
    s = _series(spark, d)
    lagged = WN.create_lag_features(s, S.TARGETS, lag_steps=[1])
    return lagged.withColumnsRenamed({f"{c}_lag_1": f"{c}_pred" for c in S.TARGETS})


def _naive_metrics(spark, d):
    test = LN.chrono_split(_with_naive(spark, d)).where(F.col("split") == "test")
    return LN.evaluate(test)


_NAIVE_SQL = (f"SELECT *, " + ", ".join(f"lag({c}, 1) OVER (ORDER BY Date) AS {c}_pred" for c in S.TARGETS)
              + f" FROM ({_POS_SQL}) p_")


def _long_sql(src, extra=""):
    return " UNION ALL ".join(f"SELECT {extra}'{c}' AS feature, {c} AS y, {c}_pred AS yhat FROM ({src}) l_"
                              for c in S.TARGETS)


def _metrics_sql(long_sql, keys=("feature",)):
    k = ", ".join(keys)
    return f"""
SELECT {k},
  CASE WHEN var_pop(y) * count(y) = 0 THEN CASE WHEN sum((y - yhat) * (y - yhat)) = 0 THEN 1.0 ELSE 0.0 END
       ELSE 1.0 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(y)) END AS r2,
  avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse
FROM ({long_sql}) m_ GROUP BY {k}"""


register("naive_forecast_metrics", O.wrap_round(_metrics_sql(_long_sql(
    f"SELECT * FROM ({_NAIVE_SQL}) t_ WHERE pos_ >= n_ - CAST(floor(n_ * 0.2) AS BIGINT)")),
    ["r2", "mae", "rmse"], ["feature"]))(_naive_metrics)


def _cv_naive(spark, d):
    f = LN.time_series_folds(_with_naive(spark, d), n_splits=5).where(F.col("role") == "test")
    per_fold, _ = ST.multi_rmse(LN.long_predictions(f, S.TARGETS, keys=["fold"]))
    return per_fold


_FOLD_TEST_SQL = f"""
SELECT p_.*, f.fold FROM ({_NAIVE_SQL}) p_, (SELECT unnest(range(0, 5)) AS fold) f
WHERE pos_ >= n_ - (5 - f.fold) * (n_ // 6) AND pos_ < n_ - (5 - f.fold) * (n_ // 6) + (n_ // 6)"""

register("cv_naive_rmse", O.wrap_round(f"""
SELECT fold, sqrt(avg(mse_)) AS rmse FROM (
  SELECT fold, feature, avg((y - yhat) * (y - yhat)) AS mse_ FROM ({_long_sql(_FOLD_TEST_SQL, 'fold, ')}) a_
  GROUP BY fold, feature) b_ GROUP BY fold""", ["rmse"], ["fold"]))(_cv_naive)


def _scaled(spark, d):
    s = _series(spark, d)
    return ST.minmax_transform(s, ST.minmax_fit(s, S.TARGETS), S.TARGETS)


_SCALED_SQL = ("SELECT Date, " + ", ".join(
    f"CASE WHEN max({c}) OVER () - min({c}) OVER () = 0 THEN 0.0 ELSE ({c} - min({c}) OVER ()) / "
    f"(max({c}) OVER () - min({c}) OVER ()) END AS {c}" for c in S.TARGETS) + f" FROM ({TD.SERIES_SQL}) s_")

register("minmax_scaled", O.wrap_round(_SCALED_SQL, S.TARGETS, ["Date"]))(_scaled)


def _scaled_on_train(spark, d, keys=()):
    split = LN.chrono_split3(_series(spark, d, bool(keys)), keys=keys).drop("_pos")
    return SC.SeriesScaler(inputCols=list(S.TARGETS), keys=list(keys)).fit(split).transform(split)


def _scaled_on_train_sql(keys=()):
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    src = TD.SERIES_STATION_SQL if keys else TD.SERIES_SQL
    train, val = (f"CAST(floor(n_ * {x}) AS BIGINT)" for x in (0.6, 0.2))
    split = (f"SELECT *, CASE WHEN pos_ < {train} THEN 'train' WHEN pos_ < {train} + {val} THEN 'val' ELSE 'test' END AS split "
             f"FROM (SELECT *, row_number() OVER ({part}ORDER BY Date) - 1 AS pos_, count(*) OVER ({part}) AS n_ FROM ({src}) s0_) p_")
    scaled = []
    for c in S.TARGETS:
        lo, hi = (f"{f}({c}) FILTER (WHERE split = 'train') OVER ({part})" for f in ("min", "max"))
        scaled.append(f"CASE WHEN {hi} - {lo} = 0 THEN 0.0 ELSE ({c} - {lo}) / ({hi} - {lo}) END AS {c}")
    own = [*keys, "Date", "split"]
    return O.wrap_round(f"SELECT {', '.join(own + scaled)} FROM ({split}) t_", S.TARGETS, own)


register("minmax_scaled_train", _scaled_on_train_sql())(_scaled_on_train)
register("minmax_scaled_train_station", _scaled_on_train_sql(["station"]))(
    lambda spark, d: _scaled_on_train(spark, d, ["station"]))

# ---------------------------------------------------------------------------
# targets of the next day (J5 with a horizon)
# ---------------------------------------------------------------------------
_NEXT = [f"{c}_next" for c in S.TARGETS]

register("next_day_targets_station", O.wrap_round(
    "SELECT a.*, " + ", ".join(f"b.{c} AS {c}_next" for c in S.TARGETS)
    + f" FROM ({TD.SERIES_STATION_SQL}) a LEFT JOIN ({TD.SERIES_STATION_SQL}) b"
      " ON a.station = b.station AND b.Date = a.Date + INTERVAL 1 DAY",
    S.TARGETS + _NEXT, ["station", "Date"]))(
    lambda spark, d: PR.later_targets(_series(spark, d, True), keys=["station"]))


def _prepared_sql():
    exprs = O.all_features_sql(S.TARGETS, [], ["Date"])
    feats = O.select_with(TD.SERIES_SQL, _BASE, exprs)
    cols = _BASE + list(exprs)
    later = ", ".join(f"n_.{c} AS {c}_next" for c in S.TARGETS)
    whole = " AND ".join([f"f_.{O.q(c)} IS NOT NULL" for c in cols] + [f"n_.{c} IS NOT NULL" for c in S.TARGETS])
    days = ["Date", "dayofweek", "month"]
    return O.wrap_round(f"SELECT f_.*, {later} FROM ({feats}) f_ JOIN ({TD.SERIES_SQL}) n_ "
                        f"ON n_.Date = f_.Date + INTERVAL 1 DAY WHERE {whole}",
                        [c for c in cols if c not in days] + _NEXT, days)


register("prepared_next_day", _prepared_sql())(
    lambda spark, d: PR.prepare_features(_series(spark, d), horizon=1).rows)


def _sequences_long(spark, d, L=14):
    seq = WN.create_sequences(_scaled(spark, d), S.TARGETS, seq_length=L)
    ex = seq.select("Date", F.posexplode("seq").alias("step", "row"))
    return ex.select("Date", "step", *[F.col("row")[i].alias(c) for i, c in enumerate(S.TARGETS)])


def _sequences_sql(L=14):
    base = f"SELECT *, row_number() OVER (ORDER BY Date) - 1 AS pos_ FROM ({_SCALED_SQL}) z_"
    parts = []
    for s in range(L):
        lags = ", ".join(f"lag({c}, {L - s}) OVER (ORDER BY Date) AS {c}" for c in S.TARGETS)
        parts.append(f"SELECT Date, {s} AS step, {', '.join(S.TARGETS)} FROM "
                     f"(SELECT Date, pos_, {lags} FROM ({base}) b_) c_ WHERE pos_ >= {L}")
    return " UNION ALL ".join(parts)


register("sequences", O.wrap_round(_sequences_sql(), S.TARGETS, ["Date", "step"]))(
    lambda spark, d: _sequences_long(spark, d).withColumn("step", F.col("step").cast("int")))


# ---------------------------------------------------------------------------
# relational operators
# ---------------------------------------------------------------------------
from seriesframe.operators import merged as MG  # noqa: E402
from seriesframe.operators import relational as RL  # noqa: E402

_CUTOFF = "1999-01-01"


def _append_new(spark, d):
    hist = TD.pollutants(spark, d).where(F.col("Date") < F.lit(_CUTOFF).cast("date"))
    new = RL.not_future(RL.newer_than(TD.weather(spark, d), hist), "2100-01-01")
    return RL.append(hist, new)


register("append_newer_than", O.wrap_round(f"""
SELECT Date, co, no2, o3, pm10, pm25, so2, NULL::DOUBLE AS Temp, NULL::DOUBLE AS Rain, NULL::DOUBLE AS Cloud,
       NULL::DOUBLE AS Pressure, NULL::DOUBLE AS Wind, NULL::DOUBLE AS Gust
FROM ({TD.POLLUTANTS_SQL}) h_ WHERE Date < DATE '{_CUTOFF}'
UNION ALL
SELECT Date, NULL, NULL, NULL, NULL, NULL, NULL, Temp, Rain, Cloud, Pressure, Wind, Gust
FROM ({TD.WEATHER_SQL}) w_
WHERE Date > (SELECT max(Date) FROM ({TD.POLLUTANTS_SQL}) x_ WHERE Date < DATE '{_CUTOFF}')
  AND Date < DATE '2100-01-01'""", S.TARGETS, ["Date"]))(_append_new)

register("join_on_date", O.wrap_round(TD.SERIES_SQL, S.TARGETS, ["Date"]))(
    lambda spark, d: RL.join_on_date(TD.pollutants(spark, d), TD.weather(spark, d)))

register("join_on_date_station", O.wrap_round(TD.SERIES_STATION_SQL, S.TARGETS, ["station", "Date"]))(
    lambda spark, d: RL.join_on_date(TD.pollutants(spark, d, True), TD.weather(spark, d, True),
                                     keys=["station"]))


def _dates_to_load(spark, d):
    hist = TD.pollutants(spark, d, True)
    return RL.dates_to_load(hist, "2002-03-01", keys=["station"])


register("dates_to_load", """
SELECT station, CAST(unnest(generate_series(hw + INTERVAL 1 DAY, DATE '2002-02-28', INTERVAL 1 DAY)) AS DATE) AS Date
FROM (SELECT s_nationkey AS station, max(CAST(l_shipdate AS DATE)) AS hw
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey) h_""")(_dates_to_load)


def _chart(spark, d):
    return PL.chart_series(_series(spark, d), "pm25", "1996-01-01", "1997-12-31")


register("chart_series", O.wrap_round(
    f"SELECT Date, pm25 FROM ({TD.SERIES_SQL}) s_ WHERE Date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'",
    ["pm25"], ["Date"]))(_chart)

register("latest_row_station", O.wrap_round(f"""
SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY Date DESC) AS rn_
FROM ({TD.SERIES_STATION_SQL}) s_) t_ WHERE rn_ = 1""", S.TARGETS, ["station", "Date"]))(
    lambda spark, d: RL.latest_row(_series(spark, d, True), keys=["station"]))


def _top_days(spark, d):
    a = aqi_daily_df(spark, d).select("Date", "aqi", "main_pollutant", "category",
                                      F.col("Date").cast("string").alias("day"))
    return RL.top_k(a, 20, "aqi", "day").drop("day")


register("top_aqi_days", f"""
SELECT Date, aqi, main_pollutant, category FROM ({aqi_sql_select(masked_pollutants_sql(TD.POLLUTANTS_SQL, ['Date']), ['Date'] + S.POLLUTANTS)}) a_
ORDER BY aqi DESC, CAST(Date AS VARCHAR) ASC LIMIT 20""")(_top_days)


def _units_report(spark, d):
    last = RL.latest_row(_series(spark, d))
    long = RL.unpivot_metrics(last, S.TARGETS, ["Date"])
    return RL.with_units(long, spark).withColumn("text", RL.format_value()) \
        .withColumn("day", F.date_format(F.date_add("Date", 1), "yyyy-MM-dd"))


def _units_sql():
    units = " UNION ALL ".join(
        "SELECT '{}' AS metric, {} AS unit".format(m, "'" + u.replace("\n", "' || chr(10) || '") + "'")
        for m, u in S.UNITS.items())
    last = f"SELECT * FROM ({TD.SERIES_SQL}) s_ ORDER BY Date DESC LIMIT 1"
    long = " UNION ALL ".join(f"SELECT Date, '{c}' AS metric, {c} AS value FROM ({last}) l_" for c in S.TARGETS)
    return O.wrap_round(f"""
SELECT l.Date, l.metric, l.value, u.unit, printf('%.3f', l.value) || ' ' || u.unit AS text,
       strftime(l.Date + INTERVAL 1 DAY, '%Y-%m-%d') AS day
FROM ({long}) l LEFT JOIN ({units}) u ON l.metric = u.metric""", ["value"], ["Date", "metric", "unit", "text", "day"])


register("units_report", _units_sql())(_units_report)


def _page_rows(spark, d):
    pages = TD.table(spark, d, "pages")
    rows = RD.rows_from_pages(pages)
    return rows.select("page_id", F.col("row_no").cast("int").alias("row_no"),
                       F.array_join("cells", "|").alias("cells"))


register("rows_from_pages", r"""
SELECT page_id, CAST(row_no AS INTEGER) AS row_no, array_to_string(cells, '|') AS cells FROM (
  SELECT page_id, generate_subscripts(items, 1) - 1 AS row_no, unnest(items) AS item,
         regexp_extract_all(unnest(items), '<a [^>]*>(.*?)</a>', 1) AS cells
  FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS items FROM pages) p_
) x_ WHERE len(cells) > 0""")(_page_rows)


# ---------------------------------------------------------------------------
# update of the final table (J3) and union of locations
# ---------------------------------------------------------------------------
def _update_first(spark, d):
    out, _ = PL.update_dataset(None, TD.weather_rows(spark, d), TD.pollutants_raw(spark, d))
    return out


def _process_weather_sql(where="true"):
    return O.impute_sql(_daily_mean_sql(where), _W, S.WEATHER, [], ["Date"], method="auto",
                        seasonal_above=S.WEATHER_SEASONAL_ABOVE)


def _process_pollutants_plain_sql(history=None):
    """Twin of ``process_pollutants``; ``history`` is SQL for stored days, which newer rows follow."""
    parsed = O.coerce_pollutants_sql(TD.POLLUTANTS_RAW_SQL)
    kept = f"SELECT * FROM ({parsed}) k_ WHERE Date IS NOT NULL AND Date < DATE '2100-01-01'"
    if history:
        cols = ", ".join(_POL)
        kept = (f"SELECT {cols} FROM ({history}) h_ UNION ALL SELECT {cols} FROM ({kept}) n_ "
                f"WHERE Date > (SELECT max(Date) FROM ({history}) g_)")
    masked = O.mask_sql(kept, _POL, S.POLLUTANTS, [], S.POLLUTANT_LIMITS, 3.0, 4.0)
    filled = O.impute_sql(masked, _POL, S.POLLUTANTS, [], ["Date"], method="auto",
                          seasonal_above=S.POLLUTANT_SEASONAL_ABOVE)
    return O.replace_cols(filled, _POL, {c: O.np_round_sql(c) for c in S.POLLUTANTS})


def _update_sql(where="true"):
    return f"""
SELECT p.Date, p.co, p.no2, p.o3, p.pm10, p.pm25, p.so2, w.Temp, w.Rain, w.Cloud, w.Pressure, w.Wind, w.Gust
FROM ({_process_pollutants_plain_sql()}) p JOIN ({_process_weather_sql(where)}) w ON p.Date = w.Date"""


_POL_HISTORY_SQL = f"SELECT * FROM ({TD.POLLUTANTS_SQL}) p_ WHERE Date < DATE '{_CUTOFF}'"
_WEATHER_CONTEXT_SQL = f"SELECT * FROM ({TD.WEATHER_SQL}) w_ WHERE Date < DATE '{_CUTOFF}'"


def _before_cutoff(df):
    return df.where(F.col("Date") < F.lit(_CUTOFF).cast("date"))


register("process_pollutants_history", O.wrap_round(
    _process_pollutants_plain_sql(_POL_HISTORY_SQL), S.POLLUTANTS, ["Date"]))(
    lambda spark, d: PL.process_pollutants(TD.pollutants_raw(spark, d), _before_cutoff(TD.pollutants(spark, d))))


def _merged_counts(spark, d, source):
    """Counts of the days before the cutoff and of those from it on, counted apart and merged."""
    rows = source(spark, d)
    old, new = _before_cutoff(rows), rows.where(F.col("Date") >= F.lit(_CUTOFF).cast("date"))
    return MG.merge_counts(*[materialize(MG.value_counts(part)) for part in (old, new)]), new


def _mask_batch_merged(spark, d):
    counts, new = _merged_counts(spark, d, TD.pollutants)
    return MG.mask_batch(new, MG.mask_statistics(counts))


def _masked_merged(spark, d):
    counts, _ = _merged_counts(spark, d, TD.pollutants_with_outages)
    return MG.masked_counts(counts, MG.mask_statistics(counts))


def _seasonal_merged(spark, d):
    by_day, by_month = MG.seasonal_means(_masked_merged(spark, d), ["co", "no2"])
    return by_day.join(by_month, "_m").withColumnsRenamed({"_m": "month", "_doy": "dayofyear"})


_MASKED_POL_SQL = O.mask_sql(TD.POLLUTANTS_SQL, _POL, S.POLLUTANTS, [], S.POLLUTANT_LIMITS, 3.0, 4.0)
_MASKED_OUTAGES_SQL = O.mask_sql(TD.OUTAGES_SQL, _POL, S.POLLUTANTS, [], S.POLLUTANT_LIMITS, 3.0, 4.0)
register("mask_batch_merged", O.wrap_round(
    f"SELECT * FROM ({_MASKED_POL_SQL}) b_ WHERE Date >= DATE '{_CUTOFF}'", S.POLLUTANTS, ["Date"]))(_mask_batch_merged)
register("missing_rates_merged", O.wrap_round(
    "SELECT " + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS {c}_missing" for c in S.POLLUTANTS)
    + f" FROM ({_MASKED_OUTAGES_SQL}) a_", [f"{c}_missing" for c in S.POLLUTANTS], []))(
    lambda spark, d: MG.missing_rates(_masked_merged(spark, d)))
_SEASONAL_MERGED = [f"_s{k}_{c}" for k in "dm" for c in ("co", "no2")]
register("seasonal_means_merged", O.wrap_round(f"""
SELECT d.month, d.dayofyear, d._sd_co, d._sd_no2, m._sm_co, m._sm_no2
FROM (SELECT month(Date) AS month, dayofyear(Date) AS dayofyear, avg(nullif(co, 0)) AS _sd_co, avg(nullif(no2, 0)) AS _sd_no2
      FROM ({_MASKED_OUTAGES_SQL}) a_ GROUP BY 1, 2) d
JOIN (SELECT month(Date) AS month, avg(nullif(co, 0)) AS _sm_co, avg(nullif(no2, 0)) AS _sm_no2
      FROM ({_MASKED_OUTAGES_SQL}) b_ GROUP BY 1) m ON d.month = m.month""", _SEASONAL_MERGED, ["month", "dayofyear"]))(_seasonal_merged)


def _process_weather_context_sql():
    cols = ", ".join(_W)
    after = f"Date > (SELECT max(Date) FROM ({_WEATHER_CONTEXT_SQL}) m_)"
    both = (f"SELECT {cols} FROM ({_daily_mean_sql()}) d_ WHERE {after} "
            f"UNION ALL SELECT {cols} FROM ({_WEATHER_CONTEXT_SQL}) c_")
    filled = O.impute_sql(both, _W, S.WEATHER, [], ["Date"], method="auto", seasonal_above=S.WEATHER_SEASONAL_ABOVE)
    return f"SELECT * FROM ({filled}) f_ WHERE {after}"


register("process_weather_context", O.wrap_round(_process_weather_context_sql(), S.WEATHER, ["Date"]))(
    lambda spark, d: PL.process_weather(TD.weather_rows(spark, d), context=_before_cutoff(TD.weather(spark, d))))

_ADVICE_SQL = " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in S.HEALTH_ADVICE.items())
register("aqi_advice", f"""
SELECT Date, aqi, category, CASE category {_ADVICE_SQL} END AS advice FROM ({aqi_sql_select(
    masked_pollutants_sql(TD.POLLUTANTS_SQL, ['Date']), ['Date'] + S.POLLUTANTS)}) a_""")(
    lambda spark, d: A.with_advice(aqi_daily_df(spark, d).select("Date", "aqi", "category")))

register("update_dataset", O.wrap_round(_update_sql(), S.TARGETS, ["Date"]))(_update_first)


def _update_incremental(spark, d):
    final = RL.join_on_date(TD.pollutants(spark, d), TD.weather(spark, d)).where(
        F.col("Date") < F.lit(_CUTOFF).cast("date"))
    out, _ = PL.update_dataset(final, TD.weather_rows(spark, d), TD.pollutants_raw(spark, d))
    return out


_AFTER_FINAL = f"Date > (SELECT max(Date) FROM ({TD.SERIES_SQL}) g_ WHERE Date < DATE '{_CUTOFF}')"

register("update_dataset_incremental", O.wrap_round(f"""
SELECT * FROM ({TD.SERIES_SQL}) f_ WHERE Date < DATE '{_CUTOFF}'
UNION ALL
SELECT * FROM ({_update_sql(_AFTER_FINAL)}) u_
WHERE {_AFTER_FINAL} AND Date < DATE '2100-01-01'""", S.TARGETS, ["Date"]))(_update_incremental)


def _union_locations(spark, d):
    frames = {"north": TD.pollutants(spark, d), "south": TD.weather(spark, d), "east": None}
    data, status = RL.union_locations(frames, spark)
    counts = data.groupBy("station").agg(F.count(F.lit(1)).alias("rows"))
    return status.join(counts, "station", "left")


register("union_locations", f"""
SELECT s.station, s.success, c.rows FROM
  (SELECT 'north' AS station, true AS success UNION ALL SELECT 'south', true UNION ALL SELECT 'east', false) s
LEFT JOIN (SELECT 'north' AS station, count(*) AS rows FROM ({TD.POLLUTANTS_SQL}) a_
           UNION ALL SELECT 'south', count(*) FROM ({TD.WEATHER_SQL}) b_) c ON s.station = c.station""")(
    _union_locations)


# ---------------------------------------------------------------------------
# model fits (K4-K9, J6, J8): metric-level checks only, no SQL twin
# ---------------------------------------------------------------------------
from seriesframe.plans import forecast as FC  # noqa: E402
from seriesframe.session import materialize, wide_plans  # noqa: E402

def _features(spark, d):
    feats = materialize(RL.drop_incomplete(WN.create_all_features(_series(spark, d))))
    return feats, RL.split_xy(feats)


def _forest(spark, d):
    feats, names = _features(spark, d)
    split = materialize(LN.chrono_split(feats))
    return LN.train_forest(split.where(F.col("split") == "train"), names), split.where(F.col("split") == "test")


def _forest_metrics(spark, d):
    model, test = _forest(spark, d)
    return LN.evaluate(LN.predict(model, test))


def _forest_importance(spark, d):
    model, _ = _forest(spark, d)
    return RL.top_k(LN.feature_importance(model, spark), 20, "importance", "feature")


def _forest_report(spark, d):
    model, _ = _forest(spark, d)
    return FC.forecast_report(FC.forecast(model, _series(spark, d)), spark)


def _feature_selection(spark, d):
    feats, names = _features(spark, d)
    top = LN.select_features(LN.chrono_split(feats).where(F.col("split") == "train"), names)
    return spark.createDataFrame(list(enumerate(top)), "pos int, feature string")


def _search(spark, d):
    feats, names = _features(spark, d)
    idx = materialize(FR.with_row_index(feats, [], ["Date"], idx_col="_pos"))
    train = LN.chrono_split(feats).where(F.col("split") == "train")
    _, trials = LN.search_params(idx, LN.select_features(train, names))
    rows = [(t["trial"], t["score"], len(t["scores"]), t["pruned"], str(t["params"])) for t in trials]
    return spark.createDataFrame(rows, "trial int, cv_rmse double, folds int, pruned boolean, params string")


def _sequence_regression(spark, d):
    seq = WN.create_sequences(_scaled(spark, d), S.TARGETS, seq_length=14)
    split = LN.chrono_split3(seq)
    pred = LN.sequence_regression(split)
    return LN.evaluate(pred.where(F.col("split") == "test"))


from seriesframe.operators import frames as FR  # noqa: E402

def _wide(fn):
    """Model queries plan over the 330 feature columns (see ``session.wide_plans``);
    their results are small and written inside."""
    def run(spark, d):
        with wide_plans(spark):
            return materialize(fn(spark, d))
    run.__name__ = fn.__name__
    return run


register("forest_metrics")(_wide(_forest_metrics))
register("forest_importance_top20")(_wide(_forest_importance))
register("forest_forecast_report")(_wide(_forest_report))
register("feature_selection")(_wide(_feature_selection))
register("search_params")(_wide(_search))
register("sequence_regression_metrics")(_sequence_regression)


# ---------------------------------------------------------------------------
# per-row AQI over the whole lineitem table (scale variant of the flagship)
# ---------------------------------------------------------------------------
def _aqi_rows(spark, d):
    li = TD.table(spark, d, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("Date"),
                     (F.col("l_quantity") / 6).alias("co"),
                     (F.col("l_extendedprice") / 1400).alias("no2"),
                     (F.col("l_extendedprice") / 1500).alias("o3"),
                     (F.col("l_extendedprice") / 800).alias("pm10"),
                     (F.col("l_extendedprice") / 80).alias("pm25"),
                     (F.col("l_tax") * 1000).alias("so2"))
    out = A.with_aqi(_masked(rows, ["l_orderkey", "l_linenumber", "Date"]), keep_sub_indices=False)
    return out.select("l_orderkey", "l_linenumber", "Date", "aqi", "main_pollutant", "category")


_AQI_ROWS_SRC = """
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS Date, l_quantity / 6 AS co,
       l_extendedprice / 1400 AS no2, l_extendedprice / 1500 AS o3, l_extendedprice / 800 AS pm10,
       l_extendedprice / 80 AS pm25, l_tax * 1000 AS so2 FROM lineitem"""

register("aqi_rows", f"""
SELECT l_orderkey, l_linenumber, Date, aqi, main_pollutant, category FROM ({aqi_sql_select(
    masked_pollutants_sql(_AQI_ROWS_SRC, ['l_orderkey', 'l_linenumber', 'Date']),
    ['l_orderkey', 'l_linenumber', 'Date'] + S.POLLUTANTS)}) a_""")(_aqi_rows)

"""Window operators of the series: lags, rolling statistics, trends, fills,
interpolation, row index and fixed-length sequences (E1-E10).

Every operator takes ``keys`` (series columns, may be empty) and ``order``
(date first, tie-breakers after) and runs on the halo buckets of
:mod:`seriesframe.operators.frames`, so neither an unpartitioned series nor a
hot station lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesframe import schema as S
from seriesframe.operators import frames as FR


def _present(df: DataFrame, cols) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c in have]


# ---------------------------------------------------------------------------
# expression builders (take the bucket window ``w``)
# ---------------------------------------------------------------------------
def lag_exprs(cols, lag_steps, name="{c}_lag_{k}", col_major=True) -> dict:
    out = {}
    pairs = ([(c, k) for c in cols for k in lag_steps] if col_major
             else [(c, k) for k in lag_steps for c in cols])
    for c, k in pairs:
        out[name.format(c=c, k=k)] = (lambda w, c=c, k=k: F.lag(c, k).over(w))
    return out


def _median_of(arr: Column) -> Column:
    s = F.array_sort(arr)
    n = F.size(s)
    half = F.floor(n / 2).cast("int")
    odd = F.element_at(s, half + 1)
    even = (F.element_at(s, half) + F.element_at(s, half + 1)) / 2
    return F.when(n == 0, F.lit(None).cast("double")).when(n % 2 == 1, odd).otherwise(even)


def rolling_exprs(cols, windows, stats) -> dict:
    """``{c}_rolling_{stat}_{n}`` over the current and previous ``n-1`` rows.

    pandas ``min_periods=1`` semantics: NULLs are skipped, a frame without
    values gives NULL, a one-value standard deviation is NULL.
    """
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    out = {}
    for c in cols:
        for n in windows:
            for st in stats:
                name = f"{c}_rolling_{st}_{n}"
                if st == "median":
                    out[name] = (lambda w, c=c, n=n: _median_of(
                        F.collect_list(c).over(w.rowsBetween(-(n - 1), 0))))
                else:
                    out[name] = (lambda w, c=c, n=n, f=fns[st]: f(c).over(w.rowsBetween(-(n - 1), 0)))
    return out


def trend_exprs(cols, windows) -> dict:
    """slope, change rate (%) and difference against the value ``n`` rows back."""
    out = {}
    for c in cols:
        for n in windows:
            def lagged(w, c=c, n=n):
                return F.lag(c, n).over(w)
            out[f"{c}_slope_{n}"] = (lambda w, c=c, n=n, lg=lagged: (F.col(c) - lg(w)) / F.lit(float(n)))
            out[f"{c}_change_rate_{n}"] = (lambda w, c=c, lg=lagged: F.try_divide(
                F.col(c) - lg(w), lg(w) + F.lit(S.EPS)) * F.lit(100.0))
            out[f"{c}_diff_{n}"] = (lambda w, c=c, lg=lagged: F.col(c) - lg(w))
    return out


def seasonal_exprs() -> dict:
    """Day of week (Monday = 0) and month (H4)."""
    return {"dayofweek": F.weekday(S.DATE), "month": F.month(S.DATE)}


def ratio_exprs(df_cols) -> dict:
    have = set(df_cols)
    return {name: F.try_divide(F.col(a), F.col(b) + F.lit(S.EPS))
            for name, a, b in S.RATIOS if a in have and b in have}


def interaction_exprs(df_cols) -> dict:
    have = set(df_cols)
    out = {}
    for name, a, b, div in S.INTERACTIONS:
        if a in have and b in have:
            e = F.col(a) * F.col(b)
            out[name] = e / F.lit(div) if div else e
    return out


# ---------------------------------------------------------------------------
# public operators
# ---------------------------------------------------------------------------
def row_index(df, keys=(), order=(S.DATE,), block="month", name="row_idx"):
    """Position of the row in its series, 0-based."""
    return FR.with_row_index(df, list(keys), list(order), block, idx_col=name)


def create_lag_features(df, columns=None, lag_steps=S.LAG_STEPS, keys=(), order=(S.DATE,),
                        bucket_rows=FR.DEFAULT_BUCKET_ROWS, block="month"):
    """``{c}_lag_{k}`` by row position."""
    cols = _present(df, columns or S.TARGETS)
    return FR.bounded(df, list(keys), list(order), max(lag_steps), lag_exprs(cols, lag_steps),
                      bucket_rows, block)


def create_rolling_features(df, columns=None, windows=S.ROLLING_WINDOWS, stats=S.ROLLING_STATS,
                            keys=(), order=(S.DATE,), bucket_rows=FR.DEFAULT_BUCKET_ROWS,
                            block="month"):
    """``{c}_rolling_{stat}_{n}`` (E3, E4 with ``stats=['median']``)."""
    cols = _present(df, columns or S.TARGETS)
    return FR.bounded(df, list(keys), list(order), max(windows) - 1,
                      rolling_exprs(cols, windows, stats), bucket_rows, block)


def create_trend_features(df, columns=None, windows=S.TREND_WINDOWS, keys=(), order=(S.DATE,),
                          bucket_rows=FR.DEFAULT_BUCKET_ROWS, block="month"):
    """``{c}_{slope,change_rate,diff}_{n}`` (E5)."""
    cols = _present(df, columns or S.POLLUTANTS)
    return FR.bounded(df, list(keys), list(order), max(windows), trend_exprs(cols, windows),
                      bucket_rows, block)


def create_seasonal_features(df):
    return df.withColumns(seasonal_exprs())


def create_ratio_features(df):
    return df.withColumns(ratio_exprs(df.columns))


def create_interaction_features(df):
    return df.withColumns(interaction_exprs(df.columns))


def create_all_features(df, pollutant_cols=None, weather_cols=None, lag_steps=S.LAG_STEPS,
                        rolling_windows=S.ROLLING_WINDOWS, keys=(), order=(S.DATE,),
                        bucket_rows=FR.DEFAULT_BUCKET_ROWS, block="month"):
    """All 330 derived columns in one projection over one window spec.

    Column order follows the original builder: lags, rolling statistics,
    calendar fields, ratios, pollutant trends, interactions.
    """
    pol = _present(df, pollutant_cols or S.POLLUTANTS)
    wea = _present(df, weather_cols or S.WEATHER)
    allc = pol + wea
    exprs = {}
    exprs.update(lag_exprs(allc, lag_steps))
    exprs.update(rolling_exprs(allc, rolling_windows, S.ROLLING_STATS))
    exprs.update({k: (lambda w, e=e: e) for k, e in seasonal_exprs().items()})
    exprs.update({k: (lambda w, e=e: e) for k, e in ratio_exprs(df.columns).items()})
    exprs.update(trend_exprs(pol, S.TREND_WINDOWS))
    exprs.update({k: (lambda w, e=e: e) for k, e in interaction_exprs(df.columns).items()})
    halo = max(max(lag_steps), max(rolling_windows) - 1, max(S.TREND_WINDOWS))
    return FR.bounded(df, list(keys), list(order), halo, exprs, bucket_rows, block)


def create_simple_lags(df, targets=None, lag_steps=12, keys=(), order=(S.DATE,),
                       bucket_rows=FR.DEFAULT_BUCKET_ROWS, block="month"):
    """``{c}_t-{k}`` for k = 1..lag_steps, then drop the first ``lag_steps`` rows
    and the last row of each series (E2 + B20)."""
    tg = _present(df, targets or S.TARGETS)
    exprs = lag_exprs(tg, list(range(1, lag_steps + 1)), name="{c}_t-{k}", col_major=False)
    keys = list(keys)
    d = FR.with_row_index(df, keys, list(order), block)
    n = _series_count(d, keys)
    out = FR.bounded(d, keys, list(order), lag_steps, exprs, bucket_rows, block,
                     keep_idx=True, indexed=True)
    out = _attach_count(out, n, keys)
    out = out.where((F.col(FR.IDX) >= lag_steps) & (F.col(FR.IDX) < F.col("_n") - 1))
    return out.select(*keys, *list(exprs.keys()), *tg, *[c for c in order if c not in tg and c not in keys])


def _series_count(d_idx, keys):
    return d_idx.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def _attach_count(df, counts, keys):
    if keys:
        return df.join(counts, keys, "left")
    return df.withColumn("_n", counts.select("_n").scalar())


def create_sequences(df, cols=None, seq_length=14, keys=(), order=(S.DATE,),
                     bucket_rows=FR.DEFAULT_BUCKET_ROWS, block="month"):
    """Windows of ``seq_length`` rows and the following row as target.

    Output: keys, the target row's date, ``seq`` (array of ``seq_length`` rows,
    each an array of the columns) and ``target`` (array of the target row's
    columns).
    """
    cols = cols or S.TARGETS
    row = F.array(*[F.col(c) for c in cols])
    exprs = {"seq": (lambda w: F.collect_list(row).over(w.rowsBetween(-seq_length, -1))),
             "target": (lambda w: row)}
    out = FR.bounded(df, list(keys), list(order), seq_length, exprs, bucket_rows, block)
    return out.where(F.size("seq") == seq_length).select(*keys, order[0], "seq", "target")


# ---------------------------------------------------------------------------
# fills and interpolation
# ---------------------------------------------------------------------------
def fill_exprs(c: str, method: str, limit: int | None = S.FORWARD_FILL_LIMIT,
               final_fill: bool = True, idx_col: str = FR.IDX) -> Column:
    """Fill of column ``c`` from the carries ``_prev_c`` / ``_next_c``.

    ``method``: 'interpolate' (time), 'linear' (position), 'forward_fill',
    'backward_fill', 'none'. ``final_fill`` adds the unlimited forward then
    backward fill that ends every imputation (quirk Q3).
    """
    v, prev, nxt = F.col(c), F.col(f"_prev_{c}"), F.col(f"_next_{c}")
    idx = F.col(idx_col)
    if method == "interpolate":
        tp, tn, t = prev["t"], nxt["t"], F.col("_t")
        # values at the same time around the gap leave no slope: the earlier one holds
        step = F.when(tn == tp, prev["v"]).otherwise((nxt["v"] - prev["v"]) / (tn - tp) * (t - tp) + prev["v"])
        filled = F.when(v.isNull() & prev.isNotNull() & nxt.isNotNull(), step)
    elif method == "linear":
        ip, inx = prev["i"].cast("double"), nxt["i"].cast("double")
        step = (nxt["v"] - prev["v"]) / (inx - ip) * (idx.cast("double") - ip) + prev["v"]
        filled = F.when(v.isNull() & prev.isNotNull() & nxt.isNotNull(), step)
    elif method == "forward_fill":
        ok = prev.isNotNull() if limit is None else (idx - prev["i"] <= F.lit(limit))
        filled = F.when(ok, prev["v"])
    elif method == "backward_fill":
        ok = nxt.isNotNull() if limit is None else (nxt["i"] - idx <= F.lit(limit))
        filled = F.when(ok, nxt["v"])
    elif method == "none":
        filled = F.lit(None).cast("double")
    else:
        raise ValueError(f"unknown fill method {method!r}")
    parts = [v, filled]
    if final_fill:
        parts += [prev["v"], nxt["v"]]
    return F.coalesce(*parts)


def fill(df, cols, method="interpolate", keys=(), order=(S.DATE,), limit=S.FORWARD_FILL_LIMIT,
         final_fill=False, bucket_rows=FR.DEFAULT_BUCKET_ROWS, block="month", indexed=False):
    """Fill NULLs of ``cols`` within each series by one of the methods of
    :func:`fill_exprs` (E6 forward/backward fill with limit, E7 time
    interpolation, E8 position interpolation)."""
    keys = list(keys)
    d = df if indexed else FR.with_row_index(df, keys, list(order), block)
    d = FR.with_carries(d, keys, list(cols), time_col=order[0], bucket_rows=bucket_rows)
    if method == "interpolate":
        dtype = dict(df.dtypes)[order[0]]
        t = (F.unix_date(F.col(order[0])) if dtype == "date"
             else F.unix_micros(F.col(order[0]).cast("timestamp")) / F.lit(1e6)).cast("double")
        d = d.withColumn("_t", t)
    out = d.withColumns({c: fill_exprs(c, method, limit, final_fill) for c in cols})
    out = FR.drop_carries(out, cols).drop("_t")
    return out if indexed else out.drop(FR.IDX)


def forward_fill(df, cols, limit=S.FORWARD_FILL_LIMIT, **kw):
    return fill(df, cols, "forward_fill", limit=limit, **kw)


def backward_fill(df, cols, limit=S.FORWARD_FILL_LIMIT, **kw):
    return fill(df, cols, "backward_fill", limit=limit, **kw)


def interpolate_time(df, cols, **kw):
    return fill(df, cols, "interpolate", **kw)


def interpolate_linear(df, cols, **kw):
    return fill(df, cols, "linear", **kw)


def series_window(keys, order):
    """Plain window spec of a series (used only on small per-key tables)."""
    return Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)

"""SQL text generators for the DuckDB twins of the registered queries.

Independent formulations of the same semantics with plain SQL window
functions (no buckets, no carries), used only by ``oracle_sql``.
"""

from __future__ import annotations

from seriesframe import schema as S


def dlit(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def tdiv(num: str, den: str) -> str:
    """Spark ``try_divide``: NULL on a zero denominator."""
    return f"CASE WHEN ({den}) = 0 THEN NULL ELSE ({num}) / ({den}) END"


def win(keys, order, frame: str = "") -> str:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"({part}ORDER BY {', '.join(order)} {frame})"


def rnd(c: str) -> str:
    """Twin of ``scalar.quantize``: snap to the same binary grid, half-even."""
    x = f"CAST({c} AS DOUBLE)"
    step = f"pow(2.0, greatest(-20.0, floor(log2(abs({x}))) - 30.0))"
    return f"round_even({x} / {step}, 0) * {step} + 0.0"


def wrap_round(sql: str, doubles: list[str], others: list[str]) -> str:
    parts = [f"{rnd(q(c))} AS {q(c)}" for c in doubles] + [q(c) for c in others]
    return f"SELECT {', '.join(parts)} FROM ({sql}) r_"


def q(name: str) -> str:
    """Quote an identifier when needed (e.g. ``co_t-1``)."""
    reserved = {"column", "order", "group", "select", "from", "where", "table"}
    if not name.replace("_", "a").isalnum() or name.lower() in reserved:
        return f'"{name}"'
    return name


# ---------------------------------------------------------------------------
# feature expressions
# ---------------------------------------------------------------------------
def lag_sql(cols, steps, keys, order, name="{c}_lag_{k}", col_major=True) -> dict:
    pairs = ([(c, k) for c in cols for k in steps] if col_major
             else [(c, k) for k in steps for c in cols])
    return {name.format(c=c, k=k): f"lag({c}, {k}) OVER {win(keys, order)}" for c, k in pairs}


def rolling_sql(cols, windows, stats, keys, order) -> dict:
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median"}
    out = {}
    for c in cols:
        for n in windows:
            frame = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
            for st in stats:
                out[f"{c}_rolling_{st}_{n}"] = f"{fn[st]}({c}) OVER {win(keys, order, frame)}"
    return out


def trend_sql(cols, windows, keys, order) -> dict:
    out = {}
    for c in cols:
        for n in windows:
            lg = f"lag({c}, {n}) OVER {win(keys, order)}"
            out[f"{c}_slope_{n}"] = f"({c} - {lg}) / {dlit(n)}"
            out[f"{c}_change_rate_{n}"] = f"({tdiv(f'{c} - {lg}', f'{lg} + {dlit(S.EPS)}')}) * {dlit(100)}"
            out[f"{c}_diff_{n}"] = f"{c} - {lg}"
    return out


def seasonal_sql() -> dict:
    return {"dayofweek": "CAST(isodow(Date) - 1 AS INTEGER)", "month": "CAST(month(Date) AS INTEGER)"}


def ratio_sql(cols) -> dict:
    have = set(cols)
    return {name: tdiv(a, f"{b} + {dlit(S.EPS)}") for name, a, b in S.RATIOS if a in have and b in have}


def interaction_sql(cols) -> dict:
    have = set(cols)
    out = {}
    for name, a, b, div in S.INTERACTIONS:
        if a in have and b in have:
            out[name] = f"{a} * {b} / {dlit(div)}" if div else f"{a} * {b}"
    return out


def all_features_sql(base_cols, keys, order) -> dict:
    pol = [c for c in S.POLLUTANTS if c in base_cols]
    allc = pol + [c for c in S.WEATHER if c in base_cols]
    out = {}
    out.update(lag_sql(allc, S.LAG_STEPS, keys, order))
    out.update(rolling_sql(allc, S.ROLLING_WINDOWS, S.ROLLING_STATS, keys, order))
    out.update(seasonal_sql())
    out.update(ratio_sql(base_cols))
    out.update(trend_sql(pol, S.TREND_WINDOWS, keys, order))
    out.update(interaction_sql(base_cols))
    return out


def select_with(src: str, passthrough: list[str], exprs: dict) -> str:
    cols = [q(c) for c in passthrough] + [f"{e} AS {q(n)}" for n, e in exprs.items()]
    return f"SELECT {', '.join(cols)} FROM ({src}) s_"


# ---------------------------------------------------------------------------
# fills and interpolation
# ---------------------------------------------------------------------------
def fill_sql(src: str, cols, method: str, keys, order, passthrough, limit=S.FORWARD_FILL_LIMIT,
             final=False, seconds=False) -> str:
    """Plain-window twin of ``windows.fill``; ``seconds`` where the order starts with a timestamp."""
    wf = win(keys, order, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    wb = win(keys, order, "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")
    inner = [f"*", f"row_number() OVER {win(keys, order)} - 1 AS idx_",
             f"epoch_us({order[0]}) / 1000000.0::DOUBLE AS t_" if seconds else
             f"CAST(date_diff('day', DATE '1970-01-01', {order[0]}) AS DOUBLE) AS t_"]
    stage1 = f"SELECT {', '.join(inner)} FROM ({src}) a_"
    carry = ["*"]
    for c in cols:
        carry += [
            f"last_value({c} IGNORE NULLS) OVER {wf} AS pv_{c}",
            f"last_value(CASE WHEN {c} IS NOT NULL THEN idx_ END IGNORE NULLS) OVER {wf} AS pi_{c}",
            f"last_value(CASE WHEN {c} IS NOT NULL THEN t_ END IGNORE NULLS) OVER {wf} AS pt_{c}",
            f"first_value({c} IGNORE NULLS) OVER {wb} AS nv_{c}",
            f"first_value(CASE WHEN {c} IS NOT NULL THEN idx_ END IGNORE NULLS) OVER {wb} AS ni_{c}",
            f"first_value(CASE WHEN {c} IS NOT NULL THEN t_ END IGNORE NULLS) OVER {wb} AS nt_{c}",
        ]
    stage2 = f"SELECT {', '.join(carry)} FROM ({stage1}) b_"
    outs = []
    for c in cols:
        inside = f"{c} IS NULL AND pv_{c} IS NOT NULL AND nv_{c} IS NOT NULL"
        if method == "interpolate":
            filled = (f"CASE WHEN {inside} THEN CASE WHEN nt_{c} = pt_{c} THEN pv_{c} ELSE"
                      f" (nv_{c} - pv_{c}) / (nt_{c} - pt_{c}) * (t_ - pt_{c}) + pv_{c} END END")
        elif method == "linear":
            filled = (f"CASE WHEN {inside} THEN (nv_{c} - pv_{c}) / CAST(ni_{c} - pi_{c} AS DOUBLE)"
                      f" * CAST(idx_ - pi_{c} AS DOUBLE) + pv_{c} END")
        elif method == "forward_fill":
            filled = (f"pv_{c}" if limit is None
                      else f"CASE WHEN idx_ - pi_{c} <= {limit} THEN pv_{c} END")
        elif method == "backward_fill":
            filled = (f"nv_{c}" if limit is None
                      else f"CASE WHEN ni_{c} - idx_ <= {limit} THEN nv_{c} END")
        elif method == "none":
            filled = "CAST(NULL AS DOUBLE)"
        else:
            raise ValueError(method)
        parts = [c, filled] + ([f"pv_{c}", f"nv_{c}"] if final else [])
        outs.append(f"coalesce({', '.join(parts)}) AS {c}")
    return f"SELECT {', '.join([q(p) for p in passthrough] + outs)} FROM ({stage2}) c_"


# ---------------------------------------------------------------------------
# carries and fills as separate pieces (used by the imputation twins)
# ---------------------------------------------------------------------------
def carries_sql(src: str, cols, keys, order) -> str:
    """Add idx_, t_ and pv_/pi_/pt_/nv_/ni_/nt_ for each column."""
    wf = win(keys, order, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    wb = win(keys, order, "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")
    stage1 = (f"SELECT *, row_number() OVER {win(keys, order)} - 1 AS idx_, "
              f"CAST(date_diff('day', DATE '1970-01-01', {order[0]}) AS DOUBLE) AS t_ FROM ({src}) a_")
    carry = ["*"]
    for c in cols:
        carry += [
            f"last_value({c} IGNORE NULLS) OVER {wf} AS pv_{c}",
            f"last_value(CASE WHEN {c} IS NOT NULL THEN idx_ END IGNORE NULLS) OVER {wf} AS pi_{c}",
            f"last_value(CASE WHEN {c} IS NOT NULL THEN t_ END IGNORE NULLS) OVER {wf} AS pt_{c}",
            f"first_value({c} IGNORE NULLS) OVER {wb} AS nv_{c}",
            f"first_value(CASE WHEN {c} IS NOT NULL THEN idx_ END IGNORE NULLS) OVER {wb} AS ni_{c}",
            f"first_value(CASE WHEN {c} IS NOT NULL THEN t_ END IGNORE NULLS) OVER {wb} AS nt_{c}",
        ]
    return f"SELECT {', '.join(carry)} FROM ({stage1}) b_"


def fill_expr_sql(c: str, method: str, limit=S.FORWARD_FILL_LIMIT, final=False) -> str:
    inside = f"{c} IS NULL AND pv_{c} IS NOT NULL AND nv_{c} IS NOT NULL"
    if method == "interpolate":
        filled = (f"CASE WHEN {inside} THEN CASE WHEN nt_{c} = pt_{c} THEN pv_{c} ELSE"
                  f" (nv_{c} - pv_{c}) / (nt_{c} - pt_{c}) * (t_ - pt_{c}) + pv_{c} END END")
    elif method == "linear":
        filled = (f"CASE WHEN {inside} THEN (nv_{c} - pv_{c}) / CAST(ni_{c} - pi_{c} AS DOUBLE)"
                  f" * CAST(idx_ - pi_{c} AS DOUBLE) + pv_{c} END")
    elif method == "forward_fill":
        filled = f"pv_{c}" if limit is None else f"CASE WHEN idx_ - pi_{c} <= {limit} THEN pv_{c} END"
    elif method == "backward_fill":
        filled = f"nv_{c}" if limit is None else f"CASE WHEN ni_{c} - idx_ <= {limit} THEN nv_{c} END"
    elif method == "none":
        filled = "CAST(NULL AS DOUBLE)"
    else:
        raise ValueError(method)
    parts = [c, filled] + ([f"pv_{c}", f"nv_{c}"] if final else [])
    return f"coalesce({', '.join(parts)})"


# ---------------------------------------------------------------------------
# statistics joined back to rows
# ---------------------------------------------------------------------------
def join_stats(src: str, stats: str, keys) -> str:
    if keys:
        on = " AND ".join(f"x_.{k} = y_.{k}" for k in keys)
        return f"SELECT x_.*, y_.* EXCLUDE ({', '.join(keys)}) FROM ({src}) x_ LEFT JOIN ({stats}) y_ ON {on}"
    return f"SELECT x_.*, y_.* FROM ({src}) x_, ({stats}) y_"


def group_sql(src: str, keys, aggs: list[str]) -> str:
    k = ", ".join(keys)
    sel = ", ".join(([k] if keys else []) + aggs)
    return f"SELECT {sel} FROM ({src}) g_" + (f" GROUP BY {k}" if keys else "")


def limit_sql(c: str, limits: dict) -> str:
    lo, hi, mode = limits[c]
    if mode == "clamp":
        return f"CASE WHEN {c} < {dlit(lo)} THEN {dlit(lo)} WHEN {c} > {dlit(hi)} THEN {dlit(hi)} ELSE {c} END"
    return f"CASE WHEN {c} >= {dlit(lo)} AND {c} <= {dlit(hi)} THEN {c} END"


def replace_cols(src: str, all_cols, new: dict) -> str:
    parts = [f"{new[c]} AS {q(c)}" if c in new else q(c) for c in all_cols]
    return f"SELECT {', '.join(parts)} FROM ({src}) p_"


def iqr_flag_sql(c: str, f: float) -> str:
    lo = f"q1_{c} - {dlit(f)} * (q3_{c} - q1_{c})"
    hi = f"q3_{c} + {dlit(f)} * (q3_{c} - q1_{c})"
    return f"coalesce({c} < {lo} OR {c} > {hi}, false)"


def z_flag_sql(c: str, t: float) -> str:
    return (f"coalesce(CASE WHEN sd_{c} <> 0 THEN abs(({c} - mu_{c}) / sd_{c}) > {dlit(t)} END, false)")


def mask_sql(src: str, all_cols, cols, keys, limits, iqr_factor, z_threshold,
             min_valid=S.MIN_VALID_FOR_STATS) -> str:
    d = replace_cols(src, all_cols, {c: limit_sql(c, limits) for c in cols if c in limits})
    if iqr_factor is not None:
        aggs = []
        for c in cols:
            aggs += [f"count({c}) AS n_{c}", f"quantile_cont({c}, 0.25) AS q1_{c}",
                     f"quantile_cont({c}, 0.75) AS q3_{c}"]
        j = join_stats(d, group_sql(d, keys, aggs), keys)
        d = replace_cols(j, all_cols, {c: f"CASE WHEN n_{c} > {min_valid} AND {iqr_flag_sql(c, iqr_factor)}"
                                          f" THEN NULL ELSE {c} END" for c in cols})
    if z_threshold is not None:
        aggs = []
        for c in cols:
            aggs += [f"count({c}) AS n_{c}", f"avg({c}) AS mu_{c}", f"stddev_samp({c}) AS sd_{c}"]
        j = join_stats(d, group_sql(d, keys, aggs), keys)
        d = replace_cols(j, all_cols, {c: f"CASE WHEN n_{c} > {min_valid} AND {z_flag_sql(c, z_threshold)}"
                                          f" THEN NULL ELSE {c} END" for c in cols})
    return d


def seasonal_sql_join(src: str, cols, keys, date_col="Date", out="s_{c}") -> str:
    """Add coalesce(value, mean by (month, doy), mean by month) as ``out``."""
    base = f"SELECT *, month({date_col}) AS m_, dayofyear({date_col}) AS doy_ FROM ({src}) z_"
    kd = keys + ["m_", "doy_"]
    km = keys + ["m_"]
    by_day = group_sql(base, kd, [f"avg({c}) AS sd_{c}" for c in cols])
    by_month = group_sql(base, km, [f"avg({c}) AS sm_{c}" for c in cols])
    on_d = " AND ".join(f"b_.{k} = d_.{k}" for k in kd)
    on_m = " AND ".join(f"b_.{k} = mm_.{k}" for k in km)
    outs = ", ".join(f"coalesce(b_.{c}, d_.sd_{c}, mm_.sm_{c}) AS {out.format(c=c)}" for c in cols)
    return (f"SELECT b_.* EXCLUDE (m_, doy_), {outs} FROM ({base}) b_ "
            f"LEFT JOIN ({by_day}) d_ ON {on_d} LEFT JOIN ({by_month}) mm_ ON {on_m}")


def impute_sql(src: str, all_cols, cols, keys, order, method="auto",
               seasonal_above=S.POLLUTANT_SEASONAL_ABOVE, zero_except=("Rain",), clip=0.0,
               final=True, limit=S.FORWARD_FILL_LIMIT) -> str:
    d = src
    if method == "auto":
        rates = group_sql(d, keys, [f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS miss_{c}"
                                    for c in cols])
        d = join_stats(d, rates, keys)
    cur_cols = all_cols + ([f"miss_{c}" for c in cols] if method == "auto" else [])
    d = replace_cols(d, cur_cols, {c: f"CASE WHEN {c} = 0 THEN NULL ELSE {c} END"
                                   for c in cols if c not in zero_except})
    seasonal = method in ("auto", "seasonal")
    if seasonal:
        d = seasonal_sql_join(d, cols, keys, order[0])
    carry = ([] if method == "seasonal" else list(cols)) + ([f"s_{c}" for c in cols] if seasonal else [])
    d = carries_sql(d, carry, keys, order)
    outs = {}
    for c in cols:
        if method == "seasonal":
            v = fill_expr_sql(f"s_{c}", "none", final=final)
        elif method == "auto":
            v = (f"CASE WHEN miss_{c} > {dlit(seasonal_above)} THEN {fill_expr_sql(f's_{c}', 'none', final=final)}"
                 f" ELSE {fill_expr_sql(c, 'interpolate', final=final)} END")
        else:
            v = fill_expr_sql(c, method, limit=limit, final=final)
        outs[c] = v if clip is None else f"CASE WHEN ({v}) < {dlit(clip)} THEN {dlit(clip)} ELSE ({v}) END"
    return replace_cols(d, all_cols, outs)


# ---------------------------------------------------------------------------
# ingest twins
# ---------------------------------------------------------------------------
def num_sql(x: str) -> str:
    """Twin of ``scalar.to_numeric``: try_cast, NaN to NULL."""
    return f"CASE WHEN isnan(try_cast({x} AS DOUBLE)) THEN NULL ELSE try_cast({x} AS DOUBLE) END"


def blank_sql(x: str) -> str:
    return f"CASE WHEN {x} IN ('', ' ') THEN NULL ELSE {x} END"


def strip_units_sql(x: str, suffixes) -> str:
    e = f"CAST({x} AS VARCHAR)"
    for s in suffixes:
        lit_s = "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        e = f"replace({e}, {lit_s}, '')"
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def coerce_pollutants_sql(raw: str) -> str:
    from seriesframe.sources.testdata import RAW_HEADERS
    parts = [f"CAST(try_strptime({q(RAW_HEADERS['date'])}, '%Y/%m/%d') AS DATE) AS Date"]
    for c in S.POLLUTANTS:
        parts.append(f"{num_sql(blank_sql(q(RAW_HEADERS[c])))} AS {c}")
    return f"SELECT {', '.join(parts)} FROM ({raw}) w_"


def coerce_weather_rows_sql(rows: str) -> str:
    parts = ["CAST(try_strptime(Date, '%Y-%m-%d') AS DATE) AS Date"]
    for c, suffixes in S.UNIT_SUFFIXES.items():
        parts.append(f"{num_sql(strip_units_sql(c, suffixes))} AS {c}")
    return f"SELECT * FROM (SELECT {', '.join(parts)} FROM ({rows}) w_) v_ WHERE Date IS NOT NULL"


def np_round_sql(x: str, digits: int = 2) -> str:
    scale = float(10 ** digits)
    return f"round_even(({x}) * {scale!r}, 0) / {scale!r}"

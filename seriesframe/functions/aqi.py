"""Air-quality index expressions.

The sub-index is a ``CASE WHEN`` chain generated from the breakpoint table,
so the whole computation is a projection inside whole-stage codegen; no
join and no Python on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesframe import schema as S


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sub_index(col, breakpoints) -> Column:
    """First breakpoint row with ``C_lo <= C <= C_hi``; NULL outside and in gaps."""
    c = _c(col)
    expr = None
    for c_lo, c_hi, i_lo, i_hi in breakpoints:
        slope = (i_hi - i_lo) / (c_hi - c_lo)
        value = F.lit(float(slope)) * (c - F.lit(float(c_lo))) + F.lit(float(i_lo))
        cond = (c >= F.lit(float(c_lo))) & (c <= F.lit(float(c_hi)))
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr


def sub_indices(prefix: str = "si_", cols: dict | None = None) -> dict[str, Column]:
    """``{prefix+pollutant: sub_index}`` for the six pollutants."""
    cols = cols or {p: p for p in S.AQI_ORDER}
    return {f"{prefix}{p}": sub_index(cols[p], S.BREAKPOINTS[p]) for p in S.AQI_ORDER}


def aqi_columns(si: dict[str, Column] | None = None, prefix: str = "si_") -> dict[str, Column]:
    """AQI value (half-even rounded max of valid sub-indices) and main pollutant.

    No valid sub-index gives ``(0, 'unknown')``; on ties the first pollutant
    in ``AQI_ORDER`` wins.
    """
    names = [f"{prefix}{p}" for p in S.AQI_ORDER]
    cols = [F.col(n) for n in names] if si is None else [si[n] for n in names]
    top = F.greatest(*cols)
    main = None
    for p, c in zip(S.AQI_ORDER, cols):
        cond = c == top
        main = F.when(cond, F.lit(p)) if main is None else main.when(cond, F.lit(p))
    return {
        "aqi": F.coalesce(F.rint(top), F.lit(0.0)).cast("int"),
        "main_pollutant": main.otherwise(F.lit("unknown")),
    }


def health_category(aqi_col="aqi") -> Column:
    """Band name of an AQI value (H3)."""
    c = _c(aqi_col)
    expr = None
    for upper, name, _ in S.HEALTH_BANDS:
        if upper is None:
            return expr.otherwise(F.lit(name))
        cond = c <= F.lit(upper)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def with_aqi(df, prefix: str = "si_", keep_sub_indices: bool = True):
    """Add sub-indices, ``aqi``, ``main_pollutant`` and ``category`` in two projections."""
    si = sub_indices(prefix)
    staged = df.withColumns(si)
    res = aqi_columns(prefix=prefix)
    out = staged.withColumns(res).withColumn("category", health_category("aqi"))
    if not keep_sub_indices:
        out = out.drop(*si.keys())
    return out


def health_dimension(spark):
    """Six-row band table: upper bound, name, original label, advice."""
    rows = [(u, n, lbl, S.HEALTH_ADVICE[n]) for u, n, lbl in S.HEALTH_BANDS]
    return spark.createDataFrame(rows, "upper int, category string, label string, advice string")


def with_advice(df):
    """Add the health advice of each row's ``category`` (six rows, joined)."""
    bands = health_dimension(df.sparkSession).select("category", "advice")
    return df.join(F.broadcast(bands), "category", "left").select(*df.columns, "advice")


def breakpoint_table(spark):
    """The breakpoint table as a 40-row DataFrame (C3 table form)."""
    rows = []
    for p in S.AQI_ORDER:
        for ord_, (c_lo, c_hi, i_lo, i_hi) in enumerate(S.BREAKPOINTS[p]):
            rows.append((p, float(c_lo), float(c_hi), float(i_lo), float(i_hi), ord_))
    return spark.createDataFrame(
        rows, "pollutant string, c_lo double, c_hi double, i_lo double, i_hi double, ord int")

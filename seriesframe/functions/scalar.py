"""Scalar column expressions: casts, rounding, unit stripping, masks.

All helpers return ``Column`` objects built from ``pyspark.sql.functions`` so
they stay inside whole-stage codegen. Missing values are NULL only: every
numeric cast turns NaN into NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesframe import schema as S

DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "yyyy-M-d H:m:s", "yyyy/M/d H:m:s",
                "M/d/yyyy", "d/M/yyyy"]
#: Whole texts that are dates (with or without a time) and numbers; casts alone
#: also take texts with a date in front and numbers with a type letter.
ISO_DATE = (r"^\s*\d{4}(-\d{1,2}(-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?"
            r"\s*(Z|UTC|[+-]\d{2}:?\d{2})?)?)?)?\s*$")
#: All characters that Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$|^\s*[+-]?inf(inity)?\s*$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_numeric(col) -> Column:
    """Cast to double; unparsable text, NaN (no match of ``NUMBER``) and blanks become NULL.

    ``col`` is read twice: a costly text belongs in a column of its own first.
    """
    c = _c(col)
    return F.when(c.cast("string").rlike(NUMBER), c.try_cast("double"))


def blank_to_null(col) -> Column:
    """'' and ' ' become NULL (B2)."""
    c = _c(col)
    return F.when(~c.isin("", " "), c)


def to_date_safe(col) -> Column:
    """Parse a date from text or timestamp; bad values become NULL.

    The whole text must be a date; ``3/4/2024`` is the fourth of March, and the
    day comes first only where the month could not.
    """
    c = _c(col).cast("string")
    parsed = [F.try_to_timestamp(c, F.lit(fmt)) for fmt in DATE_FORMATS]
    return F.coalesce(F.when(c.rlike(ISO_DATE), _c(col).try_cast("date")), *[p.cast("date") for p in parsed])


def np_round(col, digits: int = 2) -> Column:
    """NumPy rounding: half-even on ``x * 10^d`` (H7)."""
    scale = float(10 ** digits)
    return F.rint(_c(col) * F.lit(scale)) / F.lit(scale)


def strip_units(col, suffixes) -> Column:
    """Remove unit texts literally, one after another, then strip blanks."""
    c = _c(col).cast("string")
    for s in suffixes:
        c = F.replace(c, F.lit(s), F.lit(""))
    return F.btrim(c, F.lit(WHITE))


def mask_range(col, lo, hi) -> Column:
    """Values outside [lo, hi] become NULL."""
    c = _c(col)
    return F.when(~((c < F.lit(float(lo))) | (c > F.lit(float(hi)))) | c.isNull(), c)


def clamp(col, lo=None, hi=None) -> Column:
    """Clip into [lo, hi]; NULL stays NULL."""
    c = _c(col)
    if lo is not None:
        c = F.when(c < F.lit(float(lo)), F.lit(float(lo))).otherwise(c)
    if hi is not None:
        c = F.when(c > F.lit(float(hi)), F.lit(float(hi))).otherwise(c)
    return c


def zero_to_missing(col) -> Column:
    """Zero counts as missing (quirk Q1)."""
    return F.nullif(_c(col), F.lit(0.0))


def limit_expr(name: str, limits: dict) -> Column:
    """Domain rule of one column: mask or clamp according to the table."""
    lo, hi, mode = limits[name]
    if mode == "clamp":
        return clamp(name, lo, hi)
    return mask_range(name, lo, hi)


def safe_ratio(num, den, eps: float = S.EPS) -> Column:
    """``num / (den + eps)``; a zero denominator gives NULL instead of an error."""
    return F.try_divide(_c(num), _c(den) + F.lit(eps))


def quantize(col) -> Column:
    """Snap a double to a binary grid, half-even; -0.0 becomes 0.0.

    The grid step is ``2^max(-20, floor(log2|x|) - 30)``: absolute ~1e-6 for
    small values, 31 significant bits for large ones. A binary grid has no
    ties for values computed from decimal data, so two engines whose
    summation order differs in the last bits land on the same grid point
    (a decimal grid would split exact halves such as x.xxxxxx5).
    """
    c = _c(col)
    step = F.pow(F.lit(2.0), F.greatest(F.lit(-20.0), F.floor(F.log2(F.abs(c))) - F.lit(30.0)))
    return F.rint(c / step) * step + F.lit(0.0)


def _quantize_sql(name: str) -> str:
    c = f"`{name}`"
    step = f"pow(2.0D, greatest(-20.0D, CAST(floor(log2(abs({c}))) AS DOUBLE) - 30.0D))"
    return f"rint({c} / {step}) * {step} + 0.0D AS {c}"


def round_doubles(df):
    """Quantize every double column (outputs of registered queries).

    Same expression as :func:`quantize`, sent as one ``selectExpr`` so that a
    343-column result is parsed and analysed once on the JVM side.
    """
    exprs = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            exprs.append(_quantize_sql(f.name))
        else:
            exprs.append(f"`{f.name}`")
    return df.selectExpr(*exprs)

"""Sources: typed reads of the series tables and landed raw files (A1-A5),
and the ingest projections that coerce them (B1-B8).

All readers use explicit schemas (no inference pass over the data) and
return lazy DataFrames; filters on ``Date`` applied later are pushed into
the parquet scan.
"""

from __future__ import annotations


from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesframe import schema as S
from seriesframe.functions.scalar import blank_to_null, strip_units, to_date_safe, to_numeric


def _fmt(path: str) -> str:
    p = path.rstrip("/")
    if p.endswith(".csv"):
        return "csv"
    if p.endswith(".json"):
        return "json"
    return "parquet"


def read_series(spark: SparkSession, path: str, fmt: str | None = None,
                schema: T.StructType = S.SERIES_SCHEMA, keys=()) -> DataFrame:
    """Read the daily table; ``Date`` coerced, numeric columns cast (A1)."""
    fmt = fmt or _fmt(path)
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
        df = raw.select(*keys, to_date_safe("Date").alias("Date"),
                        *[to_numeric(c).alias(c) for c in raw.columns if c not in ("Date", *keys)])
    else:
        df = spark.read.format(fmt).load(path)
        if dict(df.dtypes).get("Date") != "date":
            df = df.withColumn("Date", to_date_safe("Date"))
    return df


def read_pollutants(spark: SparkSession, path: str) -> DataFrame:
    """Read a downloaded pollutant CSV: all text, padded headers (A2)."""
    return spark.read.option("header", True).csv(path)


def read_weather_rows(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Landed sub-daily weather rows as nine text columns (A3)."""
    fmt = fmt or _fmt(path)
    if fmt == "csv":
        return spark.read.option("header", True).schema(S.WEATHER_ROWS_SCHEMA).csv(path)
    return spark.read.format(fmt).load(path).select(
        *[F.col(c).cast("string") for c in S.WEATHER_ROW_COLUMNS])


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str | None = None):
    """Missing history becomes an empty typed table (A5)."""
    fmt = fmt or _fmt(path)
    try:
        return spark.read.format(fmt).schema(schema).load(path) if fmt != "csv" else \
            spark.read.option("header", True).schema(schema).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def rows_from_pages(pages: DataFrame, row_pattern: str = r"(?s)<li>(.*?)</li>",
                    cell_pattern: str = r"(?s)<a [^>]*>(.*?)</a>", skip: int = 0,
                    take: int | None = None, key: str = "page_id") -> DataFrame:
    """Rows of stored HTML pages (A4, re-aimed crawl): keep row elements
    ``skip+1 .. skip+take`` of each page (all by default), take their cells, and drop rows
    whose cells cannot be read. Output: ``key, row_no, cells``."""
    rows = F.regexp_extract_all(F.col("html"), F.lit(row_pattern), 1)
    kept = F.slice(rows, F.lit(skip + 1), F.size(rows) if take is None else F.lit(take))
    exploded = pages.select(key, F.posexplode(kept).alias("row_no", "row_html"))
    cells = F.regexp_extract_all(F.col("row_html"), F.lit(cell_pattern), 1)
    return exploded.select(key, "row_no", cells.alias("cells")).where(F.size("cells") > 0)


# ---------------------------------------------------------------------------
# ingest projections
# ---------------------------------------------------------------------------
def normalize_columns(df: DataFrame, renames: dict | None = None) -> DataFrame:
    """Strip blanks from header names and rename ``date`` to ``Date`` (B1)."""
    renames = {"date": "Date", **(renames or {})}
    names = [c.strip() for c in df.columns]
    names = [renames.get(n, n) for n in names]
    return df.toDF(*names)


def blank_to_null_all(df: DataFrame) -> DataFrame:
    """'' and ' ' become NULL in every text column (B2)."""
    return df.select(*[blank_to_null(c).alias(c) if t == "string" else F.col(c)
                       for c, t in df.dtypes])


def ensure_columns(df: DataFrame, cols, dtype: str = "double") -> DataFrame:
    """Add absent expected columns as missing."""
    missing = {c: F.lit(None).cast(dtype) for c in cols if c not in df.columns}
    return df.withColumns(missing) if missing else df


def drop_columns(df: DataFrame, cols=("Weather", "Day of Year")) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def coerce_pollutants(df: DataFrame, keys=()) -> DataFrame:
    """B1 + B2 + B4 + B3 + B5 on a raw pollutant table."""
    d = blank_to_null_all(normalize_columns(df))
    d = ensure_columns(d, S.POLLUTANTS, "string")
    return d.select(*keys, to_date_safe("Date").alias("Date"),
                    *[to_numeric(c).alias(c) for c in S.POLLUTANTS])


def coerce_weather_rows(df: DataFrame, keys=()) -> DataFrame:
    """B6 + B4 + B7 + B8 + B3 + B5 on landed weather rows."""
    d = drop_columns(df, ["Weather"])
    d = d.withColumn("Date", to_date_safe("Date")).where(F.col("Date").isNotNull())
    out = [*keys, "Date"]
    # texts without units are columns of their own, so that each is made once
    d = d.select(*out, *[strip_units(c, suffixes).alias(c) for c, suffixes in S.UNIT_SUFFIXES.items() if c in d.columns])
    cols = [to_numeric(c).alias(c) if c in d.columns else F.lit(None).cast("double").alias(c) for c in S.UNIT_SUFFIXES]
    return d.select(*out, *cols)

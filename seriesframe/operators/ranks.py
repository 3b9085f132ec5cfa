"""Positions and exact quantiles by range partitions.

A row's position in its series needs the rows before it counted, and a
quantile the values at two ranks; neither needs one task to hold a series.
Rows are dealt into ranges of (keys, order) from a sample, sorted inside each
partition and written to the shared folder, so that the ranges stay as they
are. Every partition is then counted; running sums over these counts, one row
for each series and partition, give each partition its offset.

* ``positions``: offset plus the place inside the partition.
* ``exact_quantiles``: equal values are counted first (combined before the
  shuffle) and the distinct values dealt; the two ranks of each quantile fall
  into known partitions, which alone are read again for running counts.

However the values or days are spread, a partition holds about its share of
the rows; rows that are equal in all order columns stay together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesframe.session import table

PART, PLACE = "_part", "_place"
#: Bound on the number of partitions, so on the rows of a series in the table of offsets.
MAX_PARTS = 1 << 20


def join_on(df: DataFrame, other: DataFrame, keys, on=None, how: str = "inner") -> DataFrame:
    """Join on keys that may be null (a null key equals itself); ``df`` keeps its key columns."""
    keys = list(keys)
    other = other.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    conds = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    if on is not None:
        conds.append(on(df, other))
    return df.join(other, reduce(lambda a, b: a & b, conds), how).drop(*[f"_on_{k}" for k in keys])


def place(df: DataFrame, keys, order, parts: int | None = None) -> DataFrame:
    """Rows dealt into sorted ranges of (keys, order), with their partition and place in it; a written table."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts > MAX_PARTS:
        raise ValueError(f"parts: at most {MAX_PARTS}")
    by = [*keys, *order]
    dealt = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    # the id is the partition's number above 33 bits and the row's place below
    written = table(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    return written.withColumns({PART: F.shiftright("_at", 33), PLACE: F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")


def offsets(placed: DataFrame, keys, weight: Column | None = None) -> DataFrame:
    """For each series and partition: ``_n`` rows (or weight), ``_off`` before it, ``_total`` of the series, ``_first`` place."""
    sums = placed.groupBy(*keys, PART).agg(
        F.sum(F.lit(1) if weight is None else weight).alias("_n"), F.min(PLACE).alias("_first"))
    series = Window.partitionBy(*keys, F.shiftright(PART, 20))
    before = F.sum("_n").over(series.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(*keys, PART, "_n", "_first", F.coalesce(before, F.lit(0)).alias("_off"),
                       F.sum("_n").over(series).alias("_total"))


def positions(df: DataFrame, keys, order, idx_col: str, total_col: str | None = None,
              parts: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in its series, and the series' row count as ``total_col``."""
    placed = place(df, keys, order, parts)
    off = offsets(placed, keys)
    d = join_on(placed, off, [*keys, PART])
    out = {idx_col: F.col("_off") + F.col(PLACE) - F.col("_first")}
    if total_col:
        out[total_col] = F.col("_total")
    return d.withColumns(out).select(*df.columns, *out)


def exact_quantiles(df: DataFrame, cols, probs, keys=(), parts: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles of each column by series.

    A row for each series: the keys, ``_n_<c>`` (values that are not null) and
    ``_q_<c>``, the array of quantiles in the order of ``probs`` (null without
    values). An empty table has no series, so no row.
    """
    keys, cols = list(keys), list(cols)
    values = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)])))
    counted = values.groupBy(*keys, "_c", "_v").agg(F.count("_v").alias("_w"))
    return quantiles_of_counts(counted, cols, probs, keys, parts)


def quantiles_of_counts(counted: DataFrame, cols, probs, keys=(), parts: int | None = None) -> DataFrame:
    """``exact_quantiles`` of counted values: ``keys…``, ``_c`` (place in ``cols``), ``_v`` and its count ``_w`` (0 for null)."""
    keys, cols, probs = list(keys), list(cols), [float(p) for p in probs]
    series = [*keys, "_c"]
    placed = place(counted, series, ["_v"], parts)
    off = offsets(placed, series, F.col("_w"))
    at = lambda p: F.lit(p) * (F.col("_total") - 1)
    ranks = F.array_distinct(F.array(*[f(at(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]))
    wanted = off.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_off")) & (r < F.col("_off") + F.col("_n"))))
    rows = join_on(placed.select(*series, PART, "_v", "_w"),
                   wanted.where(F.size("_ranks") > 0).select(*series, PART, "_off", "_ranks"), [*series, PART])
    inside = Window.partitionBy(*series, PART).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.col("_off") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    found = rows.select(*series, "_v", F.explode(F.filter("_ranks", lambda r: (
        r >= F.col("_before")) & (r < F.col("_before") + F.col("_w")))).alias("_r"))
    # at most two ranks for each quantile
    by_rank = found.groupBy(*series).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))
    totals = off.groupBy(*series).agg(F.max("_total").alias("_total"))
    each = join_on(totals, by_rank, series, how="left")

    def quantile(p):
        pos = at(p)
        lo, hi = F.floor(pos).cast("long"), F.ceil(pos).cast("long")
        low, high = F.try_element_at("_at", lo), F.try_element_at("_at", hi)
        return F.when((lo == hi) | (low == high), low).otherwise((hi - pos) * low + (pos - lo) * high)

    each = each.withColumn("_q", F.when(F.col("_total") > 0, F.array(*[quantile(p) for p in probs])))
    own = lambda i, c: F.first(F.when(F.col("_c") == i, F.col(c)), ignorenulls=True)
    aggs = [a for i, c in enumerate(cols) for a in (F.coalesce(own(i, "_total"), F.lit(0)).alias(f"_n_{c}"), own(i, "_q").alias(f"_q_{c}"))]
    # columns are numbered from 0, so without keys the one group is a column's value, not a single partition
    return each.groupBy(*keys, F.shiftright("_c", 20).alias("_all")).agg(*aggs).drop("_all")

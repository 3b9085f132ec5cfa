"""Window frames that scale: row index, halo buckets and carries.

A plain ``Window.orderBy('Date')`` without partition keys moves every row
into one task, and ``partitionBy(station)`` puts a hot station (say a third
of all rows) into one task. All window operators of this package therefore
run on *buckets*: fixed-size runs of consecutive rows of one series.

1. ``with_row_index``: for a series with a declared grain (``block``, such as
   the months of a daily series) per (series, calendar block) row counts — a
   small aggregate — give each block its offset by a running sum over the
   block table; ``idx = offset + row_number() within the block``. The block
   table is joined back by key; Spark turns that join into a broadcast only
   while the table is under ``autoBroadcastJoinThreshold`` (size-checked) and
   into a shuffle join beyond it. Without a grain (``block=None``: any number
   of rows in a day) positions come from sampled ranges of (keys, order), see
   ``ranks``.
2. ``with_buckets``: ``bucket = idx div B``. For frames that look back at most
   ``H`` rows, the last ``H`` rows of a bucket are also copied into the next
   bucket (``_copy``); windows then run ``partitionBy(series, bucket)`` and
   the copies are dropped. Requires ``B >= H``. Cost: one extra row per
   ``B/H`` rows, one shuffle.
3. ``with_carries``: unbounded look-back / look-ahead (fills, interpolation)
   is a per-bucket summary (last / first non-null value with its position
   and time), a scan over the bucket table in two levels (runs of ``FAN``
   buckets, then the runs), joined back, and a within-bucket running max/min.
   No task sees more than one bucket, one run of buckets, or a series' runs,
   each of which stands for ``FAN`` times the bucket's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesframe.operators import ranks

IDX = "_idx"
BKT = "_bkt"
COPY = "_copy"
DEFAULT_BUCKET_ROWS = 2048
FAN = 4096


def _block_col(order_col: str, block: str) -> Column:
    return F.date_trunc(block, F.col(order_col))


def with_row_index(df: DataFrame, keys: list[str], order: list[str], block: str | None = "month",
                   idx_col: str = IDX, total_col: str | None = None) -> DataFrame:
    """Add the 0-based position of each row within its series (E9), distributed.

    ``order`` lists the sort columns; the first must be a date/timestamp and
    the rest break ties so the index is deterministic. ``block`` declares a
    calendar unit in which a series has few rows; None deals the rows into
    ranges instead (written once). ``total_col`` also adds the series' row count.
    """
    keys = list(keys)
    if block is None:
        return ranks.positions(df, keys, list(order), idx_col, total_col)
    blk = "_blkt"
    d = df.withColumn(blk, _block_col(order[0], block))
    counts = d.groupBy(*keys, blk).agg(F.count(F.lit(1)).alias("_n"))
    series = Window.partitionBy(*keys)
    before = F.sum("_n").over(series.orderBy(blk).rowsBetween(Window.unboundedPreceding, -1))
    total = [F.sum("_n").over(series).alias(total_col)] if total_col else []
    offsets = counts.select(*keys, F.col(blk).alias("_blko"), F.coalesce(before, F.lit(0)).alias("_off"), *total)
    w_rows = Window.partitionBy(*keys, blk).orderBy(*order)
    d = ranks.join_on(d, offsets, keys, lambda a, b: F.col(blk) == F.col("_blko"))
    return (d.withColumn(idx_col, F.col("_off") + F.row_number().over(w_rows) - 1)
             .drop(blk, "_blko", "_off"))


def with_buckets(df_idx: DataFrame, halo: int = 0, bucket_rows: int = DEFAULT_BUCKET_ROWS,
                 idx_col: str = IDX) -> DataFrame:
    """Assign fixed-size buckets; copy the last ``halo`` rows into the next bucket."""
    if bucket_rows < max(halo, 1):
        raise ValueError(f"bucket_rows ({bucket_rows}) must be >= halo ({halo})")
    b = F.floor(F.col(idx_col) / F.lit(bucket_rows)).cast("long")
    if halo <= 0:
        return df_idx.withColumn(BKT, b).withColumn(COPY, F.lit(False))
    tail = (F.col(idx_col) % F.lit(bucket_rows)) >= F.lit(bucket_rows - halo)
    own = F.struct(b.alias("b"), F.lit(False).alias("c"))
    nxt = F.struct((b + 1).alias("b"), F.lit(True).alias("c"))
    return (df_idx.withColumn("_bc", F.explode(F.when(tail, F.array(own, nxt)).otherwise(F.array(own))))
                  .withColumn(BKT, F.col("_bc.b")).withColumn(COPY, F.col("_bc.c"))
                  .drop("_bc"))


def bucket_window(keys: list[str], idx_col: str = IDX):
    return Window.partitionBy(*keys, BKT).orderBy(idx_col)


def bounded(df: DataFrame, keys: list[str], order: list[str], halo: int,
            columns: dict, bucket_rows: int = DEFAULT_BUCKET_ROWS, block: str = "month",
            keep_idx: bool = False, indexed: bool = False):
    """Evaluate row-bounded window expressions (look-back <= ``halo`` rows).

    ``columns`` maps output names to functions ``w -> Column`` where ``w`` is the
    bucket window (partitioned by series and bucket, ordered by position).
    All expressions share one window spec, so Catalyst plans one Sort and one
    Window node for all of them.
    """
    d = df if indexed else with_row_index(df, keys, order, block)
    d = with_buckets(d, halo, bucket_rows)
    w = bucket_window(keys)
    out = d.select("*", *[fn(w).alias(name) for name, fn in columns.items()])
    out = out.where(~F.col(COPY)).drop(BKT, COPY)
    return out if keep_idx else out.drop(IDX)


def _attach(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    return ranks.join_on(df, stats, keys, how="left")


def _scan(summary: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Carries into each bucket from the buckets before (``_cl_``) and after (``_cr_``) it.

    Both directions are running frames (an "unbounded following" frame is
    re-aggregated per row, quadratic in the partition size).
    """
    def running(table, part, pos, left, right):
        ahead = Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
        return table.select("*", *[F.max(f"_bl_{c}").over(ahead.orderBy(pos)).alias(left.format(c=c)) for c in cols],
                            *[F.min(f"_bf_{c}").over(ahead.orderBy(F.col(pos).desc())).alias(right.format(c=c)) for c in cols])

    runs = summary.withColumn("_run", F.floor(F.col(BKT) / FAN))
    tops = runs.groupBy(*keys, "_run").agg(*[F.max(f"_bl_{c}").alias(f"_bl_{c}") for c in cols],
                                           *[F.min(f"_bf_{c}").alias(f"_bf_{c}") for c in cols])
    # runs are numbered from 0, so one partition (a column, 0 for all) is a whole series
    tops = running(tops.withColumn("_all", F.shiftright("_run", 40)), [*keys, "_all"], "_run", "_tl_{c}", "_tr_{c}")
    tops = tops.select(*keys, "_run", *[f"_t{s}_{c}" for s in "lr" for c in cols])
    inner = running(runs, [*keys, "_run"], BKT, "_il_{c}", "_ir_{c}").drop(*[f"_b{s}_{c}" for s in "lf" for c in cols])
    both = ranks.join_on(inner, tops, [*keys, "_run"], how="left")
    return both.select(*keys, BKT, *[F.coalesce(f"_i{s}_{c}", f"_t{s}_{c}").alias(f"_c{s}_{c}") for s in "lr" for c in cols])


def with_carries(df_idx: DataFrame, keys: list[str], cols: list[str], time_col: str | None = None,
                 bucket_rows: int = DEFAULT_BUCKET_ROWS, idx_col: str = IDX) -> DataFrame:
    """Add ``_prev_<c>`` / ``_next_<c>``: nearest non-null (at or before / at or after).

    Each is a struct ``(i, v, t)`` of position, value and time (``t`` is the
    day number for dates, epoch seconds for timestamps). NULL when none exists.
    """
    d = with_buckets(df_idx, 0, bucket_rows, idx_col)
    t_expr = None
    if time_col is not None:
        dtype = dict(d.dtypes)[time_col]
        t_expr = (F.unix_date(F.col(time_col)) if dtype == "date"
                  else F.unix_micros(F.col(time_col).cast("timestamp")) / F.lit(1e6)).cast("double")

    def st(c):
        fields = [F.col(idx_col).alias("i"), F.col(c).alias("v")]
        if t_expr is not None:
            fields.append(t_expr.alias("t"))
        return F.when(F.col(c).isNotNull(), F.struct(*fields))

    structs = {f"_s_{c}": st(c) for c in cols}
    d = d.withColumns(structs)
    part = list(keys) + [BKT]
    summary = d.groupBy(*part).agg(
        *[F.max(f"_s_{c}").alias(f"_bl_{c}") for c in cols],
        *[F.min(f"_s_{c}").alias(f"_bf_{c}") for c in cols])
    d = _attach(d, _scan(summary, list(keys), cols), part)
    w_run = Window.partitionBy(*part).orderBy(idx_col).rowsBetween(Window.unboundedPreceding, 0)
    w_rest = Window.partitionBy(*part).orderBy(F.col(idx_col).desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    out = d.select(
        *[F.col(c) for c in df_idx.columns],
        *[F.coalesce(F.max(f"_s_{c}").over(w_run), F.col(f"_cl_{c}")).alias(f"_prev_{c}") for c in cols],
        *[F.coalesce(F.min(f"_s_{c}").over(w_rest), F.col(f"_cr_{c}")).alias(f"_next_{c}") for c in cols])
    return out


def drop_carries(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*[f"_prev_{c}" for c in cols], *[f"_next_{c}" for c in cols])

"""Quality rules and robust multivariate outliers per language and source.

Every text gives counts (words, characters, symbols, repeated lines and word
windows) and from them a vector of transformed shares. For each language and
source, a minimum-covariance-determinant estimate is found by concentration
steps: squared Mahalanobis distances, the closest ``KEEP`` share of the rows,
their mean and covariance, and again. Two starts are followed (mean and
covariance of all rows; medians and absolute deviations) and the one with the
smaller determinant is kept. A document is rejected by the base rules or by a
distance over ``CUTOFF``.

Everything is DataFrame expressions. Texts are read once; all else works on
narrow rows of numbers. A step is one aggregation by group and distance bin
with sums of coordinates and products (combined before the shuffle, so a hot
group is no more work than others), then a running count over the bins, whose
number is bounded. Estimates have one row for each group.

Groups of fewer than ``MIN_GROUP`` rows share an estimate with the other such
groups of their language, and those of small languages one for all. The ridge
``FLOORS`` keeps constant coordinates and tiny groups from giving zero widths.

Defined results: a null or empty text has no words and fails the base rules.
Null languages and sources are groups of their own. Repeated rows count as
often as they occur and are all returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesframe.llm.common import SPACE, WORD, free, read, shared, text_of

SYMBOLS = "#*$%&|<>"
#: Share of rows that a concentration step keeps, and the factor that makes
#: the kept rows' covariance that of all rows of a normal distribution in five
#: dimensions (fixed values of the chi-square distribution).
KEEP, CONSISTENT = 0.75, 1.41
#: 0.99999 quantile of the chi-square distribution with five degrees of freedom.
CUTOFF = 30.9
MIN_GROUP = 100
STEPS = 4
#: Coordinates with the least standard deviation that each may have.
FLOORS = {"x_length": 0.07, "x_symbols": 0.10, "x_repeats": 0.20, "x_upper": 0.08, "x_lines": 0.30}
DIMS = list(FLOORS)
GROUP = ["lang", "source"]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def statistics(docs: DataFrame, *more: Column) -> DataFrame:
    """Counts of every text, and the vector, with doc_id, lang, source and the columns ``more``."""
    base = docs.select("doc_id", "lang", "source", *more, text_of("text").alias("text"))
    carried = [c for c in base.columns if c != "text"]
    cut = base.withColumns({
        "words": F.filter(F.split("text", SPACE), lambda w: w != ""),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))})
    n = F.size("words")
    w = lambda i: F.get(F.col("words"), i)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(
        F.xxhash64(w(i), w(i + 1), w(i + 2)).alias("h"), i.alias("i")))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rest = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]+", "")).cast("long")
    counted = cut.select(
        *carried, n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        rest(SYMBOLS).alias("n_symbols"), rest(r"\p{Lu}").alias("n_upper"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.sort_array(windows).alias("ranked"))
    # equal windows are neighbours in the ranked array; their places, sorted, cover three words each
    h = lambda i: F.get(F.col("ranked"), i)["h"]
    found = F.filter(F.transform("ranked", lambda x, i: F.when((h(i - 1) == x["h"]) | (h(i + 1) == x["h"]), x["i"])), lambda i: i.isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(F.sort_array(found), start, lambda a, i: F.struct(
        (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))["n"]
    out = counted.withColumn("n_repeat_words", covered).drop("ranked")
    return out.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "x_length": F.log1p(_ratio(F.col("word_chars"), F.col("n_words"))),
        "x_symbols": F.sqrt(F.least(F.lit(9.0), _ratio(F.col("n_symbols"), F.col("n_words")))),
        "x_repeats": F.sqrt(_ratio(F.col("n_repeat_words"), F.col("n_words"))),
        "x_upper": F.sqrt(_ratio(F.col("n_upper"), F.col("word_chars"))),
        "x_lines": F.sqrt(_ratio(F.col("n_dup_lines"), F.col("n_lines")))})


def _pool(rows: DataFrame, min_group: int) -> DataFrame:
    """Each language and source with the group (lang, source, level) whose estimate it uses."""
    sizes = rows.groupBy(*GROUP).agg(F.count("*").alias("n"))
    small = F.col("n") < min_group
    by_lang = sizes.where(small).groupBy("lang").agg((F.sum("n") < min_group).alias("tiny")).withColumnRenamed("lang", "_lang")
    level = F.when(~small, 0).when(~F.col("tiny"), 1).otherwise(2)
    return (sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("level", level)
            .select(*GROUP, F.when(F.col("level") < 2, F.col("lang")).alias("g_lang"), F.when(F.col("level") == 0, F.col("source")).alias("g_source"), "level"))


KEY = ["g_lang", "g_source", "level"]


def _with(rows: DataFrame, table: DataFrame, keys) -> DataFrame:
    """Join on keys that may be null; the key columns of ``rows`` stay."""
    other = table.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(other, on).drop(*[f"_{k}" for k in keys])


def _moments() -> list[Column]:
    sums = [F.sum(d).alias(f"s_{d}") for d in DIMS]
    return [F.count("*").alias("n"), *sums, *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[:i + 1]]]


def _estimate(sums: DataFrame, keys, factor: float) -> DataFrame:
    """Means and the lower Cholesky factor of the ridged covariance, from sums."""
    mean = {d: F.col(f"s_{d}") / F.col("n") for d in DIMS}
    out = sums.select(*keys, "n", *[m.alias(f"m_{d}") for d, m in mean.items()], *[
        (F.greatest(F.col(f"s_{a}_{b}") / F.col("n") - mean[a] * mean[b], F.lit(0.0) if a == b else F.lit(-1e9)) * factor
         + (FLOORS[a] ** 2 if a == b else 0.0)).alias(f"c_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[:i + 1]])
    return _factor(out, keys)


def _factor(cov: DataFrame, keys) -> DataFrame:
    out = cov
    for i, a in enumerate(DIMS):
        for j, b in enumerate(DIMS[:i + 1]):
            left = reduce(lambda x, y: x - y, [F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}") for k in DIMS[:j]], F.col(f"c_{a}_{b}"))
            out = out.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(left, F.lit(1e-9))) if a == b else left / F.col(f"l_{b}_{b}"))
    logdet = reduce(lambda x, y: x + y, [F.ln(F.col(f"l_{d}_{d}")) for d in DIMS])
    return out.select(*keys, *[f"m_{d}" for d in DIMS], *[f"l_{a}_{b}" for i, a in enumerate(DIMS) for b in DIMS[:i + 1]], logdet.alias("logdet"))


def _distance(rows: DataFrame) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance by the estimate's columns; these are dropped."""
    out = rows
    for i, a in enumerate(DIMS):
        left = reduce(lambda x, y: x - y, [F.col(f"l_{a}_{b}") * F.col(f"z_{b}") for b in DIMS[:i]], F.col(a) - F.col(f"m_{a}"))
        out = out.withColumn(f"z_{a}", left / F.col(f"l_{a}_{a}"))
    out = out.withColumn("d2", reduce(lambda x, y: x + y, [F.col(f"z_{d}") * F.col(f"z_{d}") for d in DIMS]))
    return out.drop(*[c for c in out.columns if c[:2] in ("m_", "l_", "z_") or c == "logdet"])


def _quantile_bins(rows: DataFrame, keys, value: Column, share: float, aggs: list[Column]) -> DataFrame:
    """Sums by key over the bins of ``value`` up to the one that reaches ``share`` of the rows."""
    bins = rows.withColumn("bin", value).groupBy(*keys, "bin").agg(*aggs)
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bins.withColumns({"_before": before, "_all": F.sum("n").over(w)}).where(F.col("_before") < F.ceil(F.col("_all") * share))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and normalised absolute deviations by key, on a grid of an eighth of each floor."""
    long = rows.select(*KEY, F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.round(F.col(d) * 8 / FLOORS[d]).alias("v")) for d in DIMS])).alias("e"))
    long = long.select(*KEY, "e.dim", "e.v")
    count = [F.count("*").alias("n")]
    median = _quantile_bins(long, [*KEY, "dim"], F.col("v"), 0.5, count).groupBy(*KEY, "dim").agg(F.max("bin").alias("median"))
    away = _with(long, median, [*KEY, "dim"])
    spread = _quantile_bins(away, [*KEY, "dim"], F.abs(F.col("v") - F.col("median")), 0.5, count).groupBy(*KEY, "dim").agg(F.max("bin").alias("mad"))
    both = _with(median, spread, [*KEY, "dim"])
    pick = lambda d, c: F.max(F.when(F.col("dim") == d, F.col(c) * FLOORS[d] / 8))
    wide = both.groupBy(*KEY).agg(*[pick(d, "median").alias(f"m_{d}") for d in DIMS], *[pick(d, "mad").alias(f"mad_{d}") for d in DIMS])
    cov = wide.select(*KEY, F.lit("median").alias("start"), *[f"m_{d}" for d in DIMS], *[
        (F.pow(F.col(f"mad_{a}") * 1.4826, F.lit(2)) + FLOORS[a] ** 2 if a == b else F.lit(0.0)).alias(f"c_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[:i + 1]])
    return _factor(cov, [*KEY, "start"])


def estimate(stats: DataFrame, min_group: int = MIN_GROUP, steps: int = STEPS) -> DataFrame:
    """Means and covariance factors for each language and source of ``stats``."""
    usable = stats.where(~F.col("base_failed")).select(*GROUP, *DIMS)
    pool = shared(_pool(stats, min_group), "quality-pool")
    rows = shared(_with(usable, pool, GROUP).select(*KEY, *DIMS), "quality-rows")
    keys = [*KEY, "start"]
    plain = _estimate(rows.groupBy(*KEY).agg(*_moments()).withColumn("start", F.lit("mean")), keys, 1.0)
    current = shared(plain.unionByName(_start(rows)), "quality-estimate")
    log_bin = F.floor(F.log2(F.col("d2") + 1e-4) * 16)
    for _ in range(steps):
        near = _quantile_bins(_distance(_with(rows, current, KEY)), keys, log_bin, KEEP, _moments())
        sums = near.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in near.columns if c == "n" or c.startswith("s_")])
        current = shared(_estimate(sums, keys, CONSISTENT), "quality-estimate")
    best = current.groupBy(*KEY).agg(F.min_by(F.struct(*[c for c in current.columns if c not in keys]), F.struct(F.round("logdet", 9), "start")).alias("best"))
    return _with(pool, best.select(*KEY, "best.*"), KEY).drop(*KEY)


def judge(stats: DataFrame, cutoff: float = CUTOFF, **options) -> DataFrame:
    """Add ``distance`` and ``kept`` to rows of ``statistics`` (a table: it is read several times).

    ``distance`` is null where the base rules fail or no row of the pool passed them.
    """
    estimates = estimate(stats, **options).withColumnsRenamed({k: f"_{k}" for k in GROUP})
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    out = _distance(stats.join(estimates, on, "left").drop("_lang", "_source"))
    return out.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt("d2"))).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).drop("d2")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected documents, which are found by id and text."""
    stats = shared(statistics(docs, F.xxhash64(text_of("text")).alias("text_hash")), "quality-stats")
    own, text = free(docs, "_id"), free(docs, "_hash")
    bad = judge(stats, **options).where("NOT kept").select(F.col("doc_id").alias(own), F.col("text_hash").alias(text)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64(text_of("text")) == F.col(text)), "left_anti")


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark, sf_dir: str) -> DataFrame:
    stats = shared(statistics(read(spark, sf_dir, "documents")), "quality-stats")
    return judge(stats).select(*RESULT, "distance")

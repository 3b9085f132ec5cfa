"""Learning on tables (K1-K9): time-ordered splits, folds, metrics, scaling,
sequences, multi-target forests, feature selection, parameter search and
the sequence regression that stands in for the recurrent network.

Splits and folds are positions from the distributed row index (no collect);
the forests are those of ``forest``.
"""

from __future__ import annotations

import json
import random
import statistics
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe import schema as S
from seriesframe.operators import frames as FR
from seriesframe.operators import stats as ST
from seriesframe.plans import forest as FO
from seriesframe.session import table
from seriesframe.sources import readers as RD


# ---------------------------------------------------------------------------
# splits and folds (K1-K3)
# ---------------------------------------------------------------------------
def _indexed(df, keys, order, block):
    """Position of each row and row count of its series, from the same offsets."""
    return FR.with_row_index(df, list(keys), list(order), block, idx_col="_pos", total_col="_n")


def chrono_split(df, test=0.2, keys=(), order=(S.DATE,), block="month"):
    """Last ``int(test·n)`` rows of each series are ``test``, the rest ``train`` (K1)."""
    d = _indexed(df, keys, order, block)
    test_size = F.floor(F.col("_n") * F.lit(test)).cast("long")
    split = F.when(F.col("_pos") < F.col("_n") - test_size, F.lit("train")).otherwise(F.lit("test"))
    return d.withColumn("split", split).drop("_n")


def chrono_split3(df, train=0.6, val=0.2, keys=(), order=(S.DATE,), block="month"):
    """Train / validation / test by position: ``int(0.6n)``, ``int(0.2n)``, rest (K2)."""
    d = _indexed(df, keys, order, block)
    tr = F.floor(F.col("_n") * F.lit(train)).cast("long")
    va = F.floor(F.col("_n") * F.lit(val)).cast("long")
    split = (F.when(F.col("_pos") < tr, F.lit("train"))
             .when(F.col("_pos") < tr + va, F.lit("val")).otherwise(F.lit("test")))
    return d.withColumn("split", split).drop("_n")


def time_series_folds(df, n_splits=5, keys=(), order=(S.DATE,), block="month"):
    """Each row with the folds it belongs to: ``fold, role`` (train / test).

    The fold list is generated per row (no join): a row is in the training
    set of every later fold and in the test set of at most one.
    """
    d = _indexed(df, keys, order, block)
    t = F.floor(F.col("_n") / F.lit(n_splits + 1)).cast("long")
    x = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.col("_n") - (F.lit(n_splits) - F.col("fold")) * t
    role = (F.when(F.col("_pos") < start, F.lit("train"))
            .when(F.col("_pos") < start + t, F.lit("test")))
    return x.withColumn("role", role).where(F.col("role").isNotNull()).drop("_n")


# ---------------------------------------------------------------------------
# long form of predictions and metrics
# ---------------------------------------------------------------------------
def long_predictions(df, targets, pred_fmt="{c}_pred", keys=()):
    """``(keys…, feature, y, yhat)`` from wide target and prediction columns."""
    rows = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("y"),
                     F.col(pred_fmt.format(c=c)).cast("double").alias("yhat")) for c in targets]
    return df.select(*keys, F.inline(F.array(*rows)))


def evaluate(pred_df, targets=S.TARGETS, pred_fmt="{c}_pred"):
    """R², MAE, RMSE per target (K7)."""
    return ST.regression_metrics(long_predictions(pred_df, targets, pred_fmt))


# ---------------------------------------------------------------------------
# forests (K4-K6, K8)
# ---------------------------------------------------------------------------
DEFAULT_FOREST = FO.DEFAULTS


def train_forest(train_df, features, targets=S.TARGETS, params=None, seed=42):
    """One forest for all targets (K4), see ``forest``."""
    return FO.train(train_df, features, targets, params, seed)


def predict(model: FO.Forest, df):
    """Add ``<target>_pred`` for each fitted target."""
    return model.transform(df)


def feature_importance(model: FO.Forest, spark) -> DataFrame:
    """Importance per feature, averaged over the trees."""
    rows = [(f, float(v)) for f, v in zip(model.features, model.importance())]
    return spark.createDataFrame(rows, "feature string, importance double")


#: The baseline forests of the selection try every feature at every split.
BASELINE = {"numTrees": 100, "maxDepth": 20, "featureSubsetStrategy": "all"}


def select_features(train_df, features, targets=S.TARGETS, k=150, params=None, seed=42):
    """Top-k features by the mean over the targets of a baseline forest's
    importances (K5); all features when there are at most k."""
    if len(features) <= k:
        return list(features)
    imp = FO.importance_by_target(train_df, features, targets, {**BASELINE, **(params or {})}, seed)
    return [f for _, f in sorted(zip(-imp, features))[:k]]


#: Forests of the search that are fitted at the same time, and trials whose sure folds are begun ahead.
SIDE, AHEAD = 8, 8

SEARCH_SPACE = {
    "numTrees": (100, 500), "maxDepth": (5, 30),
    "featureSubsetStrategy": ["sqrt", "log2", "0.5", "0.7"],
    "minInstancesToSplit": (2, 20), "minInstancesPerNode": (1, 10), "bootstrap": [True, False], "subsamplingRate": (0.6, 1.0),
}


def sample_params(rng: random.Random, space=SEARCH_SPACE) -> dict:
    p = {k: rng.randint(*v) if isinstance(v, tuple) else rng.choice(v) for k, v in space.items() if k != "subsamplingRate"}
    p["subsamplingRate"] = rng.uniform(*space["subsamplingRate"]) if p["bootstrap"] else 1.0
    return p


def should_prune(scores, completed, n_startup=5, n_warmup=2) -> bool:
    """Median pruning: stop a trial whose best score so far is worse than the
    median score of the completed trials at its last fold. No trial is stopped
    before ``n_startup`` have completed, or in its first ``n_warmup`` folds."""
    step = len(scores) - 1
    at = [c[step] for c in completed if len(c) > step]
    return len(completed) >= n_startup and step >= n_warmup and bool(at) and min(scores) > statistics.median(at)


def _fold_score(model: FO.Forest, part: DataFrame, targets) -> float:
    pred = predict(model, part)
    per_fold, _ = ST.multi_rmse(long_predictions(pred, targets).withColumn("fold", F.lit(0)))
    return per_fold.first()["rmse"]


def search_params(df_idx, features, targets=S.TARGETS, n_trials=50, n_splits=5, seed=42,
                  n_startup=5, n_warmup=2, space=SEARCH_SPACE, pos_col="_pos", store=None):
    """Random search with expanding-window CV and median pruning (K6).

    ``df_idx`` carries the row position ``pos_col``. Each fold's training rows
    are binned once and serve all trials. With ``store`` (a path) every finished
    trial is a row of a table there, and a search started again with the same
    settings goes on after the trials it finds. Small forests leave most of a
    cluster idle, so ``SIDE`` of them are fitted at a time, only such as are
    needed whatever is pruned. Returns ``(best_params,
    trials)`` with ``trials`` a list of dicts: trial, params, scores (one a
    fold), score (their mean) and pruned.
    """
    rng = random.Random(seed)
    features, targets = list(features), list(targets)
    spark = df_idx.sparkSession
    data = table(df_idx.select(pos_col, *[f"`{c}`" for c in [*features, *targets]]), "search")
    n = data.count()
    t = n // (n_splits + 1)
    if t == 0:
        raise ValueError(f"{n} rows are too few for {n_splits} folds")

    def prepare(fold):
        start = n - (n_splits - fold) * t
        train = data.where(F.col(pos_col) < start)
        cuts = FO._cuts(train, features)
        rows = FO.held(FO._bin_table(train, features, targets, cuts), start, len(features), len(targets))
        return rows, start, cuts, data.where((F.col(pos_col) >= start) & (F.col(pos_col) < start + t))

    def fit(p, fold):
        rows, n_rows, cuts, val = fold
        return _fold_score(FO.train_binned(rows, n_rows, cuts, features, targets, {**FO.DEFAULTS, **p}, seed), val, targets)

    trials = _stored_trials(store, spark)
    params = [sample_params(rng, space) for _ in range(n_trials)]
    pool, ahead = ThreadPoolExecutor(SIDE), {}
    try:
        folds = list(pool.map(prepare, range(n_splits)))
        for trial in range(len(trials), n_trials):
            # folds that no pruning can skip, of this trial and of the next ones, are fitted side by side;
            # start-up trials, which have more of them, begin fewer trials ahead
            for k in range(trial, min(n_trials, trial + (3 if trial < n_startup else AHEAD))):
                if k not in ahead:
                    sure = n_splits if k < n_startup else n_warmup + 1
                    ahead[k] = [pool.submit(fit, params[k], fold) for fold in folds[:sure]]
            fitted = ahead.pop(trial)
            completed = [x["scores"] for x in trials if not x["pruned"]]
            scores, pruned = [], False
            for k, fold in enumerate(folds):
                scores.append(fitted[k].result() if k < len(fitted) else fit(params[trial], fold))
                if should_prune(scores, completed, n_startup, n_warmup):
                    pruned = True
                    break
            trials.append({"trial": trial, "params": params[trial], "scores": scores, "score": sum(scores) / len(scores), "pruned": pruned})
            if store:
                spark.createDataFrame([(trial, json.dumps(trials[-1]))], "trial int, result string").coalesce(1).write.mode("append").parquet(store)
    finally:
        pool.shutdown(cancel_futures=True)
    best = min((x for x in trials if not x["pruned"]), key=lambda x: x["score"])
    return best["params"], trials


def _stored_trials(store, spark) -> list[dict]:
    """Finished trials of an earlier run, as far as they follow each other from the first."""
    if not store:
        return []
    held = RD.read_or_empty(spark, store, "trial int, result string").collect()
    by = {r.trial: json.loads(r.result) for r in held}
    return [by[k] for k in range(len(by)) if set(range(k + 1)) <= set(by)]


def tuned_forest(df_idx, features, targets=S.TARGETS, test=0.2, k=150, pos_col="_pos", store=None, **search):
    """The whole training chain: select features on the training rows, search
    the parameters, refit on the training rows, evaluate on the last ones.

    Returns ``(model, metrics, best_params)``. At least one row must be left
    for either part.
    """
    n = df_idx.count()
    start = n - int(test * n)
    if not 0 < start < n:
        raise ValueError(f"{n} rows are too few for a test share of {test}")
    train, rest = df_idx.where(F.col(pos_col) < start), df_idx.where(F.col(pos_col) >= start)
    names = select_features(train, features, targets, k)
    best, _ = search_params(df_idx, names, targets, pos_col=pos_col, store=store, **search)
    model = train_forest(train, names, targets, best)
    return model, evaluate(predict(model, rest), targets), best


# ---------------------------------------------------------------------------
# scaling and sequence regression
# ---------------------------------------------------------------------------
def sequence_regression(seq_df, targets=S.TARGETS, seq_length=14, split_col="split",
                        max_iter=50, reg=0.0):
    """Next-row forecast from ``seq_length`` × k scaled windows (K9): the window
    is flattened into a vector and one linear model per target is fitted on
    the ``train`` rows; returns predictions for all rows."""
    d = seq_df.withColumn("features", array_to_vector(F.flatten("seq")))
    d = d.withColumns({t: F.col("target")[i] for i, t in enumerate(targets)})
    tr = d.where(F.col(split_col) == "train").select("features", *targets).persist()

    def fit(t):
        lr = LinearRegression(featuresCol="features", labelCol=t, predictionCol=f"{t}_pred",
                              maxIter=max_iter, regParam=reg)
        return t, lr.fit(tr)

    with ThreadPoolExecutor(max_workers=4) as ex:
        models = dict(ex.map(fit, targets))
    tr.unpersist()
    for m in models.values():
        d = m.transform(d)
    return d


def sequence_boosting(seq_df, targets=S.TARGETS, split_col="split", max_iter=100, max_depth=5, step=0.1,
                      tol=0.001, seed=42):
    """Next-row forecast from windows by boosted trees that stop early (K9).

    Trees are fitted on the ``train`` rows, a model per target on the flattened
    window; the ``val`` rows decide when to stop: at the first tree that lowers
    their error by less than ``tol`` of it, the best number before it is kept.
    Returns predictions for all rows with whole windows and the number of trees
    by target. A window with a missing value gives no row; rows with a missing
    target are scored and not fitted.
    """
    d = seq_df.withColumn("features", F.flatten("seq")).where(~F.exists("features", lambda x: x.isNull()))
    d = d.withColumn("features", array_to_vector("features"))
    d = d.withColumns({t: F.col("target")[i] for i, t in enumerate(targets)})
    rows = d.where(F.col(split_col).isin("train", "val")).select(
        "features", (F.col(split_col) == "val").alias("held"), *targets).persist()

    def fit(t):
        gbt = GBTRegressor(featuresCol="features", labelCol=t, predictionCol=f"{t}_pred", validationIndicatorCol="held",
                           maxIter=max_iter, maxDepth=max_depth, stepSize=step, validationTol=tol, seed=seed)
        return t, gbt.fit(rows.where(F.col(t).isNotNull()))

    try:
        parts = {r.held for r in rows.select("held").distinct().collect()}
        if parts != {True, False}:
            raise ValueError("both train and val rows are needed")
        with ThreadPoolExecutor(max_workers=4) as ex:
            models = dict(ex.map(fit, targets))
    finally:
        rows.unpersist()
    for m in models.values():
        d = m.transform(d)
    return d, {t: m.getNumTrees for t, m in models.items()}

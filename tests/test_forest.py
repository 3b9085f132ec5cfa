"""The multi-target forest against plain computations, and the parameter search."""
import numpy as np
import pytest

from seriesframe.plans import forest as FO
from seriesframe.plans import learn as LN


def rules(**k):
    return FO.Rules(**{"max_depth": 3, "subset": 4, "least": 1, "to_split": 2, "bootstrap": False, "rate": 1.0, "seed": 1, **k})


def sse(y, w):
    return sum(((y[:, k] - np.average(y[:, k], weights=w)) ** 2 * w).sum() for k in range(y.shape[1])) if len(y) else 0.0


def brute_split(bins, y, w, least):
    """Best (gain, feature, bin) by trying every cut."""
    best = (-np.inf, -1, 0)
    for f in range(bins.shape[1]):
        for b in np.unique(bins[:, f])[:-1]:
            side = bins[:, f] <= b
            if w[side].sum() >= least and w[~side].sum() >= least:
                gain = sse(y, w) - sse(y[side], w[side]) - sse(y[~side], w[~side])
                if gain > best[0] + 1e-9:
                    best = (gain, f, b)
    return best


@pytest.mark.parametrize("least", [1, 5])
def test_splits_like_brute_force(least):
    rng = np.random.default_rng(least)
    for _ in range(20):
        n = int(rng.integers(8, 60))
        bins, y = rng.integers(0, 6, (n, 4)).astype(np.uint8), rng.normal(size=(n, 3))
        w = rng.integers(1, 4, n).astype(float)
        (gain, feature, at), total = FO._best_splits(bins, np.column_stack([w, y * w[:, None]]), np.array([(y ** 2 * w[:, None]).sum()]), np.zeros(n, np.int64), 1, np.arange(4)[None, :], least)
        want = brute_split(bins, y, w, least)
        if want[1] < 0:
            assert feature[0] == -1
        else:
            assert gain[0] == pytest.approx(want[0], rel=1e-6) and (feature[0], at[0]) == want[1:]
        tree = FO.grow(bins, y, w, 0, 1, 0, rules(least=least))
        leaf = tree.leaf_of(bins)
        for k in np.unique(leaf):
            assert np.allclose(tree.value[k], np.average(y[leaf == k], axis=0, weights=w[leaf == k]))
            assert w[leaf == k].sum() >= least


def test_samples_and_subsets():
    r = rules(bootstrap=True, rate=0.7, subset=3)
    w = np.concatenate([r.weights(np.arange(20_000), t) for t in range(5)])
    assert abs(w.mean() - 0.7) < 0.02 and abs(w.var() - 0.7) < 0.03
    f = r.features(1, np.arange(1, 4000), 12)
    assert f.shape == (3999, 3) and (np.diff(f, axis=1) > 0).all()
    assert np.abs(np.bincount(f.ravel(), minlength=12) / 3999 - 0.25).max() < 0.03
    assert [FO.subset_size(s, 330) for s in ("all", "sqrt", "log2", "0.5")] == [330, 19, 9, 165]


def data(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    y = np.column_stack([np.where(x[:, 0] > 0, 3.0, -1.0) + x[:, 1], np.abs(x[:, 2]) * 4])
    rows = [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "_pos int, a double, b double, c double, `d e` double, f double, y double, z double").repartition(4)


NAMES = ["a", "b", "c", "d e", "f"]


def test_level_by_level_equals_one_task(spark):
    """Nodes split by sums over partitions and nodes grown whole give the same forest."""
    df = data(spark)
    p = {"numTrees": 4, "maxDepth": 7, "featureSubsetStrategy": "0.6"}
    whole = FO.train(df, NAMES, ["y", "z"], p)
    parts = FO.train(df, NAMES, ["y", "z"], p, local_rows=40)
    assert not whole.splits and len(parts.splits) > 20
    a, b = (sorted(map(tuple, m.transform(df).select("_pos", "y_pred", "z_pred").collect())) for m in (whole, parts))
    assert np.allclose(np.array(a), np.array(b))
    assert np.allclose(whole.importance(), parts.importance())


def test_fit_importance_and_groups_of_trees(spark, monkeypatch):
    df, new = data(spark, 1500), data(spark, 300, seed=9)
    model = FO.train(df, NAMES, ["y", "z"], {"numTrees": 20, "featureSubsetStrategy": "all"})
    m = {r.feature: r.r2 for r in LN.evaluate(model.transform(new), ["y", "z"]).collect()}
    assert m["y"] > 0.9 and m["z"] > 0.9
    imp = model.importance()
    assert imp.sum() == pytest.approx(1) and set(np.argsort(imp)[-3:]) == {0, 1, 2}
    one = sorted(map(tuple, model.transform(new).select("_pos", "y_pred").collect()))
    monkeypatch.setattr(FO, "MODEL_BYTES", 1)
    assert len(list(model.groups())) == 20
    assert np.allclose(one, sorted(map(tuple, model.transform(new).select("_pos", "y_pred").collect())))


def test_selection_averages_over_targets(spark):
    df = data(spark)
    params = {"numTrees": 6, "maxDepth": 6, "featureSubsetStrategy": "all"}
    got = FO.importance_by_target(df, NAMES, ["y", "z"], params)
    each = [FO.train(df, NAMES, [t], params).importance() for t in ("y", "z")]
    # a target's rows have other hashes alone than together, so the samples differ
    assert np.allclose(got, np.mean(each, axis=0), atol=0.05)
    assert set(LN.select_features(df, NAMES, ["y", "z"], 3, {"numTrees": 6})) == {"a", "b", "c"}
    assert LN.select_features(df, NAMES, ["y", "z"]) == NAMES


def test_pruning_rule():
    done = [[1.0, 2.0, 3.0, 4.0, 5.0]] * 3 + [[1.0, 2.0, 9.0, 4.0, 5.0]] * 2
    assert not LN.should_prune([9.0, 9.0], done)                      # warm-up
    assert LN.should_prune([9.0, 9.0, 9.0], done)                     # best 9 > median 3
    assert not LN.should_prune([2.5, 9.0, 9.0], done)                 # best so far counts, not the last or the mean
    assert not LN.should_prune([9.0, 9.0, 9.0], done[:4])             # start-up
    assert LN.should_prune([6.5, 6.5, 6.5], [*done[:3], *done[3:], [1.0, 2.0, 9.0, 1.0, 1.0]])  # median of 3 and 9
    assert not LN.should_prune([6.0, 6.5, 6.5], [*done, [1.0, 2.0, 9.0, 1.0, 1.0]])


def test_search_goes_on_after_a_lost_driver(spark, tmp_path, monkeypatch):
    df = data(spark, 240)
    space = {**LN.SEARCH_SPACE, "numTrees": (2, 5), "maxDepth": (2, 5)}
    options = dict(targets=["y", "z"], n_trials=4, n_splits=3, space=space, n_startup=1, n_warmup=0)
    best, trials = LN.search_params(df, NAMES, **options)
    assert len(trials) == 4 and best == min((t for t in trials if not t["pruned"]), key=lambda t: t["score"])["params"]
    for k, t in enumerate(trials):
        assert t["pruned"] == LN.should_prune(t["scores"], [x["scores"] for x in trials[:k] if not x["pruned"]], 1, 0)
    store, real, calls = str(tmp_path / "trials"), LN._fold_score, []

    def lost(*args):
        calls.append(1)
        if len(calls) > 5:
            raise RuntimeError("driver lost")
        return real(*args)

    monkeypatch.setattr(LN, "_fold_score", lost)
    with pytest.raises(RuntimeError):
        LN.search_params(df, NAMES, store=store, **options)
    held = len(LN._stored_trials(store, spark))
    assert 0 < held < 4
    monkeypatch.setattr(LN, "_fold_score", real)
    again, others = LN.search_params(df, NAMES, store=store, **options)
    assert again == best and [t["params"] for t in others] == [t["params"] for t in trials]
    assert np.allclose([t["score"] for t in others], [t["score"] for t in trials])


def test_the_whole_chain(spark):
    df = data(spark, 240)
    space = {**LN.SEARCH_SPACE, "numTrees": (4, 6), "maxDepth": (4, 6)}
    model, metrics, best = LN.tuned_forest(df, NAMES, ["y", "z"], n_trials=2, n_splits=2, space=space)
    assert model.params["numTrees"] == best["numTrees"] and metrics.count() == 2
    with pytest.raises(ValueError):
        LN.tuned_forest(df.where("_pos < 1"), NAMES, ["y", "z"])


def test_small_trees_share_tasks(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(120, 4))], "a double, b double, c double, y double")
    model = FO.train(df, ["a", "b", "c"], ["y"], {"numTrees": 150, "maxDepth": 3})
    assert model.parts.count() == 150
    assert len(model.parts.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism


def test_search_fits_side_by_side_what_no_pruning_skips(spark, monkeypatch):
    import threading
    import time
    lock, active, most, fitted = threading.Lock(), [0], [0], []

    def fit(rows, n_rows, cuts, features, targets, p, seed):
        with lock:
            active[0] += 1
            most[0] = max(most[0], active[0])
        time.sleep(0.05)
        with lock:
            active[0] -= 1
            fitted.append((p["numTrees"], p["maxDepth"], n_rows))
        return p["numTrees"] + p["maxDepth"] / 100 + n_rows

    monkeypatch.setattr(FO, "train_binned", fit)
    monkeypatch.setattr(LN, "_fold_score", lambda model, part, targets: model)
    df = spark.createDataFrame([(k, float(k % 7), float(k)) for k in range(60)], "_pos long, a double, y double")
    best, trials = LN.search_params(df, ["a"], ["y"], n_trials=12)
    completed = []
    for t in trials:
        want = []
        for n_rows in (10, 20, 30, 40, 50):
            want.append(t["params"]["numTrees"] + t["params"]["maxDepth"] / 100 + n_rows)
            if LN.should_prune(want, completed):
                break
        pruned = LN.should_prune(want, completed)
        assert (t["scores"], t["pruned"]) == (want, pruned)
        if not pruned:
            completed.append(want)
    assert any(t["pruned"] for t in trials) and most[0] > 1
    assert len(fitted) == sum(len(t["scores"]) for t in trials)


@pytest.mark.parametrize("bootstrap", [True, False])
def test_trees_side_by_side_equal_trees_alone(bootstrap, monkeypatch):
    rng = np.random.default_rng(6)
    bins, y = rng.integers(0, 32, (300, 12)).astype(np.uint8), rng.normal(size=(300, 3))
    bins[:20], y[:20] = bins[20:40], y[20:40]                        # equal rows
    r = rules(bootstrap=bootstrap, rate=0.8 if bootstrap else 1.0, subset=8, max_depth=9, least=2)
    items = []
    for t in range(10):
        w = r.weights(np.arange(300), t)
        items.append((t, 1, 0, np.flatnonzero(w), w[w > 0]))
    alone = [FO.grow(bins[own], y[own], w, t, 1, 0, r) for t, _, _, own, w in items]
    pairs, real = [], FO._sorted_rows
    monkeypatch.setattr(FO, "_sorted_rows", lambda flat, src, feature, *rest: (pairs.append(feature.shape[0] * len(src)), real(flat, src, feature, *rest))[1])
    for s, t in zip(FO.grow_all(bins, y, items, r), alone):
        assert all(np.allclose(getattr(s, f), getattr(t, f)) for f in FO.Subtree.FIELDS)
    together, pairs[:] = sum(pairs), []
    for item in items:
        FO.grow_all(bins, y, [item], r)
    assert together == sum(pairs) if bootstrap else together < sum(pairs)


def test_a_target_that_is_not_a_number_spoils_only_its_own_trees():
    rng = np.random.default_rng(7)
    bins, y = rng.integers(0, 32, (80, 4)).astype(np.uint8), rng.normal(size=(80, 2))
    y[5, 0] = np.nan
    with_, without = np.arange(80), np.delete(np.arange(80), 5)
    spoiled, whole = FO.grow_all(bins, y, [(0, 1, 0, with_, np.ones(80)), (1, 1, 0, without, np.ones(79))], rules())
    alone = FO.grow(bins[without], y[without], np.ones(79), 1, 1, 0, rules())
    assert len(spoiled.feature) == 1 and np.isnan(spoiled.value[0, 0])
    assert all(np.allclose(getattr(whole, f), getattr(alone, f)) for f in FO.Subtree.FIELDS) and len(alone.feature) > 1


def test_held_forest_scores_where_it_grows(spark):
    df, new = data(spark, 240), data(spark, 90, seed=3)
    cuts = FO._cuts(df, NAMES)
    rows = FO._bin_table(df, NAMES, ["y", "z"], cuts)
    assert FO.held(rows, 240, 5, 2, local_rows=100) is rows and FO.held(rows, 1 << 30, 5, 2, local_rows=1 << 31) is rows
    for p in ({"numTrees": 7, "maxDepth": 6}, {"numTrees": 30, "maxDepth": 4, "bootstrap": False, "featureSubsetStrategy": "0.7"}):
        p = {**FO.DEFAULTS, **p}
        at_once = FO.train_binned(FO.held(rows, 240, 5, 2), 240, cuts, NAMES, ["y", "z"], p)
        written = FO.train_binned(rows, 240, cuts, NAMES, ["y", "z"], p)
        dealt = FO.train_binned(rows, 240, cuts, NAMES, ["y", "z"], p, local_rows=60)
        got, same, other = (sorted(map(tuple, m.transform(new).collect())) for m in (at_once, written, dealt))
        assert "parts" not in at_once.__dict__ and len(got) == 90
        assert np.allclose(np.array(got), np.array(same)) and np.allclose(np.array(got), np.array(other))
        assert at_once.transform(new.where("_pos < 0")).count() == 0
        assert np.allclose(at_once.importance(), written.importance()) and at_once.parts.count() == p["numTrees"]


def test_search_writes_no_trees(spark, monkeypatch):
    written, real = [], FO.table
    monkeypatch.setattr(FO, "table", lambda df, name: (written.append(name), real(df, name))[1])
    space = {**LN.SEARCH_SPACE, "numTrees": (2, 5), "maxDepth": (2, 5)}
    LN.search_params(data(spark, 120), NAMES, ["y", "z"], n_trials=2, n_splits=2, space=space)
    assert sorted(written) == ["forest-rows"] * 2

"""The registered model queries run their operators with the operators' own settings."""
import pytest

from seriesframe import queries as Q
from seriesframe.plans import forest as FO
from seriesframe.plans import learn as LN

SF = "/root/testdata/sf0.001"


class Stop(Exception):
    pass


@pytest.mark.parametrize("build, name, trees, depth, subset", [
    (Q._forest, "train", 100, 10, "sqrt"), (Q._feature_selection, "importance_by_target", 100, 20, "all")])
def test_forests_have_the_operators_settings(spark, monkeypatch, build, name, trees, depth, subset):
    def stop(df, features, targets, params, seed):
        p = {**FO.DEFAULTS, **(params or {})}
        assert (p["numTrees"], p["maxDepth"], p["featureSubsetStrategy"]) == (trees, depth, subset)
        raise Stop

    monkeypatch.setattr(FO, name, stop)
    with pytest.raises(Stop):
        build(spark, SF)


def test_search_has_the_operators_settings(spark, monkeypatch):
    def search(df, features, *args, **kwargs):
        assert not args and not kwargs
        raise Stop

    monkeypatch.setattr(LN, "search_params", search)
    monkeypatch.setattr(LN, "select_features", lambda df, names: names[:150])
    with pytest.raises(Stop):
        Q._search(spark, SF)

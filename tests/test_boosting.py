"""Boosted sequence learner: nonlinear series, stop by the validation rows, missing values."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesframe.plans import learn as L


def _windows(spark, noise=0.0):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        w = rng.uniform(-1, 1, (3, 2))
        y = float(w[2, 0] * w[1, 1] > 0) + noise * rng.normal()
        rows.append((["train", "val", "test"][0 if i < 360 else 1 if i < 480 else 2], w.tolist(), [y, 2.0]))
    return spark.createDataFrame(rows, "split string, seq array<array<double>>, target array<double>")


def test_beats_the_linear_model_and_a_constant(spark):
    seq = _windows(spark)
    got, trees = L.sequence_boosting(seq, ["y", "same"], max_iter=20, max_depth=3, step=0.3)
    scores = {r.feature: r for r in L.evaluate(got.where("split = 'test'"), ["y", "same"]).collect()}
    linear = L.sequence_regression(seq, ["y", "same"], 3).where("split = 'test'")
    assert scores["y"].r2 > 0.5 > 0.2 > {r.feature: r for r in L.evaluate(linear, ["y", "same"]).collect()}["y"].r2
    assert scores["same"].rmse == pytest.approx(0.0) and got.count() == 600
    assert 1 < trees["y"] <= 20 and trees["same"] == 1


def test_noise_stops_early(spark):
    _, trees = L.sequence_boosting(_windows(spark, 3.0), ["y"], max_iter=20, max_depth=3, step=0.3)
    assert trees["y"] < 10


def test_missing_values_and_parts(spark):
    seq = _windows(spark)
    holes = seq.withColumn("i", F.monotonically_increasing_id() % 10)
    holes = holes.withColumn("seq", F.when(F.col("i") == 0, F.transform("seq", lambda x: F.transform(x, lambda _: F.lit(None).cast("double")))).otherwise(F.col("seq")))
    holes = holes.withColumn("target", F.when(F.col("i") == 1, F.array(F.lit(None).cast("double"))).otherwise(F.col("target")))
    got, _ = L.sequence_boosting(holes, ["y"], max_iter=2, max_depth=2)
    assert got.count() == holes.where("i <> 0").count()
    assert got.where("y IS NULL AND y_pred IS NULL").count() == 0
    with pytest.raises(ValueError, match="val"):
        L.sequence_boosting(seq.where("split <> 'val'"), ["y"])

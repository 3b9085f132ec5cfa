"""Min-max scaling as an estimator that is fitted once, kept and applied.

``SeriesScaler`` takes the bounds of each column (and of each series) from one
part of the rows, by default the training part, so that validation and test
rows do not reach the model through the scale. The bounds are a table: a model
of many series is joined to the rows, never held by the driver.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable,
                             DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.operators import relational as R
from seriesframe.operators import stats as ST
from seriesframe.session import table


class _ScalerParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to scale", TypeConverters.toListString)
    keys = Param(Params._dummy(), "keys", "columns that name a series", TypeConverters.toListString)
    splitCol = Param(Params._dummy(), "splitCol", "column that names the part of a row", TypeConverters.toString)
    fitOn = Param(Params._dummy(), "fitOn", "part that the bounds are taken from, or 'all'", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(keys=[], splitCol="split", fitOn="train")

    def _own(self):
        return self.getOrDefault(self.inputCols), self.getOrDefault(self.keys)


class SeriesScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Bounds of ``inputCols`` by series over the rows whose ``splitCol`` is ``fitOn`` (``all``: every row)."""

    @keyword_only
    def __init__(self, *, inputCols=None, keys=None, splitCol=None, fitOn=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "SeriesScalerModel":
        cols, keys = self._own()
        part = self.getOrDefault(self.fitOn)
        if part != "all":
            R.require_columns(df, [self.getOrDefault(self.splitCol)])
            df = df.where(F.col(self.getOrDefault(self.splitCol)) == part)
        R.require_columns(df, [*keys, *cols])
        model = SeriesScalerModel(table(ST.minmax_fit(df, cols, keys), "scaler"))
        return self._copyValues(model._resetUid(self.uid))


class SeriesScalerModel(Model, _ScalerParams, MLReadable, MLWritable):
    """Scales to 0..1 by the fitted bounds; a constant column becomes 0, rows beyond the bounds leave 0..1.

    A series without fitted rows, and a column whose fitted rows are all null, become null.
    Null keys are no series: their rows become null.
    """

    def __init__(self, bounds: DataFrame | None = None):
        super().__init__()
        self.bounds = bounds

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, keys = self._own()
        return ST.minmax_transform(df, self.bounds, cols, keys)

    def inverse_transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Columns ``<name><suffix>`` (say predictions) back in the units of the input; a constant column becomes its value."""
        cols, keys = self._own()
        d = ST.attach(df, self.bounds, keys)
        back = {f"{c}{suffix}": F.col(f"{c}{suffix}") * (F.col(f"{c}_max") - F.col(f"{c}_min")) + F.col(f"{c}_min") for c in cols}
        return d.withColumns(back).drop(*self.bounds.drop(*keys).columns)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.bounds.write.parquet(f"{path}/bounds")


class _ModelReader(DefaultParamsReader):
    def load(self, path: str) -> SeriesScalerModel:
        model = super().load(path)
        model.bounds = self.sparkSession.read.parquet(f"{path}/bounds")
        return model

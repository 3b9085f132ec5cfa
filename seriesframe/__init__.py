"""seriesframe: daily environmental time series on Spark DataFrames."""

__version__ = "0.1.0"

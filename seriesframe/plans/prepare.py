"""Feature and target table of a forecaster (J5), for the same or a later day.

The original scores a row against its own day, so that a target is also among
its features' inputs. With ``horizon`` a row's targets are those of the day
``horizon`` days on, and the row's own values become features.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seriesframe import schema as S
from seriesframe.operators import relational as R
from seriesframe.operators import windows as WN

#: Ending of a target's name when it is that of a later day.
NEXT = "_next"


class Prepared(NamedTuple):
    """``rows`` has keys, Date, features and targets; ``read`` and ``kept`` count rows while it is computed."""

    rows: DataFrame
    features: list
    targets: list
    read: Observation
    kept: Observation

    def counts(self) -> dict:
        """Rows read and kept; waits for the first action on ``rows``."""
        done = {**self.read.get, **self.kept.get}
        return {**done, "dropped": done["rows_in"] - done["rows_out"]}


def later_targets(df: DataFrame, targets=S.TARGETS, horizon: int = 1, keys=()) -> DataFrame:
    """Add ``<target>_next``, the values of the same series ``horizon`` days on.

    Days, not rows: where that day is absent the targets are null, so a gap is
    never bridged. A join on (keys, day) with one row a day on each side. Rows
    with a null key or day have null targets.
    """
    if horizon < 1:
        raise ValueError("horizon is a number of days from 1 on")
    R.require_columns(df, [*keys, S.DATE, *targets])
    later = df.select(*keys, F.date_sub(S.DATE, horizon).alias(S.DATE), *[F.col(t).alias(f"{t}{NEXT}") for t in targets])
    return df.join(later, [*keys, S.DATE], "left")


def prepare_features(df: DataFrame, targets=S.TARGETS, horizon: int = 0, keys=()) -> Prepared:
    """All features of a series with its targets, rows with any missing value dropped and counted.

    ``horizon`` 0 is the original's pairing. The counts are taken on the way
    (no pass of their own). The newest ``horizon`` days of a series have no
    targets yet and are dropped here; ``forecast`` scores them.
    """
    keys, targets = list(keys), list(targets)
    feats = WN.create_all_features(df, keys=keys)
    if horizon:
        names = R.split_xy(feats.drop(*keys), [])
        later = later_targets(df.select(*keys, S.DATE, *targets), targets, horizon, keys).drop(*targets)
        feats = feats.join(later, [*keys, S.DATE], "left")
        targets = [f"{t}{NEXT}" for t in targets]
    else:
        names = R.split_xy(feats.drop(*keys), targets)
    read, kept = Observation(), Observation()
    feats = feats.select(*keys, S.DATE, *names, *targets).observe(read, F.count(F.lit(1)).alias("rows_in"))
    done = R.drop_incomplete(feats).observe(kept, F.count(F.lit(1)).alias("rows_out"))
    return Prepared(done, names, targets, read, kept)

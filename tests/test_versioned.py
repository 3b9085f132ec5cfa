"""Versioned table: whole commits, failed writes, conflicts, reading while writing."""
import tempfile

import pytest
from pyspark.sql import functions as F

from seriesframe.sources import versioned as V


def _path():
    return tempfile.mkdtemp(prefix="sf-versions-") + "/table"


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_commit_read_and_earlier_versions(spark):
    path = _path()
    assert V.read_version(spark, path) is None and V.versions(spark, path) == []
    assert V.commit(spark.range(3), path) == 1
    old = V.read_version(spark, path)
    assert V.update(spark, path, lambda t: t.union(spark.range(3, 5))) == 2
    assert _ids(old) == [0, 1, 2] and _ids(V.read_version(spark, path)) == [0, 1, 2, 3, 4]
    assert _ids(V.read_version(spark, path, 1)) == [0, 1, 2]
    with pytest.raises(ValueError):
        V.read_version(spark, path, 7)


def test_a_write_that_fails_half_way_leaves_the_table(spark):
    path = _path()
    V.commit(spark.range(4), path)
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        V.commit(broken, path)
    assert _ids(V.read_version(spark, path)) == [0, 1, 2, 3] and V.versions(spark, path) == [1]
    assert V.commit(spark.range(1), path) == 2


def test_a_writer_that_dies_while_it_claims(spark):
    path = _path()
    V.commit(spark.range(2), path)
    with open(f"{path}/versions/0000000002", "w") as f:
        f.write("abc")  # no line end: not whole
    assert _ids(V.read_version(spark, path)) == [0, 1]
    assert V.commit(spark.range(5), path, base=1) == 3
    assert V.versions(spark, path) == [1, 3]


def test_two_writers_from_one_version(spark):
    path = _path()
    V.commit(spark.range(2), path)

    def slow(table):
        V.commit(spark.range(9), path, base=1)  # another writer is first
        return table

    with pytest.raises(V.ConflictError):
        V.update(spark, path, slow)
    assert _ids(V.read_version(spark, path)) == list(range(9))


def test_expire_keeps_the_newest(spark):
    path = _path()
    for n in (1, 2, 3):
        V.commit(spark.range(n).withColumn("p", F.col("id") % 2), path, partition_by=["p"])
    assert V.expire(spark, path, 1) == [1, 2]
    assert V.versions(spark, path) == [3] and _ids(V.read_version(spark, path)) == [0, 1, 2]
    with pytest.raises(ValueError):
        V.expire(spark, path, 0)

"""Stream-driven incremental append: a second run over the same landing folder adds nothing."""
import tempfile

from pyspark.sql import functions as F

from seriesframe.sources import testdata as TD
from seriesframe.streaming import incremental as INC

SF = "/root/testdata/sf0.001"


def test_stream_append_is_idempotent(spark):
    land = tempfile.mkdtemp(prefix="sf-land-")
    target = tempfile.mkdtemp(prefix="sf-target-") + "/t"
    ckpt = tempfile.mkdtemp(prefix="sf-ck-")
    TD.pollutants(spark, SF).write.mode("overwrite").parquet(land + "/a")
    schema = spark.read.parquet(land + "/a").schema
    src = spark.readStream.schema(schema).parquet(land + "/a")
    q = INC.start_update_stream(spark, src, lambda b: b.select(*schema.names), target, checkpoint=ckpt)
    q.awaitTermination()
    n1 = spark.read.parquet(target).count()
    assert n1 == spark.read.parquet(land + "/a").count()
    # the same rows again in a new file: nothing is newer than the stored days
    q2 = INC.start_update_stream(spark, spark.readStream.schema(schema).parquet(land + "/a"),
                                 lambda b: b.select(*schema.names), target,
                                 checkpoint=tempfile.mkdtemp(prefix="sf-ck2-"))
    q2.awaitTermination()
    assert spark.read.parquet(target).count() == n1
    assert spark.read.parquet(target).where(F.col("Date").isNull()).count() == 0


def _run(spark, days_by_file, max_files, stored=()):
    import datetime as dt
    base = tempfile.mkdtemp(prefix="sf-batches-")
    rows = lambda days: spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=d), float(d)) for d in days], "Date date, v double")
    if stored:
        rows(stored).write.parquet(base + "/t")
    for days in days_by_file:  # landed one after another
        rows(days).coalesce(1).write.mode("append").parquet(base + "/in")
    src = INC.landed_rows_stream(spark, base + "/in", "Date date, v double", max_files=max_files)
    INC.start_update_stream(spark, src, lambda b: b.select("Date", "v"), base + "/t", base + "/ck", late_path=base + "/late").awaitTermination()
    late = spark.read.parquet(base + "/late").count() if stored else 0
    return sorted(r.v for r in spark.read.parquet(base + "/t").collect()), late


def test_result_does_not_depend_on_batches(spark):
    files = [range(10, 20), range(0, 10), range(5, 12)]
    for max_files in (1, 100):
        days, _ = _run(spark, files[:2], max_files)
        assert days == [float(d) for d in range(20)]
        days, late = _run(spark, files[:2], max_files, stored=(2, 3))
        assert days == [float(d) for d in range(2, 20)] and late == 2


def test_a_day_in_two_files(spark):
    files = [range(10, 20), range(0, 10), range(5, 12)]  # days 5 to 11 have two rows each
    want = sorted(float(d) for f in files for d in f)
    for max_files in (1, 2, 100):
        assert _run(spark, files, max_files) == (want, 0)
        days, late = _run(spark, files, max_files, stored=(2, 6))
        assert days == [2.0, 6.0, *[d for d in want if d > 6]] and late == 6  # 0, 1, 3, 4 and 5 twice


def test_a_failed_run_goes_on_with_its_mark(spark):
    import datetime as dt

    import pytest
    base = tempfile.mkdtemp(prefix="sf-failed-")
    for days in (range(10, 20), range(0, 10)):
        spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=d), float(d)) for d in days], "Date date, v double").coalesce(1).write.mode("append").parquet(base + "/in")
    calls = []

    def process(b):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("driver failure")
        return b.select("Date", "v")

    def start():
        src = INC.landed_rows_stream(spark, base + "/in", "Date date, v double", max_files=1)
        INC.start_update_stream(spark, src, process, base + "/t", base + "/ck").awaitTermination()

    with pytest.raises(Exception, match="driver failure"):
        start()
    assert spark.read.parquet(base + "/t").count() == 10
    start()
    assert sorted(r.v for r in spark.read.parquet(base + "/t").collect()) == [float(d) for d in range(20)]

"""Incremental updates driven by Structured Streaming (J3 as micro-batches).

The original pipeline has no streaming; its updates are batch increments
behind a high-water mark. ``start_update_stream`` runs the same update over the
files that landed. A *run* begins with a mark, the newest stored day of each
series: days up to it are late and are not stored, all newer days are. Each
micro-batch's raw rows are kept for the run, and the run's days are computed
anew from all of them, so a day's rows may lie in any files and the result does
not depend on how the files are dealt to batches. Progress (which files were
consumed) lives in the checkpoint location, and so do the run's mark, its raw
rows and the names of the files that the table had before. A run whose query
failed or was stopped goes on with them when it is started again; it ends when
an ``availableNow`` query has consumed all that had landed. A query without that
trigger is one run for as long as its checkpoint is used; its raw rows are all
kept and computed anew in each batch.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesframe import schema as S
from seriesframe.operators import relational as R
from seriesframe.operators import stats as ST


def _stored(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:  # no table yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _same(keys) -> list[str]:
    return [*keys, S.DATE]


def append_new_days(batch: DataFrame, target_path: str, keys=(), fmt: str = "parquet",
                    mark: DataFrame | None = None, late_path: str | None = None) -> None:
    """Append the days of ``batch`` after the mark that are not stored yet (B9 + G1).

    ``mark`` has the newest stored day of each series when the run began (the
    stored table itself by default). Late days that are not stored are written
    to ``late_path`` where that is given.
    """
    stored = _stored(batch.sparkSession, target_path, fmt)
    mark = stored if mark is None else mark
    batch = batch.where(F.col(S.DATE).isNotNull())
    new = batch if mark is None else R.newer_than(batch, mark, keys)
    if stored is not None:
        new = _not_in(new, stored, keys)
    if late_path and mark is not None:
        newest = mark.groupBy(*keys).agg(F.max(S.DATE).alias("_hw"))
        late = ST.attach(batch, newest, list(keys)).where(F.col(S.DATE) <= F.col("_hw")).drop("_hw")
        (late if stored is None else _not_in(late, stored, keys)).write.mode("append").format(fmt).save(late_path)
    new.write.mode("append").format(fmt).save(target_path)


def _not_in(rows: DataFrame, stored: DataFrame, keys) -> DataFrame:
    """Rows whose series and day are not stored; null keys are equal."""
    other = stored.select(*[F.col(c).alias(f"_{c}") for c in _same(keys)]).distinct()
    on = F.lit(True)
    for c in _same(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(other, on, "left_anti")


class _Run:
    """The state of a run: a folder under the checkpoint, whose name is in the ``current`` file until the run has ended."""

    def __init__(self, spark: SparkSession, checkpoint: str, targets, keys, key_schema):
        self.spark, self.targets = spark, [t for t in targets if t]
        home = f"{checkpoint.rstrip('/')}/runs"
        self.fs, self.current = _fs(spark, home), f"{home}/current"
        if not self.fs.exists(_path(spark, self.current)):
            base = f"{home}/{uuid.uuid4().hex}"
            stored = _stored(spark, targets[0], "parquet")
            newest = spark.createDataFrame([], key_schema) if stored is None else stored.groupBy(*keys).agg(F.max(S.DATE).alias(S.DATE))
            newest.write.parquet(f"{base}/mark")
            rows = [(k, n) for k, t in enumerate(self.targets) for n in _files(spark, t)]
            spark.createDataFrame(rows, "target int, name string").write.parquet(f"{base}/before")
            _write_text(spark, self.current, base)
        self.base = _read_text(spark, self.current)
        self.had_rows = not spark.read.parquet(f"{self.base}/mark").isEmpty()
        self.mark = spark.read.parquet(f"{self.base}/mark")
        self.before = {k: set() for k in range(len(self.targets))}
        for r in spark.read.parquet(f"{self.base}/before").collect():
            self.before[r.target].add(r.name)

    def raw(self, batch: DataFrame, epoch_id: int) -> DataFrame:
        """Keep a batch's raw rows, and return all of the run; a batch that is run again replaces itself."""
        batch.write.mode("overwrite").parquet(f"{self.base}/raw/batch-{epoch_id}")
        return self.spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(f"{self.base}/raw")

    def replace(self, k: int, rows: DataFrame) -> None:
        """Make ``rows`` all that the run has stored in target ``k``."""
        staged = f"{self.base}/staged-{k}"
        rows.write.mode("overwrite").parquet(staged)
        # what an earlier batch stored goes once the new rows are written; both are done again if the driver fails between
        for name in _files(self.spark, self.targets[k]) - self.before[k]:
            self.fs.delete(_path(self.spark, f"{self.targets[k]}/{name}"), False)
        self.spark.read.schema(rows.schema).parquet(staged).write.mode("append").parquet(self.targets[k])

    def end(self) -> None:
        self.fs.delete(_path(self.spark, self.current), False)
        self.fs.delete(_path(self.spark, self.base), True)


def _path(spark, name):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _fs(spark, name):
    return _path(spark, name).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _files(spark, target) -> set[str]:
    """Names of the data files of a table without partitions."""
    fs = _fs(spark, target)
    if not fs.exists(_path(spark, target)):
        return set()
    names = (f.getPath().getName() for f in fs.listStatus(_path(spark, target)) if f.isFile())
    return {n for n in names if not n.startswith(("_", "."))}


def _write_text(spark, name, text):
    fs, part = _fs(spark, name), f"{name}.part"
    out = fs.create(_path(spark, part), True)
    out.writeUTF(text)
    out.close()
    fs.rename(_path(spark, part), _path(spark, name))  # whole or not at all


def _read_text(spark, name) -> str:
    stream = _fs(spark, name).open(_path(spark, name))
    try:
        return stream.readUTF()
    finally:
        stream.close()


class _UpdateQuery:
    """A streaming query whose run ends when it has consumed all that had landed."""

    def __init__(self, query, run, once):
        self._query, self._run, self._once, self._stopped = query, run, once, False

    def __getattr__(self, name):
        return getattr(self._query, name)

    def awaitTermination(self, timeout=None):
        done = self._query.awaitTermination(timeout) if timeout is not None else self._query.awaitTermination()
        if self._once and not self._stopped and not self._query.isActive and self._query.exception() is None:
            self._run.end()
            self._once = False
        return done

    def stop(self):
        self._stopped = self._query.isActive
        self._query.stop()


def start_update_stream(spark: SparkSession, source: DataFrame, process, target_path: str,
                        checkpoint: str, keys=(), trigger_once: bool = True, late_path: str | None = None):
    """Start a streaming query: ``process(rows_df) -> daily rows``, then store
    the new days in ``target_path``. ``source`` is a ``readStream`` DataFrame,
    ``checkpoint`` a folder that all executors share and no other stream uses.
    Nothing else may write to ``target_path`` or ``late_path`` during a run.
    ``awaitTermination`` ends the run; without it the next start goes on with it."""
    empty = source.select(*keys, F.lit(None).cast("date").alias(S.DATE)).schema
    state = _Run(spark, checkpoint, [target_path, late_path], keys, empty)

    def run(batch_df, epoch_id):
        if batch_df.isEmpty():
            return  # an empty batch leaves the table unchanged
        rows = process(state.raw(batch_df, epoch_id)).where(F.col(S.DATE).isNotNull())
        if late_path and state.had_rows:
            newest = state.mark.withColumnRenamed(S.DATE, "_hw")
            late = ST.attach(rows, newest, list(keys)).where(F.col(S.DATE) <= F.col("_hw")).drop("_hw")
            stored = [f"{target_path.rstrip('/')}/{n}" for n in state.before[0]]
            state.replace(1, _not_in(late, spark.read.parquet(*stored), keys) if stored else late)
        state.replace(0, R.newer_than(rows, state.mark, keys) if state.had_rows else rows)

    w = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return _UpdateQuery(w.start(), state, trigger_once)


def landed_rows_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                       max_files: int = 100):
    """File-source stream of landed rows with an explicit schema."""
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", max_files).load(path)
            .withColumn("_ingested", F.current_timestamp()))

"""Spark session and shared-folder helpers.

On a cluster the session comes from the platform; ``get_spark`` only builds a
local session (tests, bench) and never overrides settings that already exist.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # 330-column feature plans: constraint inference over hundreds of
    # aliases is super-linear in the optimizer; it adds no pushdown here
    "spark.sql.constraintPropagation.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "seriesframe", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (``local[*]`` by default)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = (SparkSession.builder
               .master(master or os.environ.get("SERIESFRAME_MASTER", "local[*]"))
               .appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("SERIESFRAME_DRIVER_MEM", "8g")))
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting wins. Only when nothing is set (local tests) a
    fresh scratch folder is created and registered.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not current and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="seriesframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder, for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def table(df, name: str = "table"):
    """Write an intermediate table into the shared folder and read it again.

    Columnar, so that later passes read only their columns; it survives the
    loss of executors and cuts the lineage.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df, how: str = "checkpoint"):
    """Cut the lineage of a multi-consumer intermediate.

    ``checkpoint`` writes it as a table to the shared ``spark.checkpoint.dir``
    (survives executor loss, no recomputation of the upstream plan); ``cache``
    keeps it in executor memory/disk and falls back to recomputation on loss;
    ``none`` leaves the plan lazy.
    """
    if how == "none":
        return df
    if how == "cache":
        return df.persist()
    return table(df, "materialized")


@contextmanager
def wide_plans(spark: SparkSession):
    """Optimizer settings for plans with hundreds of derived columns.

    Constraint propagation re-derives every alias constraint at each node; on
    the 330 feature columns it dominates planning. It is switched off for the
    duration and restored afterwards.
    """
    key = "spark.sql.constraintPropagation.enabled"
    old = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield spark
    finally:
        spark.conf.set(key, old)

"""Versioned table: a write is seen whole or not at all.

A version is a data folder of its own below ``<path>/data``; it becomes the
table when its number is claimed below ``<path>/versions``. A write that fails
or is killed leaves only a folder that no version names. Two writers cannot
claim one number: the later one gets an error and starts from the new table.
The store must create a file exclusively (HDFS and local disks do).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class ConflictError(RuntimeError):
    """Another writer has committed since the version that this write began with."""


def _path(spark, name):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _fs(spark, name):
    return _path(spark, name).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _claims(spark: SparkSession, path: str) -> dict[int, str]:
    """Folder of each claimed number; empty where a writer died while it claimed."""
    home = f"{path.rstrip('/')}/versions"
    fs = _fs(spark, home)
    if not fs.exists(_path(spark, home)):
        return {}
    out = {}
    for f in fs.listStatus(_path(spark, home)):
        name = f.getPath().getName()
        if name.isdigit():
            stream = fs.open(f.getPath())
            try:
                text = stream.readAllBytes().decode()
            finally:
                stream.close()
            out[int(name)] = text[:-1] if text.endswith("\n") else ""
    return out


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    return sorted(n for n, folder in _claims(spark, path).items() if folder)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version, the newest by default; None where nothing has been committed yet.

    The plan names the version's own folder, so later commits do not change what it reads.
    """
    claims = {n: folder for n, folder in _claims(spark, path).items() if folder}
    if not claims and version is None:
        return None
    number = max(claims) if version is None else version
    if number not in claims:
        raise ValueError(f"no version {number} in {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/data/{claims[number]}")


def commit(df: DataFrame, path: str, base: int | None = None, partition_by=()) -> int:
    """Write ``df`` as the next version and return its number.

    ``base`` is the version that ``df`` was made from (0: no table yet); a
    newer one is a ``ConflictError``. ``df`` may read the table itself.
    """
    spark, home = df.sparkSession, path.rstrip("/")
    taken = _claims(spark, path)
    newest = max((n for n, folder in taken.items() if folder), default=0)
    if base is not None and base != newest:
        raise ConflictError(f"{path} is at version {newest}, not {base}")
    number, folder = max(taken, default=0) + 1, uuid.uuid4().hex
    df.write.partitionBy(*partition_by).parquet(f"{home}/data/{folder}")
    claim = _path(spark, f"{home}/versions/{number:010d}")
    fs = _fs(spark, home)
    fs.mkdirs(claim.getParent())
    if fs.exists(claim):
        raise ConflictError(f"{path} got version {number} while this one was written")
    out = fs.create(claim, False)  # exclusive: fails where another writer was first
    try:
        out.write(bytearray(f"{folder}\n".encode()))
    finally:
        out.close()
    return number


def update(spark: SparkSession, path: str, change, partition_by=()) -> int:
    """Commit ``change(current table or None)``; the version read is the one replaced, else ``ConflictError``."""
    base = max(versions(spark, path), default=0)
    current = read_version(spark, path, base) if base else None
    return commit(change(current), path, base, partition_by)


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Remove all but the newest ``keep`` versions with their data; returns their numbers.

    Folders that no version names stay, as a writer may still fill them.
    """
    if keep < 1:
        raise ValueError("at least one version stays")
    claims, home = _claims(spark, path), path.rstrip("/")
    old = versions(spark, path)[:-keep]
    fs = _fs(spark, home)
    for n in old:
        fs.delete(_path(spark, f"{home}/versions/{n:010d}"), False)
        fs.delete(_path(spark, f"{home}/data/{claims[n]}"), True)
    return old

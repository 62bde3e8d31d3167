"""Work folders for written tables and streaming checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


@functools.cache
def _local_root() -> str:
    """One folder for this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="foliomill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Only a local session may leave it unset; it then gets a temporary folder for its lifetime.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{SETTING} must name a folder all executors share")
    return _local_root()


_scopes: list[list[str]] = []


def fresh(spark: SparkSession, purpose: str) -> str:
    """A folder name no other run uses."""
    path = f"{root(spark)}/{purpose}-{uuid.uuid4().hex}"
    for made in _scopes[-1:]:
        made.append(path)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Folders named inside go when it ends: what is left must have been written to a folder named outside.

    Only folders that ``fresh`` has named are deleted, through the file system that holds them.
    """
    _scopes.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for name in _scopes.pop():
            path = hadoop.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back.

    Later steps start from the stored table: nothing is computed twice and a lost executor costs
    no more than its own tasks.
    """
    path = path or fresh(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Tables and folders in the place that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where it is unset and the master is local (as in tests) a folder of this machine is taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Applications whose folders are to be removed when their driver ends.
_ending: set[str] = set()


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folder(spark: SparkSession) -> str:
    """A new folder name in the application's own folder in the shared one, which is removed when the driver ends."""
    own = f"{checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if own not in _ending:
        files, place = _place(spark, own)
        files.mkdirs(place)
        files.deleteOnExit(place)
        _ending.add(own)
    return f"{own}/table-{uuid.uuid4().hex}"


#: Of the scopes that are open, from the outermost in, the tables written in each.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open scopes", default=())


def _stored(df: DataFrame, scope: list[str] | None) -> DataFrame:
    path = folder(df.sparkSession)
    if scope is not None:
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read again: lost executors cost nothing of it.

    The table is removed at the end of the scope in which it is written, if there is one.
    """
    return _stored(df, _open.get()[-1] if _open.get() else None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A stretch of a job at whose end the tables written in it are removed.

    It gives a function that writes a table as `written` does, but so that it stays: what the stretch is for.
    """
    around = _open.get()
    own: list[str] = []
    token = _open.set((*around, own))
    try:
        yield lambda df: _stored(df, around[-1] if around else None)
    finally:
        _open.reset(token)
        for path in own:
            files, place = _place(spark, path)
            files.delete(place, True)

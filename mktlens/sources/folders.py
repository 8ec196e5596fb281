"""Folders for tables and streams that are written on the way, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is named and all runs in one process."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("name a folder that the whole cluster shares in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="mktlens-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def new(spark: SparkSession, kind: str) -> str:
    """A new, empty folder. It goes with clear(), or with the session at the latest."""
    folder = f"{shared(spark)}/{kind}-{uuid.uuid4().hex}"
    files, path = _at(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    _made.append(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df, written to a new folder and read again: what reads it more than once computes it once, and a lost executor costs none of what led to it."""
    folder = new(df.sparkSession, "table")
    df.write.mode("append").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds."""
    files, path = _at(spark, folder)
    return [str(entry.getPath().getName()) for entry in files.listStatus(path)] if files.exists(path) else []


def exists(spark: SparkSession, folder: str) -> bool:
    files, path = _at(spark, folder)
    return bool(files.exists(path))


def rename(spark: SparkSession, folder: str, name: str) -> bool:
    """Give a folder another name, which must not be taken."""
    files, path = _at(spark, folder)
    target = _at(spark, name)[1]
    return not files.exists(target) and bool(files.rename(path, target))


def delete(spark: SparkSession, folder: str) -> None:
    files, path = _at(spark, folder)
    files.delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all folders made so far; nothing must read them any more."""
    while _made:
        delete(spark, _made.pop())

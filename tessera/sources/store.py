"""Tables that are written once and read often, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; a temporary one only in local mode, where there is one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), f"tessera-{os.getpid()}")
    return f"{at.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read back: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_of(spark: SparkSession, path: str):
    """A path of any file system as the JVM sees it, and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside the old one and put it in its place by a rename, so a reader sees the one or the other."""
    at, fs = path_of(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark._sc._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(beside, at, options)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that isn't there yet, whole or not at all; False if another writer was first."""
    at, fs = path_of(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}"
    put(spark, beside, text)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), at, spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError:
        delete(spark, beside)
        if fs.exists(at):
            return False
        raise
    return True


def get(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    at, fs = path_of(spark, path)
    if not fs.exists(at):
        return None
    found = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(found)).decode()
    finally:
        found.close()


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = path_of(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no folder."""
    at, fs = path_of(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, fs = path_of(spark, path)
    fs.delete(at, True)

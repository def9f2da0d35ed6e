"""The folder that driver and executors share, and small files in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the session's checkpoint folder. Only where all is one process (tests) may the session name none."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        top = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/work-{uuid.uuid4().hex}"


def mounted_scratch(spark: SparkSession) -> str:
    """``scratch`` as a path that tasks can open; an error where the shared folder is in a store that only Spark reads."""
    path = re.sub(r"^file:/+", "/", scratch(spark))
    if re.match(r"^\w+:", path):
        raise ValueError("files of tasks need a shared folder that is mounted on all nodes")
    return path


def written(df: DataFrame) -> DataFrame:
    """``df``, written to a new path and read from there: what follows sees the same rows, whatever executors are lost."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system and path of ``path``."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _located(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    fs, p = _located(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not be there yet: of two writers the second one gets an error."""
    fs, p = _located(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = _located(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _located(spark, path)
    fs.delete(p, True)

"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a task's writer holds; intermediates are read by whole files, so larger row groups gain nothing.
ROW_GROUP = 1 << 24
_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset (tests on one machine), a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="plait-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    made = f"{folder(spark)}/plait-{name}-{uuid.uuid4().hex[:12]}"
    _made.append(made)
    return made


def write(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written as Parquet and read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    to = path(spark, name)
    df.write.option("compression", compression).option("parquet.block.size", ROW_GROUP).parquet(to)
    until_exit(spark, to)
    return spark.read.schema(df.schema).parquet(to)


def _where(spark: SparkSession, path: str) -> tuple:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, none if there is no such folder."""
    files, where = _where(spark, path)
    return [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    files, where = _where(spark, path)
    files.delete(where, True)


def until_exit(spark: SparkSession, path: str) -> None:
    """Has a folder that is there removed when the driver ends, as results that read it must be written by then."""
    files, where = _where(spark, path)
    files.deleteOnExit(where)


def clear(spark: SparkSession) -> None:
    """Removes all intermediate tables of this session; results that still read them must have been written."""
    while _made:
        remove(spark, _made.pop())

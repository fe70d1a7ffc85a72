"""Cutting lineage in iterations: tables written to the folder that driver and executors share, and removed again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a session whose executor is the driver may go without."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = getattr(spark, "_weftline_dir", None) or "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark._weftline_dir = where
    return where.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that clear() removes."""
    path = f"{shared_dir(spark)}/weft-core-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, written and read back: a lost executor costs no recomputation, and plans stay small."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_bucketed(df: DataFrame, *keys: str, buckets: int) -> DataFrame:
    """As cut(), in files by the hash of keys: what is joined or grouped by them with as many shuffle partitions is not
    shuffled again."""
    path = new_path(df.sparkSession)
    name = f"weft_{path[-32:]}"
    df.write.bucketBy(buckets, *keys).format("parquet").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def drop(df: DataFrame) -> None:
    """Remove what cut() wrote for df, when no later plan reads it."""
    for f in df.inputFiles()[:1]:
        _remove(df.sparkSession, f.rsplit("/", 1)[0])


def clear(spark: SparkSession) -> None:
    """Remove all that this application has cut; results must have been written before."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS weft_{path[-32:]}")
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

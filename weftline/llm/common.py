"""Pieces that several corpus operators share: staging, expression helpers, batch sizing."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the control characters 9 to 13.
WORD = r"[^ \t-\r]+"
GAP = r"[ \t-\r]+"

#: Rows in an Arrow batch and bytes in one; the byte bound keeps very long texts from filling a worker.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.  Only a session whose executor is the
    driver itself (tests) may go without: it gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = getattr(spark, "_weftline_dir", None)
        if where is None:
            where = "file://" + tempfile.mkdtemp(prefix="weftline-")
            spark._weftline_dir = where
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_staged: dict[str, list[str]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_staged(spark: SparkSession) -> None:
    """Remove every table this application has staged; results that still read one must have been written before."""
    for path in _staged.pop(spark.sparkContext.applicationId, []):
        _remove(spark, path)


@contextlib.contextmanager
def staging(spark: SparkSession):
    """What is staged inside goes at the end, but for the tables that the frames in the list it gives still read."""
    mine = _staged.setdefault(spark.sparkContext.applicationId, [])
    begin, kept = len(mine), []
    yield kept
    read = {f.rsplit("/", 2)[-2] for df in kept for f in df.inputFiles()}
    for path in mine[begin:]:
        if path.rsplit("/", 1)[-1] not in read:
            mine.remove(path)
            _remove(spark, path)


def staged_as(spark: SparkSession) -> str:
    """A new path in the shared folder, which clear_staged removes."""
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = staged_as(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*frames: DataFrame) -> None:
    """Remove staged tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for f in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            if path.getName().startswith("weft-"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too, unless the session already has a smaller bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = str(spark.conf.get(key, None) or "").lower().rstrip("b")
    if not have.isdigit() or not 0 < int(have) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, even where body uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"_{name}".lower() in have:
            name = f"_{name}"
        have.add(f"_{name}".lower())
        out.append(f"_{name}")
    return out


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df

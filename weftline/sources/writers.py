"""Sinks: separated text, one ordered file, Parquet, postings by term, write-once statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _lines(df: DataFrame, sep: str) -> DataFrame:
    return df.select(F.concat_ws(sep, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)).alias("value"))


def text(df: DataFrame, path: str, sep: str = "\t", success_file: bool = True) -> None:
    """Fields parted by sep, one row a line, as readers.separated reads them: nothing is quoted, nulls are empty."""
    _lines(df, sep).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(success_file).lower()).text(path)


#: Rows that one file may get.
ONE_FILE = 10_000_000


def single_sorted_text(df: DataFrame, path: str, *order, sep: str = "\t", most: int = ONE_FILE) -> None:
    """One ordered file, for results of bounded size, such as a top-k; more rows than `most` are refused."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows for one file; sort them into ranges instead")
    _lines(df.orderBy(*order), sep).coalesce(1).write.text(path)


def ordered_text(df: DataFrame, path: str, *order, sep: str = "\t") -> None:
    """Any number of rows in one total order: files under path/lines, each a range, in the order of their numbers; and
    path/manifest (part, file, lines, before) with what each holds and how many lines stand before it.  Rows with the same
    keys share a range, so the order should end with a column that tells rows apart.  A field with a line end would be two lines
    and is refused."""
    spark = df.sparkSession
    keyed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    line = _lines(keyed, sep).select(F.when(F.col("value").rlike(r"[\r\n]"), F.raise_error(F.lit("a field holds a line end"))).otherwise(F.col("value")).alias("value"))
    line.write.text(f"{path}/lines")
    name = F.col("_metadata.file_name")
    held = spark.read.text(f"{path}/lines").groupBy(F.regexp_extract(name, r"part-(\d+)", 1).cast("int").alias("part"), name.alias("file")).agg(F.count("*").alias("lines"))
    held.withColumn("before", F.sum("lines").over(Window.orderBy("part")) - F.col("lines")).write.parquet(f"{path}/manifest")


def postings(df: DataFrame, path: str, buckets: int = 256) -> None:
    """An index that a search for a term can prune: Parquet in directories by a hash of the term, sorted by term."""
    keyed = df.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    keyed.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def read_postings(spark, path: str, terms: list[str], buckets: int = 256) -> DataFrame:
    """The rows of some terms, reading only their buckets."""
    found = spark.sql("SELECT pmod(xxhash64(t), :n) AS b FROM (SELECT explode(:terms) AS t)", args={"n": buckets, "terms": list(terms)}) if terms else None
    wanted = [r.b for r in found.collect()] if terms else []
    return spark.read.parquet(path).where(F.col("bucket").isin(wanted) & F.col("term").isin(list(terms))).drop("bucket")


def once(df: DataFrame, path: str) -> None:
    """Write only if nothing is there yet."""
    df.write.mode("ignore").parquet(path)

"""Sources: text lines, wiki pages, tweet CSV, lexicon TSV, and stored tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as tx

TWEET = "class int, tweet_id string, created string, query string, user string, text string"
LEXICON = "term string, score int"
MANIFEST = "part int, file string, lines long, before long"


def text_lines(spark: SparkSession, paths: str | list[str], drop_empty: bool = False) -> DataFrame:
    """(doc_id, line): lines of text files, doc_id the file's name.  Several paths may be joined by commas."""
    each = paths.split(",") if isinstance(paths, str) else paths
    rows = spark.read.text(each).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("line"))
    return rows.where("line <> ''") if drop_empty else rows


def file_count(spark: SparkSession, path: str) -> DataFrame:
    """(n_docs): the number of files, empty ones too, which Spark's own readers leave out."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    n = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getFileCount()
    return spark.range(1).select(F.lit(n).cast("long").alias("n_docs"))


def wiki_pages(lines: DataFrame, column: str = "line") -> DataFrame:
    """(title, body, links) of the lines that have a title, one page a line."""
    page = F.col(column)
    rows = lines.select(tx.title(page).alias("title"), tx.wiki_body(page).alias("body"), tx.wiki_links(page).alias("links"))
    return rows.where("title IS NOT NULL")


def wiki_dump(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(line): the pages of dumps in which a page spans many lines, each as one line that wiki_pages takes; line ends become
    spaces.  Pages end at </page> and begin after the last <page> before it; what stands outside is left out.  A dump is
    read in byte ranges of any size, and a page belongs to the range in which its predecessor's end tag lies or it begins."""
    held = spark.read.option("lineSep", "</page>").text(paths).where(F.contains("value", F.lit("<page>")))
    return held.select(F.regexp_replace(F.substring_index("value", "<page>", -1), r"[\r\n]", " ").alias("line"))


def tweets(spark: SparkSession, paths: str | list[str], malformed: str = "fail") -> DataFrame:
    """Six quoted fields a line; a line of other form stops the read, or with malformed="drop" is left out."""
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED"}[malformed]
    return spark.read.schema(TWEET).option("quote", '"').option("escape", '"').option("mode", mode).csv(paths)


def separated(spark: SparkSession, path: str | list[str], columns: list[str], sep: str = "\t") -> DataFrame:
    """What writers.text writes, read again as strings.  A line with fewer fields than columns is left out, and more fields
    belong to the last."""
    parts = F.split("value", re.escape(sep), len(columns))
    return spark.read.text(path).where(F.size(parts) == len(columns)).select(*(parts[i].alias(c) for i, c in enumerate(columns)))


def stop_words(spark: SparkSession, path: str) -> list[str]:
    """The words of a stop list, one a line or parted by commas or space.  Meant for lists of some hundred words."""
    found = spark.read.text(path).select(F.explode(F.split("value", r"[\s,]+")).alias("w")).where("w <> ''").distinct()
    return sorted(r.w for r in found.collect())


def tweet_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """(class, tweet_id, text) from lines by splitting at commas outside quotes; quotes go from class and id."""
    parts = tx.split_csv(F.col(column))
    return lines.select(
        tx.unquote(F.element_at(parts, 1)).cast("int").alias("class"), tx.unquote(F.element_at(parts, 2)).alias("tweet_id"), F.element_at(parts, 6).alias("text")
    )


def lexicon(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(LEXICON).option("sep", "\t").option("quote", "").csv(paths)


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, line) of what writers.ordered_text wrote, places from 1.  A split of a file is numbered by itself, and begins
    where the lines of the files (by the manifest) and of the splits before it end."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    rows = spark.read.text(f"{path}/lines").select("value", part.alias("part"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"))
    splits = rows.groupBy("part", "at").agg(F.count("*").alias("n"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("at")) - F.col("n")
    starts = splits.select("part", "at", inside.alias("inside")).join(spark.read.schema(MANIFEST).parquet(f"{path}/manifest"), "part")
    place = F.row_number().over(Window.partitionBy("part", "at").orderBy("i")) + F.col("before") + F.col("inside")
    return rows.join(starts, ["part", "at"]).select(place.cast("long").alias("place"), F.col("value").alias("line"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

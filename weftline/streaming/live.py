"""Structured Streaming forms: running word counts, and scoring a stream of texts with a fixed lexicon or model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as tx


def word_counts(stream: DataFrame, text: str = "text", ts: str | None = None, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of boundary tokens; with a time column, in windows that close behind the watermark."""
    keys = []
    if ts:
        stream = stream.withWatermark(ts, watermark)
        keys = [F.window(ts, window).alias("window")]
    lines = stream.select(*([ts] if ts else []), F.explode(tx.lines(F.col(text))).alias("line"))
    words = lines.select(*([ts] if ts else []), F.explode(tx.boundary_tokens(F.col("line"))).alias("term"))
    return words.groupBy(*keys, "term").agg(F.count("*").alias("n"))


def lexicon_scores(stream: DataFrame, entries: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, term, score): lexicon rows met by each text's set of words, by a stream-static join."""
    words = stream.select(id_column, F.explode(F.array_distinct(F.transform(tx.space_tokens(F.col(text)), lambda w: F.lower(w)))).alias("w"))
    return words.join(entries, F.col("w") == F.lower("term")).select(id_column, "term", "score")


def event_windows(stream: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by window and type: count and sum."""
    late = stream.withWatermark("ts", watermark)
    return late.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def term_runs(stream: DataFrame, terms, ts: str = "ts", expiry: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """(term, first, expires, df): how many rows (documents) hold a term, counted anew when it has not been seen for `expiry`.

    terms is an array column; a term counts once a row, null terms and rows without time do not.  As a stream a term's state goes, and its
    row comes, when the watermark passes `expires`; rows that come later than that are left out.  A table gives all rows."""
    seen = stream.withWatermark(ts, watermark).select(ts, F.explode(F.array_distinct(terms)).alias("term")).where(F.col("term").isNotNull() & F.col(ts).isNotNull())
    runs = seen.groupBy(F.session_window(ts, expiry).alias("run"), "term").agg(F.count("*").alias("df"))
    return runs.select("term", F.col("run.start").alias("first"), F.col("run.end").alias("expires"), "df")

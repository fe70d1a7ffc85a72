"""Term statistics, TF-IDF and keyword search: (doc_id, term) tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import tally
from weftline.operators.staging import cut

#: A term with this many times the mean of postings is hot, and at most this many terms are (a broadcast of some MB).
HOT_TIMES = 2
HOT_TERMS = 100_000


def boundary_terms(docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep_empty: bool = False, with_docs: bool = False) -> DataFrame:
    """(doc_id, term): a row for each token of each line.  Tokens are cut to size after they are rows, in generated code.
    with_docs adds one row without term for each document, so that documents are counted where their tokens are."""
    lines = tx.lines(F.col(text))
    if with_docs:
        lines = F.concat(lines, F.array(F.lit(None).cast("string")))
    by_line = docs.select(F.col(id_column).alias("doc_id"), F.explode(lines).alias("line"))
    if with_docs and not keep_empty:
        found = by_line.select("doc_id", F.col("line").isNull().alias("doc"), tx.runs(F.col("line")).alias("runs"), tx.begins_with_word(F.col("line")).alias("word_first"))
        each = found.select("doc_id", "doc", "word_first", F.size("runs").alias("n"), F.posexplode_outer("runs").alias("i", "run"))
        return each.select("doc_id", "doc", tx.bare_run(F.col("run"), F.col("i"), F.col("n"), F.col("word_first")).alias("term")).where("doc OR term <> ''").drop("doc")
    if not keep_empty:
        found = by_line.select("doc_id", tx.runs(F.col("line")).alias("runs"), tx.begins_with_word(F.col("line")).alias("word_first"))
        each = found.select("doc_id", "word_first", F.size("runs").alias("n"), F.posexplode("runs").alias("i", "run"))
        return each.select("doc_id", tx.bare_run(F.col("run"), F.col("i"), F.col("n"), F.col("word_first")).alias("term")).where("term <> ''")
    return by_line.select("doc_id", F.explode(tx.boundary_tokens(F.col("line"), keep_empty)).alias("term"))


def space_terms(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.explode(tx.space_tokens(F.col(text))).alias("term"))


def word_count(terms: DataFrame) -> DataFrame:
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def log_tf(counts: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return counts.select(*ids, "term", (F.log10("n") + 1).alias("tf"))


def doc_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def _hot(frequency: DataFrame) -> DataFrame | None:
    """The terms with far more postings than others, if there are any; HOT_TERMS at most, since each has that share of all."""
    r = frequency.agg(F.sum("df").alias("all"), F.count("*").alias("terms"), F.max("df").alias("most")).first()
    bar = max(HOT_TIMES * (r["all"] or 0) / max(r["terms"], 1), (r["all"] or 0) / HOT_TERMS)
    return frequency.where(F.col("df") > bar) if (r["most"] or 0) > bar else None


def meet(postings: DataFrame, frequency: DataFrame, key: str) -> DataFrame:
    """postings joined with frequency (key, df, ...): those of hot keys are met where they are read and never shuffled by key; all
    others are few for a key."""
    hot = _hot(frequency)
    if hot is None:
        return postings.join(frequency, key)
    known = postings.join(F.broadcast(hot), key, "left")
    cold = known.where("df IS NULL").select(*postings.columns).join(frequency, key)
    return known.where("df IS NOT NULL").unionByName(cold)


def _weighed(counts: DataFrame, n_docs: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    frequency = cut(doc_frequency(counts))
    met = meet(log_tf(counts, ids), frequency, "term")
    idf = F.log10(F.lit(1) + F.expr("n_docs div df"))
    return met.crossJoin(F.broadcast(n_docs)).select(*ids, "term", (F.col("tf") * idf).alias("tfidf"))


def tfidf(counts: DataFrame, n_docs: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """tf x log10(1 + n div df).  counts has a row for each term of a document, which ids tell apart; n_docs is one row with n_docs.

    Counts are written once and read for both, and how terms are joined with their frequency follows from what is found
    there; staging.clear() removes what the result still reads."""
    return _weighed(cut(counts), n_docs, ids)


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    return tfidf(word_count(terms), docs.agg(F.count("*").alias("n_docs")))


def text_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text", asked: Column | None = None) -> DataFrame:
    """index() of boundary tokens in one pass over docs, which counts documents as well: each has a row without term.  (An
    observed metric would count a task's documents twice where a lost executor makes it run again.)  With a condition on
    term, only the postings that meet it."""
    found = tally.counts(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), with_docs=True)
    counts = cut(found if asked is None else found.where(asked | F.col("term").isNull()))
    n_docs = counts.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"))
    return _weighed(counts.where("term IS NOT NULL"), n_docs)


def search_texts(docs: DataFrame, terms: list[str], how: str = "exact", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """search() without an index: only postings of matching terms are counted."""
    return search(text_index(docs, id_column, text, matches(terms, how)), terms, how)


def matches(terms: list[str], how: str = "exact") -> Column:
    """exact: case matters; ignore_case and substring: query terms are trimmed."""
    col = F.col("term")
    if not terms:
        return F.lit(False)
    if how == "exact":
        return col.isin(terms)
    if how == "ignore_case":
        return F.lower(col).isin([t.strip().lower() for t in terms])
    if how == "substring":
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(col, F.lit(t.strip()))
        return hit
    raise ValueError(how)


def search(postings: DataFrame, terms: list[str], how: str = "exact", weight: str = "tfidf") -> DataFrame:
    """(doc_id, score): the sum of the weights of matching postings, each counted once."""
    return postings.where(matches(terms, how)).groupBy("doc_id").agg(F.sum(weight).alias("score"))


def rank(hits: DataFrame, limit: int | None = None, by: str = "score", tie: str = "doc_id") -> DataFrame:
    """Hits by descending score, ties by id; limit gives a top-k."""
    ordered = hits.orderBy(F.desc(by), tie)
    return ordered.limit(limit) if limit else ordered


def positions(hits: DataFrame, by: str = "score", tie: str = "doc_id", tasks: int | None = None) -> DataFrame:
    """Hits with their place, from 1, in the order of rank().  Sorted in ranges; a range's first place is the number of
    hits in those before it, so no task sees more than its range."""
    spark = hits.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(hits.repartitionByRange(n, F.desc(by), tie).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc(by), tie)) + F.col("_before")
    return ranged.join(F.broadcast(before), "_range").withColumn("position", place.cast("long")).drop("_range", "_before")

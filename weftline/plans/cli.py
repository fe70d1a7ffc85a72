"""Command line: python -m weftline.plans.cli PIPELINE IN OUT [WORDS ...] [--stop-words FILE] [--match HOW] [--top K].

`index` adds the texts of IN to the index at OUT, as one more segment; `lookup` searches it as often as wanted, its IN being the OUT
of `index`.  A file may be in one segment only."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph, index, sentiment, staging, store
from weftline.sources import readers, writers


def _terms(spark: SparkSession, path: str) -> DataFrame:
    return index.boundary_terms(readers.text_lines(spark, path), text="line")


def add(spark: SparkSession, path: str, root: str) -> str:
    """The files of path, each a document, as one more segment of the index at root."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))
    return store.add_segment(whole, root, n_docs=readers.file_count(spark, path).first().n_docs)


def pagerank(spark, path, words) -> DataFrame:
    lines = readers.text_lines(spark, path)
    e = graph.edges(lines, "line")
    return index.rank(graph.pagerank(e, graph.nodes(lines, e, "line")).select(F.col("id").alias("doc_id"), F.col("rank").alias("score")))


def wordcount(spark, path, words) -> DataFrame:
    return index.word_count(_terms(spark, path))


def tf(spark, path, words) -> DataFrame:
    return index.log_tf(wordcount(spark, path, words))


def tfidf(spark, path, words) -> DataFrame:
    return index.tfidf(wordcount(spark, path, words), readers.file_count(spark, path))


def search(spark, path, words) -> DataFrame:
    return index.rank(index.search(tfidf(spark, path, words), words))


#: How `lookup` matches words (exact, ignore_case or substring), and how many hits it gives (0: all).
LOOKUP: dict = {"how": "exact", "top": 0}


def lookup(spark, path, words) -> DataFrame:
    """Documents of an index that `index` wrote, ranked; with a top, from the blocks that can hold it."""
    found = store.Stored(spark, path)
    return found.top_k(words, LOOKUP["top"], LOOKUP["how"]) if LOOKUP["top"] else index.rank(found.search(words, LOOKUP["how"]))


def wikisearch(spark, path, words) -> DataFrame:
    pages = readers.wiki_pages(readers.text_lines(spark, path)).select(F.col("title").alias("doc_id"), F.col("body").alias("text"))
    postings = index.tfidf(index.word_count(index.space_terms(pages.where("text IS NOT NULL"))), pages.agg(F.count("*").alias("n_docs")))
    return index.rank(index.search(postings, words, "substring"))


def lexicon(spark, path, words) -> DataFrame:
    return sentiment.lexicon_classify(sentiment.lexicon(readers.lexicon(spark, path.split(","))), words)


#: A path to a stop list; without one, Spark's own English list.
STOP_WORDS: list[str] = []


def _stop_words(spark) -> list[str]:
    if STOP_WORDS:
        return readers.stop_words(spark, STOP_WORDS[0])
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def _tweets(spark, path) -> DataFrame:
    return readers.tweets(spark, path.split(",")).select("tweet_id", "class", "text")


def naivebayes(spark, path, words) -> DataFrame:
    tweets = _tweets(spark, path)
    counts, stats = sentiment.nb_train(tweets, _stop_words(spark))
    asked = spark.createDataFrame([("query", " ".join(words))], "tweet_id string, text string")
    return sentiment.nb_classify(sentiment.nb_model(counts, stats), stats, asked)


def knn(spark, path, words) -> DataFrame:
    return sentiment.knn_class_scores(sentiment.knn_neighbours(sentiment.knn_index(_tweets(spark, path), _stop_words(spark)), words))


def maxent(spark, path, words) -> DataFrame:
    return sentiment.maxent_iterate(sentiment.maxent_init(_tweets(spark, path)))


PIPELINES = {f.__name__: f for f in (pagerank, wordcount, tf, tfidf, search, lookup, wikisearch, lexicon, naivebayes, knn, maxent)}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("pipeline", choices=[*PIPELINES, "index"])
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("words", nargs="*")
    p.add_argument("--stop-words", help="a file of stop words, one a line")
    p.add_argument("--match", choices=["exact", "ignore_case", "substring"], default="exact", help="how lookup matches words")
    p.add_argument("--top", type=int, default=0, help="how many hits lookup gives")
    a = p.parse_args(argv)
    LOOKUP.update(how=a.match, top=a.top)
    STOP_WORDS[:] = [a.stop_words] if a.stop_words else []
    spark = SparkSession.builder.appName(f"weftline-{a.pipeline}").getOrCreate()
    if a.pipeline == "index":
        add(spark, a.input, a.output)
    else:
        writers.text(PIPELINES[a.pipeline](spark, a.input, a.words), a.output)
    staging.clear(spark)


if __name__ == "__main__":
    main()

"""Terms counted text by text, against the tokenizers that are column expressions."""

import random

from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import index, tally

PARTS = ["a", "Wörld", "don't", "x_1", " ", "  ", "\t", "\n", "\r\n", "\r", ",", ". ", " .", "--", "½", "²", "é", "́", "Ⅷ", "中文", "٣", "\x0b", "\f", "!\n\"", " \n ", " ", " ", "😀"]


def _texts(n=400):
    rng = random.Random(5)
    return [(i, "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 2, 5, 30])))) for i in range(n)] + [(n, None), (n + 1, " "), (n + 2, "   "), (n + 3, " a"), (n + 4, "\n \n")]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_same_terms_as_the_column_expressions(spark):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string").repartition(3)
    assert _rows(tally.counts(docs)) == _rows(index.word_count(index.boundary_terms(docs)))
    assert _rows(tally.counts(docs, with_docs=True)) == _rows(index.word_count(index.boundary_terms(docs, with_docs=True)))
    assert _rows(tally.counts(docs, tally.space)) == _rows(index.word_count(index.space_terms(docs)))


def test_rows_of_one_id_are_one(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "b c"), (None, "a"), (None, "a"), (2, "d")], "doc_id int, text string")
    assert _rows(tally.counts(docs)) == _rows(index.word_count(index.boundary_terms(docs)))


def test_tokens_are_not_shuffled(spark, monkeypatch):
    """Ids that tell rows apart need no exchange, and what a task gives on at once is bounded."""
    monkeypatch.setattr(tally, "ROWS", 3)
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"))
    found = tally.counts(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 250 and tx.SPACE[0] == " "


def test_parts_of_cleaned_texts(spark):
    """Counted where they are read, the tokens with empty ones among them are those of the column expression."""
    texts = ["", " ", "   ", "a", " a", "a ", "  a  ", "a b", "a  b", " a b a ", "  a   b  ", "! !", "!a? b", "@x a", "x http://y.z b", None, "A a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    line = tx.clean_tweet(F.col("text"))
    want = df.select("doc_id", line.alias("line")).select("doc_id", F.explode(tx.boundary_tokens(F.col("line"), keep_empty=True)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    got = tally.counts(df, tally.cleaned(parts=tally.parted))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    count = tally.cleaned(folded=True, parts=tally.asked)()
    assert [dict(count(t)) for t in (None, "", "! !", " A a  b ")] == [{}, {"": 1}, {"": 1}, {"": 2, "a": 2, "b": 1}]

"""Measures and verdicts against a direct reading, the cascade in any order, and odd rows."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import quality_rules as qr

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a b c d e f g h i j"), (5, "a b c d e a b c d e"), (6, "w " * 4000), (7, "x" * 3000 + " a b c d e f g h i"), (8, "# $ % & | < > * a b c d e f g h"),
    (9, "one two three\nfour five\none two three\none two three\nsix seven eight nine"), (10, "LOUD WORDS ALL OVER THIS LINE HERE AND THERE AND EVERYWHERE AGAIN"), (11, "a\u00a0b c\u2003d e f g h i j k l m"), (12, "a b c d e f g h i j\n\n\n"),
    (12, "a b c d e f g h i j\n\n\n"), (None, "q r s t u v w x y z " + "\U0001f999 " * 3), (13, "p q r s t u v " * 300 + "end"),
]


def brute(text):
    t = text or ""
    w = re.findall(WORD, t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeat = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    upper = sum(c.isupper() and re.match(r"[^\W\d_]", c) is not None for c in t)
    failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
    kept = not (failed or 2 * symbols > len(w) or chars > 25 * len(w) or (len(lines) >= 4 and 2 * dup > len(lines)) or (chars >= 40 and 2 * upper > chars))
    return len(w), chars, symbols, dup, len(repeat), failed, kept


def test_scores_against_a_direct_reading(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    docs = docs.selectExpr("*", "1 AS _text", "2 AS _words", "3 AS n_words")
    got = Counter(tuple(r) for r in qr.score_documents(docs).collect())
    assert got == Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    kept = qr.filter_documents(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r.doc_id, r.text) for r in docs.collect() if brute(r.text)[-1])


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert qr.score_documents(none).count() == 0 and qr.filter_documents(none).count() == 0
    assert [r for r, _, _ in qr.order_rules(none)] == list(qr.RULES)


def test_verdict_does_not_depend_on_order(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("words", F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+"), ""))
    m = qr.measures(F.coalesce(F.col("text"), F.lit("")), F.col("words"))
    orders = list(itertools.permutations(qr.RULES))[::119]
    rows = docs.select("text", *(qr.cascade(list(o), m).alias(f"o{i}") for i, o in enumerate(orders))).collect()
    assert all(set(r[1:]) == {brute(r.text)[-1]} for r in rows)


def test_order_is_by_rejection_per_cost(spark, monkeypatch):
    rows = [(i, f"{'#' * (i % 2)} " * 5 + " ".join(f"w{j}" for j in range(12))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = qr.order_rules(docs, sample_rows=200)
    assert {r.name for r, _, _ in found} == {r.name for r in qr.RULES}
    shares = {r.name: s for r, s, _ in found}
    assert shares["few_words"] == 0 and 0.3 < shares["symbols"] < 0.7 or shares["symbols"] == 0
    worth = [-(s + 1e-3) / c for _, s, c in found]
    assert worth == sorted(worth) and all(c >= qr.LEAST_COST for _, _, c in found)
    # costs are counted, so the order is the same whenever it is asked for
    assert all(qr.order_rules(docs, sample_rows=200) == found for _ in range(2))
    # with the measures at hand, a rule that needs only them costs a comparison
    have = {r.name: c for r, _, c in qr.order_rules(docs, sample_rows=200, have=qr.MEASURES)}
    assert have["repeated_windows"] == qr.LEAST_COST < {r.name: c for r, _, c in found}["repeated_windows"]


@pytest.mark.parametrize("text", ["a b c d e f", "a a a a a a a", "a b c d e x a b c d e", "x " * 9])
def test_repeat_words(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(qr.repeat_words(F.split(F.trim("t"), " ")).alias("n")).first()
    assert row.n == brute(text)[4]

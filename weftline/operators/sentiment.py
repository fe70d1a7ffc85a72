"""Short-text sentiment: lexicon scores, Naive Bayes, TF-IDF neighbours and the maximum-entropy update."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weftline.functions import text as tx
from weftline.operators import index, neighbours, tally
from weftline.operators.staging import cut

CLASSES = (0, 2, 4)
NEIGHBOURS = 30
#: Steps of the maximum-entropy update whose moves are looked at in one job.
STEPS_AT_ONCE = 10


def lexicon(entries: DataFrame) -> DataFrame:
    """Distinct (term, score); a term may keep several scores."""
    return entries.select("term", "score").dropDuplicates(["score", "term"])


def lexicon_classify(entries: DataFrame, words: list[str]) -> DataFrame:
    """(avg_score, label): the mean score of the lexicon's rows for the set of words; nothing if none is known."""
    wanted = sorted({w.lower() for w in words})
    hit = entries.where(F.lower("term").isin(wanted) if wanted else F.lit(False))
    mean = hit.agg(F.avg("score").alias("avg_score")).where("avg_score IS NOT NULL")
    label = F.when(F.col("avg_score") > 1, "positive").when(F.col("avg_score") < -1, "negative").otherwise("neutral")
    return mean.select("avg_score", label.alias("label"))


def _known_words(tweets: DataFrame, stop_words: list[str], at_only: bool, ignore_case: bool) -> DataFrame:
    cleaned = tweets.select("tweet_id", "class", tx.clean_tweet(F.col("text"), at_only).alias("text"))
    words = cleaned.select("tweet_id", "class", F.explode(tx.space_tokens(F.col("text"))).alias("word"))
    key = F.lower("word") if ignore_case else F.col("word")
    return words.where(~key.isin([w.lower() if ignore_case else w for w in stop_words]) if stop_words else F.lit(True))


def without_stop_words(tokens: DataFrame, stop_words: list[str], ignore_case: bool, column: str = "word") -> DataFrame:
    key = F.lower(column) if ignore_case else F.col(column)
    return tokens.where(~key.isin([w.lower() if ignore_case else w for w in stop_words]))


def nb_words(tweets: DataFrame, stop_words: list[str]) -> DataFrame:
    """(tweet_id, class, word) of cleaned tweets without stop words, whatever their case."""
    return _known_words(tweets, stop_words, at_only=True, ignore_case=True)


def _by_word(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(*(F.count_if(F.col("class") == c).alias(f"c{c}") for c in CLASSES))


def _three_rows(by_word: DataFrame) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"c{c}").alias("n")) for c in CLASSES))
    return by_word.select("word", F.explode(rows).alias("x")).select("word", "x.class", "x.n")


def nb_counts(words: DataFrame) -> DataFrame:
    """(word, class, n): three rows a word, zeros included."""
    return _three_rows(_by_word(words))


def nb_stats(tweets: DataFrame, words: DataFrame) -> DataFrame:
    """One row: tweets and words in all and by class, and the size of the vocabulary.  Words are summed from the counts of
    nb_counts, whose shuffle is read again, so that texts are split once."""
    names = ((4, "positive"), (2, "neutral"), (0, "negative"))
    t = tweets.agg(F.count("*").alias("total_tweets"), *(F.count_if(F.col("class") == c).alias(f"{n}_tweets") for c, n in names))
    w = _by_word(words).agg(F.count("word").alias("vocabulary"), *(F.coalesce(F.sum(f"c{c}"), F.lit(0)).alias(f"{n}_words") for c, n in names))
    return t.crossJoin(w)


def nb_train(tweets: DataFrame, stop_words: list[str]) -> tuple[DataFrame, DataFrame]:
    """nb_counts and nb_stats of tweets from one pass: each tweet has one row without word, which the counts by word gather
    under no word.  Those counts are written; staging.clear() removes what the results still read."""
    each = tally.rows(tweets, tally.cleaned(at_only=True), ("class",), with_docs=True).withColumnRenamed("term", "word")
    stop = F.lower("word").isin([w.lower() for w in stop_words]) if stop_words else F.lit(False)
    known = each.where(F.col("word").isNull() | ~stop)
    found = cut(known.groupBy("word").agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias(f"c{c}") for c in CLASSES)))
    names = ((4, "positive"), (2, "neutral"), (0, "negative"))
    tweet, word = F.col("word").isNull(), F.col("word").isNotNull()
    total = lambda of, c: F.coalesce(F.sum(F.when(of, F.col(c))), F.lit(0))
    stats = found.agg(
        total(tweet, "n").alias("total_tweets"), *(total(tweet, f"c{c}").alias(f"{n}_tweets") for c, n in names), F.count("word").alias("vocabulary"), *(total(word, f"c{c}").alias(f"{n}_words") for c, n in names)
    )
    return _three_rows(found.where("word IS NOT NULL")), stats


def _of_class(stats: str) -> Column:
    return F.when(F.col("class") == 4, F.col(f"positive_{stats}")).when(F.col("class") == 2, F.col(f"neutral_{stats}")).otherwise(F.col(f"negative_{stats}"))


def nb_model(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """(word, class, p) with add-one smoothing over the vocabulary."""
    p = (F.col("n") + 1) / (F.col("vocabulary") + _of_class("words"))
    return counts.crossJoin(F.broadcast(stats)).select("word", "class", p.alias("p"))


def nb_scores(model: DataFrame, stats: DataFrame, tweets: DataFrame, at_only: bool = True) -> DataFrame:
    """(tweet_id, class, probability, log_probability): prior times the product over the words of each tweet, matched without
    case.  The product of a long text may be too small for a double, its logarithm never is.  Unknown words are passed over; a
    tweet without known words has no row, and a class without tweets has probability 0 and no logarithm."""
    words = tally.rows(tweets, tally.cleaned(at_only, folded=True), ("tweet_id",)).withColumnRenamed("term", "w")
    # one row a word, whatever its cases and classes; several rows of a model are factors each
    lp = [F.sum(F.when(F.col("class") == c, F.ln("p"))).alias(f"lp{c}") for c in CLASSES]
    known = model.groupBy(F.coalesce(F.lower("word"), F.lit("")).alias("w")).agg(*lp)
    sums = words.join(known, "w").groupBy("tweet_id").agg(*(F.sum(F.col("n") * F.col(f"lp{c}")).alias(f"lp{c}") for c in CLASSES))
    rows = F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"lp{c}").alias("lp")) for c in CLASSES))
    logs = sums.select("tweet_id", F.explode(rows).alias("x")).select("tweet_id", "x.class", "x.lp").where("lp IS NOT NULL")
    prior = _of_class("tweets") / F.col("total_tweets")
    log = logs.crossJoin(F.broadcast(stats)).select("tweet_id", "class", (F.ln(prior) + F.col("lp")).alias("log_probability"))
    return log.select("tweet_id", "class", F.coalesce(F.exp("log_probability"), F.lit(0.0)).alias("probability"), "log_probability")


def nb_classify(model: DataFrame, stats: DataFrame, tweets: DataFrame) -> DataFrame:
    """(tweet_id, class, probability, log_probability) of the best class, the lower one on ties; (-1, 0.0, null) where no word is known."""
    order = F.struct(F.col("log_probability"), (-F.col("class")).alias("c"))
    best = nb_scores(model, stats, tweets).where("log_probability IS NOT NULL").groupBy("tweet_id").agg(F.max_by(F.struct("class", "probability", "log_probability"), order).alias("b"))
    known = tweets.select("tweet_id").distinct().join(best, "tweet_id", "left")
    return known.select("tweet_id", F.coalesce("b.class", F.lit(-1)).alias("class"), F.coalesce("b.probability", F.lit(0.0)).alias("probability"), "b.log_probability")


def knn_index(tweets: DataFrame, stop_words: list[str]) -> DataFrame:
    """(tweet_id, class, term, tfidf) of cleaned tweets, stop words dropped case by case."""
    ids = ("tweet_id", "class")
    counts = tally.counts(tweets, tally.cleaned(), ids)
    if stop_words:
        counts = counts.where(~F.col("term").isin(stop_words))
    return index.tfidf(counts, tweets.agg(F.count("*").alias("n_docs")), ids)


def knn_neighbours(postings: DataFrame, terms: list[str], k: int = NEIGHBOURS) -> DataFrame:
    """(tweet_id, class, score): the k tweets with the greatest sum of weights of the terms."""
    hits = postings.where(index.matches(terms, "ignore_case")).groupBy("tweet_id", "class").agg(F.sum("tfidf").alias("score"))
    return hits.orderBy(F.desc("score"), "tweet_id", "class").limit(k)


def knn_all(postings: DataFrame, asked: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(asked_id, tweet_id, class, score): knn_neighbours for every row of asked (asked_id, terms) at once.

    A row's terms are matched without case, each once; scores are rounded to six digits, ties go to the lower tweet_id, then
    class.  Rows that share no term with any tweet, null or empty ones too, have no neighbours.  asked_id tells rows apart;
    rows of one id are one.  What is written stays until staging.clear().  See `neighbours`."""
    weights = postings.select("tweet_id", "class", F.lower("term").alias("word"), F.col("tfidf").alias("w"))
    words = asked.select("asked_id", F.explode("terms").alias("t")).select("asked_id", F.lower(F.trim("t")).alias("word")).distinct()
    return neighbours.best(weights, cut(words.where("word IS NOT NULL")), k)


def knn_class_scores(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("class").agg(F.sum("score").alias("score"))


def knn_classify(class_scores: DataFrame) -> DataFrame:
    return class_scores.orderBy(F.desc("score"), "class").limit(1)


def maxent_init(tweets: DataFrame) -> DataFrame:
    """(tweet_id, class, word, f, lambda): each word's count in its cleaned tweet, weight zero.  Empty tokens between
    words are words here."""
    counts = tally.counts(tweets, tally.cleaned(parts=tally.parted), ("tweet_id", "class"))
    return counts.select("tweet_id", "class", F.col("term").alias("word"), F.col("n").cast("double").alias("f"), F.lit(0.0).alias("lambda"))


def _delta() -> Column:
    tweet = Window.partitionBy("tweet_id")
    return F.sum("f").over(tweet) / F.sum(F.col("f") * math.exp(-2)).over(tweet)


def maxent_step(rows: DataFrame) -> DataFrame:
    """Every weight grows by sum(f) / sum(f x p), p = exp(x) / exp(x + 2), x = sum(f x lambda) of the tweet.  The quotient is
    taken of the exponents, so that it is exact for texts of any length, where exp(x) is beyond a double."""
    return rows.withColumn("lambda", F.col("lambda") + _delta())


def maxent_iterate(rows: DataFrame, iterations: int = 1) -> DataFrame:
    return reduce(lambda df, _: maxent_step(df), range(iterations), rows)


def maxent_moves(rows: DataFrame) -> DataFrame:
    """rows with _delta, by which every step moves a weight: counts do not change, and p is the same in all steps.  So tweets
    are gathered once, for any number of steps and errors.  They are written; staging.clear() removes them."""
    return cut(rows.withColumn("_delta", _delta()))


def maxent_until(moves: DataFrame, error: float, most: int = 100) -> DataFrame:
    """Steps over maxent_moves until none moves a weight by more than the allowed error, or `most` of them.  The largest moves of
    STEPS_AT_ONCE steps are looked at together, in weights and moves alone."""
    after = [F.col("lambda")]
    while len(after) <= most:
        begin = len(after)
        for _ in range(min(STEPS_AT_ONCE, most + 1 - begin)):
            after.append(after[-1] + F.col("_delta"))
        moved = moves.agg(*(F.max(F.abs(after[i] - after[i - 1])).alias(f"m{i}") for i in range(begin, len(after)))).first()
        met = next((i for i in range(begin, len(after)) if not (moved[f"m{i}"] or 0.0) > error), None)
        if met is not None:
            after = after[: met + 1]
            break
    return moves.withColumn("lambda", after[-1]).drop("_delta")


def maxent_converged(rows: DataFrame, error: float, most: int = 100) -> DataFrame:
    """Steps until none moves a weight by more than the allowed error, or `most` of them."""
    return maxent_until(maxent_moves(rows), error, most)


def maxent_records(rows: DataFrame) -> DataFrame:
    """(tweet_id, records): a tweet's words with their class, count and weight."""
    return rows.groupBy("tweet_id").agg(F.sort_array(F.collect_list(F.struct("word", "class", "f", "lambda"))).alias("records"))


def parsed_sum(rows: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Sums of the values that are numbers, by key; and the rows whose values are not, as they are."""
    number = F.col(value).try_cast("double")
    return rows.where(number.isNotNull()).groupBy(key).agg(F.sum(number).alias("total")), rows.where(number.isNull() & F.col(value).isNotNull())


def record_count(rows: DataFrame) -> DataFrame:
    """(records): how many records there are, whatever tweet they are of."""
    return rows.agg(F.count("*").alias("records"))

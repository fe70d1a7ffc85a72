"""Hand-sized goldens of the operators (FIXTURES.md)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import graph, index, sentiment, staging
from weftline.sources import readers, writers

DOCS = [("d1", "a b a"), ("d2", "a c"), ("d3", "b b b d")]


def column(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", expression(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_boundary_tokens(spark):
    got = column(spark, ["Hello, world!", "don't", "foo_bar", "   ", "", "a , . b", "b!  ", "wörld été"], tx.boundary_tokens)
    assert got == [["Hello", ",", "world", "!"], ["don", "'", "t"], ["foo_bar"], ["   "], [], ["a", ", .", "b"], ["b", "!  "], ["wörld", "été"]]
    assert column(spark, ["a b", "a", ""], lambda c: tx.boundary_tokens(c, keep_empty=True)) == [["a", "", "b"], ["a"], []]


def test_space_tokens(spark):
    assert column(spark, ["a b  c ", "", "  ", " a", None], tx.space_tokens) == [["a", "b", "", "c"], [""], [], ["", "a"], [""]]


def test_cleaners(spark):
    t = ["@rivergate http://q.io/7k - Oh well, that's", "http://x.co/a?b=c"]
    assert [x.split() for x in column(spark, t, tx.clean_tweet)] == [["Oh", "well", "thats"], ["bc"]]
    assert column(spark, t, lambda c: tx.clean_tweet(c, at_only=True))[0].split() == ["rivergate", "Oh", "well", "thats"]


def test_links(spark):
    df = spark.createDataFrame([("<title>T</title>[[A]] [[B|x]] [[]] [[C [[D]]",), ("[[no title]]",)], "line string")
    assert sorted(r.dst for r in graph.edges(df, "line").collect()) == ["A", "B|x", "C D"]
    assert graph.edges(df, "line", keep_empty=True).count() == 4


def test_wiki_page(spark):
    df = spark.createDataFrame([("x <title>T</title> <text a='b'>1 &lt;b&gt;2&lt;/b&gt; &amp;lt;</text>",)], "line string")
    r = readers.wiki_pages(df).first()
    assert (r.title, r.body) == ("T", "1 2 &lt;")
    odd = ["&eacute;&#233;&#xE9; &nope; &amp;lt; &#55296;", "<i>", None, "a & b &amp", "&#128512;&euro;&apos;&", ""]
    assert column(spark, odd, tx.unescape_html) == ["ééé &nope; &lt; &#55296;", "<i>", None, "a & b &amp", "\U0001f600€&apos;&", ""]
    df = spark.createDataFrame([("<title>T</title><text>&eacute;&lt;i&gt;x</text>",)], "line string")
    assert readers.wiki_pages(df).first().body == "éx"


def test_boundary_tokens_as_java_splits(spark):
    """The same as splitting at word boundaries with the space around them, for every line of a small alphabet."""
    import itertools

    lines = ["".join(x) for n in range(6) for x in itertools.product("aé ,\t", repeat=n)]
    parts = F.split("t", r"\s*\b\s*")
    rows = spark.createDataFrame([(t,) for t in lines], "t string").select("t", parts.alias("p"), tx.boundary_tokens(F.col("t")).alias("some"), tx.boundary_tokens(F.col("t"), keep_empty=True).alias("every")).collect()
    for r in rows:
        kept = list(r.p)
        while kept and not kept[-1]:
            kept.pop()
        assert (r.some, r.every) == ([w for w in r.p if w], kept), repr(r.t)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id int, text string")
    terms = index.word_count(index.boundary_terms(rows)).collect()
    want = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id int, t string").select("doc_id", F.explode(tx.boundary_tokens(F.col("t"))).alias("term")).groupBy("doc_id", "term").count().collect()
    assert {tuple(r) for r in terms} == {tuple(r) for r in want}
    import time

    long = spark.createDataFrame([("x" + " " * 200_000 + "y",)], "t string").select(tx.boundary_tokens(F.col("t")).alias("w"))
    began = time.time()
    assert long.first().w == ["x", "y"] and time.time() - began < 10


def test_plans_read_texts_once(spark, monkeypatch):
    """One scan of documents in all in the TF-IDF family, one of documents and of labels for the Naive Bayes model."""
    from weftline.operators import staging
    from weftline.plans import catalog

    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString())
        return staging.cut(df)

    for module in (index, sentiment):
        monkeypatch.setattr(module, "cut", noted)
    for run, tables in ((catalog.tfidf, 1), (catalog.search_substring, 1), (catalog.nb_model, 2)):
        plans.clear()
        df = run(spark, "/root/testdata/sf0.001")
        noted(df)
        assert "".join(plans).count("/root/testdata") == tables


def test_hubs_of_a_graph(spark, monkeypatch):
    pairs = [("hub", f"n{i}") for i in range(40)] * 2 + [(f"n{i}", "hub") for i in range(0, 40, 3)] + [("n1", "n2"), ("n1", "n2")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = graph.endpoints(edges)
    want = {r.id: r.rank for r in graph.pagerank(edges, nodes, 7).collect()}
    monkeypatch.setattr(graph, "LINKS_OF_KEY", 5)
    monkeypatch.setattr(graph, "HUBS", 20)
    got = {r.id: r.rank for r in graph.pagerank(edges, nodes, 7).collect()}
    rank, out = {n: 1 / len(want) for n in want}, {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    for _ in range(7):
        into = dict.fromkeys(want, 0.0)
        for a, bs in out.items():
            for b in bs:
                into[b] += rank[a] / len(bs)
        rank = {n: 0.15 + 0.85 * x for n, x in into.items()}
    assert got == pytest.approx(rank) and want == pytest.approx(rank)


def test_without_the_corpus_operators(monkeypatch):
    import importlib.util

    import __spark_entry__ as e

    from weftline.plans import catalog

    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None)
    assert e.queries() == catalog.QUERIES and e.oracle_sql() == catalog.ORACLES


def test_positions(spark):
    hits = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "doc_id long, score double")
    got = sorted((r.position, r.doc_id) for r in index.positions(hits, tasks=6).collect())
    assert got == [(n + 1, i) for n, (_, i) in enumerate(sorted((-float(i % 7), i) for i in range(500)))]
    assert index.positions(hits.limit(0)).count() == 0


def test_stop_list_and_malformed_lines(spark, tmp_path):
    (tmp_path / "stop").write_text("the,of\nand  to\n\nthe\n")
    assert readers.stop_words(spark, str(tmp_path / "stop")) == ["and", "of", "the", "to"]
    (tmp_path / "t.csv").write_text('"0","1","Mon","NO_QUERY","u","fine"\n"oops"\n"4","2","Tue","q","v","too"\n')
    assert sorted(r.text for r in readers.tweets(spark, str(tmp_path / "t.csv"), malformed="drop").collect()) == ["fine", "too"]
    (tmp_path / "s").write_text("a#####b#####c\nnone\n\nx#####\n")
    assert sorted(tuple(r) for r in readers.separated(spark, str(tmp_path / "s"), ["k", "v"], "#####").collect()) == [("a", "b#####c"), ("x", "")]
    with pytest.raises(ValueError):
        writers.single_sorted_text(spark.range(5), str(tmp_path / "one"), "id", most=4)


def test_tfidf_and_search(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    found = index.index(docs, index.boundary_terms(docs))
    got = {(r.term, r.doc_id): r.tfidf for r in found.collect()}
    want = {("a", "d1"): 0.391649054, ("a", "d2"): 0.301029996, ("b", "d1"): 0.301029996, ("b", "d3"): 0.444657805, ("c", "d2"): 0.602059991, ("d", "d3"): 0.602059991}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in want)
    ranked = [(r.doc_id, round(r.score, 9)) for r in index.rank(index.search(found, ["a", "d"])).collect()]
    assert ranked == [("d3", 0.602059991), ("d1", 0.391649054), ("d2", 0.301029996)]
    assert index.search(found, [], "exact").count() == 0 and index.search(found, [" A"], "ignore_case").count() == 2
    assert [r.doc_id for r in index.rank(index.search(found, ["a", "d"]), 1).collect()] == ["d3"]
    again = index.index(docs.repartition(3), index.boundary_terms(docs.repartition(3)))
    assert {(r.term, r.doc_id): r.tfidf for r in again.collect()} == got


def test_pagerank(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("B", "C"), ("C", "A"), ("D", "E")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "ABCDEF"], "id string")
    want = {
        1: dict(A=0.291666667, B=0.220833333, C=0.3625, D=0.15, E=0.291666667, F=0.15), 2: dict(A=0.458125, B=0.273958333, C=0.461666667, D=0.15, E=0.2775, F=0.15),
        10: dict(A=0.966788609, B=0.545837597, C=0.995187783, D=0.15, E=0.2775, F=0.15),
    }
    for steps, ranks in want.items():
        got = {r.id: r.rank for r in graph.pagerank(edges, nodes, steps).collect()}
        assert got == pytest.approx(ranks, abs=1e-8)


def test_naive_bayes(spark):
    tweets = spark.createDataFrame([(1, 4, "good great day"), (2, 4, "good fun"), (3, 0, "bad day"), (4, 0, "sad bad rain")], "tweet_id int, class int, text string")
    words = sentiment.nb_words(tweets, [])
    stats, counts = sentiment.nb_stats(tweets, words), sentiment.nb_counts(words)
    s = stats.first()
    assert (s.vocabulary, s.positive_words, s.negative_words, s.neutral_words, s.total_tweets) == (7, 5, 5, 0, 4)
    model = sentiment.nb_model(counts, stats)
    total = {r["class"]: r.s for r in model.groupBy("class").agg(F.sum("p").alias("s")).collect()}
    assert total == pytest.approx({0: 1, 2: 1, 4: 1})
    asked = spark.createDataFrame([("q", "Good day"), ("none", "zzz")], "tweet_id string, text string")
    got = {r.tweet_id: (r["class"], round(r.probability, 9)) for r in sentiment.nb_classify(model, stats, asked).collect()}
    assert got == {"q": (4, 0.020833333), "none": (-1, 0.0)}
    scores = {r["class"]: round(r.probability, 9) for r in sentiment.nb_scores(model, stats, asked).collect()}
    assert scores == {0: 0.006944444, 4: 0.020833333, 2: 0.0}


def test_lexicon(spark):
    entries = sentiment.lexicon(spark.createDataFrame([("happy", 3), ("sad", -2), ("meh", 0), ("happy", 3)], "term string, score int"))
    ask = lambda *w: [(r.avg_score, r.label) for r in sentiment.lexicon_classify(entries, list(w)).collect()]
    assert ask("happy") == [(3.0, "positive")] and ask("sad") == [(-2.0, "negative")] and ask("happy", "SAD") == [(0.5, "neutral")]
    assert ask("happy", "happy") == [(3.0, "positive")] and ask("zzz") == [] and ask() == []


def test_knn_and_maxent(spark):
    tweets = spark.createDataFrame([(i, 4 if i % 3 else 0, f"word w{i} common common") for i in range(50)], "tweet_id int, class int, text string")
    near = sentiment.knn_neighbours(sentiment.knn_index(tweets, ["word"]), ["COMMON"])
    assert near.count() == 30 and [r.tweet_id for r in near.collect()] == list(range(30))
    scores = sentiment.knn_class_scores(near)
    assert sentiment.knn_classify(scores).first()["class"] == 4
    rows = sentiment.maxent_iterate(sentiment.maxent_init(tweets))
    assert {round(r["lambda"], 9) for r in rows.collect()} == {round(math.e**2, 9)}
    assert len(sentiment.maxent_records(rows).first().records) >= 3
    total, other = sentiment.parsed_sum(spark.createDataFrame([("a", "1.5"), ("a", "x"), ("a", "2")], "k string, v string"), "k", "v")
    assert total.first().total == 3.5 and other.first().v == "x"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("the cat\n\nthe dog\n")
    (tmp_path / "in/b.txt").write_text("")
    lines = readers.text_lines(spark, str(tmp_path / "in"))
    assert sorted((r.doc_id, r.line) for r in lines.collect()) == [("a.txt", ""), ("a.txt", "the cat"), ("a.txt", "the dog")]
    assert readers.text_lines(spark, str(tmp_path / "in"), drop_empty=True).count() == 2
    assert readers.file_count(spark, str(tmp_path / "in")).first().n_docs == 2
    (tmp_path / "t.csv").write_text('"0","1","Mon","NO_QUERY","u","a, ""b"" c"\n"4","2","Tue","q","v","plain"\n')
    assert [(r["class"], r.tweet_id, r.text) for r in readers.tweets(spark, str(tmp_path / "t.csv")).collect()] == [(0, "1", 'a, "b" c'), (4, "2", "plain")]
    (tmp_path / "lex.tsv").write_text("can't stand\t-3\ngood\t3")
    assert readers.lexicon(spark, str(tmp_path / "lex.tsv")).count() == 2
    counts = index.word_count(index.boundary_terms(lines, text="line"))
    writers.postings(counts, str(tmp_path / "p"), 8)
    assert {r.term for r in writers.read_postings(spark, str(tmp_path / "p"), ["cat", "the"], 8).collect()} == {"cat", "the"}
    writers.single_sorted_text(counts, str(tmp_path / "one"), F.desc("n"), "term")
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    writers.once(counts, str(tmp_path / "stats"))
    writers.once(counts.limit(0), str(tmp_path / "stats"))
    assert spark.read.parquet(str(tmp_path / "stats")).count() == 3
    writers.text(counts, str(tmp_path / "text"), success_file=False)
    assert not (tmp_path / "text/_SUCCESS").exists()


def test_cli_search(spark, tmp_path):
    from weftline.plans import cli

    (tmp_path / "in").mkdir()
    for n, t in DOCS:
        (tmp_path / f"in/{n}").write_text(t)
    got = [r.doc_id for r in cli.search(spark, str(tmp_path / "in"), ["a", "d"]).collect()]
    assert got == ["d3", "d1", "d2"]
    cli.main(["index", str(tmp_path / "in"), str(tmp_path / "postings")])
    cli.main(["lookup", str(tmp_path / "postings"), str(tmp_path / "found"), "a", "d"])
    assert [r.k for r in readers.separated(spark, str(tmp_path / "found"), ["k", "v"]).collect()] == ["d3", "d1", "d2"]
    (tmp_path / "more").mkdir()
    (tmp_path / "more/d4").write_text("Abc abc d\nd")
    (tmp_path / "more/d5").write_text("")
    cli.main(["index", str(tmp_path / "more"), str(tmp_path / "postings")])
    cli.main(["lookup", str(tmp_path / "postings"), str(tmp_path / "parts"), "abc", "--match", "substring"])
    assert [r.k for r in readers.separated(spark, str(tmp_path / "parts"), ["k", "v"]).collect()] == ["d4"]
    cli.main(["lookup", str(tmp_path / "postings"), str(tmp_path / "best"), "A", "d", "--match", "ignore_case", "--top", "2"])
    best = readers.separated(spark, str(tmp_path / "best"), ["k", "v"]).collect()
    tie = round((1 + math.log10(2)) * math.log10(1 + 5 // 2), 6)
    assert [(r.k, float(r.v)) for r in best] == [("d1", tie), ("d4", tie)]
    (tmp_path / "w").write_text("<title>A</title>[[B]]\n<title>B</title>[[A]] [[A]]\n")
    assert {r.doc_id for r in cli.pagerank(spark, str(tmp_path / "w"), []).collect()} == {"A", "B"}


def test_streams(spark, tmp_path):
    from weftline.streaming import live

    spark.createDataFrame([(1, "The cat the"), (2, "dog")], "doc_id int, text string").write.parquet(str(tmp_path / "d"))
    stream = lambda: spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "d"))
    q = live.word_counts(stream()).writeStream.outputMode("complete").format("memory").queryName("wc").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.term, r.n) for r in spark.table("wc").collect()} == {("The", 1), ("the", 1), ("cat", 1), ("dog", 1)}
    lex = spark.createDataFrame([("the", 2)], "term string, score int")
    q = live.lexicon_scores(stream(), lex).writeStream.outputMode("append").format("memory").queryName("lex").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.doc_id, r.score) for r in spark.table("lex").collect()] == [(1, 2)]


def _rank_edges(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(300)] + [("hub", f"n{i % 40}") for i in range(60)] + [("n1", "end")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    return pairs, edges, graph.endpoints(edges)


@pytest.mark.parametrize("per_key", [100_000, 5])
def test_pagerank_shuffles_links_once(spark, monkeypatch, per_key):
    """After the layout, the only exchanges of a run are those of what links carry (and, with hubs, of what nodes give)."""
    monkeypatch.setattr(graph, "LINKS_OF_KEY", per_key)
    monkeypatch.setattr(graph, "HUBS", 1000)
    monkeypatch.setattr(graph, "CUT_EVERY", 100)
    _, edges, nodes = _rank_edges(spark)
    lines = graph.pagerank(edges, nodes, 10)._jdf.queryExecution().executedPlan().toString().splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(exchanges) == (10 if per_key > 5 else 20)
    carried = [i for i in exchanges if "HashAggregate(keys=[dst" in lines[i + 1]]
    given = [i for i in exchanges if "Generate explode" in "".join(lines[i + 1 : i + 3])]
    assert len(carried) == 10 and len(carried) + len(given) == len(exchanges)


def test_pagerank_fixed_point(spark):
    """Nodes that wait change the ranks by less than what the docstring allows; a run that ends early is cut at a step."""
    pairs, edges, nodes = _rank_edges(spark)
    names = sorted({x for p in pairs for x in p})
    out = {n: [b for a, b in pairs if a == n] for n in names}
    exact = dict.fromkeys(names, 0.0)
    for _ in range(400):
        new = dict.fromkeys(names, 0.15)
        for n in names:
            for t in out[n]:
                new[t] += 0.85 * exact[n] / len(out[n])
        exact = new
    for error in (1e-2, 1e-6):
        got = {r.id: r["rank"] for r in graph.pagerank_converged(edges, nodes, error).collect()}
        assert got.keys() == exact.keys()
        assert sum(abs(got[n] - exact[n]) for n in names) <= len(names) * error * 0.85 / 0.15
    assert [r["rank"] for r in graph.pagerank_converged(edges, nodes, 1.0).collect()] == pytest.approx([0.15] * len(names))
    assert graph.pagerank_converged(edges.limit(0), nodes.limit(0)).count() == 0


def test_index_counts_documents_in_its_pass(spark, monkeypatch):
    rows = [("d1", "a b a\n\n c"), ("d2", ""), ("d3", None), ("d4", "a a\r\na"), ("d4", "z"), ("d5", "  ,"), (None, "a")] + [(f"e{i}", f"a w{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    plain = lambda df: sorted(((r.doc_id, r.term, round(r.tfidf, 9)) for r in df.collect()), key=repr)
    want = plain(index.index(docs, index.boundary_terms(docs)))
    assert len(want) > 100 and plain(index.text_index(docs)) == want
    monkeypatch.setattr(index, "HOT_TIMES", 2)  # now one term is met without a shuffle, others stay whole
    hot = index._hot(index.doc_frequency(index.word_count(index.boundary_terms(docs))))
    assert [r.term for r in hot.collect()] == ["a"] and plain(index.text_index(docs)) == want
    assert sorted((r.doc_id, round(r.score, 9)) for r in index.search_texts(docs, ["w3", "z"]).collect()) == sorted((d, w) for d, t, w in want if t in ("w3", "z"))
    assert index.text_index(docs.limit(0)).count() == 0 and index.search_texts(docs, []).count() == 0


def test_naive_bayes_of_long_texts(spark):
    """A product of 2,000 probabilities is no double; its logarithm still tells the classes apart."""
    tweets = spark.createDataFrame([("1", 4, "good great day " * 50), ("2", 0, "bad day " * 50), ("3", 2, None), ("4", 2, "")], "tweet_id string, class int, text string")
    counts, stats = sentiment.nb_train(tweets, [])
    words = sentiment.nb_words(tweets, [])
    assert stats.collect() == sentiment.nb_stats(tweets, words).collect()
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, sentiment.nb_counts(words).collect()))
    asked = spark.createDataFrame([("a", "good day " * 1000), ("b", "bad " * 3000), ("c", "zzz"), ("d", None)], "tweet_id string, text string")
    got = {r.tweet_id: r for r in sentiment.nb_classify(sentiment.nb_model(counts, stats), stats, asked).collect()}
    assert got["a"]["class"] == 4 and got["b"]["class"] == 0 and got["a"].probability == 0.0 and got["a"].log_probability < -1000
    assert got["c"]["class"] == -1 and got["c"].log_probability is None


def test_maxent_stops_at_its_error(spark):
    rows = sentiment.maxent_init(spark.createDataFrame([("1", 4, "w " * 3000 + "x y")], "tweet_id string, class int, text string"))
    step = math.exp(2)
    for error, steps in ((8.0, 1), (1.0, 5), (math.inf, 1)):
        assert {round(r["lambda"], 6) for r in sentiment.maxent_converged(rows, error, 5).collect()} == {round(step * steps, 6)}
    assert sentiment.maxent_converged(rows.limit(0), 1.0).count() == 0


def test_maxent_gathers_tweets_once(spark, monkeypatch):
    """However many steps there are, rows are written once, and what the steps read is not shuffled."""
    rows = sentiment.maxent_init(spark.createDataFrame([(str(i), 4, "w " * i + "x y") for i in range(9)], "tweet_id string, class int, text string"))
    written = []
    monkeypatch.setattr(sentiment, "cut", lambda df: written.append(df) or staging.cut(df))
    steps = sentiment.maxent_converged(rows, 1.0, 23)
    assert len(written) == 1 and "Exchange" not in steps._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, steps.collect())) == sorted(map(tuple, sentiment.maxent_iterate(rows, 23).collect()))
    assert sentiment.maxent_converged(rows, 1.0, 0).agg({"lambda": "max"}).first()[0] == 0.0


def test_links_are_numbers(spark, monkeypatch):
    """Steps shuffle numbers, not ids; where two ids have one number, another salt is taken, and null and repeated nodes stay."""
    pairs, edges, nodes = _rank_edges(spark)
    assert {t for _, t in graph.Links(edges, nodes).links.dtypes} == {"bigint"}
    want = {r.id: r.rank for r in graph.pagerank(edges, nodes, 3).collect()}
    number, salts = graph._number, set()
    monkeypatch.setattr(graph, "_number", lambda of, salt: salts.add(salt) or (number(of, salt) if salt > 1 else number(of, salt) % 2))
    more = nodes.unionByName(spark.createDataFrame([(None,), ("n1",)], "id string"))
    got = graph.pagerank(edges, more, 3).collect()
    assert salts == {0, 1, 2} and len(got) == len(want) + 2 and [round(r.rank, 9) for r in got if r.id is None] == [0.15]
    assert len({r.rank for r in got if r.id == "n1"}) == 1
    assert {r.id for r in got} == {*want, None}

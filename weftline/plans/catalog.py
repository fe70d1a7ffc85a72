"""Every query of the engine, each over its whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import graph, index, sentiment, staging, store, tally
from weftline.sources import readers, writers
from weftline.sources.readers import table

TERMS = ["the", "und", "stupid"]
TWEET = "The und of idiot pour"
#: A short stop list for the queries; the operators take any.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "der", "die", "und", "de", "la"]
CLASS = "CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 4 ELSE 2 END"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(column):
    return F.round(column, 6)


def _sql_list(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(("'" + x.replace("'", "''") + "'") if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


# --- tokens, TF-IDF, search -------------------------------------------------------------------------------------

TOKENS = r"""
WITH line_runs AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(line, '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_]+') AS runs
  FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n')) AS line FROM documents)
), run AS MATERIALIZED (
  SELECT doc_id, unnest(runs) AS r, generate_subscripts(runs, 1) AS i, len(runs) AS n FROM line_runs
), token AS MATERIALIZED (
  SELECT doc_id, term FROM (
    SELECT doc_id, CASE WHEN regexp_matches(r, '^[\p{L}\p{Nd}_]') THEN r
      WHEN i > 1 AND i < n THEN trim(r, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
      WHEN i > 1 THEN ltrim(r, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
      WHEN i < n THEN rtrim(r, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
      ELSE r END AS term FROM run
  ) WHERE term <> ''
), wc AS MATERIALIZED (SELECT doc_id, term, count(*) AS n FROM token GROUP BY doc_id, term)
"""
TFIDF = (
    TOKENS
    + """, freq AS (SELECT term, count(*) AS df FROM wc GROUP BY term), total AS (SELECT count(*) AS n_docs FROM documents),
ti AS MATERIALIZED (SELECT doc_id, term, (1 + log10(n)) * log10(1 + n_docs // df) AS tfidf FROM wc JOIN freq USING (term) CROSS JOIN total)
"""
)


def _counts(spark, d):
    return tally.counts(table(spark, d, "documents"))


def _postings(spark, d):
    return index.text_index(table(spark, d, "documents"))


@query(TOKENS + "SELECT doc_id, term, n FROM wc")
def word_count(spark, d):
    return _counts(spark, d)


@query(TOKENS + "SELECT doc_id, term, round(1 + log10(n), 6) AS tf FROM wc")
def log_tf(spark, d):
    return index.log_tf(_counts(spark, d)).withColumn("tf", r6("tf"))


@query(TOKENS + "SELECT term, count(*) AS df FROM wc GROUP BY term")
def doc_frequency(spark, d):
    return index.doc_frequency(_counts(spark, d))


@query(TFIDF + "SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM ti")
def tfidf(spark, d):
    return _postings(spark, d).withColumn("tfidf", r6("tfidf"))


@query(TFIDF + f"SELECT doc_id, round(sum(tfidf), 6) AS score FROM ti WHERE term IN ({_sql_list(TERMS)}) GROUP BY doc_id")
def search_exact(spark, d):
    return index.search_texts(table(spark, d, "documents"), TERMS).withColumn("score", r6("score"))


@query(TFIDF + f"SELECT doc_id, round(sum(tfidf), 6) AS score FROM ti WHERE {' OR '.join(f'contains(term, {_sql_list([t])})' for t in TERMS)} GROUP BY doc_id")
def search_substring(spark, d):
    return index.search_texts(table(spark, d, "documents"), TERMS, "substring").withColumn("score", r6("score"))


@query(TFIDF + f"SELECT doc_id, round(sum(tfidf), 6) AS score FROM ti WHERE lower(term) IN ({_sql_list(TERMS)}) GROUP BY doc_id")
def search_ignore_case(spark, d):
    return index.search_texts(table(spark, d, "documents"), TERMS, "ignore_case").withColumn("score", r6("score"))


RANKED = TFIDF + f", hit AS (SELECT doc_id, round(sum(tfidf), 6) AS score FROM ti WHERE term IN ({_sql_list(TERMS)}) GROUP BY doc_id)\n"


@query(RANKED + "SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS position, doc_id, score FROM hit")
def rank_desc(spark, d):
    """Hits in one global order, with their places: a range-partitioned sort, not one task."""
    return index.positions(search_exact(spark, d)).select("position", "doc_id", "score")


@query(RANKED + "SELECT doc_id, score FROM hit ORDER BY score DESC, doc_id LIMIT 30")
def topk_30(spark, d):
    return index.rank(search_exact(spark, d), 30)


@query(TOKENS.replace("SELECT doc_id, unnest(regexp_split", "SELECT conv_id * 1000 + turn AS doc_id, unnest(regexp_split").replace("FROM documents)", "FROM conversations)") + "SELECT doc_id, term, n FROM wc")
def tokenize_boundary(spark, d):
    turns = table(spark, d, "conversations").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    return index.word_count(index.boundary_terms(turns))


@query("SELECT doc_id, term, count(*) AS n FROM (SELECT conv_id * 1000 + turn AS doc_id, unnest(string_split(rtrim(text, ' '), ' ')) AS term FROM conversations WHERE text IS NOT NULL AND rtrim(text, ' ') <> '') GROUP BY ALL")
def tokenize_space(spark, d):
    turns = table(spark, d, "conversations").where("text IS NOT NULL AND rtrim(text) <> ''").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    return index.word_count(index.space_terms(turns))


# --- cleaning -----------------------------------------------------------------------------------------------------


def _clean_sql(at_only: bool) -> str:
    handle = tx.AT_ONLY if at_only else tx.HANDLE
    return f"regexp_replace(regexp_replace(regexp_replace(text, '{tx.URL}', '', 'gi'), '{handle}', '', 'gi'), '{tx.NOT_PLAIN}', '', 'g')"


EXTRA = [(-1, "@rivergate http://q.io/7k - Oh well, that's"), (-2, "see http://x.co/a?b=c @bob @bobby"), (-3, "mail a@b.de, ftp://h/p+q")]


def _texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(EXTRA, "doc_id long, text string"))


TEXTS_SQL = f"(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_values(EXTRA)}))"


@query(f"SELECT doc_id, {_clean_sql(False)} AS cleaned FROM {TEXTS_SQL}")
def clean_text_handles(spark, d):
    return _texts(spark, d).select("doc_id", tx.clean_tweet(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {_clean_sql(True)} AS cleaned FROM {TEXTS_SQL}")
def clean_text_at_only(spark, d):
    return _texts(spark, d).select("doc_id", tx.clean_tweet(F.col("text"), at_only=True).alias("cleaned"))


SPACE_WORDS = "SELECT doc_id, unnest(string_split(rtrim(text, ' '), ' ')) AS word FROM documents WHERE text IS NOT NULL AND rtrim(text, ' ') <> ''"


def _space_words(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL AND rtrim(text) <> ''")
    return index.space_terms(docs).withColumnRenamed("term", "word")


@query(f"SELECT doc_id, count(*) AS n FROM ({SPACE_WORDS}) WHERE lower(word) NOT IN ({_sql_list(STOP_WORDS)}) GROUP BY doc_id")
def stopwords_ci(spark, d):
    return sentiment.without_stop_words(_space_words(spark, d), STOP_WORDS, True).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, count(*) AS n FROM ({SPACE_WORDS}) WHERE word NOT IN ({_sql_list(STOP_WORDS)}) GROUP BY doc_id")
def stopwords_cs(spark, d):
    return sentiment.without_stop_words(_space_words(spark, d), STOP_WORDS, False).groupBy("doc_id").agg(F.count("*").alias("n"))


# --- pages and links ----------------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages WHERE regexp_matches(html, '<title>.*?</title>')")
def title_extract(spark, d):
    return table(spark, d, "pages").select("page_id", tx.title(F.col("html")).alias("title")).where("title IS NOT NULL")


@query("SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY ALL")
def link_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(tx.href_links(F.col("html"))).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


# A wiki line made of each page: its title, links as [[...]], and its HTML escaped once more as the body.
LINE_SQL = (
    "wiki AS (SELECT page_id, regexp_replace(regexp_replace(html, 'href=\"([^\"]*)\"', '[[\\1]]', 'g'), '[\\r\\n]', ' ', 'g') AS linked, "
    "CASE WHEN page_id % 3 = 0 THEN '' ELSE ' <text xml:space=\"preserve\">' || replace(replace(regexp_replace(html, '[\\r\\n]', ' ', 'g'), '<', '&lt;'), '>', '&gt;') || ' &#65;&eacute;&nope;</text>' END AS body FROM pages), "
    "line AS (SELECT page_id, linked || body || '[[ [[odd]]' AS line FROM wiki)"
)


def _wiki_line(keep_ends: bool = False):
    flat = F.col("html") if keep_ends else F.regexp_replace("html", r"[\r\n]", " ")
    linked = F.regexp_replace(flat, 'href="([^"]*)"', "[[$1]]")
    escaped = F.replace(F.replace(flat, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(' <text xml:space="preserve">'), escaped, F.lit(" &#65;&eacute;&nope;</text>")))
    return F.concat(linked, body, F.lit("[[ [[odd]]"))


def _wiki(spark, d):
    return table(spark, d, "pages").select("page_id", _wiki_line().alias("line"))


@query(f"WITH {LINE_SQL} SELECT page_id, link, count(*) AS n FROM (SELECT page_id, replace(replace(unnest(regexp_extract_all(line, '\\[\\[.*?\\]\\]')), '[[', ''), ']]', '') AS link FROM line) GROUP BY ALL")
def wiki_link_extract(spark, d):
    links = _wiki(spark, d).select("page_id", F.explode(tx.wiki_links(F.col("line"))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


# Text is cut at ampersands, and what follows each is looked up among all names and numbers, so that nothing is resolved twice.
_NAMES = "MAP {" + ", ".join(f"'{name}': chr({code})" for name, code in sorted(name2codepoint.items())) + "}"
_FOUND = f"regexp_extract(p, '{tx.ENTITY}')"
_DIGITS = f"CASE WHEN regexp_matches(p, '^#[xX]') THEN TRY_CAST('0x' || {_FOUND}[3:-2] AS INTEGER) ELSE TRY_CAST({_FOUND}[2:-2] AS INTEGER) END"
_NUMBER = f"CASE WHEN {_DIGITS} < 1114112 AND {_DIGITS} NOT BETWEEN 55296 AND 57343 THEN chr({_DIGITS}) END"
_RESOLVED = f"coalesce(CASE WHEN {_FOUND} = '' THEN NULL WHEN starts_with(p, '#') THEN {_NUMBER} ELSE list_extract(map_extract({_NAMES}, {_FOUND}[1:-2]), 1) END || p[length({_FOUND}) + 1:], '&' || p)"
_INNER = "string_split(regexp_replace(regexp_extract(line, '<text(.*?)</text>', 1), '^[^>]*>', ''), '&')"
BODY_SQL = f"regexp_replace(array_to_string([({_INNER})[1]] || list_transform(({_INNER})[2:], lambda p: {_RESOLVED}), ''), '<.*?>', '', 'g')"


@query(f"WITH {LINE_SQL} SELECT page_id, {BODY_SQL} AS body FROM line WHERE regexp_matches(line, '<text(.*?)</text>')")
def wiki_text_strip(spark, d):
    return _wiki(spark, d).select("page_id", tx.wiki_body(F.col("line")).alias("body")).where("body IS NOT NULL")


EDGES = "edge AS (SELECT src, dst FROM (SELECT regexp_extract(html, '<title>(.*?)</title>', 1) AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages WHERE regexp_matches(html, '<title>.*?</title>')) WHERE dst <> '')"
NODES = "node AS (SELECT unnest(regexp_extract_all(html, '<title>(.*?)</title>', 1)) AS id FROM pages UNION SELECT dst FROM edge)"


def _edges(spark, d):
    return graph.edges(table(spark, d, "pages"), links=tx.href_links(F.col("html")))


@query(f"WITH {EDGES} SELECT src, dst, count(*) AS n FROM edge GROUP BY ALL")
def edge_list(spark, d):
    return _edges(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT src, count(*) AS out_degree FROM edge GROUP BY src")
def out_degree(spark, d):
    return graph.out_degree(_edges(spark, d))


@query(f"WITH {EDGES}, {NODES} SELECT count(*) AS n_nodes FROM node")
def node_count(spark, d):
    return graph.node_count(graph.nodes(table(spark, d, "pages"), _edges(spark, d)))


def _pagerank_sql(edge: str, node: str, steps: int) -> str:
    ctes = [edge, node, "deg AS (SELECT src, count(*) AS k FROM edge GROUP BY src)", "r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM node) AS rank FROM node)"]
    for i in range(1, steps + 1):
        ctes.append(
            f"r{i} AS MATERIALIZED (SELECT id, 0.15 + 0.85 * coalesce(s, 0) AS rank FROM node LEFT JOIN (SELECT dst, sum(rank / k) AS s FROM edge JOIN deg USING (src) JOIN r{i - 1} ON src = id GROUP BY dst) ON dst = id)"
        )
    return f"WITH {', '.join(ctes)} SELECT id, round(rank, 6) AS rank FROM r{steps}"


@query(_pagerank_sql(EDGES, NODES, 1))
def pagerank_1(spark, d):
    e = _edges(spark, d)
    return graph.pagerank(e, graph.nodes(table(spark, d, "pages"), e), 1).withColumn("rank", r6("rank"))


@query(_pagerank_sql(EDGES, NODES, 10))
def pagerank_10(spark, d):
    e = _edges(spark, d)
    return graph.pagerank(e, graph.nodes(table(spark, d, "pages"), e)).withColumn("rank", r6("rank"))


LINE_EDGES = "edge AS MATERIALIZED (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"
LINE_NODES = "node AS (SELECT src AS id FROM edge UNION SELECT dst FROM edge)"


@query(_pagerank_sql(LINE_EDGES, LINE_NODES, 10))
def pagerank_dense(spark, d):
    """Supplier and part link each other in every order line."""
    pair = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))
    e = pair.unionByName(pair.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.pagerank(e, graph.endpoints(e)).withColumn("rank", r6("rank"))


ERROR = 1e-3


def _converged_sql(steps: int) -> str:
    """Steps in which only nodes with over ERROR waiting send; with enough of them the last ones change nothing."""
    ctes = [EDGES, NODES, "deg AS (SELECT src, count(*) AS k FROM edge GROUP BY src)", "link AS MATERIALIZED (SELECT src, dst, count(*) AS n, k FROM edge JOIN deg USING (src) GROUP BY ALL)", "r0 AS (SELECT id, 0.0::DOUBLE AS rank, 0.15::DOUBLE AS waits FROM node)"]
    for i in range(1, steps + 1):
        ctes.append(
            f"r{i} AS MATERIALIZED (SELECT id, rank + CASE WHEN waits > {ERROR} THEN waits ELSE 0 END AS rank, CASE WHEN waits > {ERROR} THEN 0 ELSE waits END + 0.85 * coalesce(got, 0) AS waits "
            f"FROM r{i - 1} LEFT JOIN (SELECT dst, sum(waits / k * n) AS got FROM link JOIN r{i - 1} ON src = id WHERE waits > {ERROR} GROUP BY dst) ON dst = id)"
        )
    return f"WITH {', '.join(ctes)} SELECT id, round(rank + waits, 6) AS rank FROM r{steps}"


@query(_converged_sql(70))
def pagerank_converged(spark, d):
    """Ranks at the fixed point: nodes send what has come to them until less than ERROR waits at each."""
    e = _edges(spark, d)
    return graph.pagerank_converged(e, graph.nodes(table(spark, d, "pages"), e), ERROR).withColumn("rank", r6("rank"))


# --- wiki search --------------------------------------------------------------------------------------------------


WIKI_TERMS = ["tion", "que"]


@query(
    f"WITH {LINE_SQL}, p AS (SELECT regexp_extract(line, '<title>(.*?)</title>', 1) AS doc_id, CASE WHEN regexp_matches(line, '<text(.*?)</text>') THEN {BODY_SQL} END AS body FROM line WHERE regexp_matches(line, '<title>.*?</title>')), "
    "w AS (SELECT doc_id, unnest(string_split(rtrim(body, ' '), ' ')) AS term FROM p WHERE body IS NOT NULL), wc AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM wc GROUP BY term) "
    f"SELECT doc_id, round(sum((1 + log10(n)) * log10(1 + (SELECT count(*) FROM p) // df)), 6) AS score FROM wc JOIN f USING (term) WHERE {' OR '.join(f'contains(term, {_sql_list([t])})' for t in WIKI_TERMS)} GROUP BY doc_id"
)
def wiki_search(spark, d):
    """Pages to titles and bodies, space tokens, TF-IDF over pages with a title, substring search, ranked."""
    pages = readers.wiki_pages(_wiki(spark, d)).select(F.col("title").alias("doc_id"), F.col("body").alias("text"))
    terms = index.space_terms(pages.where("text IS NOT NULL")).where(index.matches(WIKI_TERMS, "substring"))
    return index.rank(index.search(index.tfidf(index.word_count(terms), pages.agg(F.count("*").alias("n_docs"))), WIKI_TERMS, "substring").withColumn("score", r6("score")))


# --- lexicon ------------------------------------------------------------------------------------------------------

# A lexicon made of the words of all conversations: each with one or two scores, every pair several times.
LEX = (
    "lex AS (SELECT DISTINCT term, CAST(length(term) % 7 - 3 + step AS INTEGER) AS score FROM (SELECT unnest(string_split(lower(text), ' ')) AS term FROM conversations WHERE text IS NOT NULL), "
    "(VALUES (0), (1)) AS t(step) WHERE term <> '' AND (step = 0 OR length(term) % 2 = 0))"
)


def _lexicon(spark, d):
    words = table(spark, d, "conversations").select(F.explode(F.split(F.lower("text"), " ")).alias("term")).where("term <> ''")
    steps = words.select("term", F.explode(F.when(F.length("term") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("step"))
    return steps.select("term", (F.length("term") % 7 - 3 + F.col("step")).cast("int").alias("score"))


@query(f"WITH {LEX} SELECT term, score FROM lex")
def lexicon_dedup(spark, d):
    return sentiment.lexicon(_lexicon(spark, d))


ASKED = ["The", "the", "that", "of", "zzzz", "thention"]


@query(f"WITH {LEX}, a AS (SELECT avg(score) AS avg_score FROM lex WHERE term IN ({_sql_list(sorted({w.lower() for w in ASKED}))})) SELECT round(avg_score, 6) AS avg_score, CASE WHEN avg_score > 1 THEN 'positive' WHEN avg_score < -1 THEN 'negative' ELSE 'neutral' END AS label FROM a WHERE avg_score IS NOT NULL")
def lexicon_classify(spark, d):
    return sentiment.lexicon_classify(sentiment.lexicon(_lexicon(spark, d)), ASKED).withColumn("avg_score", r6("avg_score"))


@query(
    f"WITH {LEX}, w AS (SELECT doc_id, unnest(list_distinct(list_transform(string_split(rtrim(text, ' '), ' '), lambda x: lower(x)))) AS word FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, round(avg(score), 6) AS avg_score, CASE WHEN avg(score) > 1 THEN 'positive' WHEN avg(score) < -1 THEN 'negative' ELSE 'neutral' END AS label FROM w JOIN lex ON word = term GROUP BY doc_id"
)
def lexicon_documents(spark, d):
    """Every document scored by a lexicon, joined, not filtered by a list."""
    from weftline.streaming.live import lexicon_scores

    met = lexicon_scores(table(spark, d, "documents"), sentiment.lexicon(_lexicon(spark, d))).groupBy("doc_id").agg(F.avg("score").alias("a"))
    label = F.when(F.col("a") > 1, "positive").when(F.col("a") < -1, "negative").otherwise("neutral")
    return met.select("doc_id", r6("a").alias("avg_score"), label.alias("label"))


# --- Naive Bayes, neighbours, maximum entropy ---------------------------------------------------------------------


def _labelled(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select(F.col("doc_id").alias("tweet_id"), F.expr(CLASS).cast("int").alias("class"), "text")


def _labelled_sql(at_only: bool) -> str:
    return f"tweet AS (SELECT doc_id AS tweet_id, {CLASS} AS class, {_clean_sql(at_only)} AS text FROM documents JOIN labels USING (doc_id))"


def _words_sql(at_only: bool, ignore_case: bool) -> str:
    key = "lower(word)" if ignore_case else "word"
    split = "SELECT tweet_id, class, unnest(CASE WHEN text = '' THEN [''] WHEN rtrim(text, ' ') = '' THEN [] ELSE string_split(rtrim(text, ' '), ' ') END) AS word FROM tweet"
    return f"{_labelled_sql(at_only)}, w AS MATERIALIZED (SELECT * FROM ({split}) WHERE {key} NOT IN ({_sql_list(STOP_WORDS)}))"


NB_WORDS = "WITH " + _words_sql(True, True)
NB_COUNTS = NB_WORDS + ", cnt AS MATERIALIZED (SELECT word, c.class AS class, count(*) FILTER (w.class = c.class) AS n FROM w CROSS JOIN (VALUES (0), (2), (4)) AS c(class) GROUP BY word, c.class)"
NB_STATS = (
    NB_COUNTS
    + ", st AS MATERIALIZED (SELECT * FROM (SELECT count(*) AS total_tweets, count(*) FILTER (class = 4) AS positive_tweets, count(*) FILTER (class = 2) AS neutral_tweets, count(*) FILTER (class = 0) AS negative_tweets FROM tweet), "
    "(SELECT count(DISTINCT word) AS vocabulary, count(*) FILTER (class = 4) AS positive_words, count(*) FILTER (class = 2) AS neutral_words, count(*) FILTER (class = 0) AS negative_words FROM w))"
)
NB_MODEL = NB_STATS + ", model AS MATERIALIZED (SELECT word, class, (n + 1)::DOUBLE / (vocabulary + CASE class WHEN 4 THEN positive_words WHEN 2 THEN neutral_words ELSE negative_words END) AS p FROM cnt CROSS JOIN st)"


def _nb(spark, d):
    counts, stats = sentiment.nb_train(_labelled(spark, d), STOP_WORDS)
    return counts, stats, sentiment.nb_model(counts, stats)


@query(NB_COUNTS + "SELECT word, class, n FROM cnt")
def nb_counts(spark, d):
    return _nb(spark, d)[0]


@query(NB_STATS + "SELECT * FROM st")
def nb_stats(spark, d):
    return _nb(spark, d)[1]


@query(NB_MODEL + "SELECT word, class, round(p, 9) AS p FROM model")
def nb_model(spark, d):
    return _nb(spark, d)[2].withColumn("p", F.round("p", 9))


@query(
    NB_MODEL
    + f", q AS (SELECT unnest(string_split('{TWEET}', ' ')) AS word), s AS (SELECT class, exp(sum(ln(p))) AS lp FROM q JOIN model ON lower(q.word) = lower(model.word) GROUP BY class), "
    "sc AS (SELECT class, lp * (CASE class WHEN 4 THEN positive_tweets WHEN 2 THEN neutral_tweets ELSE negative_tweets END)::DOUBLE / total_tweets AS probability FROM s CROSS JOIN st) "
    "SELECT 1 AS tweet_id, class, round(ln(probability), 6) AS log_probability FROM sc WHERE probability > 0 ORDER BY probability DESC, class LIMIT 1"
)
def nb_classify(spark, d):
    _, stats, model = _nb(spark, d)
    best = sentiment.nb_classify(model, stats, spark.createDataFrame([(1, TWEET)], "tweet_id int, text string"))
    return best.select("tweet_id", "class", r6("log_probability").alias("log_probability"))


@query(
    NB_MODEL
    + f", asked AS (SELECT doc_id AS tweet_id, {_clean_sql(True)} AS text FROM documents), q AS (SELECT tweet_id, unnest(string_split(rtrim(text, ' '), ' ')) AS word FROM asked WHERE text IS NOT NULL AND (text = '' OR rtrim(text, ' ') <> '')), "
    "known AS (SELECT lower(word) AS lw, class, sum(ln(p)) AS lp FROM model GROUP BY ALL), s AS (SELECT tweet_id, class, sum(lp) AS lp FROM q JOIN known ON lower(q.word) = lw GROUP BY ALL), "
    "sc AS (SELECT tweet_id, class, lp + ln((CASE class WHEN 4 THEN positive_tweets WHEN 2 THEN neutral_tweets ELSE negative_tweets END)::DOUBLE / total_tweets) AS lp FROM s CROSS JOIN st WHERE CASE class WHEN 4 THEN positive_tweets WHEN 2 THEN neutral_tweets ELSE negative_tweets END > 0), "
    "best AS (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY round(lp, 6) DESC, class) AS r FROM sc) "
    "SELECT a.tweet_id, CAST(coalesce(class, -1) AS INTEGER) AS class, round(lp, 4) AS log_probability FROM asked a LEFT JOIN best b ON b.tweet_id = a.tweet_id AND r = 1"
)
def nb_classify_documents(spark, d):
    """Every whole text classified, however long: scores are logarithms throughout."""
    _, stats, model = _nb(spark, d)
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("tweet_id"), "text")
    return sentiment.nb_classify(model, stats, asked).select("tweet_id", "class", F.round("log_probability", 4).alias("log_probability"))


KNN = (
    "WITH " + _words_sql(False, False) + ", wc AS (SELECT tweet_id, class, word, count(*) AS n FROM w GROUP BY ALL), freq AS (SELECT word, count(*) AS df FROM wc GROUP BY word), "
    "ti AS (SELECT tweet_id, class, word, (1 + log10(n)) * log10(1 + (SELECT count(*) FROM tweet) // df) AS tfidf FROM wc JOIN freq USING (word)), "
    f"hit AS MATERIALIZED (SELECT tweet_id, class, sum(tfidf) AS score FROM ti WHERE lower(word) IN ({_sql_list(TERMS)}) GROUP BY ALL ORDER BY score DESC, tweet_id, class LIMIT 30) "
)


def _neighbours(spark, d):
    return sentiment.knn_neighbours(sentiment.knn_index(_labelled(spark, d), STOP_WORDS), TERMS)


@query(KNN + "SELECT tweet_id, class, round(score, 6) AS score FROM hit")
def knn_neighbours(spark, d):
    return _neighbours(spark, d).withColumn("score", r6("score"))


@query(KNN + "SELECT class, round(sum(score), 6) AS score FROM hit GROUP BY class")
def knn_class_scores(spark, d):
    return sentiment.knn_class_scores(_neighbours(spark, d)).withColumn("score", r6("score"))


@query(KNN + "SELECT class, round(sum(score), 6) AS score FROM hit GROUP BY class ORDER BY sum(score) DESC, class LIMIT 1")
def knn_classify(spark, d):
    return sentiment.knn_classify(sentiment.knn_class_scores(_neighbours(spark, d))).withColumn("score", r6("score"))


KNN_ALL = (
    KNN.split(", hit AS")[0]
    + ", fold AS MATERIALIZED (SELECT tweet_id, class, lower(word) AS word, sum(tfidf) AS w FROM ti GROUP BY ALL), "
    + f"asked AS (SELECT conv_id * 1000 + turn AS asked_id, {_clean_sql(False)} AS text FROM conversations WHERE conv_id IS NOT NULL), "
    + "term AS MATERIALIZED (SELECT DISTINCT asked_id, lower(unnest(string_split(rtrim(text, ' '), ' '))) AS word FROM asked WHERE text IS NOT NULL), "
    + "sc AS (SELECT asked_id, tweet_id, class, round(sum(w), 6) AS score FROM term JOIN fold USING (word) GROUP BY ALL) "
    + "SELECT asked_id, tweet_id, class, score FROM sc QUALIFY row_number() OVER (PARTITION BY asked_id ORDER BY score DESC, tweet_id, class) <= 30"
)


@query(KNN_ALL)
def knn_all(spark, d):
    """The neighbours of every turn among the labelled documents."""
    turns = _turns(spark, d).where("tweet_id IS NOT NULL")
    terms = tally.rows(turns, tally.cleaned(folded=True, parts=tally.asked), ("tweet_id",))
    asked = terms.select(F.col("tweet_id").alias("asked_id"), F.array("term").alias("terms"))
    return sentiment.knn_all(sentiment.knn_index(_labelled(spark, d), STOP_WORDS), asked)


# Cleaned text has only letters, digits and spaces: a boundary split gives its words, an empty token wherever spaces stand
# between two words, and a leading token for leading space.
MAXENT = (
    f"WITH t AS (SELECT conv_id * 1000 + turn AS tweet_id, 4 AS class, {_clean_sql(False)} AS text FROM conversations), "
    "parts AS (SELECT *, regexp_extract_all(text, '[a-zA-Z0-9]+') AS ws FROM t), "
    "f0 AS MATERIALIZED (SELECT tweet_id, class, word, count(*)::DOUBLE AS f FROM (SELECT tweet_id, class, unnest(ws) AS word FROM parts) GROUP BY ALL "
    "UNION ALL SELECT tweet_id, class, '', (len(ws) - 1 + CASE WHEN starts_with(text, ' ') THEN 2 ELSE 0 END)::DOUBLE FROM parts WHERE len(ws) > 1 OR len(ws) = 1 AND starts_with(text, ' ') "
    "UNION ALL SELECT tweet_id, class, text, 1.0::DOUBLE FROM parts WHERE len(ws) = 0 AND text <> '') "
)


def _turns(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("tweet_id"), F.lit(4).alias("class"), "text")


@query(MAXENT + "SELECT tweet_id, class, word, f, 0.0::DOUBLE AS \"lambda\" FROM f0")
def maxent_init(spark, d):
    return sentiment.maxent_init(_turns(spark, d))


@query(MAXENT + 'SELECT tweet_id, class, word, f, round(sum(f) OVER w / sum(f * exp(0.0) / exp(2.0)) OVER w, 6) AS "lambda" FROM f0 WINDOW w AS (PARTITION BY tweet_id)')
def maxent_iterate(spark, d):
    return sentiment.maxent_iterate(sentiment.maxent_init(_turns(spark, d))).withColumn("lambda", r6("lambda"))


def _steps_sql(n: int) -> str:
    ctes = [f's0 AS (SELECT *, 0.0::DOUBLE AS l FROM f0)']
    for i in range(1, n + 1):
        ctes.append(f"s{i} AS MATERIALIZED (SELECT tweet_id, class, word, f, l + sum(f) OVER w / sum(f * exp(-2.0)) OVER w AS l FROM s{i - 1} WINDOW w AS (PARTITION BY tweet_id))")
    return MAXENT + ", " + ", ".join(ctes) + f' SELECT tweet_id, class, word, f, round(l, 6) AS "lambda" FROM s{n}'


@query(_steps_sql(3))
def maxent_three_steps(spark, d):
    return sentiment.maxent_iterate(sentiment.maxent_init(_turns(spark, d)), 3).withColumn("lambda", r6("lambda"))


# A step adds e^2 to every weight: an error of 7 is never met, so the bound on steps ends it; one of 8 is met by the first.
@query("WITH low AS (" + _steps_sql(4) + "), high AS (" + _steps_sql(1) + ") SELECT 7 AS error, * FROM low UNION ALL SELECT 8, * FROM high")
def maxent_converged(spark, d):
    """The update until weights move by no more than an allowed error, or for four steps."""
    moves = sentiment.maxent_moves(sentiment.maxent_init(_turns(spark, d)))
    runs = [sentiment.maxent_until(moves, error, 4).select(F.lit(error).alias("error"), "*") for error in (7, 8)]
    return runs[0].unionByName(runs[1]).withColumn("lambda", r6("lambda"))


@query(MAXENT + ", r AS (SELECT tweet_id, count(*) AS n FROM f0 GROUP BY tweet_id) SELECT sum(n)::BIGINT AS records FROM r")
def maxent_record_count(spark, d):
    return sentiment.record_count(sentiment.maxent_init(_turns(spark, d)))


@query(MAXENT + ", j AS (SELECT tweet_id, string_agg(word || ':' || class || ':' || CAST(CAST(f AS BIGINT) AS VARCHAR) || ':0', ' ' ORDER BY word) AS records FROM f0 GROUP BY tweet_id) SELECT tweet_id, sha256(records) AS records FROM j")
def maxent_tweet_records(spark, d):
    rows = sentiment.maxent_records(sentiment.maxent_init(_turns(spark, d)))
    told = F.transform("records", lambda r: F.concat_ws(":", r["word"], r["class"].cast("string"), r["f"].cast("long").cast("string"), r["lambda"].cast("long").cast("string")))
    return rows.select("tweet_id", F.sha2(F.array_join(told, " "), 256).alias("records"))


TWEET_SQL = (
    "tweet_line AS (SELECT conv_id * 1000 + turn AS id, (turn % 3) * 2 AS class, replace(regexp_replace(text, '[\\r\\n]', ' ', 'g'), '\"', '') AS text FROM conversations WHERE text IS NOT NULL)"
)


def _tweet_lines(spark, d):
    flat = F.replace(F.regexp_replace("text", r"[\r\n]", " "), F.lit('"'), F.lit(""))
    rows = table(spark, d, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), ((F.col("turn") % 3) * 2).alias("class"), flat.alias("text"))
    return rows.select(F.concat(F.lit('"'), F.concat_ws('","', F.col("class").cast("string"), F.col("id").cast("string"), F.lit("Mon, 1"), F.lit("NO_QUERY"), F.lit("u"), "text"), F.lit('"')).alias("line"))


@query(f"WITH {TWEET_SQL} SELECT CAST(class AS INTEGER) AS class, CAST(id AS VARCHAR) AS tweet_id, '\"' || text || '\"' AS text FROM tweet_line")
def tweet_csv_parse(spark, d):
    return readers.tweet_lines(_tweet_lines(spark, d))


# --- sources and sinks: written, and read back ----------------------------------------------------------------------


def _path(spark) -> str:
    return staging.new_path(spark)


@query(f"WITH {TWEET_SQL} SELECT CAST(class AS INTEGER) AS class, CAST(id AS VARCHAR) AS tweet_id, trim(text) AS text FROM tweet_line")
def tweet_csv_source(spark, d):
    """A CSV file of tweets with a line in seven that is no tweet; those are dropped."""
    lines = _tweet_lines(spark, d)
    broken = lines.where(F.xxhash64("line") % 7 == 0).select(F.lit('"x"').alias("line"))
    lines.unionByName(broken).write.text(path := _path(spark))
    return readers.tweets(spark, path, malformed="drop").select("class", "tweet_id", F.trim("text").alias("text"))


@query("SELECT c_custkey || chr(9) || c_name AS line, 4 AS files FROM customer")
def text_sink_lines(spark, d):
    """Key and value with a tab, as lines with the number of files that they stand in; no success file among them."""
    path = _path(spark)
    writers.text(table(spark, d, "customer").select("c_custkey", "c_name").repartition(4), path, success_file=False)
    files = readers.file_count(spark, path).select(F.col("n_docs").cast("int").alias("files"))
    return readers.text_lines(spark, path, drop_empty=True).select("line").crossJoin(F.broadcast(files))


@query("SELECT CAST(l_partkey AS VARCHAR) AS term, CAST(count(*) AS VARCHAR) AS n FROM lineitem GROUP BY l_partkey")
def separated_reread(spark, d):
    """A stage's own output under another separator, read again by the next; lines without separator are dropped."""
    path = _path(spark)
    counts = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    writers.text(counts, f"{path}/part=0", sep="#####")
    table(spark, d, "nation").select(F.col("n_name").alias("value")).write.text(f"{path}/part=1")
    return readers.separated(spark, [f"{path}/part=0", f"{path}/part=1"], ["term", "n"], "#####")


@query("SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place, c_custkey || '|' || c_name AS line, 1 AS files FROM customer")
def single_file_sink(spark, d):
    """One file in order: the place of each line in it."""
    path = _path(spark)
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    writers.single_sorted_text(rows.orderBy(F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_name", "c_acctbal"), path, F.desc("c_acctbal"), "c_custkey", sep="|")
    n = spark.read.text(path).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    files = n.agg(F.countDistinct("f").cast("int").alias("files"))
    placed = n.withColumn("place", F.row_number().over(Window.partitionBy("f").orderBy("i")).cast("long"))
    return placed.select("place", F.regexp_replace("value", r"\|[^|]*$", "").alias("line")).crossJoin(F.broadcast(files))


@query("SELECT n_nationkey, n_name FROM nation")
def write_once_sink(spark, d):
    path = _path(spark)
    writers.once(table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    writers.once(table(spark, d, "nation").select("n_nationkey", F.lit("again").alias("n_name")), path)
    return spark.read.parquet(path)


@query(f"WITH {LEX} SELECT term, score FROM lex WHERE NOT contains(term, chr(9)) AND NOT contains(term, chr(10)) AND NOT contains(term, chr(13)) AND trim(term) = term")
def lexicon_source(spark, d):
    """Two lexicon files, read as one and without the rows that repeat."""
    path = _path(spark)
    rows = _lexicon(spark, d).where(r"NOT term rlike '[\t\r\n]' AND trim(term) = term")
    for n in (0, 1):
        writers.text(rows.where(F.length("term") % 2 >= n), f"{path}/file{n}")
    return sentiment.lexicon(readers.lexicon(spark, [f"{path}/file0", f"{path}/file1"]))


@query(TFIDF + f"SELECT doc_id, round(sum(tfidf), 6) AS score FROM ti WHERE term IN ({_sql_list(TERMS)}) GROUP BY doc_id")
def postings_lookup(spark, d):
    """The index written once, and a search that reads only the buckets of its words."""
    path = _path(spark)
    writers.postings(_postings(spark, d), path, 16)
    return index.search(writers.read_postings(spark, path, TERMS, 16), TERMS).withColumn("score", r6("score"))


def _stored(spark, d) -> store.Stored:
    """The documents as an index of two segments, added one after the other."""
    path, docs = _path(spark), table(spark, d, "documents")
    for odd in (0, 1):
        store.add_segment(docs.where(F.col("doc_id") % 2 == odd), path)
    return store.Stored(spark, path)


@query(ORACLES["search_exact"])
def stored_segments(spark, d):
    """Frequencies of two segments, summed when they are searched."""
    return _stored(spark, d).search(TERMS).withColumn("score", r6("score"))


GRAM_TERMS = ["tion", "und", "ab"]


@query(TFIDF + f"SELECT doc_id, round(sum(tfidf), 6) AS score FROM ti WHERE {' OR '.join(f'contains(term, {_sql_list([t])})' for t in GRAM_TERMS)} GROUP BY doc_id")
def stored_substring(spark, d):
    """Substrings by trigrams; the one of two letters by all terms."""
    return _stored(spark, d).search(GRAM_TERMS, "substring").withColumn("score", r6("score"))


@query(RANKED + "SELECT doc_id, score FROM hit ORDER BY score DESC, doc_id LIMIT 30")
def stored_top_30(spark, d):
    """The best hits from the blocks whose bounds reach them."""
    return _stored(spark, d).top_k(TERMS, 30)


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey || '|' || o_custkey AS line FROM orders")
def ordered_sink(spark, d):
    """All orders as lines of many files in one order; the place of each by the manifest."""
    path = _path(spark)
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    writers.ordered_text(rows.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("p")), path, F.desc("p"), "o_orderkey", sep="|")
    return readers.ordered_lines(spark, path).select("place", F.regexp_replace("line", r"\|[^|]*$", "").alias("line"))


@query(f"WITH {LINE_SQL} SELECT regexp_extract(line, '<title>(.*?)</title>', 1) AS title, CASE WHEN regexp_matches(line, '<text(.*?)</text>') THEN {BODY_SQL} END AS body, len(regexp_extract_all(line, '\\[\\[.*?\\]\\]')) AS links FROM line WHERE regexp_matches(line, '<title>.*?</title>')")
def wiki_dump_pages(spark, d):
    """Pages that span lines, in a dump of several files with text before, between and after them."""
    path = _path(spark)
    page = F.concat(F.lit("<mediawiki>\n<page> broken off\n<page>"), _wiki_line(keep_ends=True), F.lit("</page>\n</mediawiki>"))
    table(spark, d, "pages").select(page.alias("value")).write.text(path)
    return readers.wiki_pages(readers.wiki_dump(spark, path)).select("title", "body", F.size("links").cast("long").alias("links"))


@query(
    "WITH e AS (SELECT event_type, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 5 MINUTE, true)::INT AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts)), "
    "r AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e) "
    "SELECT event_type AS term, min(ts) AS first, max(ts) + INTERVAL 5 MINUTE AS expires, count(*) AS df FROM r GROUP BY event_type, run"
)
def event_runs(spark, d):
    """The batch form of the stream's frequencies that expire."""
    from weftline.streaming.live import term_runs

    return term_runs(table(spark, d, "events"), F.array("event_type"), expiry="5 minutes")


@query(
    "SELECT event_type, round(sum(value) FILTER (event_id % 5 <> 0), 6) AS total FROM events GROUP BY event_type HAVING count(*) FILTER (event_id % 5 <> 0) > 0"
)
def parseable_sum(spark, d):
    """Sums of the values that are numbers, where every fifth is not."""
    value = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return sentiment.parsed_sum(table(spark, d, "events").select("event_type", value.alias("v")), "event_type", "v")[0].withColumn("total", r6("total"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """The batch form of the streaming window aggregate."""
    from weftline.streaming.live import event_windows as windows

    return windows(table(spark, d, "events")).withColumn("total", r6("total"))


ENTRY = rank_desc

"""A stored index in segments: texts are added part by part, and searched without being read again.

Under the root stand, a directory a segment: `postings` (term, block, doc_id, n), `blocks` (term, block, most, docs), `terms` (folded, term, df),
`grams` (gram, term) and `size` (n_docs), which is written last: a segment without it is not there.  All but the last are sorted in ranges,
so that Parquet's own minima and maxima tell which row groups a search reads, and a frequent term has as many ranges as it
needs.  Frequencies and the number of documents are summed over the segments when the index is searched.

A document belongs to one segment.  Null and empty texts count as documents and have no postings; a table without rows adds an
empty segment."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import index, tally
from weftline.operators.staging import cut, drop

GRAM = 3
#: Documents of like length that stand in one block, about.
PER_BLOCK = 4096
#: Terms that are looked up as literals; more of them are joined.
FEW = 1000
#: Scores are rounded to this many digits before they are ranked, so that equal ones stay equal however they are summed.
DIGITS = 6


def _block(id_column: str, text: str, n_docs: int) -> Column:
    """Documents by length, two classes a doubling, and by hash inside: a term's counts are alike in a block, and its largest is a close bound."""
    parts = max(1, n_docs // (8 * PER_BLOCK))
    size = F.floor(2 * F.log2(F.length(F.coalesce(text, F.lit(""))) + 1))
    return (size * parts + F.pmod(F.xxhash64(id_column), F.lit(parts))).cast("long")


def _grams(term: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(term) - GRAM + 1), lambda i: F.substring(term, i, F.lit(GRAM))))


def add_segment(docs: DataFrame, root: str, id_column: str = "doc_id", text: str = "text", n_docs: int | None = None) -> str:
    """Index docs, a row a document, as one more segment of root; its name.  What other segments hold is not read.  n_docs is
    for sources that leave out empty documents, which count as well."""
    name = "s" + uuid.uuid4().hex
    n_docs = docs.count() if n_docs is None else n_docs
    placed = docs.select(F.col(id_column).alias("doc_id"), _block(id_column, text, n_docs).alias("block"), F.col(text).alias("text"))
    counts = cut(tally.counts(placed, ids=("doc_id", "block")).select("term", "block", "doc_id", "n"))

    def put(df: DataFrame, table: str, *order: str) -> DataFrame:
        ordered = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        path = f"{root.rstrip('/')}/{table}/segment={name}"
        ordered.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    put(counts, "postings", "term", "block", "doc_id")
    blocks = put(counts.groupBy("term", "block").agg(F.max("n").alias("most"), F.count("*").alias("docs")), "blocks", "term", "block")
    terms = put(blocks.groupBy("term").agg(F.sum("docs").alias("df")).select(F.lower("term").alias("folded"), "term", "df"), "terms", "folded", "term")
    put(terms.where(F.length("term") >= GRAM).select(F.explode(_grams(F.col("term"))).alias("gram"), "term"), "grams", "gram", "term")
    put(docs.sparkSession.createDataFrame([(n_docs,)], "n_docs long"), "size")
    drop(counts)
    return name


def segments(spark: SparkSession, root: str) -> DataFrame:
    """(segment, n_docs) of all segments that are whole."""
    return spark.read.schema("n_docs long, segment string").parquet(f"{root.rstrip('/')}/size")


class Stored:
    """The segments that root holds when this is made."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        rows = segments(spark, root).collect()
        self.names = [r.segment for r in rows]
        self.n_docs = sum(r.n_docs for r in rows)
        of = spark.read.parquet(*(f"{self.root}/postings/segment={n}" for n in self.names)).schema["doc_id"].dataType.simpleString()
        self._schemas = {"postings": f"term string, block long, doc_id {of}, n long", "blocks": "term string, block long, most long, docs long", "terms": "folded string, term string, df long", "grams": "gram string, term string"}

    def table(self, name: str) -> DataFrame:
        schema = T.StructType.fromDDL(self._schemas[name] + ", segment string")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").where(F.col("segment").isin(self.names))

    def matching(self, asked: list[str], how: str = "exact") -> DataFrame:
        """(term, df) of the terms that index.matches() takes.  Substrings of three characters or more are looked up by all
        their trigrams and then compared; shorter ones are compared with every term."""
        terms = self.table("terms")
        if how == "exact":
            found = terms.where(F.col("folded").isin([t.lower() for t in asked]) & index.matches(asked, how))
        elif how == "ignore_case":
            found = terms.where(F.col("folded").isin([t.strip().lower() for t in asked]))
        else:
            long = sorted({t.strip() for t in asked if len(t.strip()) >= GRAM})
            short = [t for t in asked if len(t.strip()) < GRAM]
            found = terms.where(index.matches(short, how))
            if long:
                found = found.select("term", "df").unionByName(terms.join(self._with_grams(long).where(~index.matches(short, how)), "term", "left_semi").select("term", "df"))
        return found.groupBy("term").agg(F.sum("df").alias("df"))

    def _with_grams(self, asked: list[str]) -> DataFrame:
        """(term): those that hold all trigrams of an asked string, and the string itself."""
        wanted = [(t, g) for t in asked for g in sorted({t[i : i + GRAM] for i in range(len(t) - GRAM + 1)})]
        needs = self.spark.createDataFrame(wanted, "asked string, gram string")
        sizes = F.create_map(*(F.lit(x) for t in asked for x in (t, sum(1 for w in wanted if w[0] == t))))
        held = self.table("grams").where(F.col("gram").isin(sorted({g for _, g in wanted}))).select("gram", "term").distinct()
        met = held.join(F.broadcast(needs), "gram").groupBy("asked", "term").agg(F.count("*").alias("k"))
        return met.where((F.col("k") == sizes[F.col("asked")]) & F.contains("term", "asked")).select("term").distinct()

    def _weights(self, asked: list[str], how: str) -> tuple[DataFrame, list[str] | None]:
        """(term, idf) of the matching terms, written; and their names where they are few."""
        found = cut(self.matching(asked, how).select("term", F.log10(F.lit(1) + F.expr(f"{self.n_docs}L div df")).alias("idf")))
        few = [r.term for r in found.select("term").limit(FEW + 1).collect()]
        return found, few if len(few) <= FEW else None

    def _met(self, table: str, weights: DataFrame, few: list[str] | None) -> DataFrame:
        rows = self.table(table)
        if few is None:
            return rows.join(weights, "term")
        return rows.where(F.col("term").isin(few) if few else F.lit(False)).join(F.broadcast(weights), "term")

    def search(self, asked: list[str], how: str = "exact") -> DataFrame:
        """(doc_id, score) as index.search() gives over an index of all texts at once."""
        met = self._met("postings", *self._weights(asked, how))
        return met.groupBy("doc_id").agg(F.sum((F.log10("n") + 1) * F.col("idf")).alias("score"))

    def bounds(self, asked: list[str], how: str = "exact") -> DataFrame:
        """(segment, block, bound): no document of the block scores more."""
        return self._bounds(*self._weights(asked, how))

    def _bounds(self, weights: DataFrame, few: list[str] | None) -> DataFrame:
        met = self._met("blocks", weights, few)
        return met.groupBy("segment", "block").agg(F.sum((F.log10("most") + 1) * F.col("idf")).alias("bound"))

    def top_k(self, asked: list[str], k: int, how: str = "exact") -> DataFrame:
        """(doc_id, score): the k best, ties by id.  The k blocks with the greatest bounds hold k hits at least, and the kth score
        among them is a floor: only blocks whose bound reaches it are read."""
        return self.read_top(asked, k, how)[0]

    def read_top(self, asked: list[str], k: int, how: str = "exact") -> tuple[DataFrame, DataFrame]:
        """top_k(), and the (segment, block, bound) of the blocks that it reads."""
        weights, few = self._weights(asked, how)
        bounds = cut(self._bounds(weights, few))
        first = bounds.orderBy(F.desc("bound"), "segment", "block").limit(k)
        floor = self._scored(weights, few, first).orderBy(F.desc("score"), "doc_id").limit(k).agg(F.min("score").alias("least"), F.count("*").alias("n")).first()
        reach = bounds.where(F.col("bound") >= floor["least"] - 10.0**-DIGITS) if floor["n"] == k else bounds
        return index.rank(self._scored(weights, few, reach), k), reach

    def _scored(self, weights: DataFrame, few: list[str] | None, blocks: DataFrame) -> DataFrame:
        met = self._met("postings", weights, few).join(blocks.select("segment", "block"), ["segment", "block"], "left_semi")
        return met.groupBy("doc_id").agg(F.round(F.sum((F.log10("n") + 1) * F.col("idf")), DIGITS).alias("score"))

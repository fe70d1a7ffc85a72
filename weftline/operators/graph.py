"""Link graphs and PageRank over an edge table (src, dst) that keeps multiplicity."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators.staging import cut, cut_bucketed, drop

DAMPING = 0.85
ITERATIONS = 10
CUT_EVERY = 5
#: Targets of a source that stay under one key, at least; sources with more, at most.
LINKS_OF_KEY = 100_000
HUBS = 10_000


def edges(pages: DataFrame, page: str = "html", links: Column | None = None, keep_empty: bool = False) -> DataFrame:
    """(src, dst): a row for each link of each titled page.  Pages that share a title are one source."""
    targets = links if links is not None else tx.wiki_links(F.col(page))
    found = pages.select(tx.title(F.col(page)).alias("src"), F.explode(targets).alias("dst")).where("src IS NOT NULL")
    return found if keep_empty else found.where("dst <> ''")


def nodes(pages: DataFrame, edge_table: DataFrame, page: str = "html") -> DataFrame:
    """(id): every title, all those of a page, and every target."""
    titles = pages.select(F.explode(tx.all_titles(F.col(page))).alias("id"))
    return titles.unionByName(edge_table.select(F.col("dst").alias("id"))).distinct()


def endpoints(edge_table: DataFrame) -> DataFrame:
    return edge_table.select(F.col("src").alias("id")).unionByName(edge_table.select(F.col("dst").alias("id"))).distinct()


def out_degree(edge_table: DataFrame) -> DataFrame:
    return edge_table.groupBy("src").agg(F.count("*").alias("out_degree"))


def node_count(node_table: DataFrame) -> DataFrame:
    return node_table.agg(F.count("*").alias("n_nodes"))


def _number(of: str, salt: int) -> Column:
    return F.when(F.col(of).isNotNull(), F.xxhash64(of, F.lit(salt)))


class Links:
    """Links and nodes laid out for many steps: links (src, dst, n[, key]) in buckets of src, nodes (id, node, k, parts) in buckets
    of node, k being the number of a node's links.  What a step joins lies together already, so a step shuffles nothing but what
    links carry, added up by target in each task first.

    src, dst and node are numbers that stand for ids, so that links are laid out and steps are done without strings: hashes, with
    a salt under which all ids there are have different ones, which is looked up.  An id that is null has no number and no links.

    The links of a source with very many targets are dealt to several keys, and what it gives is sent to each; there are
    HUBS such sources at most, and in such a graph what sources give is shuffled, links are not."""

    def __init__(self, edge_table: DataFrame, node_table: DataFrame):
        spark = edge_table.sparkSession
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ends = edge_table.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(0).alias("own"))
        ids = cut(ends.unionByName(node_table.select("id", F.lit(1).alias("own"))).groupBy("id").agg(F.sum("own").alias("own")))
        salt = next(s for s in count() if ids.groupBy(_number("id", s)).agg(F.count("*").alias("n")).where("n > 1").isEmpty())
        merged = cut(edge_table.select(_number("src", salt).alias("src"), _number("dst", salt).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n")))
        per_key = max(LINKS_OF_KEY, -(-merged.count() // HUBS))
        degrees = merged.groupBy("src").agg(F.sum("n").alias("k"), F.ceil(F.count("*") / per_key).cast("int").alias("parts"))
        # a row for each row of node_table
        own = ids.where("own > 0").select("id", _number("id", salt).alias("node"), F.explode(F.sequence(F.lit(1).cast("long"), "own")).alias("_i")).drop("_i")
        found = own.join(degrees.withColumnRenamed("src", "node"), "node", "left")
        self.nodes = cut_bucketed(found.select("id", "node", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("parts", F.lit(1)).alias("parts")), "node", buckets=self.buckets)
        self.n_nodes, most = self.nodes.agg(F.count("*"), F.max("parts")).first()
        self.keys = ["src"]
        laid = merged
        if (most or 1) > 1:
            # per_key bounds the number of hubs, so they can be sent to all tasks
            hubs = F.broadcast(self.nodes.where("parts > 1").select(F.col("node").alias("src"), "parts"))
            key = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")), F.lit(0)).cast("int")
            laid = merged.join(hubs, "src", "left").select("src", "dst", "n", key.alias("key"))
            self.keys = ["src", "key"]
        self.links = cut_bucketed(laid.repartition(self.buckets, *self.keys), *self.keys, buckets=self.buckets)
        drop(merged)
        drop(ids)

    def received(self, state: DataFrame, gives: Column, sends: Column | None = None) -> DataFrame:
        """(node, got): the sum of what links to a node carry, each an equal share of what its source gives."""
        each = state.where(F.col("k") > 0 if sends is None else (F.col("k") > 0) & sends).select(F.col("node").alias("src"), (gives / F.col("k")).alias("each"), "parts")
        if len(self.keys) > 1:
            each = each.withColumn("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        sent = self.links.join(each.drop("parts").hint("shuffle_hash"), self.keys)
        return sent.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("each") * F.col("n")).alias("got"))

    def steps(self, state: DataFrame, one: Callable[[DataFrame], DataFrame], most: int, more: Column | None = None) -> DataFrame:
        """state after `most` steps of one(), or when `more`, a condition, holds for no row.  Every CUT_EVERY-th state is
        written, where the condition is looked at too: one() must leave a state alone in which it holds for no row."""
        for step in range(1, most + 1):
            state = one(state)
            if step % CUT_EVERY == 0 and step < most:
                seen = Observation()
                # a task that runs twice counts twice, which does not make more of nothing
                now = cut_bucketed(state if more is None else state.observe(seen, F.count_if(more).alias("n")), "node", buckets=self.buckets)
                if step > CUT_EVERY:
                    drop(before)
                state = before = now
                if more is not None and not seen.get["n"]:
                    break
        return state


def pagerank(edge_table: DataFrame, node_table: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """(id, rank) after the given number of steps of rank = (1 - damping) + damping x sum(share), from 1 / nodes.

    A link shares its source's rank by the number of the source's links, repeats counted; ranks are not normalised
    and what a node without links holds is not passed on.  Links are shuffled once in all, when they are merged and laid out
    (`Links`); staging.clear() removes what the result still reads."""
    graph = Links(edge_table, node_table)

    def one(state: DataFrame) -> DataFrame:
        got = graph.received(state, F.col("rank"))
        rank = F.coalesce("got", F.lit(0.0)) * damping + (1 - damping)
        return graph.nodes.join(got.hint("shuffle_hash"), "node", "left").select("id", "node", "k", "parts", rank.alias("rank"))

    start = graph.nodes.withColumn("rank", F.lit(1.0 / max(graph.n_nodes, 1)))
    return graph.steps(start, one, iterations).select("id", "rank")


def pagerank_converged(edge_table: DataFrame, node_table: DataFrame, error: float = 1e-4, damping: float = DAMPING, most: int = 1000) -> DataFrame:
    """(id, rank) where pagerank() does not move on.

    A node holds its rank and what has come since it last sent: the difference to pass on.  Only nodes whose difference is
    over `error` send it, damped and shared by their links, and add it to their rank; the others wait for more.  It ends when none
    is over it, or after `most` steps.  A difference shrinks by the damping with each link, so that what waits at the end, which
    the rank given includes, would have moved ranks by nodes x error x damping / (1 - damping) in all, at most."""
    graph = Links(edge_table, node_table)
    over = F.abs("waits") > error

    def one(state: DataFrame) -> DataFrame:
        got = graph.received(state, F.col("waits"), over)
        waits = F.when(over, F.lit(0.0)).otherwise(F.col("waits")) + F.coalesce("got", F.lit(0.0)) * damping
        rank = F.col("rank") + F.when(over, F.col("waits")).otherwise(F.lit(0.0))
        return state.join(got.hint("shuffle_hash"), "node", "left").select("id", "node", "k", "parts", rank.alias("rank"), waits.alias("waits"))

    # the fixed point is the sum of what 1 - damping at each node becomes on links of every number
    start = graph.nodes.withColumn("rank", F.lit(0.0)).withColumn("waits", F.lit(1.0 - damping))
    return graph.steps(start, one, most, over).select("id", (F.col("rank") + F.col("waits")).alias("rank"))

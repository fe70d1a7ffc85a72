"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame expressions only.

Rows alike in id, source and text are one unit with a count.  Units fall into blocks of their source by a hash.  A source
that must give more words than it has repeats whole passes over itself; the rest of its target is whole blocks in a random
but fixed order, and one boundary block that is cut between rows.  The block quotas of all sources are split down a binary
tree over the output shards: at each node an urn that holds every block is drawn without replacement until the left half
is full, which makes the counts of the sources multivariate hypergeometric.  Each source then deals its permuted blocks to
the shards by those quotas, and `mix` writes shard by shard, shuffled inside each by a hash.

There is a shard for every SHARD_WORDS words, up to 2**DEEPEST; beyond that a shard is dealt to several tasks.  Nothing
depends on the order of rows or on partitions, so reruns agree.  Only sources and blocks (BLOCKS a source, or one for each
shard) are ever gathered: the quotas of one tree node are one row with a number for each source.  The boundary block is
cut by sums over parts of it first, so that only a 2**-10th of it is put in order.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null id is an id like
others; repeated rows count as often as they occur, and where only some of them are taken once more, any of them are; ties
in the order of blocks and rows are broken by their hashes and numbers; a very long text is one row, and the cut beside it
misses the target by half its size at most; an empty table gives an empty table; a table without words takes nothing;
further columns pass through `mix` untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import GAP, fresh, stage, text_of

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
BLOCKS = 512
SHARD_WORDS = 1 << 21
DEEPEST = 10
#: The tree splits at least so often, however small the mix.
SHALLOWEST = 2
SEED = 20


def _source_key(source: Column) -> Column:
    """A string that sorts as the source does by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _unit(*parts) -> Column:
    """A number in [0, 1) from a hash of parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(skey, source_size) with weight and target added: shares of all sizes by weight, held to repeats x the
    source's size, what that frees shared again by weight.  The held sources are those with the least limit per
    weight, so one ordered pass finds them."""
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1)
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "skey")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        sizes.withColumn("weight", w)
        .withColumn("limit", F.col("source_size") * repeats)
        .withColumn("_level", level)
        .withColumn("_place", F.row_number().over(by_limit))
        .withColumn("_level", F.min_by("_level", F.when(F.col("limit") / F.col("weight") >= F.col("_level"), F.col("_place"))).over(everything))
        .withColumn("target", F.least(F.col("limit").cast("double"), F.coalesce(F.col("_level") * F.col("weight"), F.lit(0.0))))
        .drop("_level", "_place", "limit", "weight")
    )


def _split_quotas(quotas: Column, node: Column, shards: int, seed: int) -> Column:
    """The part of quotas that goes to the left half of a node: an urn emptied block by block until the left is full."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    state = lambda left, all_, got: F.struct(left.cast("long").alias("room"), all_.cast("long").alias("rest"), got.alias("got"))

    def one_source(acc, pair):
        drawn = F.aggregate(
            F.when(pair["q"] > 0, F.sequence(F.lit(1).cast("long"), pair["q"])).otherwise(F.array().cast("array<bigint>")),
            F.struct(acc["room"].alias("room"), acc["rest"].alias("rest")),
            lambda a, i: F.struct(
                (a["room"] - F.when(_unit(node, pair["s"], i, F.lit(seed)) * a["rest"] < a["room"], 1).otherwise(0)).cast("long").alias("room"),
                (a["rest"] - 1).cast("long").alias("rest"),
            ),
        )
        return F.get(F.transform(F.array(drawn), lambda d: state(d["room"], d["rest"], F.concat(acc["got"], F.array(acc["room"] - d["room"])))), F.lit(0))

    numbered = F.transform(quotas, lambda q, s: F.struct(q.alias("q"), s.alias("s")))
    room = F.floor(total * (shards // 2) / shards)
    return F.aggregate(numbered, state(room, total, F.array().cast("array<bigint>")), one_source, lambda a: a["got"])


def splitting_tree(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """(skey, quota) to (skey, ends): the running totals of the source's quotas over 2**depth shards."""
    rows = F.array_sort(F.collect_list(F.struct("skey", "quota")))
    nodes = quotas.agg(rows.alias("r")).select(F.lit(1).cast("long").alias("node"), F.col("r.skey").alias("skeys"), F.col("r.quota").alias("quotas"))
    for level in range(depth):
        left = nodes.withColumn("left", _split_quotas(F.col("quotas"), F.col("node"), 2 ** (depth - level), seed))
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")),
        )
        nodes = left.select("skeys", F.explode(children).alias("c")).select("c.node", "skeys", "c.quotas")
    shares = nodes.select("node", F.explode(F.arrays_zip("skeys", "quotas")).alias("x")).select("node", F.col("x.skeys").alias("skey"), F.col("x.quotas").alias("quota"))
    running = F.sum("quota").over(Window.partitionBy("skey").orderBy("node"))
    return shares.withColumn("end", running).groupBy("skey").agg(F.array_sort(F.collect_list("end")).alias("ends"))


def _row_keys(id_column: str, source: str, text: str) -> tuple[Column, Column]:
    parts = [F.col(id_column), F.col(source), F.col(text)]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *(F.coalesce(p.cast("string"), F.lit("-")) for p in reversed(parts)))


def tree_depth(words: float) -> tuple[int, int]:
    """(depth of the tree, tasks that share one shard) for a mix of so many words."""
    depth = min(DEEPEST, max(SHALLOWEST, math.ceil(math.log2(max(words, 1) / SHARD_WORDS))))
    return depth, max(1, math.ceil(words / SHARD_WORDS / 2**depth))


def takes(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", *, weights=WEIGHTS, repeats=MAX_REPEATS, blocks=BLOCKS, depth=None, seed=SEED) -> tuple[DataFrame, int, int]:
    """(units, depth, tasks of a shard). Units, staged: k1, k2, doc_id, size, rows (alike ones), source_size, target, passes
    (copies of every row), extra (how many rows give one more) and dealt (the shard of each copy)."""
    k1, k2 = _row_keys(id_column, source, text)
    units = stage(
        docs.select(
            F.col(id_column).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.size(F.array_remove(F.split(text_of(text), GAP), "")).cast("long").alias("size"), _source_key(F.col(source)).alias("skey")
        )
        .groupBy("k1", "k2")
        .agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("skey").alias("skey"), F.count("*").alias("rows"))
    )
    words = units.agg(F.coalesce(F.sum(F.col("size") * F.col("rows")), F.lit(0))).first()[0]
    fitting, tasks = tree_depth(words)
    depth = fitting if depth is None else depth
    blocks = max(blocks, 2**depth)
    in_block = F.pmod(F.xxhash64("k1", "k2", F.lit(seed)), F.lit(blocks)).cast("int")
    per_block = units.groupBy("skey", in_block.alias("block")).agg(F.sum(F.col("size") * F.col("rows")).alias("block_size"))
    per_source = targets(per_block.groupBy("skey").agg(F.sum("block_size").alias("source_size")), weights, repeats)

    order = Window.partitionBy("skey").orderBy(F.xxhash64("skey", "block", F.lit(seed + 1)), "block")
    before = F.coalesce(F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = F.when(F.col("source_size") > 0, F.least(F.lit(repeats), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("int")
    chosen = stage(
        per_block.join(per_source, "skey")
        .withColumn("passes", full)
        .withColumn("rest", F.when(F.col("passes") < repeats, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0))
        .withColumn("rest", F.col("rest") - before)
        .withColumn("part", F.when(F.col("rest") <= 0, F.lit(0)).when(F.col("rest") >= F.col("block_size"), F.lit(1)).otherwise(F.lit(2)))
        .withColumn("copies", F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0))
    )
    ends = splitting_tree(chosen.groupBy("skey").agg(F.sum("copies").cast("long").alias("quota")), depth, seed)
    place = F.row_number().over(Window.partitionBy("skey").orderBy(F.xxhash64("skey", "block", "pass", F.lit(seed + 2)), "block", "pass"))
    dealt = (
        chosen.where("copies > 0")
        .select("skey", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("pass"))
        .withColumn("place", place)
        .join(ends, "skey")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("place"))))
        .groupBy("skey", "block")
        .agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    )
    # where the boundary block is cut: sums of its parts, in the order of a hash, find the part; the part is put in order
    at = F.pmod(F.xxhash64("k1", "k2", F.lit(seed + 3)), F.lit(1 << 30))
    part = F.shiftright(at, 20).cast("int")
    bound = chosen.where("part = 2").select("skey", "block", "rest")
    parts = units.withColumn("block", in_block).join(bound, ["skey", "block"]).groupBy("skey", "rest", part.alias("cut")).agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    upto = F.sum("words").over(Window.partitionBy("skey").orderBy("cut").rowsBetween(Window.unboundedPreceding, 0))
    cuts = parts.withColumn("left", F.col("rest") - (upto - F.col("words"))).where("left >= 0").groupBy("skey").agg(F.max("cut").alias("cut"), F.min("left").alias("left"))
    of_block = stage(
        chosen.join(dealt, ["skey", "block"], "left").join(cuts, "skey", "left")
        .select("skey", "block", "source_size", "target", "passes", "part", F.when(F.col("part") == 2, F.col("cut")).alias("cut"), "left", F.coalesce("dealt.shard", F.array().cast("array<int>")).alias("dealt"))
    )
    known = units.withColumn("block", in_block).join(of_block, ["skey", "block"]).withColumns({"at": at, "mine": part})
    inside = F.col("cut").isNotNull() & (F.col("mine") == F.col("cut"))
    whole = F.when(F.col("part") == 1, F.col("rows")).when((F.col("part") == 2) & (F.col("mine") < F.col("cut")), F.col("rows")).otherwise(F.lit(0))
    spent = F.sum(F.col("size") * F.col("rows")).over(Window.partitionBy("skey").orderBy("at", "k1", "k2").rowsBetween(Window.unboundedPreceding, 0))
    room = F.col("left") - (spent - F.col("size") * F.col("rows"))
    some = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("rows"), F.floor(room / F.col("size") + 0.5)))).when(room >= 0, F.col("rows")).otherwise(F.lit(0))
    keep = ("k1", "k2", "doc_id", "size", "rows", "source_size", "target", "passes")
    decided = known.where(~inside).select(*keep, whole.cast("long").alias("extra"), "dealt").unionByName(known.where(inside).select(*keep, some.cast("long").alias("extra"), "dealt"))
    return stage(decided), depth, tasks


def plan(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, shards (the shard of each copy in the mix)."""
    units, _, _ = takes(docs, id_column, source, text, **options)
    n = F.col("passes") + F.when(F.col("row") <= F.col("extra"), 1).otherwise(0)
    rows = units.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * n).cast("long").alias("taken"), F.slice("dealt", F.lit(1), n).alias("shards"))


def mix(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", with_place: bool = False, **options) -> DataFrame:
    """The documents of the mix, a copy for each time they are taken, shard by shard and shuffled inside each;
    with_place: with the further columns shard and copy (with underscores before, where docs has such)."""
    units, depth, tasks = takes(docs, id_column, source, text, **options)
    seed = options.get("seed", SEED)
    k1, k2, l1, l2, copies, copy, shard = fresh(docs, "k1", "k2", "l1", "l2", "copies", "copy", "shard")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.withColumns(dict(zip((k1, k2), _row_keys(id_column, source, text), strict=True)))
    each = F.slice("dealt", F.lit(1), F.col("passes") + F.when(F.col("extra") == F.col("rows"), 1).otherwise(0))
    given = units.select(F.col("k1").alias(l1), F.col("k2").alias(l2), each.alias(copies)).where(F.size(copies) > 0)
    out = named.join(given, (F.col(k1) == F.col(l1)) & (F.col(k2) == F.col(l2))).select(*columns, F.posexplode(copies).alias(copy, shard))
    # of a unit that gives one more copy of some of its rows only, any one row stands for them: at most one unit a source
    split = units.where("extra > 0 AND extra < rows")
    if not split.isEmpty():
        more = split.select(F.col("k1").alias(l1), F.col("k2").alias(l2), F.array_repeat(F.get("dealt", F.col("passes")), F.col("extra").cast("int")).alias(copies), F.col("passes").alias(copy))
        one = F.min_by(F.struct(*columns), F.xxhash64(F.to_json(F.struct(*columns))))
        picked = named.join(more, (F.col(k1) == F.col(l1)) & (F.col(k2) == F.col(l2))).groupBy(k1, k2).agg(one.alias("one"), F.first(copies).alias(copies), F.first(copy).alias(copy))
        out = out.unionByName(picked.select(*(F.col(f"one.`{c}`").alias(c) for c in docs.columns), copy, F.explode(copies).alias(shard)))
    order = F.xxhash64(F.col(id_column), F.col(text), F.col(copy), F.lit(seed + 4))
    # a shard in as many tasks as it fills
    out = out.repartition(2**depth * tasks, shard, F.pmod(order, F.lit(tasks))).sortWithinPartitions(shard, order)
    if not with_place:
        return out.drop(shard, copy)
    bare = {c: c[1:] for c in (shard, copy) if c[1:].lower() not in {x.lower() for x in docs.columns}}
    return out.withColumnsRenamed(bare)

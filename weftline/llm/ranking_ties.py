"""The first k lines of every group, by distributed multi-select.

A line's pair is encoded as two longs, (high, low), whose order is that of the ranking.  For all groups at once a binary
search over that space finds the k-th smallest code: each pass counts, for every open group, the lines with a code up to
the middle of its range, moves the range to the half that holds the k-th line and shrinks it to the codes there are.
Counts are exact: lines are first added up to (group, code, n), in each task before anything is shuffled, and neighbouring
codes of a group are packed into one row of at most PACK codes, so that a pass moves packed counts, never lines.  What a
search has passed leaves with it.

Then each line meets its group's k-th code, in a join that can split a hot group, and lines beyond it go.  Those left,
still very many where a hot pair is at the cut, are added up where they are alike, sorted in ranges over all keys, and
each range gives the first k of each group that it holds; the last step sees k lines of a group and range at most.

Nothing is collected or broadcast: a driver sees one number a pass.

Defined results: group keys, pairs and sort keys may be null; null group keys are one group; nulls of the pair and of the
sort keys come last; a discount or amount that is not a number is null, and one beyond a long the nearest long (of those below LAST, which stands for a null); equal
lines take a place each; a group with fewer lines than k gives all; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import stage, unstage

#: The code of a null in either half of a pair.
LAST = (1 << 63) - 1
#: Bits of both halves that codes of one packed row may differ in: 8 x 32 codes.
HIGH_BITS, LOW_BITS = 3, 5
PACK = 1 << (HIGH_BITS + LOW_BITS)


def descending(value: Column) -> Column:
    """A code that puts larger longs first and nulls last.  It is offset by 7, so that small values share a packed row."""
    return F.coalesce(F.lit(7) - value.cast("long"), F.lit(LAST))


def ascending(value: Column) -> Column:
    return F.coalesce(value.cast("long"), F.lit(LAST))


def hundredths(value: Column) -> Column:
    """floor(100 * value + 0.5) as a long below LAST."""
    d = value.cast("double")
    whole = F.floor(F.when(~F.isnan(d), d) * 100 + F.lit(0.5))
    return F.when(whole.isNotNull(), F.least(whole, F.lit(LAST - 1)))


def _middle(a: Column, b: Column) -> Column:
    """floor((a + b) / 2) of longs, without overflow."""
    return F.shiftright(a, 1) + F.shiftright(b, 1) + a.bitwiseAND(b).bitwiseAND(F.lit(1))


def _code(c: Column) -> Column:
    return F.struct(c["high"].alias("high"), c["low"].alias("low"))


def packed_counts(coded: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, cells array<(high, low, n)>): counts of (groups, high, low), PACK codes a row at most."""
    counted = coded.groupBy(*groups, "high", "low").agg(F.count("*").alias("n"))
    packs = [F.shiftright("high", HIGH_BITS).alias("_h"), F.shiftright("low", LOW_BITS).alias("_l")]
    return counted.groupBy(*groups, *packs).agg(F.collect_list(F.struct("high", "low", "n")).alias("cells")).select(*groups, "cells")


def kth_codes(cells: DataFrame, groups: list[str], k: int) -> DataFrame:
    """(groups, first): the codes up to that of each group's k-th line, with their counts, staged.  first holds k at most.

    A range's state: (low, high) codes that may still be the k-th one, and how many lines are wanted from there on."""
    at = lambda c, f: F.transform(c, lambda x: f(x))
    least = F.min(F.array_min(at(F.col("cells"), _code)))
    most = F.max(F.array_max(at(F.col("cells"), _code)))
    total = F.sum(F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"]))
    state = stage(cells.groupBy(*groups).agg(least.alias("from"), most.alias("to"), total.alias("total")).select(*groups, "from", "to", F.least("total", F.lit(k)).alias("want")))
    left, done = cells, None
    while not (open_ := state.where("`from` <> `to`")).isEmpty():
        # where the first halves differ the middle is the last code of a first half, else it halves the second
        one = F.col("from")["high"] == F.col("to")["high"]
        high = F.when(one, F.col("from")["high"]).otherwise(_middle(F.col("from")["high"], F.col("to")["high"]))
        low = F.when(one, _middle(F.col("from")["low"], F.col("to")["low"])).otherwise(F.lit(LAST))
        aimed = open_.withColumn("middle", F.struct(high.alias("high"), low.alias("low")))
        met = left.join(aimed.hint("merge"), groups)
        here = F.filter("cells", lambda c: (_code(c) >= F.col("from")) & (_code(c) <= F.col("to")))
        kept = stage(met.select(*groups, "from", "to", "want", "middle", here.alias("cells")).where(F.size("cells") > 0))
        lower = F.filter("cells", lambda c: _code(c) <= F.col("middle"))
        upper = F.filter("cells", lambda c: _code(c) > F.col("middle"))
        passed = kept.groupBy(*groups).agg(
            F.sum(F.aggregate(lower, F.lit(0).cast("long"), lambda a, c: a + c["n"])).alias("n"),
            F.max(F.array_max(at(lower, _code))).alias("low_to"),
            F.min(F.array_min(at(upper, _code))).alias("high_from"),
            F.min("from").alias("from"), F.max("to").alias("to"), F.max("want").alias("want"),
        )
        inside = F.col("n") >= F.col("want")
        moved = passed.select(
            *groups,
            F.when(inside, F.col("from")).otherwise(F.col("high_from")).alias("from"),
            F.when(inside, F.col("low_to")).otherwise(F.col("to")).alias("to"),
            F.when(inside, F.col("want")).otherwise(F.col("want") - F.col("n")).alias("want"),
        )
        now = stage(moved)
        closed = state.where("`from` = `to`")
        done = closed if done is None else done.unionByName(closed)
        left = kept.select(*groups, "cells")
        state = now
    done = state if done is None else done.unionByName(state)
    # all codes up to the k-th one; the lines below it are fewer than k, so those codes are k at most
    upto = F.filter("cells", lambda c: _code(c) <= F.col("to"))
    found = cells.join(done.select(*groups, "to").hint("merge"), groups).select(*groups, upto.alias("cells")).where(F.size("cells") > 0)
    return stage(found.groupBy(*groups).agg(F.flatten(F.collect_list("cells")).alias("first")))


def first_of_runs(df: DataFrame, groups: list[str], k: int, n: str) -> DataFrame:
    """Of df, sorted within its partitions by groups first, the first rows of each run of a group, until k lines are there;
    n counts a row's lines.  One pass with one run's state."""
    schema = df.schema

    def run(batches):
        last, have = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(b.schema.get_field_index(g)) for g in groups]
            new = np.zeros(b.num_rows, bool)
            for c in keys:
                new[1:] |= ~np.asarray(pa.compute.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False), bool)
            here = tuple(c[0].as_py() for c in keys)
            if here != last:
                new[0], have = True, 0
            lines = b.column(b.schema.get_field_index(n)).to_numpy()
            upto = np.cumsum(lines) - lines  # lines of the batch before each row
            starts = np.flatnonzero(new)
            run_of = np.searchsorted(starts, np.arange(b.num_rows), side="right") - 1
            begin = np.where(run_of >= 0, upto[starts[np.maximum(run_of, 0)]] if len(starts) else 0, -have)
            yield b.filter(pa.array(upto - begin < k))
            tail = lines[starts[-1] if len(starts) else 0 :].sum()
            have = min(k, int(tail) + (0 if len(starts) else have))
            last = tuple(c[b.num_rows - 1].as_py() for c in keys)

    return df.mapInArrow(run, schema)


def top(lines: DataFrame, groups: list[str], high: Column, low: Column, order: list[str], k: int) -> DataFrame:
    """groups, order, high, low, pos, tied: the first k lines of each group.  groups and order name columns of lines, which
    are all that is kept; order breaks ties of (high, low), ascending, nulls last."""
    sides = []
    plain = lines.select(*groups, *order, high.alias("high"), low.alias("low"))
    keys = [f"_k{i}" for i in range(2 * len(groups))]
    for i, g in enumerate(groups):  # keys without nulls, so that joins match them
        zero = F.lit(0).cast(plain.schema[g].dataType)
        sides += [F.col(g).isNull().cast("int").alias(keys[2 * i]), F.coalesce(F.col(g), zero).alias(keys[2 * i + 1])]
    keyed = plain.select(*sides, *order, "high", "low")
    cells = stage(packed_counts(keyed, keys))
    cut = kth_codes(cells, keys, k)

    hit = F.filter("first", lambda c: (c["high"] == F.col("high")) & (c["low"] == F.col("low")))
    near = keyed.join(cut.hint("merge"), keys).select(*keys, *order, "high", "low", hit.alias("hit")).where(F.size("hit") > 0)
    near = stage(near.select(*keys, *order, "high", "low", F.col("hit")[0]["n"].alias("tied")))
    unstage(cells)
    # lines alike are one row with a count; so no value of all keys stands for many rows
    alike = stage(near.groupBy(*keys, "high", "low", *order, "tied").agg(F.count("*").alias("_n")))
    by = [*(F.col(c) for c in (*keys, "high", "low")), *(F.asc_nulls_last(c) for c in order)]
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = alike.repartitionByRange(n, *by).sortWithinPartitions(*by)
    chosen = first_of_runs(ranged, keys, k, "_n")
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(*by[len(keys) :]).rowsBetween(Window.unboundedPreceding, 0))
    placed = chosen.withColumn("_before", upto - F.col("_n")).where(F.col("_before") < k)
    each = placed.withColumn("pos", F.explode(F.sequence(F.col("_before") + 1, F.least(F.col("_before") + F.col("_n"), F.lit(k)))))
    named = [F.when(F.col(keys[2 * i]) == 0, F.col(keys[2 * i + 1])).alias(g) for i, g in enumerate(groups)]
    return each.select(*named, *order, "high", "low", F.col("pos").cast("long").alias("pos"), "tied")


def rank_lines(lines: DataFrame, k: int = 2) -> DataFrame:
    """vendor_id, part, month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied of sale lines: the first k
    of each vendor, part and month by quantity class and discount; a fifth of all sales form one group."""
    pooled = F.col("sale_id").isNotNull() & (F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0)
    own = lambda c: F.when(pooled, F.lit(-1).cast("long")).otherwise(c)
    month = 100 * F.year("shipped_at") + F.month("shipped_at")
    rows = lines.select(
        own(F.col("vendor_id").cast("long")).alias("vendor_id"),
        own(F.coalesce(F.col("item_id") % 5, F.lit(-1)).cast("long")).alias("part"),
        own(F.coalesce(month, F.lit(-1)).cast("long")).alias("month"),
        F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"), F.col("quantity").cast("long").alias("quantity"),
        hundredths(F.col("amount")).alias("amount_cents"), hundredths(F.col("discount")).alias("percent"),
    )
    tens = F.floor(F.col("quantity") / 10)
    found = top(rows, ["vendor_id", "part", "month"], descending(tens), ascending(F.col("percent")), ["sale_id", "line_no", "quantity", "amount_cents"], k)
    percent = F.when(F.col("low") != LAST, F.col("low")).alias("percent")
    return found.select("vendor_id", "part", "month", "pos", F.col("pos").alias("place"), "sale_id", "line_no", "quantity", percent, "amount_cents", "tied")

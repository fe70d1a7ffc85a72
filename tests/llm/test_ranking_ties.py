"""Multi-select against a sort of every group, with hot ties, nulls, equal lines and codes far apart."""

import datetime
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import ranking_ties as rt

SCHEMA = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp, tied string, high int"


def plain(rows, k):
    groups = {}
    h = lambda v: None if v is None or math.isnan(v) else max(-(1 << 63), min(rt.LAST - 1, math.floor(100 * v + 0.5) if math.isfinite(v) else (1 << 63) * (1 if v > 0 else -1)))
    last = lambda v: (v is None, v or 0)
    for s, n, item, vendor, q, amount, discount, _, at, *_ in rows:
        part, month = -1 if item is None else item % 5, -1 if at is None else 100 * at.year + at.month
        key = (-1, -1, -1) if s is not None and zlib.crc32(str(s).encode()) % 5 == 0 else (vendor, part, month)
        groups.setdefault(key, []).append((s, n, q, h(discount), h(amount)))
    out = []
    for key, lines in groups.items():
        pair = lambda x: (last(None if x[2] is None else -(x[2] // 10)), last(x[3]))
        lines.sort(key=lambda x: (*pair(x), *(last(x[i]) for i in (0, 1, 2, 4))))
        out += [(*key, i + 1, i + 1, x[0], x[1], x[2], x[3], x[4], sum(pair(y) == pair(x) for y in lines)) for i, x in enumerate(lines[:k])]
    return sorted(out, key=repr)


def lines(seed, n):
    r = random.Random(seed)
    day = lambda: r.choice([None, *(datetime.datetime(2024, m, 3) for m in (1, 2))])
    rows = []
    for _ in range(n):
        hot = r.random() < 0.3
        rows.append((r.choice([None, *range(40)]), r.choice([None, 1, 2]), 7 if hot else r.choice([None, *range(12)]), 1 if hot else r.choice([None, 1, 2, 3]), r.choice([None, 1, 9, 10, 49, 50]), r.choice([None, 1.005, 2.5]), r.choice([None, 0.0, 0.05, 0.1]), "x", datetime.datetime(2024, 1, 3) if hot else day(), "t", 1))
    return rows + rows[:20]


@pytest.mark.parametrize("k", [1, 2, 7])
def test_against_a_sort(spark, k):
    rows = lines(k, 900)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert sorted(map(tuple, rt.rank_lines(df, k).collect()), key=repr) == plain(rows, k)


def test_wide_pairs_hot_ties_and_odd_numbers(spark):
    """Quantities and discounts over the whole range of their types, more codes than a packed row holds, one tie of many lines."""
    r = random.Random(3)
    rows = [(r.randrange(9), 1, 5, 4, r.randrange(-(1 << 31), 1 << 31), 1.0, r.choice([1e30, -1e30, math.nan, math.inf, r.uniform(-1e9, 1e9)]), "x", None, None, 0) for _ in range(700)]
    rows += [(11, 1, 5, 5, 20, 1.0, 0.1, "x", None, None, 0)] * 500 + [(12, None, 5, 5, 20, 1.0, 0.1, "x", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(map(tuple, rt.rank_lines(df, 3).collect()), key=repr) == plain(rows, 3)


def test_packed_rows_are_bounded(spark):
    coded = spark.range(5000).select(F.lit(1).alias("g"), (F.col("id") % 50).alias("high"), (F.col("id") % 100).alias("low"))
    assert rt.packed_counts(coded, ["g"]).agg(F.max(F.size("cells"))).first()[0] <= rt.PACK


def test_empty(spark):
    assert rt.rank_lines(spark.createDataFrame([], SCHEMA)).count() == 0

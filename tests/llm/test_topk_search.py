"""Histogram selection against brute force, with ties, odd vectors and repeated rows."""

import math

import numpy as np
import pytest

from weftline.llm import topk_search as ts

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in ok if i != q and len(b) == len(a))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("bins", [4096, 7])
def test_against_brute_force(spark, monkeypatch, bins):
    monkeypatch.setattr(ts, "BINS", bins)
    monkeypatch.setattr(ts, "QUERY_BYTES", 100)
    monkeypatch.setattr(ts, "SCORES", 40)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]  # a large tie
    rows += [(420, None), (450, [float("nan")] * 4), (451, [1.0, None, 0.0, 0.0]), (500, [float("inf"), 0.0, 0.0, 0.0]), (550, [1.0, 2.0]), (551, [0.5, 0.25]), (600, [3.0]), rows[100], rows[101]]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    got = {tuple(r) for r in ts.search(df, df.where("vec_id % 50 = 0"), 5).collect()}
    assert got == brute(rows, 5)


def test_scores_beyond_double_precision(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=3) * 10.0 ** rng.integers(0, 9)]) for i in range(60)]
    rows += [(100, [1e6, 3e5, 0.0]), (101, [1e6, 3e5, 0.00390625]), (102, [3e5, 1e6, 1.0]), (150, [3e38, -3e38, 1e30]), (151, [-3e38, -3e38, 1e38]), (152, [3e38, 3e38, 2.0]), (50, [-3e38, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    got = {tuple(r) for r in ts.search(df, df.where("vec_id % 50 = 0"), 5).collect()}
    assert got == brute(rows, 5)
    q = ts.Integers(np.array([1e300, 2.0**52 + 1, -1e300]), 3, 256)
    c = ts.Integers(np.array([1e300, 2.0**-7, 1e300, 0.0, 2.0**-8, 0.0]), 3, 256)
    assert ts.scores(q, c, slice(0, 1)).tolist() == [[512 * (2**52 + 1), 256 * (2**52 + 1)]]
    assert ts.scores(q, q, slice(0, 1)).tolist() == [[ts.MOST]]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1), (2, [2.0], 1)], SCHEMA)
    assert sorted(map(tuple, ts.search(df, df.where("vec_id = 0"), 5).collect())) == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    assert ts.search(df.limit(0), df.limit(0), 5).count() == 0
    alone = df.where("vec_id = 0")
    assert ts.search(alone, alone, 5).count() == 0 and ts.search(df, df.where("vec_id > 5"), 5).count() == 0
    empty = spark.createDataFrame([(0, [], 1), (1, [], 1), (None, [], 1)], SCHEMA)  # a null id takes no part
    assert ts.search(empty, empty.where("vec_id = 0"), 5).where("vec_id = 1").collect()[0].score == 0

"""Exponion search against plain rounds over all centroids, with ties, odd rows and numbers beyond a long."""

import hashlib
import math

import numpy as np
import pytest

from weftline.llm import centroid_clustering as cc

SCHEMA = "vec_id long, embedding array<double>, cluster int"


def plain(rows, k, rounds, dims, scale=256):
    ok = [(i, [math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    raw = {id(v): r for (_, v), r in zip(ok, [v for _, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)], strict=True)}
    first = sorted((x for x in ok if x[0] is not None), key=lambda x: (hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), raw[id(x[1])]))[:k]
    at = [list(v) for _, v in first]
    away = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        held = [[] for _ in at]
        for _, v in ok:
            held[away(v)[1]].append(v)
        at = [[sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else old for mine, old in zip(held, at, strict=True)]
    out = [(i, *away(v)[::-1]) for i, v in ok]
    return sorted(((i, j, min(cc.MOST, d)) for i, j, d in out), key=repr), at


def got(df, **options):
    found, at = cc.cluster(df, **options)
    return sorted(map(tuple, found.collect()), key=repr), at


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_against_plain_rounds(spark, spread):
    rng = np.random.default_rng(5)
    heart = rng.normal(size=(7, 4))
    rows = [(i, (heart[i % 7] + spread * rng.normal(size=4)).tolist()) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 520)]  # repeated vectors, among them first centroids
    rows += [(600, None), (601, [1.0] * 3), (602, [float("nan")] + [0.0] * 3), (603, [None, 0.0, 0.0, 0.0]), (604, [float("inf")] * 4), (None, [0.5] * 4), (3, rows[3][1]), (3, rows[4][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    assert got(df, k=12, rounds=4, dims=4) == plain(rows, 12, 4, 4)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(9) for y in range(9))]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for rounds in (0, 1, 5):
        assert got(df, k=9, rounds=rounds, dims=2, scale=2) == plain(rows, 9, rounds, 2, 2)


def test_numbers_beyond_a_long(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=2) * 10.0 ** rng.integers(0, 30)]) for i in range(60)] + [(90, [1e300, -1e300]), (91, [1e300, 1e308])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert got(df, k=6, rounds=3, dims=2) == plain(rows, 6, 3, 2)


def test_few_and_none(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0], 9), (6, [3.0, 2.0], 9)], SCHEMA)
    assert got(df, k=40, rounds=2, dims=2) == plain([(5, [1.0, 2.0]), (6, [3.0, 2.0])], 40, 2, 2)
    for empty in (df.limit(0), df.where("vec_id > 9")):
        assert cc.report(empty).count() == 0
    report = cc.report(df, dims=2)
    assert {r.inertia for r in report.collect()} == {0} and report.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_most_vectors_are_not_scanned():
    """Bounds save the scan of vectors whose centroids have not moved far, and the ball leaves far centroids out."""
    rng = np.random.default_rng(2)
    heart = rng.integers(-4000, 4000, (20, 8))
    x = np.repeat(heart, 50, axis=0) + rng.integers(-40, 40, (1000, 8))
    start = (heart + rng.integers(-60, 60, heart.shape)).tolist()
    first = cc.Centroids(start, None)
    cluster, upper, lower, _, scanned = first.assign(x, None, None, None)
    assert scanned == 1000
    moved = [[int(v) for v in x[cluster == j].sum(axis=0) // (cluster == j).sum()] for j in range(20)]
    again, upper, lower, distance, scanned = cc.Centroids(moved, start).assign(x, cluster, upper, lower)
    assert scanned == 0 and (again == cluster).all()
    assert (distance == cc.squared(x, np.array(moved)[again])).all()

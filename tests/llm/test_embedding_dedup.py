"""The pigeonhole join against all cosines, with dense cells, copies, scaled and odd vectors."""

import math

import numpy as np
import pytest

from weftline.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<double>, label int, n_links string, node int"


def plain(rows, threshold=ed.THRESHOLD):
    fine = [label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [(u := np.array(v) / np.abs(v).max()) / math.sqrt((u * u).sum()) if ok else None for (_, v, _), ok in zip(rows, fine, strict=True)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if fine[a] and fine[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold:
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for a, r in enumerate(rows):
        if r[0] is not None:
            least[find(a)] = min(least.get(find(a), r[0]), r[0])
    return sorted(((r[0], n[a], (c := least.get(find(a))), r[0] == c and (r[0] is not None or n[a] == 0)) for a, r in enumerate(rows)), key=repr)


def clouds(seed, n, d, labels, spread):
    rng = np.random.default_rng(seed)
    heart = rng.normal(size=(n // 8, d))
    return [(i, (heart[i % len(heart)] + spread * rng.normal(size=d)).tolist(), i % labels) for i in range(n)]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, ed.links(df).collect()), key=repr)


@pytest.mark.parametrize("chunk, d", [(2048, 64), (12, 64), (12, 5), (5, 3)])
def test_against_all_pairs(spark, monkeypatch, chunk, d):
    monkeypatch.setattr(ed, "CHUNK", chunk)
    rows = clouds(chunk + d, 260, d, 2, 0.3)
    assert sum(n for _, n, _, _ in plain(rows)) > 100
    assert run(spark, rows) == plain(rows)


def test_dense_cell_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ed, "CHUNK", 20)
    rng = np.random.default_rng(8)
    one = rng.normal(size=16)
    rows = [(i, (one + 0.12 * rng.normal(size=16)).tolist(), 1) for i in range(120)]
    rows += [(i, one.tolist(), 1) for i in range(200, 240)] + [(240, (1e200 * one).tolist(), 1), (241, (1e-200 * one).tolist(), 1), (242, (-one).tolist(), 1), (243, one.tolist(), 2), (244, one.tolist(), None)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [None] + [1.0] * 15, 1), (305, [float("inf")] + [0.0] * 15, 1), (306, one[:15].tolist(), 1)]
    rows += [(None, one.tolist(), 1), (None, one.tolist(), 7), (None, None, None), (200, one.tolist(), 1), (-0, [0.0, 1.0], 1), (5000, [-0.0, 1.0], 1)]
    assert run(spark, rows) == plain(rows)


def test_at_the_threshold(spark):
    """A cosine of exactly the threshold links; the next one below does not."""
    rows = [(1, [1.0, 0.0], 1), (2, [0.93, math.sqrt(1 - 0.93**2)], 1), (3, [0.0, 1.0], 1), (4, [0.9, 5.0], 2), (5, [5.0, 0.9], 2)]
    assert run(spark, rows) == plain(rows)


def test_every_pair_within_the_share_meets_once():
    """Whatever the number of gridded coordinates, two vectors within the radius share one cell where one is at home."""
    rng = np.random.default_rng(4)
    x, radius = rng.normal(size=(150, 6)) * 0.2, 0.3
    for axes in (0, 1, 3, 6):
        seen = {}
        for rows, to, home in ed.cells(x, radius, axes):
            for i, c in zip(rows.tolist(), map(tuple, to.tolist()), strict=True):
                seen.setdefault(c, []).append((i, home))
        met = {}
        for held in seen.values():
            for p, (i, hi) in enumerate(held):
                for j, hj in held[:p]:
                    if hi or hj:
                        met[min(i, j), max(i, j)] = met.get((min(i, j), max(i, j)), 0) + 1
        close = {(i, j) for i in range(150) for j in range(i + 1, 150) if ((x[i] - x[j]) ** 2).sum() <= radius**2}
        assert close <= met.keys() and max(met.values()) == 1


def test_empty(spark):
    assert run(spark, []) == []

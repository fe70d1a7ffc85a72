"""Exact k-means on integer vectors by exponion search.

Vectors become integers, floor(scale * x).  A vector carries an upper bound u on the distance to its centroid and a lower
bound l on that to every other one.  When centroids have moved, u grows by what its own moved and l shrinks by the most any
other moved.  If u is still less than l, or than half the distance from its centroid to the nearest other one, the centroid
stays and nothing is computed; else u is made exact and tried again.  What is left scans the centroids in the ball of
radius 2 u + s around the vector's centroid, s being the distance from there to the nearest other centroid: nearest and
second nearest lie in it.  For each centroid the others are kept sorted by distance, so that the ball is a prefix of that
list.  Tests are strict and the radius is inclusive, with room for rounding, so that ties are always seen and go to the
smaller number; distances that decide are exact integers (Python's where a long is too short).

An assignment is one pass over the vectors, in whatever partitions they stand: nothing is shuffled but, for each centroid
and component, the sums of the vectors that came and went, added up in each task first.  The driver holds the centroids.
The vectors and their bounds are written to the shared folder after each pass.

Defined results: a vector that is null, has another number of components than `dims`, or holds a null or non-finite one is
left out; one without id is clustered but never a first centroid; repeated rows are as many vectors; among the first
centroids equal hashes are ordered by the vector; with fewer vectors than k there are as many centroids; equal centroids
are told apart by their number, the smaller gets the vectors; an empty centroid stays where it is; a distance or sum
beyond a long is the greatest long; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import stage, unstage
from weftline.llm.topk_search import _usable, _whole

SCALE = 256
DIMS = 64
CENTROIDS = 40
ROUNDS = 5
MOST = (1 << 63) - 1
#: Components up to this give squared distances that fit a long (of 2**12 components and fewer).
SHORT = 1 << 23
LIMB = 30
#: Room for rounding in bounds, which are doubles.
UP, DOWN = 1 + 1e-9, 1 - 1e-9

STATE = "vec_id long, v {}, cluster int, upper double, lower double, distance long, left int, moved boolean"
SUMS = "cluster int, place int, limb int, part long"


def integers(flat: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x): longs, or Python's integers where squares of differences might not fit."""
    x = flat.reshape(-1, dims)
    with np.errstate(over="ignore"):
        d = np.floor(scale * x)
    if np.abs(d).max(initial=0.0) <= SHORT and dims <= 1 << 12:
        return d.astype(np.int64)
    return np.array([_whole(v, scale) for v in x.ravel().tolist()], object).reshape(x.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to the row, or to the rows, of c."""
    d = x - c
    return (d * d).sum(axis=-1)


def roots(d) -> np.ndarray:
    """Square roots as doubles; infinite where a double is too short."""
    try:
        return np.sqrt(np.asarray(d, np.float64))
    except OverflowError:
        return np.array([math.sqrt(v) if v < 1 << 1000 else math.inf for v in np.ravel(d).tolist()]).reshape(np.shape(d))


class Centroids:
    """What one assignment needs: the centroids, for each the others by distance, and what moved since the last one."""

    def __init__(self, at: list[list[int]], before: list[list[int]] | None):
        small = all(abs(v) <= SHORT for c in at for v in c) and len(at[0]) <= 1 << 12
        self.c = np.array(at, np.int64 if small else object)
        k = len(at)
        between = np.array([roots(squared(self.c, self.c[j])) for j in range(k)])
        self.order = np.array([sorted(range(k), key=lambda j, i=i: (j != i, between[i, j], j)) for i in range(k)])
        self.reach = np.take_along_axis(between, self.order, axis=1) * DOWN
        self.nearest = self.reach[:, 1] if k > 1 else np.full(1, math.inf)
        self.moved = self.others = None
        if before is not None:
            moved = np.array([float(roots(squared(np.array(a, object), np.array(b, object)))) for a, b in zip(at, before, strict=True)]) * UP
            top = np.sort(moved)[::-1]
            self.moved, self.others = moved, np.where(moved == top[0], top[min(1, k - 1)] if (moved == top[0]).sum() == 1 else top[0], top[0])

    def assign(self, x: np.ndarray, now: np.ndarray | None, upper, lower):
        """(cluster, upper, lower, distance, rows that were scanned) of the rows of x."""
        n, k = len(x), len(self.c)
        distance = np.zeros(n, x.dtype if x.dtype == self.c.dtype else object)
        if now is None:
            cluster, upper, lower = np.zeros(n, np.int64), np.full(n, math.inf), np.zeros(n)
            open_ = np.arange(n)
        else:
            cluster = now.astype(np.int64)
            lower = lower - self.others[cluster]
            upper = upper + self.moved[cluster]
            distance[:] = squared(x, self.c[cluster])
            safe = upper * UP < np.maximum(lower, self.nearest[cluster] / 2)
            exact = roots(distance) * UP
            upper = np.where(safe, upper, exact)
            open_ = np.flatnonzero(~(upper < np.maximum(lower, self.nearest[cluster] / 2)))
        # the ball is a prefix of the list of the row's centroid; rows are scanned with others whose prefix is about as long
        for a in np.unique(cluster[open_]).tolist():
            rows = open_[cluster[open_] == a]
            near = np.searchsorted(self.reach[a], (2 * upper[rows] + self.nearest[a]) * UP, side="right") if k > 1 else np.ones(len(rows), int)
            width = np.minimum(k, 1 << np.ceil(np.log2(np.maximum(near, 1))).astype(int))
            for w in np.unique(width).tolist():
                mine = rows[width == w]
                tried = np.sort(self.order[a, :w])
                d = np.stack([squared(x[mine], self.c[j]) for j in tried.tolist()], axis=1)
                best = np.argmin(d, axis=1)  # the first of equal ones, which has the smaller number
                at = np.arange(len(mine))
                cluster[mine], distance[mine] = tried[best], d[at, best]
                upper[mine] = roots(d[at, best]) * UP
                if w > 1:
                    d[at, best] = d.max(axis=1)
                    second = roots(d.min(axis=1))
                    lower[mine] = np.where(np.isfinite(second), second * DOWN, 0.0)
                else:
                    lower[mine] = 0.0
        return cluster, upper, lower, distance, len(open_)


def _batch(batch, dims: int, scale: int) -> np.ndarray:
    return integers(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64), dims, scale)


def _assigned(state: DataFrame, centroids: Centroids, dims: int, scale: int, first: bool) -> DataFrame:
    sent = state.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        here = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _batch(b, dims, scale)
            old = None if first else b.column(2).to_numpy()
            upper, lower = (None, None) if first else (b.column(3).to_numpy(), b.column(4).to_numpy())
            cluster, upper, lower, distance, _ = here.assign(x, old, upper, lower)
            moved = np.ones(len(x), bool) if first else cluster != old
            shown = distance if distance.dtype != object else np.array([min(MOST, v) for v in distance.tolist()], np.int64)
            left = np.where(moved, -1 if first else old, -1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(shown, pa.int64()), pa.array(left, pa.int32()), pa.array(moved)],
                names=["vec_id", "v", "cluster", "upper", "lower", "distance", "left", "moved"],
            )

    return state.mapInArrow(run, STATE.format(state.schema["v"].dataType.simpleString()))


def _changes(state: DataFrame, k: int, dims: int, scale: int) -> list:
    """Rows (cluster, place, total): what the sums of the clusters gained and lost; place -1 is the number of vectors.
    Sums go in limbs of 30 bits, so that they stay exact whatever the size of the components."""

    def run(batches):
        gained = np.zeros((k, dims), object)
        count = np.zeros(k, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _batch(b, dims, scale)
            for column, sign in ((2, 1), (6, -1)):
                to = b.column(column).to_numpy()
                for j in np.unique(to[to >= 0]).tolist():
                    gained[j] += sign * x[to == j].sum(axis=0)
                    count[j] += sign * int((to == j).sum())
        out = [(j, -1, 0, int(n)) for j, n in enumerate(count.tolist()) if n]
        for j, i in zip(*np.nonzero(gained), strict=True):
            v, limb = int(gained[j, i]), 0
            sign, v = (-1, -v) if v < 0 else (1, v)
            while v:
                out.append((int(j), int(i), limb, sign * (v & ((1 << LIMB) - 1))))
                v, limb = v >> LIMB, limb + 1
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "place", "limb", "part"])

    parts = state.where("moved").mapInArrow(run, SUMS).groupBy("cluster", "place", "limb").agg(F.sum("part").alias("part"))
    return parts.collect()


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, id_column: str = "vec_id", vector: str = "embedding", salt: str = "2:") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) after `rounds` rounds and a last assignment, staged; and the final centroids."""
    spark = vectors.sparkSession
    v = F.col(vector) if dict(vectors.dtypes)[vector] == "array<float>" else F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.where(_usable(F.col(vector)) & (F.size(vector) == dims)).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id IS NOT NULL").orderBy(order, "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    centroids = [[_whole(x, scale) for x in r.v] for r in first]
    k = len(centroids)
    state = stage(_assigned(rows, Centroids(centroids, None), dims, scale, True))
    sums, sizes = [[0] * dims for _ in range(k)], [0] * k
    for _ in range(rounds):
        for r in _changes(state, k, dims, scale):
            if r.place < 0:
                sizes[r.cluster] += r.part
            else:
                sums[r.cluster][r.place] += r.part << (LIMB * r.limb)
        before, centroids = centroids, [[s // n for s in mine] if n else old for mine, n, old in zip(sums, sizes, centroids, strict=True)]
        now = stage(_assigned(state, Centroids(centroids, before), dims, scale, False))
        unstage(state)
        state = now
    return state.select("vec_id", "cluster", "distance"), centroids


def report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each vector."""
    found, centroids = cluster(vectors, **options)
    spark = vectors.sparkSession
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(total.alias("total")).collect()}
    everything = min(MOST, sum(sums.values()))
    named = [(j, min(MOST, sums.get(j, 0)), everything, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    # one row for each centroid: k of them
    of_cluster = F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(of_cluster, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

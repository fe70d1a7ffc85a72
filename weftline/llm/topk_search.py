"""Exact top-k search by distributed histogram selection.

Vectors are turned into integers, floor(scale * x).  Queries go to the tasks in blocks of QUERY_BYTES, broadcast one after
another; candidates are never moved: each pass scores all of them where they are read.  What leaves a task is not scores
but, for each query, counts by score bin.  The counts of all tasks add up to a global histogram that names the bin of the
k-th best score; that bin is cut into finer bins and counted again until a bin is one integer wide.  Then each query knows
its exact k-th score t and how many candidates at t it still takes, and one more pass gives the rows over t and, of those
at t, the ones with the smallest ids.  A task leaves out bins below its own k-th best score, which cannot hold the global
one, and rows at t that enough others of the same batch precede, so nothing that leaves it grows with the size of a tie.

Scores are exact: in double precision where no sum can reach 2**53, beyond that modulo 2**64, and where a score might not
fit a long, in Python's integers.

Defined results: a vector that is null or has a null or non-finite component takes no part, nor does a null id; vectors are compared only
with those of their length; rows that repeat an id and vector are one query but as many candidates as there are; a
candidate with the query's id is never returned; ties go to the smaller id; a score beyond a long is the nearest long, and
ties there; a very long vector is one row, and takes memory in proportion; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import bound_batches, stage, staged_as

SCALE = 256
BINS = 4096
#: Bytes of queries (8 for a component) that are broadcast at once, and scores that are held at once.
QUERY_BYTES = 16 << 20
SCORES = 1 << 22
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, fine)


def _whole(x: float, scale: int) -> int:
    """floor(scale * x) as the double product gives it; exact integers where that overflows."""
    y = scale * x
    return math.floor(y) if math.isfinite(y) else math.floor(x) * scale


class Integers:
    """Rows of floor(scale * x): as doubles, modulo 2**64, and, where needed, as Python's integers."""

    def __init__(self, flat: np.ndarray, dim: int, scale: int):
        self.x, self.scale = flat.reshape(-1, dim), scale
        with np.errstate(over="ignore"):
            self.double = np.floor(scale * self.x)
        self.largest = float(np.abs(self.double).max(initial=0.0))

    def modulo(self, rows=slice(None)) -> np.ndarray:
        d = self.double[rows]
        if self.largest < 1 << 62:
            return d.astype(np.int64)
        flat = [((_whole(v, self.scale) + (1 << 63)) % (1 << 64)) - (1 << 63) for v in self.x[rows].ravel().tolist()]
        return np.array(flat, np.int64).reshape(d.shape)

    def row(self, i: int) -> list[int]:
        return [_whole(v, self.scale) for v in self.x[i].tolist()]


def scores(q: Integers, c: Integers, rows: slice) -> np.ndarray:
    """Inner products of the queries `rows` with all candidates, as longs."""
    dim = q.x.shape[1]
    a = q.double[rows]
    if q.largest * c.largest * dim < 1 << 53:
        return (a @ c.double.T).astype(np.int64)
    out = np.empty((len(a), len(c.x)), np.int64)
    left, right = q.modulo(rows), c.modulo()
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(len(a)):
            out[i] = (left[i] * right).sum(axis=1)
            # the true sum is that modulo 2**64; it is the same if no rounding could hide a sum beyond a long
            beyond = np.flatnonzero(~((np.abs(a[i]) * np.abs(c.double)).sum(axis=1) < 1 << 62))
            if len(beyond):
                mine = q.row(range(len(q.x))[rows][i])
                for j in beyond.tolist():
                    out[i, j] = min(MOST, max(LEAST, sum(x * y for x, y in zip(mine, c.row(j), strict=True))))
    return out


def _by_length(batch, scale: int):
    """(length, ids, Integers) of the vectors of a batch (vec_id, v), length by length."""
    ids, v = batch.column(0).to_numpy(), batch.column(1)
    sizes = np.diff(v.offsets.to_numpy())
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        part = v.take(pa.array(rows)) if len(rows) < len(sizes) else v
        yield dim, ids[rows], Integers(part.flatten().to_numpy(zero_copy_only=False), dim, scale) if dim else None


def _blocks(asked: DataFrame, dims: list) -> list[tuple[int, int, int]]:
    """(length, block, blocks) so that a block of queries of one length has about QUERY_BYTES."""
    out = []
    for r in dims:
        n = max(1, -(-r.n * max(r.dim, 1) * 8 // QUERY_BYTES))
        out += [(r.dim, b, n) for b in range(n)]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors for each row of queries, both with the given columns."""
    spark = vectors.sparkSession
    bound_batches(spark)

    def clean(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector), lambda x: x.cast("double"))
        return df.where(_usable(F.col(vector)) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))

    rows = clean(vectors)
    asked = stage(clean(queries).distinct().withColumn("dim", F.size("v")))
    dims = asked.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()
    # the largest component of each length, once for all blocks
    largest = {r.dim: r.most for r in rows.groupBy(F.size("v").alias("dim")).agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("most")).collect()} if dims else {}
    path = staged_as(spark)
    result = "query_id long, rank int, vec_id long, score long"
    for dim, block, n in _blocks(asked, dims):
        mine = asked.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)) == block)).select("vec_id", "v").collect()
        if mine:
            _search_block(spark, rows, sorted((r.vec_id, r.v) for r in mine), dim, k, scale, largest.get(dim, 0.0)).write.mode("append").parquet(path)
    if not dims:
        return spark.createDataFrame([], result)
    return spark.read.schema(result).parquet(path)


def _search_block(spark, rows: DataFrame, mine: list, dim: int, k: int, scale: int, largest: float) -> DataFrame:
    ids = np.array([i for i, _ in mine], np.int64)
    sent = spark.sparkContext.broadcast((ids, np.array([v for _, v in mine], np.float64).reshape(len(mine), dim)))
    step = lambda c: max(1, SCORES // max(1, len(c)))

    def parts(batches):
        """(queries from, to, candidate ids, scores, which of them count) of all pairs of this task."""
        q_ids, q = sent.value
        q = Integers(q, dim, scale) if dim else None
        for b in batches:
            for length, c_ids, c in _by_length(b, scale):
                if length == dim:
                    for at in range(0, len(q_ids), step(c_ids)):
                        here = slice(at, at + step(c_ids))
                        s = scores(q, c, here) if dim else np.zeros((len(q_ids[here]), len(c_ids)), np.int64)
                        yield at, c_ids, s, q_ids[here][:, None] != c_ids[None, :]

    unsigned = lambda x: np.asarray(x, np.int64).view(np.uint64)

    def histogram(lo: np.ndarray, need: np.ndarray, width: int, finer: int) -> DataFrame:
        """Counts by bins of `finer` inside each query's [lo, lo + width); the last `need` of them matter."""
        state = spark.sparkContext.broadcast((lo, need))

        def run(batches):
            lo, need = state.value
            for at, _, s, counts in parts(batches):
                low, want = lo[at : at + len(s)], need[at : at + len(s)]
                # distances from lo do not fit a signed long where the bins span all of them
                place = unsigned(s) - unsigned(low)[:, None]
                counts &= (s >= low[:, None]) & (place <= np.uint64(width - 1))
                bins = np.where(counts, (place // np.uint64(finer)).astype(np.int64), -1)
                top = min(k, bins.shape[1])
                best = np.sort(np.partition(bins, -top, axis=1)[:, -top:], axis=1)[:, ::-1]
                least = best[np.arange(len(best)), np.minimum(want, top) - 1]
                i, j = np.nonzero(counts & (bins >= least[:, None]))
                keys, n = np.unique(np.stack([i, bins[i, j]]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[0] + at, pa.int32()), pa.array(keys[1], pa.int32()), pa.array(n, pa.int64())], names=["i", "bin", "n"])

        return rows.mapInArrow(run, "i int, bin int, n long").groupBy("i", "bin").agg(F.sum("n").alias("n"))

    # refine until a bin is one integer wide; the first bins span every score there can be
    bound = _bound(largest, mine, dim, scale)
    least, width = (-bound, 2 * bound + 1) if bound < MOST else (LEAST, 1 << 64)
    lo, need = np.full(len(ids), least, np.int64), np.full(len(ids), k, np.int64)
    while width > 1:
        finer = -(-width // BINS)
        counted = histogram(lo, need, width, finer).join(F.broadcast(spark.createDataFrame(list(enumerate(need.tolist())), "i int, need long")), "i")
        upto = F.sum("n").over(Window.partitionBy("i").orderBy(F.desc("bin")))
        # the bin that holds the last one wanted; where there are fewer, the lowest bin, all of which is wanted
        found = (
            counted.withColumn("upto", upto)
            .groupBy("i")
            .agg(
                F.max(F.when(F.col("upto") >= F.col("need"), F.col("bin"))).alias("bin"),
                F.coalesce(F.max(F.when(F.col("upto") < F.col("need"), F.col("upto"))), F.lit(0)).alias("above"),
                F.min("bin").alias("lowest"),
                F.max_by("n", -F.col("bin")).alias("in_lowest"),
            )
            .collect()
        )
        need = need.copy()
        some = np.zeros(len(ids), bool)
        bins = np.zeros(len(ids), np.int64)
        for r in found:
            some[r.i] = True
            bins[r.i] = r.lowest if r.bin is None else r.bin
            need[r.i] = r.in_lowest if r.bin is None else need[r.i] - r.above
        # queries without any candidate end above every score
        lo = np.array([x + b * finer if ok else MOST for x, b, ok in zip(lo.tolist(), bins.tolist(), some.tolist(), strict=True)], np.int64)
        width = finer
    last = spark.sparkContext.broadcast((lo, need))

    def final(batches):
        lo, need = last.value
        for at, c_ids, s, counts in parts(batches):
            t, want = lo[at : at + len(s)], need[at : at + len(s)]
            i, j = np.nonzero(counts & (s > t[:, None]))
            ti, tj = np.nonzero(counts & (s == t[:, None]))
            # of those at t, the smallest ids, as many as are needed: rows are ordered by query, then id
            order = np.lexsort((c_ids[tj], ti))
            ti, tj = ti[order], tj[order]
            keep = np.arange(len(ti)) - np.searchsorted(ti, ti) < want[ti]
            i, j = np.concatenate([i, ti[keep]]), np.concatenate([j, tj[keep]])
            yield pa.RecordBatch.from_arrays([pa.array(i + at, pa.int32()), pa.array(c_ids[j], pa.int64()), pa.array(s[i, j], pa.int64())], names=["i", "vec_id", "score"])

    best = Window.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    chosen = rows.mapInArrow(final, "i int, vec_id long, score long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = F.broadcast(spark.createDataFrame(list(enumerate(ids.tolist())), "i int, query_id long"))
    return chosen.join(names, "i").select("query_id", "rank", "vec_id", "score")


def _bound(largest: float, mine: list, dim: int, scale: int) -> int:
    """No score of these queries with components up to `largest` lies beyond."""
    asked = max((abs(x) for _, v in mine for x in v), default=0.0)
    return dim * (_whole(largest, scale) + 1) * (_whole(asked, scale) + 1) + 1

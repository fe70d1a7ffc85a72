"""Near-duplicate vectors by a subspace pigeonhole join, exact.

Vectors of one label and length are scaled to unit length; a cosine of at least t is then a squared distance of at most
2 (1 - t).  A fixed rotation (signs, then a Hadamard transform) spreads what a vector holds over all coordinates, which are
cut into BLOCKS blocks.  Each block gets the share of the squared distance that it has of the coordinates, so of two vectors
within the distance at least one block is within its share: the blocks are joined one by one, each under its radius r, and
no pair at the threshold can be missed.

The range join of a block is a grid of side 2 r over its first coordinates: a vector stands in its cell and visits those
later cells that its ball of radius r touches.  The number of gridded coordinates follows from the size of the largest
label, so that cells keep about CHUNK vectors where vectors are spread; a cell with more is cut into parts, and every two
parts meet in one task, so that memory is bounded however dense a cell is.  Rows carry their vector, and a pair whose block
is within its share is verified where it is found, by its cosine in double precision.  Of several blocks the first one that
qualifies counts a pair.  Tasks give out, for each vector, how many it links with there and one link to the vectors joined
so far, never pairs.

Equal vectors of a label are one node with a count throughout.  Links join nodes to components by star steps (`components`).

Defined results: a vector that is null, zero, of no component, or holds a null or non-finite one, and one without label, links with nothing
and is a component of its own; vectors of different lengths do not link; a repeated row is a vector of its own; a row
without id counts as a link and belongs to its component, but names none that has another id, and is kept only if alone;
at the threshold exactly, pairs link; a very long vector is one row, and takes memory in proportion; an empty table gives
an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textscan as ts
from weftline.llm.common import stage, unstage
from weftline.llm.components import components

THRESHOLD = 0.93
BLOCKS = 8
#: Vectors of a cell that meet in one task; more are cut into parts.
CHUNK = 8192
#: Room for rounding in what only proposes a pair.
SLACK = 1e-6
SEED = 13
#: Pairs whose vectors are compared at once.
PAIRS = 1 << 15

ROW = "cell binary, part int, node binary, copies long, home boolean, v {}"


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; cosines stay the same."""
    _, e = np.frexp(np.abs(x).max(axis=1, initial=0.0))
    return np.ldexp(x, -e[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    y = scaled(x)
    return y / np.sqrt((y * y).sum(axis=1))[:, None]


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows filled with zeros to a power of two of BLOCKS or more components, and rotated."""
    n, d = x.shape
    size = max(BLOCKS, 1 << max(0, d - 1).bit_length())
    y = np.zeros((n, size))
    y[:, :d] = x * np.where(np.random.default_rng(SEED).random(d) < 0.5, -1.0, 1.0)
    half = 1
    while half < size:
        z = y.reshape(n, size // (2 * half), 2, half)
        y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return y / math.sqrt(size)


def block_distances(x: np.ndarray, i: np.ndarray, j: np.ndarray, block: int) -> np.ndarray:
    """Squared distances in a block of rotated rows; the same for a pair wherever it is looked at."""
    m = x.shape[1] // BLOCKS
    out = np.zeros(len(i))
    for c in range(block * m, (block + 1) * m):
        d = x[i, c] - x[j, c]
        out += d * d
    return out


def share(threshold: float) -> float:
    """The squared distance that a block may have."""
    return 2 * (1 - threshold) / BLOCKS * (1 + SLACK) + 1e-12


def gridded(largest: int) -> int:
    """Coordinates of a block that the grid uses, so that spread vectors leave about CHUNK in a cell."""
    return max(0, math.ceil(math.log2(max(1, largest / CHUNK))))


def cells(block: np.ndarray, radius: float, axes: int):
    """(row, cell coordinates, home) of the cell of each row and of the later cells that its ball touches."""
    n, side = len(block), 2 * radius * (1 + SLACK)
    at = np.floor(block[:, :axes] / side).astype(np.int64)
    inside = block[:, :axes] - at * side
    step = np.where(inside * 2 < side, -1, 1)
    gap = np.minimum(inside, side - inside)
    yield np.arange(n), at, True
    reach = radius * radius * (1 + SLACK)
    for k in range(1, axes + 1):
        for some in map(list, itertools.combinations(range(axes), k)):
            # later: the first coordinate that differs is greater
            rows = np.flatnonzero(((gap[:, some] ** 2).sum(axis=1) <= reach) & (step[:, some[0]] > 0))
            if len(rows):
                to = at[rows].copy()
                to[:, some] += step[np.ix_(rows, some)]
                yield rows, to, False


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _named(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, node): node names label and vector, null where a row links with nothing."""

    def run(batches):
        for b in batches:
            labels, v = b.column(1).to_pylist(), b.column(2)
            begin = v.offsets.to_numpy()
            flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zeros
            nodes: list[bytes | None] = []
            for i, label in enumerate(labels):
                x = flat[begin[i] : begin[i + 1]]
                fine = label is not None and v[i].is_valid and len(x) and np.isfinite(x).all() and x.any()
                nodes.append(hashlib.blake2b(x.tobytes(), digest_size=16, key=label.encode()[:64] or b"\0", salt=hashlib.blake2b(label.encode(), digest_size=16).digest()).digest() if fine else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(nodes, pa.binary())], names=["vec_id", "label", "v", "node"])

    return vectors.mapInArrow(run, f"vec_id long, label string, v {vectors.schema['v'].dataType.simpleString()}, node binary")


def _dealt(nodes: DataFrame, axes: int, threshold: float) -> DataFrame:
    """ROW: each node in its cell and in the cells it visits, block by block."""
    radius = math.sqrt(share(threshold))

    def run(batches):
        for b in batches:
            sizes = np.diff(b.column(3).offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == d))
                names, labels, copies = part.column(0), part.column(1).to_pylist(), part.column(2)
                x = rotated(unit(_matrix(part.column(3))))
                m = x.shape[1] // BLOCKS
                head = [hashlib.blake2b(f"{d}:{k}".encode(), digest_size=16).digest() for k in labels]
                for block in range(BLOCKS):
                    for rows, to, home in cells(x[:, block * m : (block + 1) * m], radius, min(axes, m)):
                        key = [head[i] + bytes([block]) + c.tobytes() for i, c in zip(rows.tolist(), to, strict=True)]
                        for s in range(0, len(rows), 4096):
                            take = pa.array(rows[s : s + 4096])
                            k = len(take)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(key[s : s + 4096], pa.binary()), pa.array(np.zeros(k, np.int32)), names.take(take), copies.take(take), pa.array(np.full(k, home)), part.column(3).take(take)],
                                names=["cell", "part", "node", "copies", "home", "v"],
                            )

    return nodes.mapInArrow(run, ROW.format(nodes.schema["v"].dataType.simpleString()))


class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def linked(v: np.ndarray, home: np.ndarray, part: np.ndarray, block: int, threshold: float, pair: tuple[int, int] | None):
    """Runs of (i, j) of the pairs that this cell (or these two parts of it) must count."""
    x, y = rotated(unit(v)), scaled(v)
    norm = np.sqrt((y * y).sum(axis=1))
    m, most = x.shape[1] // BLOCKS, share(threshold)
    z = x[:, block * m : (block + 1) * m]
    square = (z * z).sum(axis=1)
    # those at home with all behind them: visitors stand last and do not meet each other
    order = np.argsort(~home, kind="stable")
    at_home = int(home.sum())
    for s in range(0, at_home, 256):
        mine = order[s : min(s + 256, at_home)]
        other = order[s:]
        near = square[mine][:, None] + square[other][None, :] - 2 * (z[mine] @ z[other].T) <= most + SLACK
        near &= np.arange(len(mine))[:, None] < np.arange(len(other))[None, :]
        a, b = np.nonzero(near)
        for at in range(0, len(a), PAIRS):
            i, j = mine[a[at : at + PAIRS]], other[b[at : at + PAIRS]]
            if pair and pair[0] != pair[1]:
                apart = part[i] != part[j]
                i, j = i[apart], j[apart]
            keep = block_distances(x, i, j, block) <= most
            for earlier in range(block):
                i, j = i[keep], j[keep]
                keep = block_distances(x, i, j, earlier) > most
            i, j = i[keep], j[keep]
            fine = (y[i] * y[j]).sum(axis=1) / (norm[i] * norm[j]) >= threshold
            yield i[fine], j[fine]


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, other, n): n links of node found in a cell, and one node that it is joined with there."""
    keys = rows.columns[:3]

    def run(batches):
        for g in ts.groups(batches, 3):
            if g.num_rows < 2:
                continue
            column = lambda name: pa.concat_arrays(g.column(name).chunks)
            home = column("home").to_numpy(zero_copy_only=False)
            if not home.any():
                continue
            nodes, copies, part = column("node").to_pylist(), column("copies").to_numpy(), column("part").to_numpy()
            pair = (g.column("i")[0].as_py(), g.column("j")[0].as_py())
            links, union = np.zeros(len(nodes), np.int64), Union(len(nodes))
            for i, j in linked(_matrix(column("v")), home, part, g.column("cell")[0].as_py()[16], threshold, pair):
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    union.join(a, b)
            some = np.flatnonzero(links).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[x] for x in some], pa.binary()), pa.array([nodes[union.find(x)] for x in some], pa.binary()), pa.array(links[some])], names=["node", "other", "n"]
            )

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node binary, other binary, n long")


def _seated(dealt: DataFrame, chunk: int) -> DataFrame:
    """(cell, i, j, ...): a cell of over `chunk` rows is cut into parts, and its rows stand in every two parts that hold them."""
    sizes = stage(dealt.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > chunk))
    if sizes.isEmpty():
        return dealt.select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), "part", "node", "copies", "home", "v")
    met = stage(dealt.join(sizes.hint("merge"), "cell", "left"))
    parts = F.coalesce(F.ceil(F.col("size") * 2 / chunk), F.lit(1)).cast("int")
    own = met.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    seat = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, "part").alias("i"), F.greatest(o, "part").alias("j")))
    return own.withColumn("at", F.explode(seat)).select("cell", "at.i", "at.j", "part", "node", "copies", "home", "v")


def links(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vector."""
    v = F.col(vector) if dict(vectors.dtypes)[vector] == "array<float>" else F.transform(F.col(vector), lambda x: x.cast("double"))
    whole = F.when(F.forall(v, lambda x: x.isNotNull()), v)
    named = _named(vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), whole.alias("v")))
    # equal vectors of a label meet as counts; every row keeps the name of its node
    nodes = stage(named.where("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("v").alias("v")))
    names = stage(named.select("vec_id", "node"))
    largest = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    dealt = _dealt(nodes.select("node", "label", "copies", "v"), gridded(largest), threshold)
    found = stage(_verified(_seated(dealt, CHUNK), threshold))
    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.select("node", "copies", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = stage(known.groupBy("root").agg(F.min("least").alias("component_id")))
    told = stage(known.join(least, "root").join(counted, "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    linked_rows = names.where("node IS NOT NULL").join(told.hint("merge"), "node").select("vec_id", "n_links", "component_id")
    alone = names.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked_rows.unionByName(alone)
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")) & (F.col("vec_id").isNotNull() | (F.col("n_links") == 0))
    return both.select("vec_id", "n_links", "component_id", kept.alias("kept"))

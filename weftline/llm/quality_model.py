"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

Words are runs of letters (lower case), digits or symbols, hashed into VOCAB buckets.  Each bucket has a sparse random
index vector; its word vector adds to that the normalised sum of the index vectors of its neighbours over the whole
corpus (window of two each side).  A document is the mean of its word vectors, and of index vectors of the shapes of its
words (kind, case, length, whether a word repeats the one before), with three pooled lengths.  All sums are of whole
numbers, so they do not depend on partitions.

The network is fitted on at most TRAIN_ROWS labelled rows, chosen by hash, and calibrated on a tenth of those.  Labels
are read only from rows whose crc32(doc_id as text) mod 4 is not 2; no score sees a label, lang, source or doc_id.
What reaches the driver is bounded: VOCAB x DIM sums and TRAIN_ROWS feature rows.

Defined results: a null or empty text has a zero vector and gets a score too; a very long text is pooled whole; a null
doc_id is never held out and never labelled; repeated rows are scored alike, and of those of one id that are labelled, one
with the least features is learned from; ties of the hash that chooses training rows go by id and label; without any labels
every score is 0.5; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textscan as ts
from weftline.llm.common import bound_batches, stage

VOCAB = 1 << 15
DIM = 32
WINDOW = 2
NONZERO = 2
SHAPES = 64
SHAPE_DIM = 32
FEATURES = DIM + SHAPE_DIM + 3
HIDDEN = 32
TRAIN_ROWS = 20_000
EPOCHS = 25
CUT = 0.7
SEED = 3
SLICES = 64

# classes of bytes: 0 space, 1 letter (and every byte of a longer character), 2 digit, 3 symbol
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def index_vectors(n: int, dim: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The NONZERO places and signs of n sparse ternary vectors."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, dim, (n, NONZERO)), rng.integers(0, 2, (n, NONZERO)) * 2 - 1


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(row, bucket, shape) of every word of a run of rows."""
    n = len(data)
    kind = _CLASS[data]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < n]] = True
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    keep = kind[begin] > 0
    begin, end = begin[keep], end[keep]
    row = np.searchsorted(offsets, begin, "right") - 1
    h = ts.spans(ts.running(_LOWER[data]), begin, end)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    size = end - begin
    caps = upper[end] - upper[begin]
    case = np.where(caps == 0, 0, np.where((caps == size) & (size > 1), 2, 1))
    # whether the word, or the one a symbol away, is the same again
    same = np.zeros(len(h), bool)
    same[1:] |= (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    same[2:] |= (h[2:] == h[:-2]) & (row[2:] == row[:-2]) & (kind[begin][2:] == 1)
    length = np.minimum(np.log2(size).astype(np.int64), 3)
    shape = (kind[begin].astype(np.int64) % 3) * 24 + case * 8 + length * 2 + same
    return row, (h % np.uint64(VOCAB)).astype(np.int64), np.minimum(shape, SHAPES - 1) if SHAPES < 72 else shape


def corpus_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """VOCAB x DIM word vectors from the neighbours of every word of the corpus."""
    bound_batches(docs.sparkSession)

    def gather(batches):
        place, sign = index_vectors(VOCAB, DIM)
        total = np.zeros(VOCAB * DIM)
        for b in batches:
            for _, _, data, offsets in ts.chunks(b.column(0)):
                row, bucket, _ = tokens(data, offsets)
                for off in range(1, WINDOW + 1):
                    ok = row[off:] == row[:-off]
                    left, right = bucket[:-off][ok], bucket[off:][ok]
                    for word, near in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            total += np.bincount(word * DIM + place[near, k], sign[near, k], VOCAB * DIM)
        yield from _slices(total)

    def _slices(total):
        if total.any():
            parts = np.split(total.astype(np.int64), SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "sums"])

    def add(batches):
        # one running sum a slice, whatever the number of rows
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(s, np.int64)
                sums[p] = sums[p] + x if p in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "sums"])

    kind = "part int, sums binary"
    first = docs.select(text).mapInArrow(gather, kind)
    # added in two steps, so that no task reads a slice of every input partition
    halfway = first.repartition(SLICES, "part", F.spark_partition_id() % 32).mapInArrow(add, kind)
    rows = halfway.repartition("part").mapInArrow(add, kind).collect()
    total = np.zeros(VOCAB * DIM)
    for r in rows:
        at = r.part * (VOCAB * DIM // SLICES)
        total[at : at + VOCAB * DIM // SLICES] = np.frombuffer(r.sums, np.int64)
    total = total.reshape(VOCAB, DIM)
    size = np.linalg.norm(total, axis=1, keepdims=True)
    own = np.zeros((VOCAB, DIM))
    place, sign = index_vectors(VOCAB, DIM)
    np.add.at(own, (np.arange(VOCAB)[:, None], place), sign)
    return (own + total / np.maximum(size, 1)).astype(np.float32)


def features(docs: DataFrame, vectors: np.ndarray, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): each document's pooled vector, FEATURES numbers as bytes."""

    def run(batches):
        place, sign = index_vectors(SHAPES, SHAPE_DIM, SEED + 1)
        shapes = np.zeros((SHAPES, SHAPE_DIM), np.float32)
        np.add.at(shapes, (np.arange(SHAPES)[:, None], place), sign)
        for b in batches:
            out = np.zeros((b.num_rows, FEATURES), np.float32)
            for at, to, data, offsets in ts.chunks(b.column(1)):
                row, bucket, shape = tokens(data, offsets)
                n = np.bincount(row, minlength=to - at)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                begin = np.searchsorted(row, full)
                x = out[at:to]
                size = n[full, None]
                x[full, :DIM] = np.add.reduceat(vectors[bucket], begin, axis=0) / size
                x[:, DIM : DIM + SHAPE_DIM] = (np.bincount(row * SHAPES + shape, minlength=(to - at) * SHAPES).reshape(-1, SHAPES) @ shapes) / np.maximum(n, 1)[:, None]
                x[:, -3] = np.log1p(n)
                x[:, -2] = np.log1p(np.diff(offsets) / np.maximum(n, 1))
                x[:, -1] = np.log1p(np.add.reduceat(np.append(data == 10, False), offsets[:-1])) * (np.diff(offsets) > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in out], pa.binary())], names=["doc_id", "x"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, x binary")


class Network:
    """Two layers, tanh between, trained with Adam on log loss, then one temperature fitted on rows set aside."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = self._in(x)
        aside = rng.random(len(z)) < 0.1
        if aside.all() or not aside.any() or len(set(y[~aside])) < 2:
            aside[:] = False
        fit, target = z[~aside], y[~aside]
        d = z.shape[1]
        w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(fit))
            for at in range(0, len(order), 128):
                k = order[at : at + 128]
                hidden = np.tanh(fit[k] @ w[0] + w[1])
                p = self._sigmoid(hidden @ w[2] + w[3])
                g = (p - target[k]) / len(k)
                back = np.outer(g, w[2]) * (1 - hidden**2)
                grads = [fit[k].T @ back + 1e-3 * w[0], back.sum(0), hidden.T @ g + 1e-3 * w[2], g.sum(keepdims=True)]
                t += 1
                for i, gr in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * gr
                    v[i] = 0.999 * v[i] + 0.001 * gr**2
                    w[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if aside.any():
            logit, truth = self._logit(z[aside]), y[aside]
            loss = lambda s: np.mean(np.logaddexp(0, logit / s) - truth * logit / s)
            self.temperature = float(min(np.geomspace(0.125, 8, 97), key=loss))

    @staticmethod
    def _sigmoid(a):
        return 1 / (1 + np.exp(-np.clip(a, -40, 40)))

    def _in(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logit(self, z):
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._logit(self._in(x)) / self.temperature)


def _held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> Network | None:
    """A network for features() from the labels of rows that are not held out, most of them at most."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~_held_out()).select("doc_id", F.col(label).cast("int").alias("y"))
    # at most `most` labels by hash, and one row of each id, so that rows that repeat an id neither crowd out others nor
    # depend on what is read first
    known = known.distinct()
    n = known.count()
    if n > 2 * most:
        # few more than wanted go on to be put in order
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * (1.2 * most + 1000) / n))
    order = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))
    chosen = known.orderBy(order, "doc_id", "y").limit(most)
    got = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.doc_id, r.y, bytes(r.x)))
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(len(got), FEATURES).astype(np.float64)
    return Network(x, np.array([r.y for r in got], np.float64))


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row a document."""
    rows = stage(features(docs, corpus_vectors(docs, text), id_column, text))
    net = train(rows, labels)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(b.num_rows, FEATURES).astype(np.float64)
                s = net.scores(x) if net else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

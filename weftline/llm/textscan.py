"""Vectorised looks at batches of texts: bytes, words and hashes of both, in numpy.

Hashes of spans come from one running polynomial sum modulo 2**64: the hash of a span is a difference of two sums,
brought back to the span's start by the inverse power, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * BASE**i before each place; one longer than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans [start, end)."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows after, bytes, offsets of rows in bytes) of runs of rows that together have about `most` bytes.
    A null is an empty text; a longer single text is a run of its own."""
    a = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if a.null_count:
        a = a.fill_null(b"")
    n = len(a)
    if not n:
        return
    _, offsets, data = a.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + a.offset)[a.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the number of words): no word crosses from one row to the next."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_SPACE[data]
    begins = inside.copy()
    begins[1:n] &= ~inside[: n - 1]
    begins[offsets[:-1]] |= inside[offsets[:-1]]
    starts = np.flatnonzero(begins[:n])
    stops = inside[:n].copy()
    if n:
        stops[: n - 1] &= ~inside[1:n] | begins[1:n]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans(running(data), starts, ends)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k neighbouring values; len(hashes) - k + 1 of them, or none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * BASE + hashes[i : i + n]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbouring values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def groups(batches, n_keys: int) -> Iterator[pa.Table]:
    """Tables with all neighbouring rows of one key (the first n_keys columns) from batches sorted by key."""
    waiting: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        changed = np.zeros(b.num_rows, bool)
        for c in range(n_keys):
            x = b.column(c)
            changed[1:] |= ~np.asarray(pa.compute.equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False), bool)
        cuts = [*np.flatnonzero(changed), b.num_rows]
        first = tuple(b.column(c)[0].as_py() for c in range(n_keys))
        if waiting and first != key:
            yield pa.Table.from_batches(waiting)
            waiting = []
        at = 0
        for cut in cuts:
            waiting.append(b.slice(at, cut - at))
            at = cut
            if cut < b.num_rows:
                yield pa.Table.from_batches(waiting)
                waiting = []
        key = tuple(b.column(c)[b.num_rows - 1].as_py() for c in range(n_keys))
    if waiting:
        yield pa.Table.from_batches(waiting)


def whole_groups(batches, n_keys: int, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about `rows` rows or more from batches sorted by key, cut only where the key changes."""
    held: list[pa.RecordBatch] = []
    n = 0
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in range(n_keys)]
        if n >= rows and tuple(k[0] for k in keys) != last:
            yield pa.Table.from_batches(held)
            held, n = [], 0
        last = tuple(k[-1] for k in keys)
        if n + b.num_rows >= rows:
            other = np.zeros(b.num_rows, bool)
            for k in keys:
                other |= k != k[-1]
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if cut:
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
                held, n = [], 0
                b = b.slice(cut)
        held.append(b)
        n += b.num_rows
    if held:
        yield pa.Table.from_batches(held)

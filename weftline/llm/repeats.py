"""Seed and extend: how substring dedup and suffix-array dedup find the places that can match.

A text is a row of units (bytes or words) and a window is `width` of them.  Every window picks the least hash among its
seeds (`seed` units each, leftmost on ties), its anchor, which depends on nothing but its content, so equal windows have
the same anchor at the same place.  Neighbouring windows with one anchor form a block.  Texts are joined on the hashes of
anchors; blocks whose anchor stands nowhere else go at once.  What is left is told apart by content: a keyed 128-bit
BLAKE2 hash of a block's units names the content, and each different content of an anchor goes on once, with its text.

`compare` brings the contents of an anchor together.  Up to SOLO of them meet in one task, which extends them both ways
by their text.  An anchor with more is not gathered: every content is joined to one that represents the anchor, both are
extended both ways from it, and what they share is settled.  A window that reaches beyond the match can only equal
windows that reach as far with the same unit after it, so it goes on under a longer anchor: the old one, the length of
the match and that unit.  Anchors grow until their groups fit a task.  Either way text decides, never a hash of a seed.

Rows are (doc, tie, s1, cnt): windows starting at s1, s1 + 1, ... (cnt of them) of the document (doc, tie), where tie
is a hash of its text and a null doc_id counts as the largest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textscan as ts
from weftline.llm.common import fresh, stage, text_of, unstage

NO_ID = (1 << 63) - 1
#: Contents of one anchor that one task compares.
SOLO = 256
SALT = b"weftline content"
PLACE = ("doc", "tie", "s1")


def keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """doc, tie, text, all not null; (doc, tie) names a document."""
    t = text_of(text)
    doc = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID).cast("long"))
    return docs.select(doc.alias("doc"), F.xxhash64(t).alias("tie"), t.alias("text"))


class Units:
    """The units of a run of rows: hashes, where each row's begin, and the bytes of any span of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: bool):
        if not words:
            self.values, self.first, self.buffer, self.begin, self.end = data, offsets, memoryview(np.ascontiguousarray(data)), None, None
            return
        starts, ends, self.first = ts.words(data, offsets)
        self.values = ts.word_hashes(data, starts, ends)
        # the words with one space after each
        size = ends - starts
        self.begin = np.cumsum(size + 1) - (size + 1)
        self.end = self.begin + size
        out = np.full(int((size + 1).sum()), 32, np.uint8)
        rest = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(self.begin, size) + rest] = data[np.repeat(starts, size) + rest]
        self.buffer = memoryview(out)

    def spans(self, a: np.ndarray, b: np.ndarray) -> Iterator[memoryview]:
        """The bytes of units [a, b) for each pair."""
        if self.begin is not None:
            a, b = self.begin[a], self.end[b - 1]
        view = self.buffer
        return (view[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True))

    def names(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """128-bit names of the units [a, b), as pairs of longs."""
        hashed = hashlib.blake2b
        return np.frombuffer(b"".join([hashed(x, digest_size=16, salt=SALT).digest() for x in self.spans(a, b)]), np.int64).reshape(-1, 2)


def blocks(values: np.ndarray, first: np.ndarray, width: int, seed: int):
    """(row, first unit in the run, number of windows, place of the anchor in the block, anchor hash) of every block."""
    n = len(values)
    if n < width:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.view(np.uint64)
    sums = ts.running(values)
    at = np.arange(n - seed + 1)
    g = ts.spans(sums, at, at + seed)
    pick = ts.sliding_min((g & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), width - seed + 1) & np.uint64(0xFFFFFFFF)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: n - width + 1]
    fits = np.arange(n - width + 1) + width <= first[row + 1]
    new = np.ones(n - width + 1, bool)
    new[1:] = (pick[1:] != pick[:-1]) | (row[1:] != row[:-1]) | (fits[1:] != fits[:-1])
    begin = np.flatnonzero(new)
    cnt = np.diff(np.append(begin, n - width + 1))
    ok = fits[begin]
    begin, cnt = begin[ok], cnt[ok]
    p = pick[begin].astype(np.int64)
    return row[begin], begin, cnt, p - begin, g[p]


def fold(name: np.ndarray, doc, tie, s1, earliest: bool):
    """Of rows of one content, one goes on for all: (places that go on, how many rows each stands for, places known to be
    repeats).  earliest: the first place is no repeat of the others, and rows at one place are one; otherwise every row of
    a content that has two is a repeat."""
    order = np.lexsort((s1, tie, doc, name[:, 1], name[:, 0]))
    k = name[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]).any(axis=1)
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    size = np.diff(np.append(begin, len(k)))
    lead = order[begin]
    if earliest:
        mine, of = order, lead[group]
        known = order[(doc[mine] != doc[of]) | (tie[mine] != tie[of]) | (s1[mine] != s1[of])]
    else:
        known = order[size[group] > 1]
    return lead, size, known


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def anchors(rows: DataFrame, words: bool, width: int, seed: int) -> DataFrame:
    """(h): anchors that stand in two blocks or more.  Counted inside each batch before anything is shuffled."""

    def run(batches):
        for b in batches:
            found = []
            for _, _, data, offsets in ts.chunks(b.column(0)):
                if words:
                    starts, ends, first = ts.words(data, offsets)
                    found.append(blocks(ts.word_hashes(data, starts, ends), first, width, seed)[4])
                else:
                    found.append(blocks(data, offsets, width, seed)[4])
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(n, pa.int64())], names=["h", "n"])

    return rows.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


BLOCK = "kind int, h long, c1 long, c2 long, doc long, tie long, s1 int, cnt int, off int, n int"


def named_blocks(rows: DataFrame, words: bool, width: int, seed: int, earliest: bool) -> DataFrame:
    """Blocks of keyed(): kind 0 to be compared, one for all of its content in a batch, n of them; kind 1: known repeats."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, ties = b.column(0).to_numpy(), b.column(1).to_numpy()
            found = []
            for at, _, data, offsets in ts.chunks(b.column(2)):
                u = Units(data, offsets, words)
                row, begin, cnt, off, h = blocks(u.values, u.first, width, seed)
                if len(row):
                    found.append((docs[at + row], ties[at + row], begin - u.first[row], cnt, off, _signed(h), u.names(begin, begin + cnt - 1 + width)))
            if not found:
                continue
            doc, tie, s1, cnt, off, h, name = (np.concatenate(x) for x in zip(*found, strict=True))
            go, n, known = fold(name, doc, tie, s1, earliest)
            # known repeats take no part in the comparison: a hash of their place spreads them
            spread = _signed(ts.mix(doc[known].view(np.uint64) + s1[known].astype(np.uint64)))
            none = np.zeros(len(known), np.int64)
            both = np.concatenate([go, known])
            small = lambda x: pa.array(x, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    small(np.repeat([0, 1], [len(go), len(known)])), pa.array(np.concatenate([h[go], spread])), pa.array(np.concatenate([name[go, 0], none])), pa.array(np.concatenate([name[go, 1], none])),
                    pa.array(doc[both]), pa.array(tie[both]), small(s1[both]), small(cnt[both]), small(off[both]), small(np.concatenate([n, none])),
                ],
                names=[f.split()[0] for f in BLOCK.split(", ")],
            )

    return rows.select("doc", "tie", "text").mapInArrow(run, BLOCK)


def bordered_blocks(rows: DataFrame, width: int, seed: int) -> DataFrame:
    """Every block of keyed() in bytes, named, with the bytes that precede its first window and follow its last; -1: none."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, ties = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at, _, data, offsets in ts.chunks(b.column(2)):
                u = Units(data, offsets, False)
                row, begin, cnt, off, h = blocks(u.values, u.first, width, seed)
                if not len(row):
                    continue
                end = begin + cnt - 1 + width
                left = np.where(begin > u.first[row], data[np.maximum(begin - 1, 0)].astype(np.int32), -1)
                right = np.where(end < u.first[row + 1], data[np.minimum(end, len(data) - 1)].astype(np.int32), -1)
                name = u.names(begin, end)
                columns = (_signed(h), name[:, 0], name[:, 1], docs[at + row], ties[at + row], begin - u.first[row], cnt, off, left, right)
                types = [pa.int64()] * 5 + [pa.int32()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["h", "c1", "c2", *PLACE, "cnt", "off", "before", "after"])

    return rows.select("doc", "tie", "text").mapInArrow(run, "h long, c1 long, c2 long, doc long, tie long, s1 int, cnt int, off int, before int, after int")


#: A content of an anchor: the key it is grouped by, the first window and the number of windows of its block, the place of
#: the anchor in the block, the windows [lo, hi] not settled yet, how many rows have it, and its units.
CONTENT = "k1 long, k2 long, doc long, tie long, s1 int, cnt int, off int, lo int, hi int, n long, text binary"
#: Settled windows: the name of what they hold, and the place of the first in its block.
RANGES = "k1 long, k2 long, doc long, tie long, s1 int, cnt int, off int"


def ranges_batch(k1, k2, doc, tie, s1, cnt, off) -> pa.RecordBatch:
    columns = [pa.array(x, t) for x, t in zip((k1, k2, doc, tie, s1, cnt, off), [pa.int64()] * 4 + [pa.int32()] * 3, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in RANGES.split(", ")])


def contexts(rows: DataFrame, wanted: DataFrame, words: bool, width: int) -> DataFrame:
    """CONTENT rows with the number of contents of their anchor, cut from the texts of rows.  wanted: doc, tie, and at, an
    array of h, s1, cnt, off, n, of_anchor."""

    def run(batches):
        before = None
        for b in batches:
            docs, ties, at = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            # rows alike in id and text stand together here: the first of them is cut for all
            once = np.ones(b.num_rows, bool)
            once[1:] = (docs[1:] != docs[:-1]) | (ties[1:] != ties[:-1])
            if b.num_rows:
                once[0] = before != (docs[0], ties[0])
                before = (docs[-1], ties[-1])
            each = np.diff(at.offsets.to_numpy())
            flat = at.flatten()
            h, s1, cnt, off, n, of_anchor = (flat.field(k).to_numpy().astype(np.int64) for k in range(6))
            owner = np.repeat(np.arange(b.num_rows), each)
            for lo, hi, data, offsets in ts.chunks(b.column(2)):
                k = np.flatnonzero((owner >= lo) & (owner < hi) & once[owner])
                if not len(k):
                    continue
                u = Units(data, offsets, words)
                a = u.first[owner[k] - lo] + s1[k]
                cut = [bytes(x) for x in u.spans(a, a + cnt[k] - 1 + width)]
                small = lambda x: pa.array(x, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[k]), pa.array(np.zeros(len(k), np.int64)), pa.array(docs[owner[k]]), pa.array(ties[owner[k]]), small(s1[k]), small(cnt[k]), small(off[k]), small(np.zeros(len(k), int)), small(cnt[k] - 1), pa.array(n[k]), pa.array(cut, pa.binary()), pa.array(of_anchor[k])],
                    names=[*(f.split()[0] for f in CONTENT.split(", ")), "of_anchor"],
                )

    return rows.join(wanted, ["doc", "tie"]).select("doc", "tie", "text", "at").mapInArrow(run, CONTENT + ", of_anchor long")


def name(part, words: bool) -> tuple[int, int]:
    """The 128-bit name of some units, as Units.names gives it."""
    key = hashlib.blake2b(b" ".join(part) if words else part, digest_size=16, salt=SALT).digest()
    return tuple(np.frombuffer(key, np.int64).tolist())


def _split(text: bytes, words: bool):
    return text.split(b" ") if words else text


def _agree(x, y) -> int:
    """How many units two rows of units begin with alike."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    a, b = 0, n  # the first a agree, the first b don't
    while b - a > 1:
        m = (a + b) // 2
        if x[a:m] == y[a:m]:
            a = m
        else:
            b = m
    return a


def settle(x, off: int, lo: int, hi: int, y, y_off: int, width: int):
    """x and y from their anchors both ways: (units matched before the anchor, units matched from it on, windows of x that
    both hold, and those of [lo, hi] left over that reach beyond the match before and after it); ranges are inclusive."""
    left = _agree(x[:off][::-1], y[:y_off][::-1])
    right = _agree(x[off:], y[y_off:])
    # windows that y's block has too: its first one starts y_off before the anchor
    first, last = off - left, off + right - width
    return left, right, (first, last), (lo, min(hi, first - 1)), (max(lo, first, last + 1), hi)


def _extend(joined: DataFrame, words: bool, width: int, both: bool) -> DataFrame:
    """One round for anchors with very many contents. joined: CONTENT and the representative's r_* columns.  Gives CONTENT
    rows under longer anchors, and rows without text that are settled ranges (s1, cnt), k1 and k2 the name of what they
    hold, off the place in their block."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for k1, k2, doc, tie, s1, cnt, off, lo, hi, n, text, r_doc, r_tie, r_s1, r_off, r_text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (doc, tie, s1) == (r_doc, r_tie, r_s1):
                    continue
                x, y = _split(text, words), _split(r_text, words)
                left, right, shared, before, after = settle(x, off, lo, hi, y, r_off, width)
                if shared[0] <= shared[1]:
                    k = name(x[shared[0] : shared[1] + width], words)
                    out.append((*k, doc, tie, s1 + shared[0], shared[1] - shared[0] + 1, shared[0], 0, 0, 0, None))
                    if both:
                        out.append((*k, r_doc, r_tie, r_s1 + shared[0] + r_off - off, shared[1] - shared[0] + 1, shared[0] + r_off - off, 0, 0, 0, None))
                for side, length, at, (a, z) in ((b"<", left, off - left - 1, before), (b">", right, off + right, after)):
                    if a <= z:
                        unit = x[at] if words else bytes(x[at : at + 1])
                        key = name(k1.to_bytes(8, "big", signed=True) + k2.to_bytes(8, "big", signed=True) + side + length.to_bytes(4, "big") + unit, False)
                        out.append((*key, doc, tie, s1, cnt, off, a, z, n, text))
            columns = list(zip(*out, strict=True)) if out else [()] * 11
            types = [pa.int64()] * 4 + [pa.int32()] * 5 + [pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in CONTENT.split(", ")])

    return joined.mapInArrow(run, CONTENT)


def compare(rows: DataFrame, solve: Callable, words: bool, width: int, both: bool) -> DataFrame:
    """RANGES of windows of CONTENT rows (with of_anchor) that other contents of their anchor hold: of the later ones, or
    of both.  solve: a function of iterators of batches (CONTENT without of_anchor, sorted by key and place) for groups of
    up to SOLO."""
    found = []
    while True:
        few = rows.where(F.col("of_anchor") <= SOLO).drop("of_anchor")
        found.append(few.repartition("k1", "k2").sortWithinPartitions("k1", "k2", *PLACE).mapInArrow(solve, RANGES))
        many = rows.where(F.col("of_anchor") > SOLO).drop("of_anchor")
        if many.isEmpty():
            break
        # the earliest content represents its anchor, so that the others are the later ones
        one = stage(many.groupBy("k1", "k2").agg(F.min(F.struct(*PLACE, "off", "text")).alias("r")).select("k1", "k2", *(F.col(f"r.{c}").alias(f"r_{c}") for c in (*PLACE, "off", "text"))))
        columns = [f.split()[0] for f in CONTENT.split(", ")]
        after = stage(_extend(many.join(one, ["k1", "k2"]).select(*columns, "r_doc", "r_tie", "r_s1", "r_off", "r_text"), words, width, both))
        unstage(one)
        found.append(after.where("text IS NULL").select("k1", "k2", *PLACE, "cnt", "off"))
        sizes = stage(after.where("text IS NOT NULL").groupBy("k1", "k2").agg(F.count("*").alias("of_anchor")).where("of_anchor > 1"))
        rows = stage(after.where("text IS NOT NULL").join(sizes, ["k1", "k2"]).select(*columns, "of_anchor"))
        unstage(sizes)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def distinct_contents(met: DataFrame, *more) -> DataFrame:
    """(h, c1, c2, place, cnt, off, n rows, more aggregates) of the contents of blocks."""
    first = F.min(F.struct(*PLACE, "cnt", "off")).alias("at")
    return met.groupBy("h", "c1", "c2").agg(first, F.sum("n").alias("n"), *more).select("*", "at.*").drop("at")


def meeting(rows: DataFrame, contents: DataFrame, words: bool, width: int) -> DataFrame:
    """The CONTENT rows, staged, of anchors with more than one content."""
    anchor = stage(contents.groupBy("h").agg(F.count("*").alias("of_anchor")).where("of_anchor > 1"))
    want = F.struct("h", "s1", "cnt", "off", "n", "of_anchor")
    wanted = contents.join(anchor, "h").groupBy("doc", "tie").agg(F.collect_list(want).alias("at"))
    return stage(contexts(rows, wanted, words, width))


def joined_on_anchors(docs: DataFrame, solve: Callable, id_column: str, text: str, *, words: bool, width: int, seed: int, earliest: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks whose anchor stands elsewhere too, their contents (h, c1, c2, place, cnt, off, n rows), what `compare` gives
    for contents that differ from others of their anchor)."""
    rows = keyed(docs, id_column, text)
    again = stage(anchors(rows, words, width, seed))
    found = named_blocks(rows, words, width, seed, earliest)
    # both sides of a join are plain exchanges throughout, so that a key with very many rows splits
    met = stage(found.join(again.withColumn("again", F.lit(1)), "h", "left").where("kind = 1 OR again = 1").drop("again"))
    unstage(again)
    contents = stage(distinct_contents(met.where("kind = 0")))
    return met, contents, compare(meeting(rows, contents, words, width), solve, words, width, not earliest)


def repeated_windows(docs: DataFrame, solve: Callable, id_column: str, text: str, *, words: bool, width: int, seed: int, earliest: bool) -> DataFrame:
    """(doc, tie, s1, cnt): starts of windows that repeat: an earlier one, or any other."""
    met, contents, differ = joined_on_anchors(docs, solve, id_column, text, words=words, width=width, seed=seed, earliest=earliest)
    several = contents.where("n > 1").select("h", "c1", "c2", *(F.col(c).alias(f"f_{c}") for c in PLACE))
    same = met.where("kind = 0").join(several, ["h", "c1", "c2"])
    if earliest:
        same = same.where("NOT (doc = f_doc AND tie = f_tie AND s1 = f_s1)")
    known = met.where("kind = 1").select(*PLACE, "cnt")
    return known.unionByName(same.select(*PLACE, "cnt")).unionByName(differ.select(*PLACE, "cnt"))


def by_document(ranges: DataFrame) -> DataFrame:
    """(doc, tie, at): the ranges of each document, each once, however many rows are alike."""
    return ranges.groupBy("doc", "tie").agg(F.collect_set(F.struct("s1", "cnt")).alias("at"))


def with_ranges(docs: DataFrame, ranges: DataFrame, id_column: str, text: str) -> DataFrame:
    """docs, all columns kept, and last the ranges of each."""
    doc, tie, at = fresh(docs, "doc", "tie", "at")
    named = docs.withColumns({doc: F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID).cast("long")), tie: F.xxhash64(text_of(text))})
    of = by_document(ranges).withColumnsRenamed({"doc": doc, "tie": tie, "at": at})
    return named.join(of, [doc, tie], "left").select(*(F.col(f"`{c}`") for c in docs.columns), at)


def merged(ranges: list[dict] | None, width: int, n: int) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of units covered by windows starting in the ranges."""
    out: list[tuple[int, int]] = []
    for r in sorted((r["s1"], r["s1"] + r["cnt"] - 1 + width) for r in ranges or ()):
        if out and r[0] <= out[-1][1]:
            if r[1] > out[-1][1]:
                out[-1] = (out[-1][0], r[1])
        else:
            out.append(r)
    return out

"""Suffix-array dedup on bytes: the common-prefix interval tree of an enhanced suffix array.

Equal windows share an anchor (repeats.py), so suffix arrays are built anchor by anchor over its different contents, and
nothing is lost between tasks.  In a task the suffixes are sorted by prefix doubling, the lengths of common prefixes of
neighbours are read off the saved ranks, and one scan with a stack walks the tree of common-prefix intervals.  An interval
is a maximal repeat if what precedes its suffixes differs; it is reported with all its occurrences.  A content that several
blocks have is a leaf that stands for several suffixes, and so an interval of its own.  A byte goes if a repeat of WIDTH
bytes covers it, wherever the other occurrence is.  An anchor with very many contents is split by longer context until its
parts fit a task, where the same tree is walked.

`repeat_groups` gives the maximal repeats themselves, of any length, each with all its occurrences.  The first window of a
maximal repeat has different bytes before it, its last one different bytes after it; the trees of the anchors (or, for
an anchor with very many contents, a grouping of its windows by name) and the borders of equal blocks tell where such
windows are.  What lies from the one to the other is named and grouped, and kept if both its sides differ.  A start tries
its nearest ends first, and further ones, twice as many each time, only while what it found still repeats.

Defined results: a null text has no bytes; each row is a document, so rows that repeat a text remove each other; a
null doc_id is allowed; a text shorter than WIDTH bytes keeps all; very long texts are one row each and take memory in
proportion; ties cannot arise, as all occurrences go; an empty table gives an empty table; other columns are kept by
`clean`, whatever their names.  A text cut inside a character is decoded with replacement characters by `clean`; `digest`
hashes the bytes themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import repeats
from weftline.llm import textscan as ts
from weftline.llm.common import bound_batches, stage, staging

WIDTH = 200
SEED_BYTES = 32
#: Bytes of contexts that are sorted at once.
SORT_BYTES = 1 << 20


class SuffixArray:
    """Suffixes of several byte strings, those that start at `starts`, in order, with common-prefix lengths.

    A string ends in a symbol of its own, so nothing matches across strings."""

    def __init__(self, texts: list[bytes], starts: np.ndarray | None = None):
        lengths = np.array([len(t) + 1 for t in texts])
        self.begin = np.cumsum(lengths) - lengths
        self.ends = self.begin + lengths - 1
        n = int(lengths.sum())
        symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + len(texts)
        symbols[self.ends] = np.arange(len(texts))
        self.symbols = symbols
        where = np.ones(n, bool)
        where[self.ends] = False
        self.starts = np.flatnonzero(where) if starts is None else starts
        # ranks by the first 1, 2, 4, ... symbols; a text's end ranks below every byte and unlike any other end
        self.levels = [(1, symbols)]
        longest = int(lengths.max())
        size, rank = 1, symbols
        while size < longest:
            after = np.zeros(n, np.int64)
            after[: n - size] = rank[size:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
            size *= 2
            self.levels.append((size, rank))
        self.order = self.starts[np.argsort(rank[self.starts], kind="stable")]
        self.lcp = self._common(self.order[:-1], self.order[1:])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(self.symbols)
        out = np.zeros(len(a), np.int64)
        for size, rank in reversed(self.levels):
            x, y = a + out, b + out
            ok = (x < n) & (y < n)
            same = np.zeros(len(a), bool)
            same[ok] = rank[x[ok]] == rank[y[ok]]
            out[same] += size
        return out

    def maximal_repeats(self, least: int):
        """(length, places of all occurrences) of every maximal repeat of at least `least` symbols."""
        order, symbols = self.order, self.symbols
        before = np.where(order > 0, symbols[order - 1], -1)
        # what precedes a string's first suffix is unknown, and unlike anything; a suffix before which none starts cannot
        # be left to the repeat one longer
        some = np.zeros(len(symbols) + 1, bool)
        some[self.starts + 1] = True
        first = ~some[order]
        before[first] = -1 - np.arange(len(order))[first]
        deep = self.lcp >= least
        cut = np.flatnonzero(~deep)
        bounds = np.concatenate([[-1], cut, [len(self.lcp)]])
        for lo, hi in zip(bounds[:-1] + 1, bounds[1:], strict=True):
            if hi > lo:
                yield from self._intervals(int(lo), int(hi), before)

    def _intervals(self, lo: int, hi: int, before: np.ndarray):
        """The tree of the run of suffixes lo..hi: (common prefix, first suffix, what precedes, or None if various)."""
        lcp, order = self.lcp[lo:hi].tolist(), self.order
        left = before[lo : hi + 1].tolist()
        various = object()
        stack: list[list] = []
        for k in range(len(lcp) + 1):
            depth = lcp[k] if k < len(lcp) else 0
            begin, seen = k, left[k]
            while stack and stack[-1][0] > depth:
                d, b, s = stack.pop()
                s = s if s == seen else various
                if s is various:
                    yield d, order[lo + b : lo + k + 1]
                begin, seen = b, s
            if stack and stack[-1][0] == depth:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else various
            elif k < len(lcp):
                stack.append([depth, begin, seen])


def _windows(texts: list[bytes], lo, hi) -> tuple[np.ndarray, np.ndarray]:
    """(where each text begins in a suffix array, the places of its windows lo to hi)."""
    size = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(size) - size
    return begin, np.concatenate([np.arange(b + x, b + y + 1) for b, x, y in zip(begin, lo, hi, strict=True)])


def covered(texts: list[bytes], lo, hi, width: int) -> list[np.ndarray]:
    """For each text, of its window starts lo to hi, those that start a repeat of width bytes."""
    begin, starts = _windows(texts, lo, hi)
    sa = SuffixArray(texts, starts)
    hit = np.zeros(len(sa.symbols) + 1, np.int64)
    for length, places in sa.maximal_repeats(width):
        # windows inside the repeat: from its place to where the last one of width bytes starts
        np.add.at(hit, places, 1)
        np.add.at(hit, places + (length - width + 1), -1)
    inside = np.cumsum(hit) > 0
    return [np.flatnonzero(inside[b + x : b + y + 1]) + x for b, x, y in zip(begin, lo, hi, strict=True)]


def groups_of(texts: list[bytes], width: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences as (text, place)) of every maximal repeat of width bytes or more."""
    begin, starts = _windows(texts, [0] * len(texts), [len(t) - width for t in texts])
    out = []
    for length, places in SuffixArray(texts, starts).maximal_repeats(width):
        text = np.searchsorted(begin, places, "right") - 1
        out.append((int(length), list(zip(text.tolist(), (places - begin[text]).tolist(), strict=True))))
    return out


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of neighbouring places."""
    if not len(places):
        return places, places
    new = np.concatenate([[True], places[1:] != places[:-1] + 1])
    begin = np.flatnonzero(new)
    return places[begin], np.diff(np.append(begin, len(places)))


def _solver(width: int, groups: bool = False):
    def tree(part):
        """RANGES of some whole anchors, from one suffix array over their contents."""
        texts, (k1, k2, doc, tie, s1, lo, hi) = part
        if not groups:
            found = covered(texts, lo.tolist(), hi.tolist(), width)
            runs = [_runs(places) for places in found]
            i = np.repeat(np.arange(len(texts)), [len(a) for a, _ in runs])
            at, cnt = (np.concatenate(x) if i.size else np.zeros(0, np.int64) for x in zip(*runs, strict=True))
            return repeats.ranges_batch(k1[i], k2[i], doc[i], tie[i], s1[i] + at, cnt, at)
        rows = [(0, 0, doc[t], tie[t], s1[t] + p, length - width + 1, p) for length, places in groups_of(texts, width) for t, p in places]
        return repeats.ranges_batch(*([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 7))

    def solve(batches):
        for g in ts.whole_groups(batches, 2, 1000):
            k1, k2, doc, tie, s1, lo, hi = (g.column(c).to_numpy().astype(np.int64) for c in ("k1", "k2", "doc", "tie", "s1", "lo", "hi"))
            # a place that comes twice is one content
            new = np.ones(len(k1), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in (k1, k2, doc, tie, s1)], axis=0)
            keep = np.flatnonzero(new)
            texts = g.column("text").take(pa.array(keep)).to_pylist()
            columns = [x[keep] for x in (k1, k2, doc, tie, s1, lo, hi)]
            # whole anchors, about SORT_BYTES of them at a time
            first = np.concatenate([[True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])])
            size = np.cumsum([len(t) for t in texts])
            cuts, done = [0], 0
            for at in np.flatnonzero(first)[1:].tolist():
                if size[at - 1] - done >= SORT_BYTES:
                    cuts.append(at)
                    done = size[at - 1]
            for a, z in zip(cuts, [*cuts[1:], len(texts)], strict=True):
                yield tree((texts[a:z], [x[a:z] for x in columns]))

    return solve


def repeated_windows(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED_BYTES) -> DataFrame:
    """(doc, tie, s1, cnt): starts of windows of width bytes that also start elsewhere."""
    bound_batches(docs.sparkSession)
    return repeats.repeated_windows(docs, _solver(width), id_column, text, words=False, width=width, seed=seed, earliest=False)


#: Ends that a start tries in the first round.
ENDS = 16


def _diverse(of: str) -> Column:
    """Whether the bytes `of` differ; -1, a border of a text, is unlike anything."""
    return (F.min(of) < 0) | (F.min(of) != F.max(of))


def _by_name(many: DataFrame, width: int) -> DataFrame:
    """(doc, tie, s1, lo, hi, l, r) as `_marks` has them, for CONTENT rows of anchors with very many contents: windows that
    several contents hold, found by name."""

    def run(batches):
        for b in batches:
            for doc, tie, s1, text in zip(*(b.column(c).to_pylist() for c in ("doc", "tie", "s1", "text")), strict=True):
                last = len(text) - width
                names = [repeats.name(text[k : k + width], False) for k in range(last + 1)]
                k1, k2 = zip(*names, strict=True)
                n = last + 1
                columns = [k1, k2, [doc] * n, [tie] * n, [s1] * n, range(n), [-1, *text[:last]], [*text[width:], -1]]
                types = [pa.int64()] * 4 + [pa.int32()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["k1", "k2", "doc", "tie", "s1", "lo", "before", "after"])

    windows = stage(many.mapInArrow(run, "k1 long, k2 long, doc long, tie long, s1 int, lo int, before int, after int"))
    several = windows.groupBy("k1", "k2").agg(F.count("*").alias("n"), _diverse("before").alias("l"), _diverse("after").alias("r")).where("n > 1")
    return windows.join(several, ["k1", "k2"]).select(*repeats.PLACE, "lo", F.col("lo").alias("hi"), "l", "r")


def _marks(rows: DataFrame, width: int, seed: int) -> DataFrame:
    """(doc, tie, at: a, z, l, r): windows a to z repeat; l: a may begin a maximal repeat, r: z may be the last window of one."""
    again = stage(repeats.anchors(rows, False, width, seed))
    met = stage(repeats.bordered_blocks(rows, width, seed).join(again, "h").withColumn("n", F.lit(1)))
    contents = stage(repeats.distinct_contents(met, _diverse("before").alias("l"), _diverse("after").alias("r")))
    texts = repeats.meeting(rows, contents.drop("l", "r"), False, width)
    few = texts.where(F.col("of_anchor") <= repeats.SOLO).drop("of_anchor")
    trees = few.repartition("k1", "k2").sortWithinPartitions("k1", "k2", *repeats.PLACE).mapInArrow(_solver(width, True), repeats.RANGES)
    by_tree = trees.select("doc", "tie", (F.col("s1") - F.col("off")).alias("s1"), F.col("off").alias("lo"), (F.col("off") + F.col("cnt") - 1).alias("hi"), F.lit(True).alias("l"), F.lit(True).alias("r"))
    inside = by_tree.unionByName(_by_name(texts.where(F.col("of_anchor") > repeats.SOLO), width))
    # what one block of a content holds, all its blocks hold; a content that several blocks have repeats as a whole
    of = contents.select("h", "c1", "c2", *repeats.PLACE).join(inside, [*repeats.PLACE]).select("h", "c1", "c2", "lo", "hi", "l", "r")
    whole = contents.where("n > 1").select("h", "c1", "c2", F.lit(0).alias("lo"), (F.col("cnt") - 1).alias("hi"), "l", "r")
    each = met.select("h", "c1", "c2", *repeats.PLACE).join(of.unionByName(whole), ["h", "c1", "c2"])
    mark = F.struct((F.col("s1") + F.col("lo")).alias("a"), (F.col("s1") + F.col("hi")).alias("z"), "l", "r")
    return each.groupBy("doc", "tie").agg(F.collect_set(mark).alias("at"))


def _between(begun: DataFrame, width: int, first: int, count: int) -> DataFrame:
    """What lies from the starts in `open` (null: all) to those of their ends that come after `first` others, `count` of
    them: its name and length, its place, the bytes around it, the rows that hold it, and whether further ends follow."""

    def run(batches):
        for b in batches:
            for doc, tie, text, n, at, open_ in zip(*(b.column(c).to_pylist() for c in ("doc", "tie", "text", "n", "at", "open")), strict=True):
                text = text.encode()
                # the runs of repeating windows, and the last window of each window's run
                runs = repeats.merged([{"s1": m["a"], "cnt": m["z"] - m["a"] + 1} for m in at], 1, len(text))
                begins = np.array([x for x, _ in runs])
                ends = np.unique([m["z"] for m in at if m["r"]])
                rows = []
                for p in sorted({m["a"] for m in at if m["l"]}) if open_ is None else open_:
                    upto = runs[int(np.searchsorted(begins, p, "right")) - 1][1]
                    i, j = (int(x) for x in np.searchsorted(ends, (p, upto)))
                    mine = ends[i + first : min(j, i + first + count)].tolist()
                    before = text[p - 1] if p else -1
                    held, done = hashlib.blake2b(digest_size=16, salt=repeats.SALT), p
                    for q in mine:
                        end = q + width
                        held.update(text[done:end])
                        done = end
                        rows.append((*np.frombuffer(held.digest(), np.int64).tolist(), end - p, doc, tie, p, n, before, text[end] if end < len(text) else -1, q == mine[-1] and j > i + first + count))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in BETWEEN.split(", ")])

    return begun.mapInArrow(run, BETWEEN)


BETWEEN = "k1 long, k2 long, length int, doc long, tie long, start int, n long, before int, after int, further boolean"


def repeat_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED_BYTES) -> DataFrame:
    """(group, length, doc_id, tie, start): every occurrence of every maximal repeat of width bytes or more; group names the
    bytes, tie tells texts of one doc_id apart, rows alike in both are listed once (and repeat each other).  Output may
    far exceed the input where repeats nest deeply."""
    spark = docs.sparkSession
    bound_batches(spark)
    with staging(spark) as kept:
        rows = repeats.keyed(docs, id_column, text)
        marks = stage(_marks(rows, width, seed))
        once = stage(rows.groupBy("doc", "tie").agg(F.count("*").alias("n"), F.first("text").alias("text")).join(marks, ["doc", "tie"]))
        begun, found, first, count = once.withColumn("open", F.lit(None).cast("array<int>")), [], 0, ENDS
        while True:
            pairs = stage(_between(begun, width, first, count))
            key = ["k1", "k2", "length"]
            several = stage(pairs.groupBy(key).agg(F.sum("n").alias("held"), _diverse("before").alias("l"), _diverse("after").alias("r")).where("held > 1"))
            found.append(pairs.join(several.where("l AND r").select(key), key, "left_semi"))
            further = stage(pairs.where("further").join(several.select(key), key, "left_semi").groupBy("doc", "tie").agg(F.array_sort(F.collect_list("start")).alias("open")))
            if further.isEmpty():
                break
            begun, first, count = once.join(further, ["doc", "tie"]), first + count, 2 * count
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        group = F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0"))
        doc_id = F.when(F.col("doc") != repeats.NO_ID, F.col("doc"))
        result = stage(out.select(group.alias("group"), "length", doc_id.alias("doc_id"), "tie", "start"))
        kept.append(result)
    return result


def digest(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    ranges = repeats.by_document(repeated_windows(docs, id_column, text, width, seed))
    both = repeats.keyed(docs, id_column, text).join(ranges, ["doc", "tie"], "left").select("doc", F.col("text").cast("binary").alias("text"), "at")

    def run(batches):
        for b in batches:
            rows = []
            for t, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                gone = repeats.merged(at, width, len(t))
                kept = hashlib.sha256()
                end = 0
                for a, z in gone:
                    kept.update(t[end:a])
                    end = z
                kept.update(t[end:])
                rows.append((len(t), sum(z - a for a, z in gone), len(gone), kept.hexdigest()))
            n, removed, spans, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            ids = pa.array([None if d == repeats.NO_ID else d for d in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED_BYTES) -> DataFrame:
    """docs with repeated bytes removed from their texts."""
    both = repeats.with_ranges(docs, repeated_windows(docs, id_column, text, width, seed), id_column, text)
    at = docs.columns.index(text)

    def cut(t: str | None, ranges_) -> str | None:
        if not t or not ranges_:
            return t
        raw, out, end = t.encode(), [], 0
        for a, z in repeats.merged(ranges_, width, len(raw)):
            out.append(raw[end:a])
            end = z
        return b"".join([*out, raw[end:]]).decode("utf-8", "replace")

    def run(batches):
        for b in batches:
            texts = [cut(t, r) for t, r in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            yield b.set_column(at, text, pa.array(texts, pa.string())).select(range(b.num_columns - 1))

    return both.mapInArrow(run, docs.schema)

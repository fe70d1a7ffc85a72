"""N-gram Jaccard join: a MinHash LSH forest proposes, exact set comparison decides.

Texts are sets of SHINGLE-word shingles (a text of fewer words is one shingle, a text without words none).  Each text
gets TREES labels of DEPTH minimum hashes, the paths of a forest of prefix tries.  A trie's rows are sorted, so that
those under one prefix stand together.  Matching starts at the full path and shortens it by a label at a time.  Under a
node, texts close to a leader (by all minima) are linked to it and stand behind it, and only leaders go on to the shorter
prefix, where they are compared again.  What would be a huge bucket is thus folded first inside each input batch, then under
long prefixes, before it meets anything else.  How far a node shortens depends on it: a node with over NODE leaders stops at
the longest prefix at which the forest finds TARGET_RECALL of the pairs at the threshold, even if all nodes stopped there;
others go one label further (`prefix_length`), which finds more.  Where no prefix of two labels meets the target all nodes
go down to one label.

The links so found only say which texts may belong together.  Their components are cut into blocks of BLOCK texts and
BLOCK_BYTES, and every pair of blocks of one component is compared exactly, in one task each: words are told apart by
themselves and shingles by the words they are made of, no hash decides.  A text's links are counted there and leave as one
number, pairs never do.  Exactly equal texts are one node throughout.

Result of `classes`: one row a document with class_id (the least doc_id of its class), n_links (different texts with
similarity >= threshold) and n_copies (documents with its text).  Defined results: a null text is an empty text;
texts without words are linked to nothing but their copies; a null doc_id never names a class that has another;
of a class the document with the least id stays, ties broken by a hash of the text and then of the row; repeated rows are
copies; a very long text is one set, in memory in proportion; an empty table gives an empty table; other columns are
ignored, whatever their names (`keep_first` keeps them).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import textscan as ts
from weftline.llm.common import bound_batches, fresh, stage, staging, text_of
from weftline.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 7
TARGET_RECALL = 0.995
#: Leaders under one node beyond which its prefix is not shortened further than the recall needs.
NODE = 4096
BLOCK = 1024
BLOCK_BYTES = 8 << 20
SEED = 17


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """The share of pairs that agree in a prefix of `depth` labels in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(threshold: float) -> int:
    """One label less than the longest prefix that meets the target for pairs at the threshold; at least one label."""
    return next((d - 1 for d in range(DEPTH, 1, -1) if recall(threshold, d) >= TARGET_RECALL), 1)


def closeness(threshold: float) -> tuple[float, float]:
    """(absorb, link): under a node, a text with that share of its minima equal to a leader's stands behind it; a link
    needs less: texts at the threshold of one behind a leader are within that of the leader, and the estimate errs by 0.05."""
    absorb = max(0.8, threshold)
    return absorb, max(0.05, absorb + threshold - 1 - 0.1)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def shingles(column: pa.Array):
    """For runs of rows: (first row, rows after, shingle hashes, where each row's begin)."""
    for at, to, data, offsets in ts.chunks(column):
        starts, ends, first = ts.words(data, offsets)
        h = ts.word_hashes(data, starts, ends)
        n = np.diff(first)
        g = ts.window_hashes(h, SHINGLE)
        count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
        begin = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(begin[-1], np.uint64)
        long = np.flatnonzero(n >= SHINGLE)
        if len(long):
            # the windows that start in a row and end in it
            row = np.repeat(np.arange(len(n)), count)
            inside = np.arange(begin[-1]) - begin[row]
            whole = n[row] >= SHINGLE
            out[whole] = g[first[row[whole]] + inside[whole]]
        for r in np.flatnonzero((n > 0) & (n < SHINGLE)):
            out[begin[r]] = ts.window_hashes(h[first[r] : first[r + 1]], int(n[r]))[0]
        yield at, to, out, begin


def minima(g: np.ndarray, begin: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signatures, one row for each non-empty set: len(a) labels of 32 bits."""
    full = np.flatnonzero(np.diff(begin))
    out = np.empty((len(full), len(a)), np.uint32)
    for k in range(len(a)):
        least = np.minimum.reduceat(g * a[k] + b[k], begin[full])
        out[:, k] = (ts.mix(least) >> np.uint64(32)).astype(np.uint32)
    return out


def _node(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _signed(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, node, size, sig): sig is null for a text without words and for one met before in its batch."""
    rows = docs.select("rid", "doc_id", _node(F.col("text")).alias("node"), "text", F.octet_length("text").alias("size"))

    def run(batches):
        a, b = _coefficients(TREES * DEPTH)
        for batch in batches:
            nodes = batch.column(2).to_pylist()
            seen: set[bytes] = set()
            new = [i for i, x in enumerate(nodes) if not (x in seen or seen.add(x))]
            texts = batch.column(3).take(pa.array(new, pa.int32()))
            sig: list[bytes | None] = [None] * len(nodes)
            for at, _, g, begin in shingles(texts):
                for i, s in zip(np.flatnonzero(np.diff(begin)), minima(g, begin, a, b), strict=True):
                    sig[new[at + i]] = s.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(sig, pa.binary())], names=["rid", "doc_id", "node", "size", "sig"])

    return rows.mapInArrow(run, "rid string, doc_id long, node binary, size int, sig binary")


def _grouped(keys: np.ndarray) -> list[np.ndarray]:
    """Places of equal rows of keys, groups of two or more."""
    flat = np.ascontiguousarray(keys).view(np.dtype((np.void, keys.dtype.itemsize * keys.shape[1]))).ravel() if keys.shape[1] else np.zeros(len(keys), "V1")
    order = np.argsort(flat, kind="stable")
    cut = np.flatnonzero(flat[order][1:] != flat[order][:-1]) + 1
    return [g for g in np.split(order, cut) if len(g) > 1]


class Fold:
    """Rows under one shortest prefix of a tree.  Adds links (node, leader) to edges; leaders are the rows left."""

    def __init__(self, nodes, sketch, near: tuple[float, float], stops: bool, edges: list):
        self.nodes, self.sketch, self.near, self.stops, self.edges = nodes, sketch, near, stops, edges
        # links only have to connect: a row is linked to one of each set of rows that links have already joined
        self.joined = np.arange(len(nodes))

    def compare(self, members: np.ndarray) -> list[int]:
        """The leaders of members, each compared with those before it."""
        absorb, link = self.near
        nodes, sketch, joined = self.nodes, self.sketch, self.joined
        kept, left = [], members
        while len(left):
            lead, left = left[0], left[1:]
            kept.append(lead)
            if not len(left):
                break
            same = nodes[left] == nodes[lead]
            alike = (sketch[left] == sketch[lead]).mean(axis=1)
            near = left[(alike >= link) | same]
            near = near[joined[near] != joined[lead]]
            sets, at = np.unique(joined[near], return_index=True)
            self.edges += [(nodes[i], nodes[lead]) for i in near[at] if nodes[i] != nodes[lead]]
            joined[np.isin(joined, sets)] = joined[lead]
            left = left[~((alike >= absorb) | same)]
        return kept

    def leaders(self, paths: np.ndarray) -> np.ndarray:
        """paths holds the rest of the label; rows that share all of it are folded before they meet the others."""
        left = np.arange(len(self.nodes))
        for d in range(paths.shape[1], -1, -1):
            if len(left) < 2:
                break
            if d == 0 and len(left) > NODE and self.stops:
                break
            groups = _grouped(paths[left][:, :d])
            alone = np.ones(len(left), bool)
            kept = []
            for g in groups:
                alone[g] = False
                kept += self.compare(left[g])
            left = np.sort(np.concatenate([left[alone], np.array(kept, left.dtype)]))
        return left


OUT = "tree int, prefix long, rest binary, node binary, sketch binary, other binary"


def _fold_rows(tree, prefix, rest, node, sketch, near, stops):
    """Columns of rows sorted or not: (rows that stay, links)."""
    edges: list[tuple[bytes, bytes]] = []
    order = np.lexsort((prefix, tree))
    t, p = tree[order], prefix[order]
    cut = np.flatnonzero((t[1:] != t[:-1]) | (p[1:] != p[:-1])) + 1
    stay = []
    for part in np.split(order, cut):
        if len(part) == 1:
            stay.append(part)
        elif len(part):
            stay.append(part[Fold(node[part], sketch[part], near, stops, edges).leaders(rest[part])])
    return np.concatenate(stay) if stay else np.zeros(0, int), sorted(set(edges))


def _rows_out(tree, prefix, rest, node, sketch, edges):
    n, m = len(tree), len(edges)
    null = lambda k: pa.nulls(k, pa.binary())
    join = lambda x, y: pa.concat_arrays([x, y])
    spread = np.array([int.from_bytes(a[:8], "big", signed=True) for a, _ in edges], np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([tree, np.full(m, -1)]), pa.int32()), pa.array(np.concatenate([prefix, spread]), pa.int64()),
            join(pa.array([r.tobytes() for r in rest], pa.binary()), null(m)), join(pa.array(list(node), pa.binary()), pa.array([a for a, _ in edges], pa.binary())),
            join(pa.array([s.tobytes() for s in sketch], pa.binary()), null(m)), join(null(n), pa.array([b for _, b in edges], pa.binary())),
        ],
        names=["tree", "prefix", "rest", "node", "sketch", "other"],
    )


def proposed_links(signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): nodes that the forest links."""
    short, near = prefix_length(threshold), closeness(threshold)
    stops = recall(threshold, short + 1) >= TARGET_RECALL

    def spread(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, TREES, DEPTH)
            nodes = np.array(batch.column(0).to_pylist(), object)
            n = len(nodes)
            tree = np.repeat(np.arange(TREES), n)
            prefix = np.concatenate([ts.window_hashes(sig[:, t, :short].astype(np.uint64).ravel(), short)[::short] for t in range(TREES)]).view(np.int64)
            rest = np.concatenate([sig[:, t, short:] for t in range(TREES)])
            sketch = np.tile((sig.reshape(n, -1) & np.uint32(255)).astype(np.uint8), (TREES, 1))
            node = np.tile(nodes, TREES)
            stay, edges = _fold_rows(tree, prefix, rest, node, sketch, near, stops)
            yield _rows_out(tree[stay], prefix[stay], rest[stay], node[stay], sketch[stay], edges)

    def fold(batches):
        for table in ts.whole_groups(batches, 2):
            links = pa.compute.equal(table.column("tree"), -1)
            old = table.filter(links)
            rows = table.filter(pa.compute.invert(links))
            wide = lambda c, kind, n: np.frombuffer(b"".join(rows.column(c).to_pylist()), kind).reshape(rows.num_rows, n)
            edges: list = []
            if rows.num_rows > 1:
                _, edges = _fold_rows(
                    rows.column("tree").to_numpy(), rows.column("prefix").to_numpy(), wide("rest", np.uint32, DEPTH - short), np.array(rows.column("node").to_pylist(), object), wide("sketch", np.uint8, TREES * DEPTH), near, stops
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array([*old.column("node").to_pylist(), *(a for a, _ in edges)], pa.binary()), pa.array([*old.column("other").to_pylist(), *(b for _, b in edges)], pa.binary())], names=["a", "b"]
            )

    rows = signed.where("sig IS NOT NULL").select("node", "sig").mapInArrow(spread, OUT)
    sorted_rows = rows.repartition("tree", "prefix").sortWithinPartitions("tree", "prefix", "rest")
    return sorted_rows.mapInArrow(fold, "a binary, b binary")


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers for pairs of numbers: equal where both are."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """Numbers for all runs of k words, equal where all words are."""
    if k == 1 or len(words) < k:
        return words[: max(0, len(words) - k + 1)]
    half = k // 2
    left = _runs(words, half)
    right = left if half == k - half else _runs(words, k - half)
    n = len(words) - k + 1
    return _pairs(left[:n], right[half : half + n])


def exact_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The shingles of each text as sorted numbers that these texts share.  Words are looked up by themselves."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    words = [np.fromiter(map(known.__getitem__, t.split()), np.int64) for t in texts]  # split() of bytes parts words as WORD does
    runs = _runs(np.concatenate(words), SHINGLE) if words else np.zeros(0, np.int64)
    short: defaultdict[bytes, int] = defaultdict()
    short.default_factory = lambda: -1 - len(short)
    out, at = [], 0
    for w in words:
        out.append(np.unique(runs[at : at + len(w) - SHINGLE + 1]) if len(w) >= SHINGLE else np.array([short[w.tobytes()]] if len(w) else [], np.int64))
        at += len(w)
    return out


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of sets at the threshold; inside left if right is None."""
    sets = left if right is None else left + right
    sizes = np.array([len(s) for s in sets])
    if right is None and len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        hit = both and both >= threshold * (sizes.sum() - both) - 1e-9
        return (np.array([0]), np.array([1])) if hit else (np.zeros(0, int), np.zeros(0, int))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    n, m = len(sets), len(left)
    inter = np.zeros((m, n if right is None else n - m), np.float32)
    width = int(column.max()) + 1 if len(column) else 0
    for at in range(0, width, 8192):
        here = (column >= at) & (column < at + 8192)
        dense = np.zeros((n, min(8192, width - at)), np.float32)
        dense[owner[here], column[here] - at] = 1
        inter += dense[:m] @ (dense if right is None else dense[m:]).T
    total = sizes[:m, None] + (sizes if right is None else sizes[m:])[None, :] - inter
    hit = (inter > 0) & (inter >= threshold * total - 1e-9)
    i, j = np.nonzero(np.triu(hit, 1) if right is None else hit)
    return i, j


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least one that the links (i, j) join it with."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (root, i, j, part, node, text), for each pair i <= j of blocks of a component. Gives (node, other, n):
    n links of node found in a pair of blocks, and one link that ties it to the rest of its class there, or itself."""

    def run(batches):
        for g in ts.groups(batches, 3):
            g = g.combine_chunks()
            node, first = np.unique(np.array(g.column("node").to_pylist(), object), return_index=True)
            part = g.column("part").to_numpy()[first]
            order = first[np.argsort(part, kind="stable")]
            part = g.column("part").to_numpy()[order]
            names = np.array(g.column("node").to_pylist(), object)[order]
            sets = exact_sets(pa.concat_arrays(g.column("text").chunks).take(pa.array(order)).cast(pa.large_binary()).to_pylist())
            k = int((part == part[0]).sum())
            one = g.column("i")[0].as_py() == g.column("j")[0].as_py()
            if not one and k == len(sets):
                continue
            i, j = similar(sets if one else sets[:k], None if one else sets[k:], threshold)
            j = j if one else j + k
            links = np.bincount(np.concatenate([i, j]), minlength=len(sets))
            root = joined(len(sets), i, j)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[some].tolist(), pa.binary()), pa.array(names[root[some]].tolist(), pa.binary()), pa.array(links[some], pa.int64())], names=["node", "other", "n"]
            )

    return rows.mapInArrow(run, "node binary, other binary, n long")


def _rid(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def _ready(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    i = F.col(id_column).cast("long")
    return docs.select(_rid(i).alias("rid"), i.alias("doc_id"), text_of(text).alias("text"))


def node_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows: rid, doc_id, node), (classes: node, class_id, keeper_node, keeper_rid, n_links, n_copies), both staged.

    What is joined on a component's root is staged on both sides, so that a component with very many texts splits."""
    bound_batches(docs.sparkSession)
    with staging(docs.sparkSession) as kept:
        rows, found = _node_classes(_ready(docs, id_column, text), threshold)
        kept += [rows, found]
    return rows, found


def _node_classes(ready: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    signed = stage(_signed(ready))
    copies = stage(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.max("size").alias("bytes")).withColumn("rid", _rid(F.col("doc_id"))))

    roots = stage(components(proposed_links(signed, threshold)))
    sized = roots.join(copies.select("node", "rid", "bytes"), "node")
    sizes = stage(sized.groupBy("root").agg(F.count("*").alias("size"), F.sum("bytes").alias("all_bytes")))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("all_bytes") / BLOCK_BYTES)).cast("int")
    members = stage(sized.join(sizes, "root").select("root", "node", "rid", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block")))
    # joined on the text and one id that has it; of rows alike in both one goes on, folded before the shuffle
    # (a merge join at every size: a broadcast of few members would only hide what the shuffle of texts comes to)
    met = ready.withColumn("node", _node(F.col("text"))).drop("doc_id").join(members.hint("merge"), ["node", "rid"])
    texts = stage(met.groupBy("node").agg(*(F.first(c).alias(c) for c in ("root", "blocks", "block", "text"))))
    seat = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    seated = texts.select("root", "node", "text", "block", F.explode(seat).alias("at")).select("root", "at.i", "at.j", F.col("block").alias("part"), "node", "text")
    # in ranges, so that no task gets several pairs of blocks of a large component by chance
    verified = stage(_verified(seated.repartitionByRange("root", "i", "j").sortWithinPartitions("root", "i", "j"), threshold))
    links = verified.groupBy("node").agg(F.sum("n").alias("n_links"))
    final = components(verified.select(F.col("node").alias("a"), F.col("other").alias("b")))

    known = stage(copies.join(final, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "node"))
    named = stage(known.groupBy("root").agg(first.alias("k")).select("root", F.col("k.doc_id").alias("class_id"), F.col("k.node").alias("keeper_node"), F.col("k.rid").alias("keeper_rid")))
    classes = known.join(named, "root").select("node", "class_id", "keeper_node", "keeper_rid", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return signed.select("rid", "doc_id", "node"), stage(classes)


def classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links, n_copies: one row a document."""
    rows, found = node_classes(docs, id_column, text, threshold)
    return rows.join(found, "node").select("doc_id", "class_id", "n_links", "n_copies")


def keep_first(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class, the one with the least id, all columns kept."""
    rows, found = node_classes(docs, id_column, text, threshold)
    keepers = found.select(F.col("keeper_node").alias("node"), F.col("keeper_rid").alias("rid")).distinct()
    alike = stage(rows.groupBy("node", "rid").agg(F.count("*").alias("n")).where("n > 1"))
    node, rid = fresh(docs, "node", "rid")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.withColumns({node: _node(text_of(text)), rid: _rid(F.col(id_column).cast("long"))})
    own = lambda df: df.select(F.col("node").alias(node), F.col("rid").alias(rid))
    if alike.isEmpty():
        return named.join(own(keepers), [node, rid]).select(*columns)
    # of rows alike in id and text one stays, folded before the shuffle
    once = named.join(own(keepers.join(alike, ["node", "rid"], "left_anti")), [node, rid]).select(*columns)
    some = named.join(own(keepers.join(alike, ["node", "rid"])), [node, rid])
    one = F.min_by(F.struct(*columns), F.xxhash64(F.to_json(F.struct(*columns))))
    return once.unionByName(some.groupBy(node, rid).agg(one.alias("one")).select(*(F.col(f"one.`{c}`").alias(c) for c in docs.columns)))

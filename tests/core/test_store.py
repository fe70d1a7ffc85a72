"""Stored index in segments, ordered files, pages over many lines, and runs of terms."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import index, neighbours, sentiment, store
from weftline.sources import readers, writers
from weftline.streaming import live


def _docs(n=240):
    rng = random.Random(3)
    words = ["the", "There", "that", "cat", "concatenate", "CAT", "a", "b", "übermut", "naïve", "x1", "scatter"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 20, 200])))) for i in range(n)]
    return rows + [(n, None), (n + 1, "")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame(_docs(), "doc_id long, text string")
    for m in range(3):
        store.add_segment(docs.where(F.col("doc_id") % 3 == m), root)
    store.add_segment(docs.where("false"), root)
    return docs, store.Stored(spark, root)


def _rows(df):
    return sorted((r.doc_id, round(r.score, 6)) for r in df.collect())


CASES = [(["cat", "the"], "exact"), ([" cat", "THERE"], "ignore_case"), (["cat", "at", "übe"], "substring"), (["catc", "tte "], "substring"), (["a"], "substring"), (["none"], "exact"), ([], "exact"), ([], "substring")]


@pytest.mark.parametrize("asked, how", CASES)
def test_segments_give_one_index(stored, asked, how):
    docs, s = stored
    want = index.search_texts(docs, asked, how)
    assert _rows(s.search(asked, how)) == _rows(want)
    for k in (5, 1000):
        ranked = [(r.doc_id, r.score) for r in s.top_k(asked, k, how).collect()]
        assert ranked == sorted(_rows(want), key=lambda r: (-r[1], r[0]))[:k]


def test_many_terms_are_joined(stored, monkeypatch):
    docs, s = stored
    monkeypatch.setattr(store, "FEW", 2)
    assert _rows(s.search(["a"], "substring")) == _rows(index.search_texts(docs, ["a"], "substring"))
    assert [r.doc_id for r in s.top_k(["w"], 5, "substring").collect()] == [r.doc_id for r in index.rank(index.search_texts(docs, ["w"], "substring").withColumn("score", F.round("score", 6)), 5).collect()]


def test_trigrams_leave_out_terms(stored):
    _, s = stored
    held = {r.term for r in s._with_grams(["catt", "aten"]).collect()}
    assert held == {"scatter", "concatenate"}
    assert {r.term: r.df for r in s.matching(["cat"], "substring").collect()}.keys() == {"cat", "concatenate", "scatter"}


def test_top_k_reads_few_blocks(stored):
    _, s = stored
    _, read = s.read_top(["cat", "w3"], 5)
    n, of = read.count(), s.bounds(["cat", "w3"]).count()
    assert 0 < n <= of / 2


def test_a_segment_reads_its_own_texts(spark, stored, tmp_path):
    docs, _ = stored
    docs.where("doc_id < 100").write.parquet(str(tmp_path / "one"))
    docs.where("doc_id >= 100").write.parquet(str(tmp_path / "two"))
    for part in ("one", "two"):
        store.add_segment(spark.read.parquet(str(tmp_path / part)), str(tmp_path / "root"))
        # what was added before is not needed again
        (tmp_path / part).rename(tmp_path / f"{part}.gone")
    assert _rows(store.Stored(spark, str(tmp_path / "root")).search(["cat"])) == _rows(index.search_texts(docs, ["cat"]))


def test_half_written_segments_are_not_there(spark, stored, tmp_path):
    docs, _ = stored
    root = str(tmp_path / "root")
    store.add_segment(docs, root)
    torn = store.add_segment(docs.withColumn("doc_id", F.col("doc_id") + 1000), root)
    (tmp_path / f"root/size/segment={torn}").rename(tmp_path / "size")
    assert _rows(store.Stored(spark, root).search(["cat"])) == _rows(index.search_texts(docs, ["cat"]))


@pytest.mark.parametrize("split", ["500", "128m"])
def test_ordered_files(spark, tmp_path, split):
    rows = spark.range(2000).select((F.col("id") * 7919 % 101).alias("k"), "id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), "id")).alias("v"))
    writers.ordered_text(rows, str(tmp_path / "o"), F.desc("k"), "id", sep="|")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = [r.line for r in sorted(readers.ordered_lines(spark, str(tmp_path / "o")).collect(), key=lambda r: r.place)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = sorted((-(i * 7919 % 101), i) for i in range(2000))
    assert got == [f"{-k}|{i}|{'v' + str(i) if i % 3 else ''}" for k, i in want]
    files = [r.file for r in spark.read.parquet(str(tmp_path / "o/manifest")).orderBy("part").collect()]
    assert [line for f in files for line in (tmp_path / "o/lines" / f).read_text().splitlines()] == got


def test_ordered_files_of_nothing_and_of_line_ends(spark, tmp_path):
    writers.ordered_text(spark.range(0), str(tmp_path / "none"), "id")
    assert readers.ordered_lines(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="line end"):
        writers.ordered_text(spark.createDataFrame([("a\nb",)], "t string"), str(tmp_path / "end"), "t")


@pytest.mark.parametrize("split", ["29", "1000", "128m"])
def test_pages_over_many_lines(spark, tmp_path, split):
    pages = [f"<title>T{i}</title>\n <text x='1'>é{i}\r\n&lt;i&gt;[[L{i}]]\n</text>" for i in range(40)]
    (tmp_path / "d").mkdir()
    for n in (0, 1):
        (tmp_path / f"d/{n}.xml").write_bytes(("<mediawiki>\n<siteinfo/>\n" + "\n".join(f"  <page>{p}</page>" for p in pages[n::2]) + "\n<page>no end").encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = sorted((r.title, r.body, r.links) for r in readers.wiki_pages(readers.wiki_dump(spark, str(tmp_path / "d"))).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted((f"T{i}", f"é{i}  [[L{i}]] ", [f"L{i}"]) for i in range(40))


def test_runs_of_terms_survive_a_restart(spark, tmp_path):
    """The stream, stopped and started again from its checkpoint, gives the rows of the table; late rows are left out."""
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", "a b a" if m else "b") for h in range(6) for m in (0, 20)] + [("2024-01-01 12:00:00", "a"), (None, "a")]
    batches = [rows[:6], rows[6:], [("2024-01-01 00:05:00", "late"), ("2024-01-02 00:00:00", "end")], [("2024-01-03 00:00:00", "end")]]
    schema = "ts timestamp, text string"
    words = F.split("text", " ")

    def frame(some):
        return spark.createDataFrame(some, "ts string, text string").select(F.col("ts").cast("timestamp").alias("ts"), "text")

    for n, batch in enumerate(batches):
        frame(batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        runs = live.term_runs(stream, words, expiry="45 minutes", watermark="10 minutes")
        q = runs.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("term <> 'end'").collect())
    want = sorted(tuple(r) for r in live.term_runs(frame(rows), words, expiry="45 minutes").collect())
    assert got == want and {r[0] for r in got} == {"a", "b"} and max(r[3] for r in got) == 12


@pytest.mark.parametrize("k", [1, 4, 500])
def test_neighbours_of_all(spark, k):
    """The same as asking for each alone, with ties, words of one tweet in several cases, and rows that ask for nothing."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["W1", "W2"]
    held = {(t, t % 3, rng.choice(words[: rng.choice([5, 42])])): rng.choice([0.5, 1.0, 2.25]) for t in range(60) for _ in range(8)}
    postings = spark.createDataFrame([(*key, w) for key, w in held.items()], "tweet_id int, class int, term string, tfidf double")
    asked = [(i, [rng.choice(words + ["none"]) for _ in range(n)]) for i, n in enumerate([1, 2, 5, 9, 30])] + [(7, []), (8, None), (9, ["none", None]), (10, [" W1", "w1"])]
    got = sorted(tuple(r) for r in sentiment.knn_all(postings, spark.createDataFrame(asked, "asked_id int, terms array<string>"), k).select("asked_id", "score", "tweet_id", "class").collect())
    want = []
    for i, terms in asked:
        lowered = {t.strip().lower() for t in terms or [] if t}
        scores = {}
        for (t, c, w), x in held.items():
            if w.lower() in lowered:
                scores[t, c] = scores.get((t, c), 0.0) + x
        want += [(i, s, t, c) for (t, c), s in sorted(scores.items(), key=lambda r: (-r[1], r[0]))[:k]]
    assert got == sorted(want)


def test_neighbours_shuffle_no_pairs(spark):
    """Where every text holds the words of every question, what is shuffled does not grow with texts x questions."""
    store = spark.sparkContext._jsc.sc().statusStore()
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    rows = [(t, 0, w, 1 + rng.random()) for t in range(1500) for w in words]
    asked = [(i, words[: 3 + i % 8]) for i in range(300)]
    postings = spark.createDataFrame(rows, "tweet_id int, class int, term string, tfidf double")
    before = store.executorSummary("driver").totalShuffleWrite()
    got = sentiment.knn_all(postings, spark.createDataFrame(asked, "asked_id int, terms array<string>"), 3).collect()
    assert len(got) == 900
    assert store.executorSummary("driver").totalShuffleWrite() - before < 2_000_000


@pytest.mark.parametrize("least", [0.5, -1.0])
def test_packs_of_neighbours(monkeypatch, least):
    """One pair of packs against all pairs one by one, with tables of a few cells, copies, and floors that hold or do not."""
    monkeypatch.setattr(neighbours, "AT_ONCE", 7)
    monkeypatch.setattr(neighbours, "CELLS", 60)
    rng = random.Random(3)
    texts = [{rng.randrange(30): round(rng.uniform(least, 3), 2) or 1.0 for _ in range(rng.randrange(1, 15))} for _ in range(40)]
    texts += [texts[0]] * 9
    asks = [sorted({rng.randrange(40) for _ in range(rng.randrange(1, 8))}) for _ in range(25)] + [[99]]
    exact = [sorted((-sum(d[w] for w in q if w in d), t) for t, d in enumerate(texts) if any(w in d for w in q)) for q in asks]
    k = 4
    floors = [-math.inf if i % 3 or len(x) < k else -x[k - 1][0] - neighbours.NEAR for i, x in enumerate(exact)]
    words, at = np.unique([w for d in texts for w in sorted(d)], return_inverse=True)
    ends = np.cumsum([len(d) for d in texts])
    ws = np.array([d[w] for d in texts for w in sorted(d)])
    q, t, raw = neighbours._of_pair(k, np.arange(len(texts)), ends, words, at, ws, np.arange(len(asks)) + 100, np.cumsum([len(x) for x in asks]), np.concatenate(asks), np.array(floors))
    for i, want in enumerate(exact):
        got = sorted((-round(r, 6), int(x)) for a, x, r in zip(q, t, raw) if a == i + 100)[:k]
        assert got == [(round(s, 6), x) for s, x in want[:k]]


def _texts_by_word(texts):
    words, at = np.unique([w for d in texts for w in sorted(d)], return_inverse=True)
    col, ws = np.repeat(np.arange(len(texts)), [len(d) for d in texts]), np.array([d[w] for d in texts for w in sorted(d)])
    return words, *neighbours._by_word(at, col, ws, len(words))


@pytest.mark.parametrize("cells, dense, summed", [(1 << 23, 1.0, 20), (3000, 1.0, 20), (1 << 23, 0.0, 20), (3000, 0.0, 20), (1 << 23, 0.0, 300)])
def test_most_postings_of_neighbours_are_not_read(monkeypatch, cells, dense, summed):
    """With floors, a few of the postings tell which texts can be among the best, and none of those is lost; packs are in
    another order than ids, a table takes all frequent words or a few, and products are used for none, some or all words."""
    monkeypatch.setattr(neighbours, "DENSE", dense)
    monkeypatch.setattr(neighbours, "PRODUCT_WORDS", summed)
    monkeypatch.setattr(neighbours, "SHARE", 0.0 if summed == 300 else neighbours.SHARE)
    monkeypatch.setattr(neighbours, "PRODUCT", 0.0 if summed == 300 else neighbours.PRODUCT)
    monkeypatch.setattr(neighbours, "CELLS", cells)
    monkeypatch.setattr(neighbours, "SCORED", 1000)
    rng = np.random.default_rng(5)
    share = 1 / np.arange(1, 301) ** 0.8
    weigh = np.log10(1 + 1 / np.minimum(share, 0.9))
    texts = []
    for n in rng.integers(10, 400, 600):
        held, times = np.unique(rng.choice(300, n, p=share / share.sum()), return_counts=True)
        texts.append({int(w): float(weigh[w] * (1 + np.log10(x))) for w, x in zip(held, times)})
    ts = rng.permutation(600)
    asks = [np.unique(rng.choice(300, n, p=share / share.sum())) for n in rng.integers(3, 60, 80)]
    k = 5
    exact = [sorted((-round(sum(d[w] for w in q.tolist() if w in d), 6), int(ts[i])) for i, d in enumerate(texts) if not d.keys().isdisjoint(q.tolist()))[:k] for q in asks]
    floors = np.array([-x[-1][0] - neighbours.NEAR for x in exact])
    pack, ends = neighbours._Pack(ts, *_texts_by_word(texts)), np.cumsum([len(x) for x in asks])
    q, t, raw = pack.best(k, np.arange(80), ends, np.concatenate(asks), floors)
    for i, want in enumerate(exact):
        assert sorted((-round(r, 6), int(x)) for a, x, r in zip(q, t, raw) if a == i)[:k] == want
    _, reads, need = pack._cut(np.searchsorted(pack.words, np.concatenate(asks)), np.diff(ends, prepend=0), floors, 1 - neighbours.EXCESS)
    assert (need > 0).all()
    if cells > 3000:
        assert reads.sum() < 0.3 * np.diff(pack.begins)[np.searchsorted(pack.words, np.concatenate(asks))].sum()


def test_copies_of_texts_are_packed_once():
    """Texts alike in words and weights stand once in a pack, on both sides of a batch's end."""
    rows = [(t, [3, 5 + t // 4], [1.0, 2.0], 7, t // 4) for t in range(12)]
    names = ["t", "wids", "ws", "s1", "s2"]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64(), pa.int64()]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], x) for i, x in enumerate(types)], names) for some in (rows[:6], rows[6:])]
    packs = [p.to_pylist()[0] for p in neighbours._packs_of_texts(iter(batches))]
    assert [t for p in packs for t in p["ts"]] == [0, 4, 8]
    assert sum(len(p["cols"]) for p in packs) == 6


def test_neighbours_among_copies(spark):
    """Copies of a text are neighbours each, the lower ids first, also where more of them than k are alike."""
    held = {0: ["a", "b"], 1: ["a"], 2: ["a", "b", "c"]}
    rows = [(t, 0, w, 1.5) for t in range(40) for w in held[t % 3]]
    postings = spark.createDataFrame(rows, "tweet_id int, class int, term string, tfidf double")
    got = sentiment.knn_all(postings, spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"])], "asked_id int, terms array<string>"), 15).collect()
    want = sorted((i, -1.5 * len(set(q) & set(held[t % 3])), t) for i, q in ((1, "abc"), (2, "a")) for t in range(40))
    want = [r for i in (1, 2) for r in [w for w in want if w[0] == i][:15]]
    assert sorted((r.asked_id, -r.score, r.tweet_id) for r in got) == want

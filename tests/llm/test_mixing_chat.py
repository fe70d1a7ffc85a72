"""Mixing and chat formatting against brute force and the stated edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from weftline.llm import chat, mixing

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def waterfill(sizes, weights):
    total, held = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        left = total - sum(held.values())
        w = sum(weights[i] for i in free)
        t = {i: left * weights[i] / w for i in free} if w else {}
        over = [i for i in free if t[i] > 3 * sizes[i]]
        if not over:
            return [held.get(i, t.get(i)) for i in range(len(sizes))]
        held |= {i: 3.0 * sizes[i] for i in over}


def test_mix_targets_and_takes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.plan(docs).collect()
    again = {(r.doc_id, r.taken, tuple(r.shards)) for r in mixing.plan(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken, tuple(r.shards)) for r in rows}
    src = {r.doc_id: r.source for r in docs.collect()}
    size, taken, target = defaultdict(int), defaultdict(int), {}
    largest = defaultdict(int)
    for r in rows:
        s = src[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert r.taken <= 3 * r.size and len(r.shards) * r.size == r.taken
    names = sorted(size)
    want = waterfill([size[n] for n in names], [i % 3 + 1 for i in range(len(names))])
    for n, t in zip(names, want, strict=True):
        assert target[n] == pytest.approx(t, rel=1e-9)
        assert abs(taken[n] - target[n]) <= largest[n]
    assert all(r.source_size == size[src[r.doc_id]] for r in rows)


def test_mix_odd_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, None, None), (2, "", "y"), (3, "w " * 5000, "y"), (1, "other", "z"), (4, None, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.plan(docs).collect()
    assert len(plan) == len(rows)
    mixed = mixing.mix(docs.selectExpr("*", "1 as size", "2 as shards"))
    assert mixed.columns == ["doc_id", "text", "source", "size", "shards"]
    want = Counter()
    for r in plan:
        want[(r.doc_id, r.size)] += len(r.shards)
    got = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in mixed.collect())
    assert got == Counter({k: n for k, n in want.items() if n})
    assert mixing.plan(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.taken for r in mixing.plan(spark.createDataFrame([(1, "", "a")], DOCS)).collect()] == [0]


def test_splitting_tree_is_exact_and_balanced(spark):
    quotas = spark.createDataFrame([(f"0{c}", 40 * (i + 1)) for i, c in enumerate("abcde")], "skey string, quota long")
    ends = {r.skey: r.ends for r in mixing.splitting_tree(quotas, depth=3).collect()}
    totals = [0] * 8
    for i, c in enumerate("abcde"):
        e = ends[f"0{c}"]
        assert len(e) == 8 and e[-1] == 40 * (i + 1) and e == sorted(e)
        for k, (a, b) in enumerate(zip([0, *e], e)):
            totals[k] += b - a
    assert set(totals) == {75}


def test_splitting_tree_is_hypergeometric(spark):
    """What each of 64 shards gets of 512 blocks among 1,536 has the mean and variance of drawing 24 without replacement."""
    quotas = spark.createDataFrame([("0a", 512), ("0b", 1024)], "skey string, quota long")
    got = []
    for seed in (1, 2, 3):
        e = next(r.ends for r in mixing.splitting_tree(quotas, depth=6, seed=seed).collect() if r.skey == "0a")
        got += [y - x for x, y in zip([0, *e], e)]
    variance = sum((x - 8) ** 2 for x in got) / len(got)
    assert sum(got) == 8 * len(got) and variance == pytest.approx(24 / 3 * 2 / 3 * (1536 - 24) / 1535, rel=0.35)
    assert min(got) < 5 and max(got) > 11


def test_mix_places(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 5_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS copy", "2 AS _k1", "3 AS _shards")
    plan = {r.doc_id: r for r in mixing.plan(docs).collect()}
    placed = mixing.mix(docs, with_place=True)
    assert placed.columns == [*docs.columns, "_copy", "shard"]
    rows = placed.selectExpr("doc_id", "shard", "_copy AS c", "spark_partition_id() AS p").collect()
    assert Counter((r.doc_id, r.c, r.shard) for r in rows) == Counter((d, c, s) for d, r in plan.items() for c, s in enumerate(r.shards))
    depth, tasks = mixing.tree_depth(sum(r.size for r in plan.values()))
    assert 2**depth > 4 and {r.shard for r in rows} == set(range(2**depth)) and tasks == 1
    # a shard is in one task, in no order of ids, and shards are alike in the number of blocks they get
    assert all(len({r.p for r in rows if r.shard == s}) == 1 for s in range(2**depth))
    ids = [r.doc_id for r in rows if r.shard == 0]
    assert ids != sorted(ids)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.tree_depth(1e15) == (mixing.DEEPEST, -(-10**15 // 5_000 // 2**mixing.DEEPEST))


def test_very_many_alike_rows(spark):
    docs = spark.range(100_000).selectExpr("7L AS doc_id", "'a b c' AS text", "'x' AS source").unionByName(spark.range(50_000).selectExpr("id + 10 AS doc_id", "'d e f' AS text", "'y' AS source"))
    plan = mixing.plan(docs).groupBy("doc_id", "size", "source_size", "target").agg({"taken": "sum", "*": "count"}).collect()
    same = [r for r in plan if r.doc_id == 7]
    assert same[0]["count(1)"] == 100_000 and abs(same[0]["sum(taken)"] - same[0].target) <= 3
    assert len(plan) == 50_001
    mixed = mixing.mix(docs)
    assert mixed.where("doc_id = 7").count() * 3 == same[0]["sum(taken)"]


def brute_chat(rows):
    out = {}
    for conv, turns in rows.items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rows = [
        (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
        (1, 0, "user", "%5B a [TURN x] %255B <s>"), (1, 1, "tool]x[", "r"), (1, 2, None, None), (1, 3, "assistant", ""), (1, 4, "assistant", "é\U0001f999\n%"),
        (2, 0, "user", "only"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"), (None, None, "system", "x" * 5000), (4, 1, "assistant", None), (4, 0, "user", "q"), (4, 2, "user", "end"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "7 as example", "'y' as formatted")
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t, r or "", x or ""))
    ex = chat.examples(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(ex).collect()}
    assert got == brute_chat(want)
    per = Counter(r.conv_id for r in ex.collect())
    assert per == {-7: 1, 1: 2, 2: 1, 3: 2, None: 1, 4: 2}
    assert chat.digest(chat.examples(df.limit(0))).count() == 0

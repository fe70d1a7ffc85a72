"""Substring and suffix-array dedup against brute force over every window."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from weftline.llm import repeats
from weftline.llm import substring_dedup as sub
from weftline.llm import suffix_dedup as suffix

SCHEMA = "doc_id long, text string, h long, source string"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_words(rows, width):
    first, docs = {}, sorted({(d is None, d or 0, t or "") for d, t in rows})
    words = {x: re.findall(r"[^\x20\x09-\x0D]+", x[2]) for x in docs}
    for x in docs:
        for s in range(len(words[x]) - width + 1):
            first.setdefault(tuple(words[x][s : s + width]), (x, s))
    out = []
    for d, t in rows:
        x = (d is None, d or 0, t or "")
        w = words[x]
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] != (x, s):
                gone |= set(range(s, s + width))
        kept = [v for i, v in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), sha(" ".join(kept).encode())))
    return sorted(out, key=str)


def corpus(seed):
    rng = np.random.default_rng(seed)
    prose = lambda n, v=60: [f"w{rng.integers(v)}" for _ in range(n)]
    shared = [prose(int(n)) for n in rng.integers(19, 70, 4)]
    rows = []
    for i in range(90):
        w = prose(int(rng.integers(0, 60)), 4000)
        for _ in range(int(rng.integers(0, 3))):
            s = shared[rng.integers(4)]
            a = int(rng.integers(0, 6))
            w += s[a:] + prose(int(rng.integers(0, 9)), 4000)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (7, rows[7][1]), (None, rows[9][1]), (None, None), (202, ""), (203, "a b " * 60), (204, " ".join(prose(6000, 9)))]
    return rows


@pytest.mark.parametrize(("seed", "solo"), [(1, 256), (2, 3)])
def test_substring_dedup(spark, monkeypatch, seed, solo):
    monkeypatch.setattr(repeats, "SOLO", solo)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in sub.digest(df).collect()), key=str)
    assert got == brute_words(rows, 20)
    cleaned = sub.clean(df)
    assert cleaned.columns == df.columns and cleaned.count() == len(rows)
    assert sub.digest(df.limit(0)).count() == 0


def brute_bytes(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[s : s + width] for t in texts for s in range(len(t) - width + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, int)
        for s in range(len(t) - width + 1):
            if seen[t[s : s + width]] > 1:
                gone[s] += 1
                gone[s + width] -= 1 if s + width <= len(t) else 0
        m = np.cumsum(gone)[: len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        out.append((d, len(t), int(m.sum()), spans, sha(bytes(np.frombuffer(t, np.uint8)[~m]))))
    return sorted(out, key=str)


@pytest.mark.parametrize("solo", [256, 3])
def test_suffix_dedup(spark, monkeypatch, solo):
    monkeypatch.setattr(repeats, "SOLO", solo)
    monkeypatch.setattr(suffix, "SORT_BYTES", 4000)
    rows = [(d, t.replace("w1", "é") if t else t) for d, t in corpus(4)] + [(300, "z" * 900), (301, "z" * 199), (302, "ab" * 150)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in suffix.digest(df).collect()), key=str)
    assert got == brute_bytes(rows, 200)
    cleaned = suffix.clean(df)
    assert cleaned.columns == df.columns and cleaned.count() == len(rows)
    assert suffix.digest(df.limit(0)).count() == 0


def test_maximal_repeats():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice(list(b"ab"), 40).tolist()) for _ in range(4)]
    sa = suffix.SuffixArray(texts)
    places = [(i, s) for i, t in enumerate(texts) for s in range(len(t))]
    flat = {int(sa.begin[i]) + s: (i, s) for i, s in places}
    got = {(n, frozenset(flat[int(p)] for p in at)) for n, at in sa.maximal_repeats(4)}
    want = set()
    for i, s in places:
        for n in range(4, 41):
            w = texts[i][s : s + n]
            if len(w) < n:
                break
            at = frozenset((j, p) for j, p in places if texts[j][p : p + n] == w)
            if len(at) > 1:
                right = {texts[j][p + n : p + n + 1] or j.to_bytes() + b"$" for j, p in at}
                left = {texts[j][p - 1 : p] if p else j.to_bytes() + b"^" for j, p in at}
                if len(right) > 1 and len(left) > 1:
                    want.add((n, at))
    assert got == want


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_texts_that_polynomial_hashes_confuse(spark):
    one = thue_morse(2048)
    two = one.translate(str.maketrans("ab", "ba"))
    common = [f"c{i}" for i in range(19)]
    rows = [(1, " ".join([*common, one])), (2, " ".join([*common, two])), (3, " ".join([one, *common])), (4, " ".join([two, *common]))]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in sub.digest(df).collect()), key=str)
    assert got == brute_words(rows, 20) and not any(r[2] for r in got)
    rows = [(1, one[:199] + "c"), (2, two[:199] + "c"), (3, "x" + one + "y"), (4, "z" + two)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in suffix.digest(df).collect()), key=str) == brute_bytes(rows, 200)


def test_very_many_alike_rows_and_one_hot_anchor(spark):
    rng = np.random.default_rng(8)
    text = " ".join(f"w{i}" for i in range(300))
    shared = " ".join(f"s{i}" for i in range(30))
    around = [(i, f"a{rng.integers(9)} b{rng.integers(400)} {shared} c{rng.integers(9)} d{rng.integers(400)}") for i in range(3000)]
    rows = [(None, text)] * 2000 + around
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(8)
    assert sorted((tuple(r) for r in sub.digest(df).collect()), key=str) == brute_words(rows, 20)
    rows = [(None, text)] * 500 + around
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(8)
    assert sorted((tuple(r) for r in suffix.digest(df, width=100, seed=16).collect()), key=str) == brute_bytes(rows, 100)


def test_names_that_clash(spark):
    rows = [(1, "w " * 40, 1, "x", 7, 8, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc long, _tie string, _at long, at long, doc string")
    for op in (sub, suffix):
        assert op.clean(df).columns == df.columns and op.clean(df).count() == 1 and op.digest(df).count() == 1


def plain_maximal(rows, width):
    """{(text of the repeat, its occurrences)} from all suffixes, sorted; rows alike in id and text are listed once."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    suffixes = sorted((t[p:], i, p) for i, (_, t) in enumerate(texts) for p in range(len(t) - width + 1))
    common = []
    for (x, *_), (y, *_) in zip(suffixes, suffixes[1:], strict=False):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        common.append(n)
    out = set()
    for k, n in enumerate(common):
        if n < width:
            continue
        a = z = k
        while a and common[a - 1] >= n:
            a -= 1
        while z + 1 < len(common) and common[z + 1] >= n:
            z += 1
        at = [(i, p) for _, i, p in suffixes[a : z + 2]]
        left = {texts[i][1][p - 1] if p else -1 - i for i, p in at}
        if len(left) > 1:
            out.add((suffixes[k][0][:n], frozenset((texts[i][0], p) for i, p in at)))
    return out


def found_maximal(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(4)
    texts = {d: (t or "").encode() for d, t in rows}
    groups = {}
    for r in suffix.repeat_groups(df, **options).collect():
        at = groups.setdefault((r.group, r.length), {})
        assert (r.doc_id, r.start) not in at
        at[r.doc_id, r.start] = texts[r.doc_id][r.start : r.start + r.length]
    for held in groups.values():
        assert len(set(held.values())) == 1
    return {(next(iter(held.values())), frozenset(held)) for held in groups.values()}


@pytest.mark.parametrize(("solo", "ends"), [(256, 16), (2, 1)])
def test_repeat_groups(spark, monkeypatch, solo, ends):
    monkeypatch.setattr(repeats, "SOLO", solo)
    monkeypatch.setattr(suffix, "ENDS", ends)
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    shared = [letters(60), letters(45), letters(400)]
    rows = [(i, letters(9) + shared[i % 2][i // 4 :] + letters(7)) for i in range(12)] + [(20, letters(70))] * 2
    # long repeats, one inside the other, at borders of texts, and repeats of a text in itself
    rows += [(30, letters(5) + shared[2] + letters(5)), (31, shared[2][:300]), (32, letters(3) + shared[2][100:]), (33, shared[2]), (34, shared[2][50:350] + shared[2][50:350])]
    rows += [(40, "ab" * 60), (41, "z" * 90), (42, ""), (43, None)]
    assert found_maximal(spark, rows, width=40, seed=8) == plain_maximal(rows, 40)
    assert found_maximal(spark, rows[:0], width=40, seed=8) == set()


@pytest.mark.parametrize("many", [200, 300])
def test_repeat_groups_of_many_texts(spark, many):
    rng = np.random.default_rng(many)
    letters = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    shared, passage = letters(260), letters(900)
    rows = []
    for i in range(many):
        a = int(rng.integers(0, 40))
        rows.append((i, letters(a) + shared + letters(40 - a)))
    rows += [(1000 + i, letters(20 + i) + passage + letters(9)) for i in range(5)]
    want = plain_maximal(rows, 200)
    assert found_maximal(spark, rows) == want
    assert (passage.encode(), frozenset((1000 + i, 20 + i) for i in range(5))) in want

"""Secret spans against a direct reading of the patterns, and the guess costs of known values."""

import hashlib
import itertools
import math
import random
import re
import time

from weftline.llm import secrets


def brute(text):
    out = []
    for kind, pattern, keep in (
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), ["assign", "access", "hex"].index(kind), m.end(), kind) for m in re.finditer(pattern, text) if keep(m)]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


ODD = [
    "", "é\U0001f999 password = hunter22xyz", 'secret:"token":abcdefg', "token=abc token = abcdef", "AKIA" + "A" * 15, "AKIA" + "B" * 16, "0" * 23 + " " + "f" * 24,
    "API_KEY:x" + "y" * 5000, "passwd='zzzzzz' PassWord=\tno", "pwd: Tr0ub4dor&3xQ9", "pwd: password1", "auth := 9f8aKQ2mm1Zt", "the token thing: no",
]


def test_base_spans_and_method():
    for t in ODD:
        base, spans = secrets.all_spans(t)
        assert [f"{k}:{a}:{b}" for a, b, k in base] == brute(t), t
        assert set(base) <= set(spans)
    assert any(k == "guess" for _, _, k in secrets.all_spans(ODD[9])[1])
    assert not secrets.all_spans(ODD[10])[1]


def test_guess_cost_orders_values():
    cheap = ["password123", "qwertyuiop", "aaaaaaaa", "2019-01-02", "abcdefgh", "P@ssw0rd!", "secretsecretsecret"]
    assert all(secrets.guess_cost(v) < 8 for v in cheap)
    assert all(secrets.guess_cost(v) > 12 for v in ["x7Kq9ZpLm2Wd", "Tr0ub4dor&3xQ9"])
    assert secrets.guess_cost("") == 0


def every_segment(v, rank, cost):
    """All (i, j): price of its own kind, each substring looked at by itself."""
    low = v.lower()
    keys = low.translate(secrets.SHIFT)
    for i in range(len(v)):
        for j in range(i + 1, len(v) + 1):
            part, n = low[i:j], j - i
            upper = 0.3 if any(c.isupper() for c in v[i:j]) else 0.0
            plain = part.translate(secrets.LEET)
            if n >= 3 and part in rank:
                yield i, j, math.log10(rank[part] + 1) + upper
            if n >= 3 and plain != part and plain in rank:
                yield i, j, math.log10(rank[plain] + 1) + 0.7 + upper
            if (m := secrets.DATE.match(v, i)) and m.end() == j:
                yield i, j, 2.1 if n == 4 else 4.6
            steps = [secrets.STEPS.get(keys[k : k + 2]) for k in range(i, j - 1)]
            if n >= 3 and all(s is not None for s in steps):
                yield i, j, math.log10(47 * n) + 0.6 * (1 + sum(s != t for s, t in zip(steps, steps[1:])))
            for way, extra in ((1, 0.0), (-1, 0.3)):
                if n >= 3 and all(ord(y) - ord(x) == way for x, y in zip(part, part[1:])):
                    yield i, j, math.log10(26 * n) + extra
            for p in range(1, n // 2 + 1):
                if n >= 3 and n % p == 0 and v[i:j] == v[i : i + p] * (n // p):
                    yield i, j, cost(v[i : i + p]) + math.log10(n // p)


def least_chain(v, rank, known):
    if v not in known:
        best = {}
        for i, j, c in every_segment(v, rank, lambda u: least_chain(u, rank, known)):
            best[i, j] = min(c, best.get((i, j), math.inf))
        upto = [0.0]
        for j in range(1, len(v) + 1):
            upto.append(min(upto[i] + (secrets.JOIN if i else 0.0) + min(best.get((i, j), math.inf), sum(map(secrets._bits, v[i:j]))) for i in range(j)))
        known[v] = upto[-1]
    return known[v]


def test_least_chain_over_all_segmentations():
    """Against segments found one by one, inner parts of runs among them."""
    rng = random.Random(4)
    rank = secrets.ranks([*secrets.WORDS, "xyzabc", "ghiuvw"])
    values = ["abcabcab", "qwe123", "aaabbb", "passpass", "P@ss2019", "zaq1xsw2", "123321", "dragon9", "aXbXaXbX", "987abc", "xyzabcdefghiuvw", "qwertyuiopasdf", "xqwertyx123456y", "1aaaaaaa1", "xabababababy"]
    values += ["".join(rng.choice("abc1qw2e") for _ in range(rng.randint(1, 14))) for _ in range(150)]
    values += ["".join(rng.choice(["abcdef", "qwerty", "xyz", "1999", "aaa", "dragon", "9"]) for _ in range(4))[rng.randint(0, 3) :] for _ in range(60)]
    known = {}
    for v in values:
        assert math.isclose(secrets.guess_cost(v, rank), least_chain(v, rank, known), abs_tol=1e-9), v
    assert math.isclose(secrets.guess_cost("xyzabcdefghiuvw", secrets.ranks(["xyzabc", "ghiuvw"])), 3.67, abs_tol=0.01)


def test_long_runs_stay_near_linear():
    began = time.time()
    for v in ("a" * 20_000, "abcdefghij" * 2_000, "qwertyuiop" * 2_000, "x7Kq9ZpLm2WdTr0ub4dor3xQ9aB5" * 700):
        assert secrets.guess_cost(v) < 45
    assert time.time() - began < 60


def test_periods_against_every_place():
    rng = random.Random(2)
    values = ["".join(rng.choice("ab") for _ in range(rng.randint(2, 30))) for _ in range(80)] + ["abcdefghij" * 6, "x" + "abcdefghijklm" * 2 + "y", "".join(map(chr, range(200, 240))) * 3]
    for v in values:
        got = {(a, b, p) for a, b, p in secrets.periods(v)}
        assert all(v[a : b - p] == v[a + p : b] and b - a >= 2 * p for a, b, p in got)
        for p in range(1, min(8, len(v) // 2) + 1):
            same = [v[i] == v[i + p] for i in range(len(v) - p)]
            runs = [(m.start(), m.end() + p, p) for m in re.finditer("1+", "".join("1" if x else "0" for x in same)) if m.end() - m.start() >= p]
            assert {x for x in got if x[2] == p} == set(runs)
    assert (0, 60, 10) in set(secrets.periods(values[80])) and (1, 27, 13) in set(secrets.periods(values[81])) and (0, 120, 40) in set(secrets.periods(values[82]))


def test_keyboard_and_dictionary():
    assert secrets.STEPS["qw"] == secrets.STEPS["po"[::-1]] == secrets.STEPS["12"] and secrets.STEPS["qa"] == secrets.STEPS["ws"] == secrets.STEPS["az"]
    assert "qs" not in secrets.STEPS and "aq" in secrets.STEPS and secrets.STEPS["q2"] != secrets.STEPS["q1"]
    straight = [secrets.guess_cost(v) for v in ("qwertyuiop", "asdfghjkl", "QWERTYUIOP", "!@#$%^&*()")]
    assert max(straight) < 3.6 and secrets.guess_cost("correcthorsebatterystaple") < 10 and secrets.guess_cost("abcdefghij" * 6) < 4
    rank = secrets.ranks(["elephant", "giraffe", "elephant"])
    assert rank == {"elephant": 1, "giraffe": 2} and secrets.guess_cost("elephantgiraffe", rank) < 3 < 10 < secrets.guess_cost("elephantgiraffe")


def test_words_of_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(secrets, "COUNTED_AT_ONCE", 3)
    rows = [(1, "Zebra zebra, lion. (lion) x9lion a-lion ape"), (2, "lion tiger\nzebra"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert secrets.corpus_words(df) == ["lion", "zebra", "tiger"] and secrets.corpus_words(df, most=1) == ["lion"]
    value = "password: Zebralionzebra"
    df = spark.createDataFrame([(5, value)] + rows, "doc_id long, text string")
    kinds = lambda words: {s.split(":")[0] for r in secrets.scan(df, words=words).collect() for s in r.spans.split(",") if s}
    assert kinds(None) == {"assign"} and kinds([]) == {"assign", "guess"}


def test_documents(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(None, None, "y", 2), (3, ODD[3], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex int")
    got = secrets.scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            want = brute(ODD[r.doc_id])
            assert (r.n_assign + r.n_access + r.n_hex, r.base_sha256) == (len(want), hashlib.sha256(",".join(want).encode()).hexdigest())
    clean = secrets.redact(df)
    assert clean.columns == df.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[None] is None and texts[12] == ODD[12] and texts[1] == "é\U0001f999 [SECRET:assign]"
    assert secrets.scan(df.limit(0)).count() == 0 and secrets.redact(df.limit(0)).count() == 0

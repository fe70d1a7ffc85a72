"""The pipeline stage by stage against brute-force versions, on a small fixture and on the smallest tables."""

import re
from collections import Counter

import corpus_pipeline as cp
import pytest

from test_mixing_chat import waterfill

from weftline.llm import common, secrets
from weftline.llm.registry import ORACLES, QUERIES


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rejected(t):
    w = words(t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    chars = sum(map(len, w))
    upper = sum(x.isupper() for x in t or "")
    return (
        len(w) < 10 or 100 * len(cover) > 20 * len(w) or 2 * len(re.findall(r"[#*$%&|<>]", t)) > len(w) or chars > 25 * len(w)
        or (len(lines) >= 4 and 2 * (len(lines) - len(set(lines))) > len(lines)) or (chars >= 40 and 2 * upper > chars)
    )


def near(a, b):
    s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(a), words(b)))
    return a == b or len(s & t) >= 0.8 * len(s | t)


BASE = (
    r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}",
)


def masked(rows):
    """Character by character: what any span covers goes, and its first character becomes the mark of the first span."""
    plain = Counter()
    for _, t in rows:
        low = (t or "").lower()
        for m in re.finditer("[a-z]+", low):
            before, after = low[m.start() - 1 : m.start()] or " ", low[m.end() : m.end() + 1] or " "
            if 4 <= len(m[0]) <= 24 and (before.isspace() or before in "\"'(") and (after.isspace() or after in ".,;:!?\"')"):
                plain[m[0]] += 1
    ranked = sorted(plain, key=lambda w: (-plain[w], w))[: secrets.DICTIONARY_WORDS]
    rank = secrets.ranks([*secrets.WORDS, *ranked])
    out = set()
    for d, t in rows:
        spans = [(m.start(), k, m.end()) for k, p in enumerate(BASE) for m in re.finditer(p, t)]
        for m in secrets.CONTEXT.finditer(t):
            if len(m[1]) >= 4 and secrets.guess_cost(m[1], rank) >= 10:
                spans.append((m.start(1), 3, m.end(1)))
        cover = [None] * len(t)
        for a, k, z in sorted(spans):
            joins = cover[a] is not None
            for i in range(a, z):
                cover[i] = cover[a] if joins else (a, k) if cover[i] is None else cover[i]
        text = "".join(c if cover[i] is None else f"[SECRET:{secrets.KINDS[cover[i][1]]}]" if cover[i][0] == i else "" for i, c in enumerate(t))
        out.add((d, text))
    return out


def check_mix(rows, copies):
    """Shares by weight, whole passes, and one more of some rows until the target is met."""
    names = sorted({r.source for r in rows})
    size = [sum(len(words(r.text)) for r in rows if r.source == n) for n in names]
    for n, total, target in zip(names, size, waterfill(size, [i % 3 + 1 for i in range(len(names))]), strict=True):
        mine = [r for r in rows if r.source == n]
        passes = min(3, int(target / total + 1e-9))
        got = [copies[r.doc_id, r.text] for r in mine]
        assert set(got) <= {passes, min(3, passes + 1)}
        taken = sum(len(words(r.text)) * k for r, k in zip(mine, got, strict=True))
        assert abs(taken - target) <= max(len(words(r.text)) for r in mine)


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = {d for d, r in rows.items() if not rejected(r.text)}
    at = {}
    for name, step in cp.STAGES[:-1]:
        docs = cp.stage(step(spark, docs, sf))
        assert docs.columns == columns, name
        at[name] = docs.collect()
    assert {r.doc_id for r in at["quality_rules"]} == kept
    parent = {d: d for d in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(kept)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if near(rows[a].text, rows[b].text):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r.doc_id for r in at["near_duplicates"]) == sorted({find(d) for d in ids})
    assert {(r.doc_id, r.text) for r in at["secret_scan"]} == masked([(r.doc_id, r.text) for r in at["near_duplicates"]])
    check_mix(at["secret_scan"], Counter((r.doc_id, r.text) for r in at["source_mixing"]))
    final = cp.STAGES[-1][1](spark, docs, sf).collect()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=cp.piece_model())
    texts = {r.doc_id: r.text for r in at["source_mixing"]}
    assert all(r.round_trip and list(r.ids) == sp.encode(texts[r.doc_id]) for r in final)
    assert len(final) == len(at["source_mixing"])


def test_run_leaves_nothing_but_its_result(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = set(common._staged.get(spark.sparkContext.applicationId, []))
    out = cp.run(spark, str(tmp_path))
    left = set(common._staged[spark.sparkContext.applicationId]) - before
    assert len(left) == 1 and out.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "sale_lines"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(found.fetchall())


def test_registry():
    assert {k.split("_")[0] for k in QUERIES} == {"pipeline", *(f"op{n}" for n in range(1, 14))}
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("empty", [True, False])
def test_odd_tables(spark, empty):
    rows = [] if empty else [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "word " * 300, "en", None, 3), (3, " ".join(f"w{i}" for i in range(400)), "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in cp.STAGES:
        docs = cp.stage(step(spark, docs, ""))
    assert {r.doc_id for r in docs.collect()} == (set() if empty else {3})

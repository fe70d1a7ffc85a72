"""Held-out accuracy, and scores for odd rows."""

import math
import zlib

import numpy as np
import pytest

from weftline.llm import quality_model as qm

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in qm.score(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    held = [(r.predicted, truth[d]) for d, r in rows.items() if r.held_out and d in truth]
    right = sum(p == t for p, t in held) / len(held)
    assert right > 0.95, right
    again = {r.doc_id: r.score for r in qm.score(docs.repartition(3), labels).collect()}
    assert max(abs(again[d] - r.score) for d, r in rows.items()) < 1e-6


def plain_tokens(text):
    """(bucket, shape) of each word, character by character."""
    data, out, at = (text or "").encode(), [], 0
    while at < len(data):
        to = at
        while to < len(data) and qm._CLASS[data[to]] == qm._CLASS[data[at]]:
            to += 1
        if qm._CLASS[data[at]]:
            h = 0
            word = data[at:to].lower()
            for i, c in enumerate(word):
                h = (h + c * pow(int(qm.ts.BASE), i, 1 << 64)) % (1 << 64)
            h = int(qm.ts.mix(np.array([(h + len(word)) % (1 << 64)], np.uint64))[0])
            caps = sum(65 <= c <= 90 for c in data[at:to])
            case = 0 if not caps else 2 if caps == to - at > 1 else 1
            kind = int(qm._CLASS[data[at]])
            same = bool(out) and out[-1][0] == h or len(out) > 1 and out[-2][0] == h and kind == 1
            out.append((h, (kind % 3) * 24 + case * 8 + min(int(math.log2(to - at)), 3) * 2 + same))
        at = to
    return [(h % qm.VOCAB, min(shape, qm.SHAPES - 1)) for h, shape in out]


TEXTS = ["The cat, the cat!", "a b  12 34", None, "", "ÄÖ straße 7x", "x x x", "The dog and the cat sat.\nThe end"]


def test_word_vectors_against_a_plain_loop(spark):
    place, sign = qm.index_vectors(qm.VOCAB, qm.DIM)
    total = np.zeros((qm.VOCAB, qm.DIM))
    for t in TEXTS:
        words = [b for b, _ in plain_tokens(t)]
        for i, w in enumerate(words):
            for j in range(max(0, i - qm.WINDOW), min(len(words), i + qm.WINDOW + 1)):
                if j != i:
                    for k in range(qm.NONZERO):
                        total[w, place[words[j], k]] += sign[words[j], k]
    want = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)
    for w in range(qm.VOCAB):
        for k in range(qm.NONZERO):
            want[w, place[w, k]] += sign[w, k]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    vectors = qm.corpus_vectors(docs.repartition(3))
    assert np.allclose(vectors, want, atol=1e-5)
    shape_place, shape_sign = qm.index_vectors(qm.SHAPES, qm.SHAPE_DIM, qm.SEED + 1)
    for r in qm.features(docs, vectors).collect():
        x = np.frombuffer(bytes(r.x), np.float32)
        words = plain_tokens(TEXTS[r.doc_id])
        pooled = np.mean([want[b] for b, _ in words], axis=0) if words else np.zeros(qm.DIM)
        shapes = np.zeros(qm.SHAPE_DIM)
        for _, s in words:
            for k in range(qm.NONZERO):
                shapes[shape_place[s, k]] += shape_sign[s, k] / len(words)
        assert np.allclose(x[: qm.DIM], pooled, atol=1e-4) and np.allclose(x[qm.DIM : qm.DIM + qm.SHAPE_DIM], shapes, atol=1e-4)
        assert x[-3] == pytest.approx(math.log1p(len(words)), abs=1e-5)


def test_temperature_calibrates():
    """Labels drawn with known probabilities: scores near those on rows not seen; an overfitted network is softened."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 4))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(6000) < p).astype(float)
    net = qm.Network(x[:3000], y[:3000])
    s = net.scores(x[3000:])
    for lo in np.arange(0, 1, 0.2):
        here = (s >= lo) & (s < lo + 0.2)
        assert abs(s[here].mean() - y[3000:][here].mean()) < 0.08
    noisy = qm.Network(rng.normal(size=(300, 60)), (rng.random(300) < 0.5).astype(float))
    assert noisy.temperature > 1.5 and 0.125 <= net.temperature < 2


def test_training_rows_are_chosen_alike(spark):
    rows = qm.features(spark.createDataFrame([(i % 50, f"word w{i} " * (i % 7 + 1)) for i in range(400)], "doc_id long, text string"), np.zeros((qm.VOCAB, qm.DIM), np.float32))
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    one, two = (qm.train(r, labels, most=20) for r in (rows, rows.repartition(5)))
    x = np.ones((1, qm.FEATURES))
    assert one.scores(x) == pytest.approx(two.scores(x), abs=1e-12)


def test_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (1, None), (2, ""), (3, "x " * 30000), (4, "#$% 12")]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert qm.score(docs, labels).count() == len(rows)
    none = qm.score(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.5}
    assert qm.score(docs.limit(0), labels).count() == 0

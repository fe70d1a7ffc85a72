"""The chunk table against the library on whole texts."""

import hashlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from weftline.llm import sentencepiece_codec as codec  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "a ", "  a", "a▁b", "▁", "\x00a", "<s>x</s> <unk> <0x0A>", "a\n b\r\n\tc", "é\U0001f999  x", " " * 40 + "x" + " " * 33, "word" * 3000, "\n\n \n", "x  ▁ y", "　   z"]


def want(t):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = sp.encode(t or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_odd_texts_and_small_table(monkeypatch):
    assert codec.Codec(open(MODEL, "rb").read()).by_chunk
    monkeypatch.setattr(codec, "TABLE_CHUNKS", 3)
    c = codec.Codec(open(MODEL, "rb").read())
    for t in ODD:
        ids, text = next(iter(c.documents([t])))
        assert (len(ids.split(",")) if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) == want(t), t


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in codec.digest(docs, MODEL).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got == {k: want(t) for k, t in texts.items()}


def test_encode_keeps_columns(spark):
    df = spark.createDataFrame([(None, "a b", 1, "z"), (1, None, 2, "y"), (1, None, 2, "y")], "doc_id long, text string, ids int, lang string")
    rows = codec.encode(df, MODEL, decoded="back").collect()
    assert [r.back for r in rows] == ["a b", "", ""] and rows[1]._ids == [] and rows[0].ids == 1 and rows[0].lang == "z"
    assert codec.encode(df.drop("ids").withColumn("Back", df.lang), open(MODEL, "rb").read(), decoded="back").columns == ["doc_id", "text", "lang", "Back", "ids", "_back"]
    assert codec.digest(df.limit(0), MODEL).count() == 0

"""SentencePiece encoding and decoding through a table of distinct chunks.

In a vocabulary where the marker U+2581 only begins a piece (or fills one), no merge crosses from a character to a
marker after it.  A text, with its leading marker, then falls into chunks of markers and what follows them, and the
segmentation of the text is that of its chunks, one after another.  A task keeps a table of the distinct chunks it
has met: the library segments and decodes each of them once, and every document is put together by looking its
chunks up in order.  The table stays with the task, because a table of the whole corpus would have to be joined to
every word occurrence; it is emptied when it holds TABLE_CHUNKS chunks or TABLE_BYTES of text, which only costs
segmenting some chunks again.  `split_ok` checks the vocabulary; another kind is encoded document by document.

The model's bytes are read where the plan is made and sent to the tasks, so that executors need not have the file.

Defined results: a null text is empty and has no ids; a NUL or an unknown character is encoded by bytes; U+2581 in a
text is a space, as in the library; a very long text is one row, and its chunks are put together 256 rows at a time;
repeated rows are encoded alike, and ties cannot arise; an empty table gives an empty table; other columns are ignored by
`digest` and kept by `encode`, whose own columns get underscores before their names where the table has such.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bound_batches

MARK = "▁"
CHUNK = re.compile(" +[^ ]*")
TABLE_CHUNKS = 200_000
TABLE_BYTES = 16 << 20


class Codec:
    """One worker's library and table of chunks: marked chunk -> (ids as text, decoded text with its spaces)."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table: dict[str, tuple[str, str]] = {}
        self.bytes = 0
        self.alone = self.sp.piece_to_id(MARK)
        self.by_chunk = self.split_ok()

    def split_ok(self) -> bool:
        """Chunks are exact if no piece has a marker after another character, text is not rewritten, and a lone
        marker is a piece that the library would give too."""
        sp = self.sp
        inner = any(MARK in p.lstrip(MARK) for p in map(sp.id_to_piece, range(sp.get_piece_size())))
        same = sp.encode(" ") == [sp.piece_to_id(MARK * 2)] and sp.decode(sp.encode("  a  b ")) == "  a  b " and sp.encode("a ")[-1] == self.alone
        return same and not inner and self.alone != sp.unk_id()

    def _add(self, chunks: set[str]) -> None:
        if len(self.table) + len(chunks) > TABLE_CHUNKS or self.bytes > TABLE_BYTES:
            self.table.clear()
            self.bytes = 0
        new = [c for c in chunks if c not in self.table and c != " "]
        # the library puts the first marker of a chunk there itself
        ids = self.sp.encode([c[1:] for c in new], num_threads=1) if new else []
        texts = self.sp.decode(ids) if new else []
        self.table.update((c, (",".join(map(str, i)), " " + t)) for c, i, t in zip(new, ids, texts, strict=True))
        self.table[" "] = (str(self.alone), " ")
        self.bytes += sum(map(len, new)) * 4

    def release(self) -> None:
        """Give the table's memory back at the end of a task; an idle worker would hold it."""
        self.table.clear()
        self.bytes = 0
        pa.default_memory_pool().release_unused()

    def documents(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each text."""
        if not self.by_chunk:
            for t in texts:
                ids = self.sp.encode(t or "", num_threads=1)
                yield ",".join(map(str, ids)), self.sp.decode(ids)
            return
        for at in range(0, len(texts), 256):
            split = [CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts[at : at + 256]]
            table = self.table
            missing = {c for chunks in split for c in chunks if c not in table}
            if missing:
                self._add(missing.union(*split) if len(table) + len(missing) > TABLE_CHUNKS or self.bytes > TABLE_BYTES else missing)
            for chunks in split:
                found = [table[c] for c in chunks]
                yield ",".join([f[0] for f in found]), "".join([f[1] for f in found])[1:]


_codecs: dict[bytes, Codec] = {}


def _codec(model: bytes) -> Codec:
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def _sent(docs: DataFrame, model: str | bytes):
    """The model for all tasks, from its bytes or a file of the driver."""
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    return docs.sparkSession.sparkContext.broadcast(model)


def encode(docs: DataFrame, model: str | bytes, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of its texts as array<int>, and if named, the text decoded from them."""
    have = {c.lower() for c in docs.columns}
    while ids.lower() in have:
        ids = f"_{ids}"
    while decoded and decoded.lower() in have | {ids.lower()}:
        decoded = f"_{decoded}"
    bound_batches(docs.sparkSession)
    sent = _sent(docs, model)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kept = [f.name for f in docs.schema.fields]

    def run(batches):
        codec = _codec(sent.value)
        for b in batches:
            numbers, texts = [], []
            for i, d in codec.documents(b.column(b.schema.get_field_index(text)).to_pylist()):
                # parsed in C: a list of Python numbers would take ten times the memory
                numbers.append(np.fromstring(i, np.int32, sep=",") if i else np.zeros(0, np.int32))
                texts += [d] if decoded else []
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int32)
            flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
            columns = [b.column(b.schema.get_field_index(c)) for c in kept]
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            if decoded:
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, *([decoded] if decoded else [])])
        codec.release()

    return docs.mapInArrow(run, f"{out}, `{ids}` array<int>" + (f", `{decoded}` string" if decoded else ""))


def digest(docs: DataFrame, model: str | bytes, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, without building the arrays."""
    bound_batches(docs.sparkSession)
    sent = _sent(docs, model)

    def run(batches):
        codec = _codec(sent.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for b in batches:
            rows = [((i.count(",") + 1) if i else 0, sha(i), sha(d)) for i, d in codec.documents(b.column(1).to_pylist())]
            n, ids, texts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.release()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

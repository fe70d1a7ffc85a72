"""Substring dedup on words: seed and extend.

Documents are joined on winnowed anchors of SEED_WORDS words (repeats.py).  Blocks of one content repeat the earliest at
once.  The different contents of an anchor are extended both ways, word by word, from the anchor: after l words to the
left and r to the right, contents that still agree are in one class, told apart by the words themselves.  A window that
reaches l words before the anchor and the rest after it repeats an earlier one if its classes on both sides hold an
earlier content.  So a match is followed exactly to both of its ends, and neighbouring repeated windows join into maximal
repeats, all at least WIDTH words long, which is what is removed.  A window stays where it starts first (least doc_id,
then start).  Pairs are never formed.

Defined results: a null text has no words; a null doc_id comes after all others; rows with one doc_id and one text are
one document and do not remove each other; rows with one doc_id and different texts are ordered by a hash of the text;
a text shorter than WIDTH words keeps all; very long texts are one row each and take memory in proportion; an empty table
gives an empty table; `clean` keeps other columns, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm import repeats
from weftline.llm import textscan as ts
from weftline.llm.common import bound_batches

WIDTH = 20
SEED_WORDS = 5


def _classes(anchor: np.ndarray, word_at, steps: int) -> list[np.ndarray]:
    """For 0 to `steps` words: classes of the contents that agree on that many; -1 where there are fewer words."""
    out = [anchor]
    for step in range(steps):
        word = word_at(step)
        ok = (word >= 0) & (out[-1] >= 0)
        now = np.full(len(anchor), -1, np.int64)
        now[ok] = pd.factorize(out[-1][ok] * (int(word.max(initial=0)) + 1) + word[ok])[0]
        out.append(now)
    return out


def later_windows(key: np.ndarray, texts: list[bytes], off: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(content, window) of the windows in [lo, hi] that a content before it with its key holds too.  Contents are in the
    order of their places; windows are counted from the start of each."""
    words = [t.split(b" ") for t in texts]
    size = np.array([len(w) for w in words])
    begin = np.cumsum(size) - size
    ids = pd.factorize(np.array([w for ws in words for w in ws], object))[0].astype(np.int64)

    def word_at(place: np.ndarray) -> np.ndarray:
        ok = (place >= 0) & (place < size)
        return np.where(ok, ids[np.where(ok, begin + place, 0)], -1)

    anchor = pd.factorize(key)[0].astype(np.int64)
    most = int(off.max(initial=0))
    left = _classes(anchor, lambda step: word_at(off - 1 - step), most)
    right = _classes(anchor, lambda step: word_at(off + step), width)
    n = len(texts)
    which, window = [], []
    for before in range(most + 1):
        at = off - before
        rows = np.flatnonzero((at >= lo) & (at <= hi) & (before <= width))
        if not len(rows):
            continue
        both = left[before][rows] * (n + 1) + right[width - before][rows]
        again = pd.Series(both).duplicated().to_numpy()
        which.append(rows[again])
        window.append(at[rows[again]])
    return (np.concatenate(which), np.concatenate(window)) if which else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _solver(width: int):
    def solve(batches):
        for g in ts.whole_groups(batches, 2):
            k1, k2, doc, tie, s1, off, lo, hi = (g.column(c).to_numpy().astype(np.int64) for c in ("k1", "k2", "doc", "tie", "s1", "off", "lo", "hi"))
            # a place that comes twice is one content
            new = np.ones(len(k1), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in (k1, k2, doc, tie, s1)], axis=0)
            keep = np.flatnonzero(new)
            key = np.cumsum(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))[keep]
            texts = g.column("text").take(pa.array(keep)).to_pylist()
            # places are compared as documents, then starts: rows are sorted so inside a key
            which, window = later_windows(key, texts, off[keep], lo[keep], hi[keep], width)
            order = np.lexsort((window, which))
            which, window = which[order], window[order]
            run = np.ones(len(which), bool)
            run[1:] = (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1)
            at = np.flatnonzero(run)
            cnt = np.diff(np.append(at, len(which)))
            row = keep[which[at]]
            yield repeats.ranges_batch(k1[row], k2[row], doc[row], tie[row], s1[row] + window[at], cnt, window[at])

    return solve


def repeated_windows(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED_WORDS) -> DataFrame:
    """(doc, tie, s1, cnt): window starts that repeat an earlier window."""
    bound_batches(docs.sparkSession)
    return repeats.repeated_windows(docs, _solver(width), id_column, text, words=True, width=width, seed=seed, earliest=True)


def _with_ranges(docs: DataFrame, id_column: str, text: str, width: int, seed: int) -> DataFrame:
    ranges = repeats.by_document(repeated_windows(docs, id_column, text, width, seed))
    return repeats.keyed(docs, id_column, text).join(ranges, ["doc", "tie"], "left").select("doc", "text", "at")


def _kept(text: str, ranges, width: int) -> tuple[list[bytes], list[bytes], int]:
    words = text.encode().split()  # bytes split at exactly space and 9 to 13
    kept, end, removed = [], 0, 0
    for a, b in repeats.merged(ranges, width, len(words)):
        kept += words[end:a]
        end = b
        removed += b - a
    return words, kept + words[end:], removed


def digest(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def run(batches):
        for b in batches:
            rows = []
            for t, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words, kept, removed = _kept(t, at, width)
                rows.append((len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, sha = zip(*rows, strict=True) if rows else ((), (), ())
            ids = pa.array([None if d == repeats.NO_ID else d for d in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_ranges(docs, id_column, text, width, seed).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED_WORDS) -> DataFrame:
    """docs with repeated words removed; a text that loses words is its kept words, one space between."""
    both = repeats.with_ranges(docs, repeated_windows(docs, id_column, text, width, seed), id_column, text)
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            pairs = zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)
            texts = [b" ".join(_kept(x, r, width)[1]).decode() if r and x else x for x, r in pairs]
            out = b.set_column(at, text, pa.array(texts, pa.string()))
            yield out.select(range(b.num_columns - 1))

    return both.mapInArrow(run, docs.schema)

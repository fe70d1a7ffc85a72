"""Terms counted where their texts are read: (ids, text) rows in, (ids, term, n) rows out, without a shuffle of tokens.

A task takes its texts one at a time, so it holds the terms of one text and one batch of rows.  Rows that share an id are
added up afterwards, and only then: whether there are any is looked up first, in a job that reads the ids alone."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as tx

#: Rows that a task gives on at once, about.
ROWS = 100_000
_LINE_END = re.compile(tx.LINE_END)
_PLAIN_RUNS = re.compile(r"\w+|\W+").findall
#: Runs of whole texts, lone spaces left out, and what tells that a line begins or ends with space.
_WHOLE = re.compile(r"\w+|[^\w \r\n][^\w\r\n]*| [^\w\r\n]+")
_BLANK = " \t\x0b\f"
_EDGES = [pair for b in _BLANK for end in "\r\n" for pair in (b + end, end + b)]


class _Runs:
    """Runs of word characters and of others as tx.RUN has them.  Python's \\w also takes numbers that are no digits and leaves
    out marks, so texts that hold such characters get a pattern of their own."""

    def __init__(self):
        self.plain: set[str] = set()
        self.numbers: set[str] = set()
        self.marks: set[str] = set()
        self.odd = None

    def of(self, text: str) -> Callable[[str], list[str]]:
        if text.isascii():
            return _PLAIN_RUNS
        held = set(text)
        if held <= self.plain:
            return _PLAIN_RUNS
        odd = False
        for c in held - self.plain:
            kind = unicodedata.category(c)
            if kind == "Mn":
                fresh = c not in self.marks
                self.marks.add(c)
            elif kind in ("Nl", "No") or (c.isalnum() and kind[0] != "L" and kind != "Nd"):
                fresh = c not in self.numbers
                self.numbers.add(c)
            else:
                self.plain.add(c)
                continue
            odd = True
            if fresh:
                self.odd = None
        if not odd:
            return _PLAIN_RUNS
        if self.odd is None:
            numbers, marks = "".join(map(re.escape, sorted(self.numbers))), "".join(map(re.escape, sorted(self.marks)))
            word = rf"[^\W{numbers}]"
            more = rf"(?:{word}|[{marks}])*" if marks else f"{word}*"
            self.odd = re.compile(rf"{word}{more}|[\W{numbers}]+")
        return self.odd.findall


def boundary() -> Callable[[str | None], Counter]:
    """The boundary tokens of each line of a text, none empty.  A run of word characters has no space to lose, so runs of both
    kinds are cut alike: at both ends inside a line, at the inner one at its ends, not at all where a line is one run."""
    runs = _Runs()

    def count(text: str | None) -> Counter:
        if not text:
            return Counter()
        split = runs.of(text)
        if split is _PLAIN_RUNS and text[0] not in _BLANK and text[-1] not in _BLANK and not any(e in text for e in _EDGES):
            # all runs are cut at both ends
            found = Counter(_WHOLE.findall(text))
            ends = []
        else:
            inner, ends = [], []
            for line in _LINE_END.split(text):
                each = split(line)
                if len(each) > 1:
                    ends.append(each[0].rstrip(tx.SPACE))
                    ends.append(each[-1].lstrip(tx.SPACE))
                    inner += each[1:-1]
                else:
                    ends += each
            found = Counter(inner)
        for run in [r for r in found if r[0] in tx.SPACE or r[-1] in tx.SPACE]:
            n, bare = found.pop(run), run.strip(tx.SPACE)
            found[bare] = found.get(bare, 0) + n
        found.update(ends)
        found.pop("", None)
        return found

    return count


def space() -> Callable[[str | None], Counter]:
    """The tokens of tx.space_tokens, empty ones too."""

    def count(text: str | None) -> Counter:
        bare = (text or "").rstrip(" ")
        return Counter(bare.split(" ")) if bare or not text else Counter()

    return count


def asked() -> Callable[[str | None], Counter]:
    """As space(), but a text of spaces alone has one empty token, and a null one none."""

    def count(text: str | None) -> Counter:
        return Counter() if text is None else Counter(text.rstrip(" ").split(" "))

    return count


def parted() -> Callable[[str | None], Counter]:
    """The tokens of tx.boundary_tokens with keep_empty, for texts of letters, digits and spaces alone: words, an empty token
    between two and two before the first one that has space before it; a text of spaces is one token."""

    def count(text: str | None) -> Counter:
        if not text:
            return Counter()
        words = text.split()
        if not words:
            return Counter([text])
        found = Counter(words)
        if empty := len(words) - 1 + 2 * (text[0] == " "):
            found[""] = empty
        return found

    return count


_URL = re.compile(tx.URL, re.IGNORECASE | re.ASCII)
_HANDLES = {True: re.compile(tx.AT_ONLY, re.IGNORECASE | re.ASCII), False: re.compile(tx.HANDLE, re.IGNORECASE | re.ASCII)}
_NOT_PLAIN = re.compile(tx.NOT_PLAIN + "+")


def cleaned(at_only: bool = False, folded: bool = False, parts: Callable[[], Callable[[str | None], Counter]] = space) -> Callable[[], Callable[[str | None], Counter]]:
    """The tokens that `parts` counts in tx.clean_tweet, by default those of tx.space_tokens, in lower case if folded.  A URL
    has a colon and a mention an at sign, so other texts are not searched for them; a null text has one empty token, as there."""

    def tokens() -> Callable[[str | None], Counter]:
        counted, handle = parts(), _HANDLES[at_only]

        def count(text: str | None) -> Counter:
            if text:
                if ":" in text:
                    text = _URL.sub("", text)
                if "@" in text:
                    text = handle.sub("", text)
                text = _NOT_PLAIN.sub("", text)
            return counted(text.lower() if folded and text else text)

        return count

    return tokens


def rows(docs: DataFrame, tokens: Callable[[], Callable[[str | None], Counter]] = boundary, ids: tuple[str, ...] = ("doc_id",), text: str = "text", with_docs: bool = False) -> DataFrame:
    """(ids, term, n): each row's terms counted by themselves, whatever other rows have its ids, which are columns of simple
    types.  with_docs adds a row without term, n being 1, for each row."""
    taken = docs.select(*ids, F.make_valid_utf8(text).alias("text"))
    schema = T.StructType([T.StructField(c, taken.schema[c].dataType) for c in ids] + [T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokens()
        for batch in batches:
            at, of, terms, ns = 0, [], [], []

            def done() -> pa.RecordBatch:
                each = pa.array(np.repeat(np.arange(at, at + len(of)), of))
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(each) for c in ids), pa.array(terms, pa.string()), pa.array(ns, pa.int64())], [*ids, "term", "n"])

            for i, value in enumerate(batch.column("text")):
                found = count(value.as_py())
                terms += found.keys()
                ns += found.values()
                if with_docs:
                    terms.append(None)
                    ns.append(1)
                of.append(len(found) + with_docs)
                if len(terms) >= ROWS:
                    yield done()
                    at, of, terms, ns = i + 1, [], [], []
            if terms:
                yield done()

    return taken.mapInArrow(run, schema)


def counts(docs: DataFrame, tokens: Callable[[], Callable[[str | None], Counter]] = boundary, ids: tuple[str, ...] = ("doc_id",), text: str = "text", with_docs: bool = False) -> DataFrame:
    """rows() with one row for each term of the same ids."""
    found = rows(docs, tokens, ids, text, with_docs)
    if docs.groupBy(*ids).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return found
    return found.groupBy(*ids, "term").agg(F.sum("n").alias("n"))

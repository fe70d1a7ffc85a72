"""Secret scans: three fixed patterns, and values in a credential context that are dear to guess.

The guess cost of a value is found by dynamic programming over its characters: a cheapest chain of segments, each a ranked
word (plain, capitalised or in leet), a date, a repeat, a keyboard walk, an alphabetic or numeric sequence or a brute-force
span, counting log10 guesses; each further segment of a chain costs JOIN.  Walks, sequences and repeats are found as maximal
runs, and a segment is such a run or what is left of it after cutting one of its ends; no length is capped.  A repeat costs
what its unit costs, by the same programme, and the number of times.  Longer units than 8 characters are found by the last
place of every 8 characters.  The chain is exact for these segments; a value of n characters takes about n steps.

Words come ranked: WORDS, and after them the DICTIONARY_WORDS most frequent words of the corpus itself, counted over all its
texts (ties by the word), or a list given instead.  That list is bounded, so it is sent to all tasks.

A value is a secret if its cheapest chain needs at least MIN_LOG10 guesses.  Only what follows a credential name and `=` or
`:` is judged, so prose is left alone.

Spans are code points, end exclusive.  Kinds: assign, access, hex (the fixed patterns) and guess (the method's).
Defined results: a null text is empty; spans that tie in their start are ordered by kind; repeated rows are scanned alike;
a very long text or value is scanned whole; an empty table gives an empty table; other columns are ignored by `scan` and
kept by `redact`, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import bound_batches, stage, unstage

KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10 = 10.0
#: log10 guesses for each segment of a chain but the first.
JOIN = 0.5
DICTIONARY_WORDS = 20_000
#: Different words that a task counts before it gives its counts on.
COUNTED_AT_ONCE = 200_000

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?)["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*(?:(?:bearer|basic)\x20+)?["']?([^\s"'`<>,;()\[\]{}]+)""",
    re.I | re.A,
)
#: Every context name holds one of these; a text without them is not searched.
HINT = re.compile(r"pass|pwd|secret|token|key|credential|auth", re.I | re.A)
#: A word of the corpus that may be part of a password: letters alone between spaces, or before a mark.
PLAIN = re.compile(r"(?<![^\s\"'(])[a-z]{4,24}(?=[\s.,;:!?\"')]|$)")

# Common words and names in passwords, most common first.
WORDS = (
    "password pass admin login welcome master user root letmein secret test guest default changeme dragon monkey shadow sunshine princess football "
    "baseball iloveyou love hello summer winter spring autumn monday friday january april june july august money freedom whatever michael jordan "
    "charlie thomas robert daniel george jessica ashley hunter soccer hockey killer batman superman computer internet service server database system "
    "access token key api dev prod demo example sample temp value none null true false string your here company office home mother father "
    "correct horse battery staple"
).split()
LEET = str.maketrans("430157$@!", "aeoistsai")
# The rows of a keyboard, the first place of each (a row is half a key right of the one above it), and what
# shift makes of its signs.
ROWS = (("`1234567890-=", 0), ("qwertyuiop[]\\", 1), ("asdfghjkl;'", 1), ("zxcvbnm,./", 1))
SHIFT = str.maketrans("~!@#$%^&*()_+{}|:\"<>?", "`1234567890-=[]\\;',./")
DIRECTIONS = ((-1, 0), (0, -1), (1, -1), (1, 0), (0, 1), (-1, 1))
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)\d\d|(?:19|20)\d\d")


def _steps() -> dict[str, int]:
    """Two neighbouring keys -> the direction from the first to the second."""
    at = {(x + first, y): c for y, (row, first) in enumerate(ROWS) for x, c in enumerate(row)}
    return {c + at[x + dx, y + dy]: n for (x, y), c in at.items() for n, (dx, dy) in enumerate(DIRECTIONS) if (x + dx, y + dy) in at}


STEPS = _steps()


#: Characters of a repeated unit up to which a repeat may begin inside its run.
UNIT = 32


def ranks(words: Sequence[str]) -> dict[str, int]:
    """Ranks from 1 of words of three letters or more, the first place of each."""
    out: dict[str, int] = {}
    for w in words:
        if len(w) >= 3 and w not in out:
            out[w] = len(out) + 1
    return out


RANK = ranks(WORDS)


def _bits(c: str) -> float:
    """log10 of the class a brute-force character comes from."""
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isalpha() else math.log10(33)


def _runs(steps: list, n: int) -> Iterator[tuple[int, int]]:
    """Maximal [a, b) of three characters or more whose steps are all set; steps[i] leads from character i to i + 1."""
    a = 0
    for i in range(n):
        if i == n - 1 or steps[i] is None:
            if i - a >= 2:
                yield a, i + 1
            a = i + 1


def _words(value: str, low: str, rank: dict[str, int], longest: int) -> Iterator[tuple[int, int, float]]:
    plain = low.translate(LEET)
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            for text, extra in ((low, 0.0), (plain, 0.7)) if plain[i:j] != low[i:j] else ((low, 0.0),):
                r = rank.get(text[i:j])
                if r:
                    upper = any(c.isupper() for c in value[i:j])
                    yield i, j, math.log10(r + 1) + extra + (0.3 if upper else 0.0)


class Run:
    """[a, b) of which every part of `least` characters or more, of a multiple of `step`, is a segment; price(i, j) is its log10.

    The longer of two segments that end alike gains on the shorter as the end moves on, since prices grow as the logarithm of a
    length; so a start that an earlier one beats once is beaten for good, and few are left to compare."""

    def __init__(self, a: int, b: int, step: int, least: int, price):
        self.a, self.b, self.step, self.least, self.price = a, b, step, least, price
        self.starts: list[list[int]] = [[] for _ in range(step)]

    def cheapest(self, j: int, upto: list[float]) -> float:
        """The cheapest chain that ends at j with a part of this run; upto has the cheapest chains to places before."""
        starts = self.starts[j % self.step]
        if j - self.least >= self.a:
            starts.append(j - self.least)
        best, kept = math.inf, []
        for i in starts:
            cost = upto[i] + self.price(i, j)
            if cost < best:
                best = cost
                kept.append(i)
        self.starts[j % self.step] = kept
        return best


def _walks(low: str) -> Iterator[Run]:
    keys = low.translate(SHIFT)
    n = len(low)
    steps = [STEPS.get(keys[i : i + 2]) for i in range(n - 1)]
    turned = [0, 0]  # turns among the steps before each step
    for i in range(1, n - 1):
        turned.append(turned[-1] + (steps[i] != steps[i - 1]))
    price = lambda i, j: math.log10(47 * (j - i)) + 0.6 * (1 + turned[j - 1] - turned[i + 1])
    yield from (Run(a, b, 1, 3, price) for a, b in _runs(steps, n))


def _sequences(low: str) -> Iterator[Run]:
    n = len(low)
    for step in (1, -1):
        price = lambda i, j, back=0.3 if step < 0 else 0.0: math.log10(26 * (j - i)) + back
        yield from (Run(a, b, 1, 3, price) for a, b in _runs([True if ord(low[i + 1]) - ord(low[i]) == step else None for i in range(n - 1)], n))


def periods(value: str) -> Iterator[tuple[int, int, int]]:
    """(a, b, p): [a, b) repeats its first p characters, twice or more."""
    n = len(value)
    for p in range(1, min(8, n // 2) + 1):
        a = 0
        for i in range(n - p + 1):
            if i == n - p or value[i] != value[i + p]:
                if i - a >= p:
                    yield a, i + p, p
                a = i + 1
    seen: dict[str, int] = {}
    done: dict[int, int] = {}
    for i in range(n - 7):
        p = i - seen.get(value[i : i + 8], i)
        seen[value[i : i + 8]] = i
        if p > 8 and done.get(p, 0) <= i:
            a, b = i, i + 8
            while b < n and value[b] == value[b - p]:
                b += 1
            while a > p and value[a - 1] == value[a - 1 - p]:
                a -= 1
            done[p] = b
            if b - a >= p:
                yield a - p, b, p


def _repeats(value: str, rank: dict[str, int], longest: int) -> Iterator[Run]:
    """What repeats a unit of up to UNIT characters, wherever the unit begins; a longer unit begins where its run does."""
    for a, b, p in periods(value):
        costs: dict[int, float] = {}

        def price(i: int, j: int, a=a, p=p, costs=costs) -> float:
            at = (i - a) % p
            if at not in costs:
                costs[at] = guess_cost(value[i : i + p], rank, longest) if at == 0 or p <= UNIT else math.inf
            return costs[at] + math.log10((j - i) // p)

        yield Run(a, b, p, max(2 * p, 3), price)


def segments(value: str, rank: dict[str, int], longest: int) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 guesses) of the words and dates in value."""
    yield from _words(value, _low(value), rank, longest)
    for i, c in enumerate(value):
        if c.isdigit() and (m := DATE.match(value, i)):
            yield i, m.end(), 2.1 if m.end() - i == 4 else 4.6


def _low(value: str) -> str:
    return value.lower() if len(value.lower()) == len(value) else value


def guess_cost(value: str, rank: dict[str, int] = RANK, longest: int | None = None) -> float:
    """log10 of the guesses that the cheapest chain needs of words, dates, keyboard walks, sequences, repeats and brute force."""
    if not value:
        return 0.0
    n = len(value)
    longest = max(map(len, rank), default=0) if longest is None else longest
    found: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in segments(value, rank, longest):
        found.setdefault(j, []).append((i, cost))
    begin: dict[int, list[Run]] = {}
    for run in (*_walks(_low(value)), *_sequences(_low(value)), *_repeats(value, rank, longest)):
        if run.a + run.least <= run.b:
            begin.setdefault(run.a + run.least, []).append(run)
    # the cheapest chain up to each place, by whether it ends in a brute-force span; upto has the price of going on from there
    brute, other, upto, open_ = [math.inf], [0.0], [0.0], []
    for j in range(1, n + 1):
        join = JOIN if j > 1 else 0.0
        brute.append(min(brute[j - 1], other[j - 1] + join) + _bits(value[j - 1]))
        open_ = [run for run in open_ if run.b >= j] + begin.get(j, [])
        ends = [upto[i] + c for i, c in found.get(j, ())] + [run.cheapest(j, upto) for run in open_]
        other.append(min(ends, default=math.inf))
        upto.append(min(brute[j], other[j]) + JOIN)
    return min(brute[-1], other[-1])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    # leftmost maximal runs, so a bound on the length in the pattern finds what filtering all runs would
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def guess_spans(text: str, rank: dict[str, int] = RANK, least: float = MIN_LOG10) -> list[tuple[int, int, str]]:
    if not HINT.search(text):
        return []
    longest = max(map(len, rank), default=0)
    return [(m.start(1), m.end(1), "guess") for m in CONTEXT.finditer(text) if len(m[1]) >= 4 and guess_cost(m[1], rank, longest) >= least]


def all_spans(text: str | None, rank: dict[str, int] = RANK) -> tuple[list, list]:
    """The fixed patterns' spans, and with them the method's; each ordered by start, then kind as listed."""
    order = lambda spans: sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    base = base_spans(text) if text else []
    return order(base), order(base + guess_spans(text, rank)) if text else []


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def corpus_words(docs: DataFrame, text: str = "text", most: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of all texts, those that letters alone make up."""

    def counted(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        words: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    words.update(PLAIN.findall(t.lower()))
                if len(words) > COUNTED_AT_ONCE:
                    yield counted(words)
                    words = Counter()
        yield counted(words)

    each = docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stage(each)
    # a histogram of the counts by powers of two tells which words can be among the first, so that few are put in order
    size = F.floor(F.log2("n")).cast("int")
    some, least = 0, 0
    for r in sorted(counts.groupBy(size.alias("b")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.b):
        some, least = some + r.words, r.b
        if some >= most:
            break
    first = counts.where(F.col("n") >= 2**least).orderBy(F.desc("n"), "word").limit(most).collect()
    unstage(counts)
    return [r.word for r in first]


def _ranked(docs: DataFrame, text: str, words: Sequence[str] | None):
    """The ranks for all tasks; at most the given words, or WORDS and DICTIONARY_WORDS more."""
    bound_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(ranks(list(words) if words is not None else [*WORDS, *corpus_words(docs, text)]))


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: Sequence[str] | None = None) -> DataFrame:
    """One row a document: counts by kind, a digest of the fixed patterns' spans, and all spans.  words: the dictionary."""
    ranked = _ranked(docs, text, words)

    def run(batches):
        rank = ranked.value
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base, spans = all_spans(t, rank)
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str | None, rank: dict[str, int] = RANK) -> str | None:
    """text with every span, overlapping ones merged, replaced by [SECRET:kind] of the first."""
    _, spans = all_spans(text, rank)
    out, end = [], 0
    for a, b, kind in spans:
        if a >= end:
            out += [text[end:a], f"[SECRET:{kind}]"]
        end = max(end, b)
    return text if not spans else "".join([*out, text[end:]])


def redact(docs: DataFrame, text: str = "text", words: Sequence[str] | None = None) -> DataFrame:
    """docs, column for column, with secrets in its texts masked."""
    ranked = _ranked(docs, text, words)
    at = docs.columns.index(text)

    def run(batches):
        rank = ranked.value
        for b in batches:
            yield b.set_column(at, text, pa.array([mask(t, rank) for t in b.column(at).to_pylist()], pa.string()))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))

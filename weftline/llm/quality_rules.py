"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a predicate on measures of a text.  In one job over a sample the operator finds what each rule rejects and what
it costs: the characters and words that its measures pass over, counted, so that the same table always gives the same order
(the time of a job over so small a sample is noise).  Rules are then chained by rejection per cost: a text that an early
rule rejects never reaches the later ones.  Where some measures are computed anyway (`score_documents` returns five), a rule
costs what is left of it.
The order changes the work and never the verdict, which is that no rule rejects.  The sample has about SAMPLE_ROWS rows,
taken in one pass over the texts (a count, which reads no texts, gives its share).

Defined results: a null text is an empty text and fails `few_words`; repeated rows are judged alike, each on its own, and
so ties cannot arise; a very long text is measured whole, in memory in proportion; an empty table gives an empty table;
further columns pass through `filter_documents` untouched, whatever their names, and `score_documents` ignores them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import GAP, let, text_of

WINDOW = 5
SEED = 11
SAMPLE_ROWS = 1000
#: What a comparison costs, in characters read.
LEAST_COST = 1.0
#: Passes over the characters of a text that a measure takes, and for each word as many characters more.
PASSES = {"n_words": (1, 2), "word_chars": (1, 1), "n_symbols": (2, 0), "n_lines": (2, 0), "n_dup_lines": (3, 0), "n_repeat_words": (0, 60), "n_upper": (2, 0)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: object  # dict of measures -> Column
    base: bool = False


RULES = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 10, True),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 20, True),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: m["n_symbols"] * 2 > m["n_words"]),
    Rule("long_words", ("n_words", "word_chars"), lambda m: m["word_chars"] > m["n_words"] * 25),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda m: (m["n_lines"] >= 4) & (m["n_dup_lines"] * 2 > m["n_lines"])),
    Rule("shouting", ("word_chars", "n_upper"), lambda m: (m["word_chars"] >= 40) & (m["n_upper"] * 2 > m["word_chars"])),
)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))


def repeat_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in the array."""

    def windows(w: Column) -> Column:
        # the last few, cut short by the end of the text, are shorter than any other and so equal none
        return F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WINDOW))))

    def covered(ordered: Column) -> Column:
        # ordered: windows by (hash, start); one is repeated if a neighbour has its hash
        starts = F.transform(
            ordered,
            lambda x, i: F.when((x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]), x["at"]),
        )
        return F.aggregate(
            F.array_sort(F.filter(starts, lambda p: p.isNotNull())),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"].cast("long"),
        )

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), covered))

    return let(let(words, windows), count)


def measures(text: Column, words: Column) -> dict[str, Column]:
    """Every measure as an expression over one text and its words."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_lines": F.size(_lines(text)).cast("long"),
        "n_dup_lines": let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words),
        "n_upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
    }


def order_rules(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, have: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """The rules with (rejected share, characters that it passes over in a text) by rejection per cost; have: measures that
    cost nothing more."""
    rows = docs.count()
    if not rows:
        return [(r, 0.0, 0.0) for r in RULES]
    t = text_of()
    some = docs.select(F.col(text).alias("text")).sample(False, min(1.0, sample_rows / rows), SEED)
    m = measures(t, F.array_remove(F.split(t, GAP), ""))
    n, chars, words, *hits = some.agg(F.count("*"), F.sum(F.length(t)), F.sum(m["n_words"]), *(F.count_if(r.rejects(m)) for r in RULES)).first()
    # an empty sample of a small table tells nothing
    if not n:
        return [(r, 0.0, 0.0) for r in RULES]
    cost = lambda rule: LEAST_COST + sum(PASSES[k][0] * chars + PASSES[k][1] * words for k in rule.needs if k not in have) / n
    found = [(rule, hit / n, cost(rule)) for rule, hit in zip(RULES, hits, strict=True)]
    return sorted(found, key=lambda x: (-(x[1] + 1e-3) / x[2], x[0].name))


def cascade(ordered: list[Rule], m: dict[str, Column]) -> Column:
    """True for a text that no rule rejects; a rule runs only where all before it passed."""
    verdict = F.lit(True)
    for rule in reversed(ordered):
        verdict = F.when(rule.rejects(m), F.lit(False)).otherwise(verdict)
    return verdict


def score_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: the base measures, base_failed, and kept, the cascade's verdict."""
    ordered = [r for r, _, _ in order_rules(docs, text, have=MEASURES)]
    t = F.col("_text")
    split = docs.select(F.col(id_column).alias("doc_id"), text_of(text).alias("_text")).withColumn("_words", F.array_remove(F.split(t, GAP), ""))
    m = measures(t, F.col("_words"))
    measured = split.select("doc_id", "_text", *(m[k].alias(k) for k in MEASURES))
    late = measures(t, F.lit(None)) | {k: F.col(k) for k in MEASURES}
    base = [r.rejects(late) for r in RULES if r.base]
    return measured.select("doc_id", *MEASURES, (base[0] | base[1]).alias("base_failed"), cascade(ordered, late).alias("kept"))


def filter_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the cascade keeps, with all their columns."""
    ordered = [r for r, _, _ in order_rules(docs, text)]
    # the words are bound inside the filter: a projection of them would be pushed into every rule that reads them
    t = text_of(text)
    return docs.where(let(F.array_remove(F.split(t, GAP), ""), lambda w: cascade(ordered, measures(t, w))))

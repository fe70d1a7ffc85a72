"""Scalar text functions: tokenizers, cleaners, extractors.  All are built-in column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns whose matches the cleaners delete.
URL = r"((https?|ftp|gopher|telnet|file|Unsure|http):((//)|(\\))+[\w\d:#@%/;$~_\+-=\\\.&]*)"
HANDLE = r"((@)[\w\d:#@%/$~\+-=\\\&]*)"
AT_ONLY = r"((@)[\\w\\d:#@%/$~\\+-=\\\\\\&]*)"
NOT_PLAIN = r"[^a-zA-Z0-9 ]"
TITLE = r"<title>(.*?)</title>"
WIKI_LINK = r"\[\[.*?\]\]"
HREF = r'href="([^"]*)"'
LINE_END = r"\r\n|\r|\n"
RUN = r"[\p{L}\p{Nd}_][\p{L}\p{Nd}\p{Mn}_]*|[^\p{L}\p{Nd}_]+"
SPACE = " \t\n\x0b\f\r"
CSV_COMMA = r""",(?=([^"]*"[^"]*")*[^"]*$)"""


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, even where body uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text, as a line reader would give them."""
    return F.split(F.coalesce(text, F.lit("")), LINE_END)


def runs(line: Column) -> Column:
    """Runs of word characters and runs of others, by turns."""
    return F.regexp_extract_all(line, F.lit(RUN), F.lit(0))


def begins_with_word(line: Column) -> Column:
    return line.rlike(r"^[\p{L}\p{Nd}_]")


def bare_run(run: Column, i: Column, n: Column, word_first: Column) -> Column:
    """Run i of n without the space that touches a run of the other kind; only runs of others can have any."""
    inner = F.when(run == " ", F.lit("")).when((i > 0) & (i < n - 1), F.btrim(run, F.lit(SPACE))).when(i > 0, F.ltrim(run, F.lit(SPACE))).when(n > 1, F.rtrim(run, F.lit(SPACE))).otherwise(run)
    return F.when(((i % 2) == 0) == word_first, run).when(n == 1, run).otherwise(inner)


def boundary_tokens(line: Column, keep_empty: bool = False) -> Column:
    """Runs of word characters and runs of others, without the space that touches a run of the other kind.

    keep_empty keeps inner empty tokens and drops the trailing ones: a word after space has an empty token before it, and
    a line that begins with space has one more.  Linear in the line, whatever it holds."""
    found = runs(line)

    def bare(all_runs: Column) -> Column:
        n = F.size(all_runs)
        return F.transform(
            all_runs,
            lambda r, i: F.when((i > 0) & (i < n - 1), F.btrim(r, F.lit(SPACE))).when((i == 0) & (n > 1), F.rtrim(r, F.lit(SPACE))).when((i > 0) & (i == n - 1), F.ltrim(r, F.lit(SPACE))).otherwise(r),
        )

    if not keep_empty:
        return F.filter(_let(found, bare), lambda w: w != "")

    def parted(all_runs: Column) -> Column:
        none = F.array().cast("array<string>")
        after_space = lambda i: (i > 0) & F.get(all_runs, i - 1).rlike("[ \\t-\\r]$") & all_runs[i].rlike(r"^[\p{L}\p{Nd}_]")
        own = lambda w, i: F.when((w != "") | (i == 0), F.array(w)).otherwise(none)
        return F.flatten(F.transform(_let(all_runs, bare), lambda w, i: F.when(after_space(i), F.array(F.lit(""), w)).otherwise(own(w, i))))

    def ended(parts: Column) -> Column:
        last = F.aggregate(F.transform(parts, lambda w, i: F.when(w != "", i + 1).otherwise(0)), F.lit(0), lambda a, i: F.greatest(a, i))
        return F.slice(parts, F.lit(1), last)

    return _let(_let(found, parted), ended)


def space_tokens(text: Column) -> Column:
    """Split at single spaces: inner empty tokens stay, trailing ones go.  The text is named more than once here: a costly one
    should be a column by then."""
    bare = F.rtrim(text, F.lit(" "))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array(F.lit(""))).when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)" + URL, "")


def strip_handles(text: Column, at_only: bool = False) -> Column:
    return F.regexp_replace(text, "(?i)" + (AT_ONLY if at_only else HANDLE), "")


def clean_tweet(text: Column, at_only: bool = False) -> Column:
    """Without URLs, then without mentions (or only their at signs), then letters, digits and spaces alone."""
    return F.regexp_replace(strip_handles(strip_urls(text), at_only), NOT_PLAIN, "")


def title(page: Column) -> Column:
    """The first title of a page, null where there is none."""
    found = F.regexp_extract(page, TITLE, 1)
    return F.when(page.rlike(TITLE), found)


def all_titles(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(TITLE), F.lit(1))


def wiki_links(page: Column) -> Column:
    """Targets of [[...]], every bracket pair inside deleted; empty targets stay."""
    bare = lambda x: F.replace(F.replace(x, F.lit("[["), F.lit("")), F.lit("]]"), F.lit(""))
    return F.transform(F.regexp_extract_all(page, F.lit(WIKI_LINK), F.lit(0)), bare)


def href_links(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(HREF), F.lit(1))


ENTITY = r"^(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"


def unescape_html(text: Column) -> Column:
    """Every named entity of HTML 4 and every numeric one resolved in one pass; unknown ones stay."""
    names = F.create_map(*(F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))))

    def resolved(part: Column) -> Column:
        # part is what follows an ampersand
        found = F.regexp_extract(part, ENTITY, 0)
        name = F.substring(found, F.lit(1), F.length(found) - 1)
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("int")
        number = (digits < 0x110000) & ~digits.between(0xD800, 0xDFFF)
        char = F.when(name.startswith("#"), F.when(number, F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32"))).otherwise(F.try_element_at(names, name))
        plain = F.concat(F.lit("&"), part)
        return F.when(found == "", plain).otherwise(F.coalesce(F.concat(char, F.substring(part, F.length(found) + 1, F.length(part))), plain))

    parts = F.split(text, "&", -1)
    joined = F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, F.lit(2), F.size(parts)), resolved)), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def wiki_body(page: Column) -> Column:
    """What <text ...> holds, entities resolved, then tags removed; null where there is no <text>."""
    inner = F.regexp_replace(F.regexp_extract(page, r"<text(.*?)</text>", 1), "^[^>]*>", "")
    return F.when(page.rlike(r"<text(.*?)</text>"), F.regexp_replace(unescape_html(inner), "<.*?>", ""))


def split_csv(line: Column) -> Column:
    """Fields at commas outside quotes; quotes stay."""
    return F.split(line, CSV_COMMA)


def unquote(field: Column) -> Column:
    return F.replace(field, F.lit('"'), F.lit(""))

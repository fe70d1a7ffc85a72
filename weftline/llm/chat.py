"""Chat formatting by prefix-target expansion, in DataFrame expressions only.

Every assistant turn becomes one example: all turns before it are context, its own text is the only part under
the loss mask.  A conversation that does not end with an assistant turn gives one more example, all context and
nothing trainable, so that every turn can be read back from the output.

Template: `[INST]text[/INST]` (user), `[SYS]text[/SYS]` (system), `text</s>` (assistant), `[TURN role]text[/TURN]`
(any other role).  Inside texts and roles `%`, `<`, `[` and `]` are written `%25`, `%3C`, `%5B` and `%5D`, so no text
can hold a control string, and reading back undoes it.

Defined results: a null text or role is empty; a null conv_id is a conversation of its own; turns that tie are
ordered by role, then text, and repeated rows stay; an empty table gives an empty table; other columns are ignored.
A conversation is one row while it is formatted, and its examples grow with the square of its turns, which the
method asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"), ("]", "%5D"))
TURN = r"\[INST\][^\[<]*\[/INST\]|\[SYS\][^\[<]*\[/SYS\]|\[TURN [^\]\[<]*\][^\[<]*\[/TURN\]|[^\[<]*</s>"


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _render(role: Column, text: Column) -> Column:
    body = escape(text)
    return (
        F.when(role == "user", F.concat(F.lit("[INST]"), body, F.lit("[/INST]")))
        .when(role == "system", F.concat(F.lit("[SYS]"), body, F.lit("[/SYS]")))
        .when(role == "assistant", F.concat(body, F.lit("</s>")))
        .otherwise(F.concat(F.lit("[TURN "), escape(role), F.lit("]"), body, F.lit("[/TURN]")))
    )


def examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (from 1), formatted, loss_start, loss_end (code points, end exclusive)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.struct(F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    whole = (
        turns.select(F.col(conv_id).alias("conv_id"), said.alias("said"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("said")).alias("said"))
        .select("conv_id", F.transform("said", lambda t: F.struct((t["role"] == "assistant").alias("reply"), _render(t["role"], t["text"]).alias("out"))).alias("turns"))
    )
    # where the examples end: after each assistant turn, and after the last turn
    ends = F.filter(
        F.transform("turns", lambda t, i: F.when(t["reply"] | (i + 1 == F.size("turns")), F.struct((i + 1).alias("n"), t["reply"].alias("reply")))),
        lambda e: e.isNotNull(),
    )
    cut = whole.select("conv_id", F.transform("turns", lambda t: t["out"]).alias("outs"), F.posexplode(ends).alias("k", "end"))
    formatted = cut.select("conv_id", (F.col("k") + 1).alias("example"), "end", F.get("outs", F.col("end.n") - 1).alias("last"), F.array_join(F.slice("outs", F.lit(1), F.col("end.n")), "").alias("formatted"))
    size = F.length("formatted")
    return formatted.select(
        "conv_id",
        "example",
        "formatted",
        F.when(F.col("end.reply"), size - F.length("last")).otherwise(size).cast("long").alias("loss_start"),
        F.when(F.col("end.reply"), size - len("</s>")).otherwise(size).cast("long").alias("loss_end"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """From examples() alone, one row a conversation: its turns (role, text) and the unescaped text under the mask."""
    trained = F.struct("example", unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("text"))
    rows = formatted.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(trained)), lambda t: t["text"]), "").alias("loss_text"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )

    def parse(t: Column) -> Column:
        role = (
            F.when(t.startswith("[INST]"), F.lit("user")).when(t.startswith("[SYS]"), F.lit("system")).when(t.startswith("[TURN "), unescape(F.regexp_extract(t, r"^\[TURN ([^\]]*)\]", 1))).otherwise(F.lit("assistant"))
        )
        return F.struct(role.alias("role"), unescape(F.regexp_extract(t, r"^(?:\[INST\]|\[SYS\]|\[TURN [^\]]*\])?([^\[<]*)", 1)).alias("text"))

    turns = F.transform(F.regexp_extract_all("longest", F.lit(TURN), F.lit(0)), parse)
    return rows.select("conv_id", turns.alias("turns"), "loss_text", "formatted_chars")


def digest(formatted: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )

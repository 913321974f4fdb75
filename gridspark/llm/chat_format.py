"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``.  A parser that
knows nothing but the control strings reads it back; where the recovered turn
is not the source turn, its content is escaped (``<|`` becomes ``<\\|``, and so
on for more backslashes), after which it is identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import let, prefix_sums

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = r"<\|im_(?:start|end)\|>"
_TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    """Adds a backslash inside every ``<|``, ``<\\|``, ``<\\\\|``, ...: no control string is left, and none is made."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role also must not hold the line feed that ends it."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.array_join(F.transform(F.split(unescape(role), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def parsed(formatted: Column) -> Column:
    """struct(valid, turns, at): what the deterministic parser reads.

    Control strings split the whole; start and end must take turns, and a line
    feed alone stands after each end.  ``at`` gives, per turn, the span of its
    text in ``formatted`` (code points, end exclusive).
    """
    parts = F.struct(F.split(formatted, _CONTROL, -1).alias("piece"), F.regexp_extract_all(formatted, F.lit(_CONTROL), F.lit(0)).alias("control"))

    def read(p: Column) -> Column:
        piece, control = p["piece"], p["control"]
        count = F.floor(F.size(control) / 2).cast("int")
        turns = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        valid = (
            (F.size(control) % 2 == 0)
            & (piece[0] == "")
            & F.forall(turns, lambda i: (control[i * 2] == START) & (control[i * 2 + 1] == END) & (piece[i * 2 + 2] == "\n") & piece[i * 2 + 1].contains("\n"))
        )

        def turn(i: Column) -> Column:
            role = F.substring_index(piece[i * 2 + 1], "\n", 1)
            text = F.substring(piece[i * 2 + 1], F.length(role) + 2, F.length(piece[i * 2 + 1]))
            return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

        lengths = F.transform(piece, lambda x, i: F.length(x) + F.coalesce(F.length(F.get(control, i)), F.lit(0)))
        at = let(
            prefix_sums(lengths),
            lambda before: F.transform(
                turns,
                lambda i: F.struct(
                    (before[i * 2 + 1] + F.length(F.substring_index(piece[i * 2 + 1], "\n", 1)) + 1).alias("start"),
                    (before[i * 2 + 1] + F.length(piece[i * 2 + 1])).alias("end"),
                ),
            ),
        )
        return F.struct(valid.alias("valid"), F.when(valid, F.transform(turns, turn)).otherwise(F.array()).cast(_TURNS).alias("turns"), F.when(valid, at).otherwise(F.array()).cast("array<struct<start:int,end:int>>").alias("at"))

    return let(parts, read)


def chat_format(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: (conv_id, formatted, turns, loss_text, loss_spans, identical).

    Turns are ordered by turn (null first), then role and text, so that ties
    and repeated rows have a defined place; null roles and texts are empty.
    ``turns`` is read back from ``formatted``, and ``identical`` says that it
    equals the source.  ``loss_spans`` are the spans of the trained role's
    texts in ``formatted``, ``loss_text`` those texts unescaped and joined by
    nothing.  An empty table gives an empty result; further columns are ignored.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    plain = rows.withColumn("plain", rendered(F.col("role"), F.col("text")))
    read = parsed(F.col("plain"))
    same = read["turns"] == F.array(F.struct("role", "text")).cast(_TURNS)
    turns = plain.withColumn("shown", F.when(same, F.col("plain")).otherwise(rendered(escape_role(F.col("role")), escape(F.col("text")))))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "shown"))).alias("source"))
    whole = whole.withColumn("formatted", F.array_join(F.col("source.shown"), "")).withColumn("read", parsed(F.col("formatted")))
    trained = F.filter(F.arrays_zip(F.col("read.turns").alias("t"), F.col("read.at").alias("at")), lambda z: z["t"]["role"] == trained_role)
    return whole.select(
        "conv_id",
        "formatted",
        F.col("read.turns").alias("turns"),
        F.array_join(F.transform(trained, lambda z: z["t"]["text"]), "").alias("loss_text"),
        F.transform(trained, lambda z: z["at"]).alias("loss_spans"),
        (F.col("read.turns") == F.transform("source", lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text"))).cast(_TURNS)).alias("identical"),
    )

"""Chat formatting with typed content parts, in DataFrame expressions only.

A turn holds an array of parts; ``VISITORS`` has one visitor for each kind of part. A text part
becomes its text with control strings escaped; an image, audio or document part becomes an
ordered placeholder, an attachment reference and the number of tokens that the placeholder will
stand for. ``format_chats`` returns one row per conversation and ``read_back`` undoes it.

Defined results: a null text is empty; a null role is empty; an unknown kind of part is treated
as a document; null units count as one; turns with equal numbers go by role, then by content;
repeated rows stay repeated; an empty table gives an empty result; further columns of the input
are ignored. A null conv_id forms a conversation of its own. One conversation is one value, so
its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("units", T.LongType())])

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Tokens that one unit of an attachment stands for: an image's tiles, seconds of audio, pages of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}

# A control string is an opener and one of these tails. Text gets one more "~" between the two, so
# what was escaped already stays apart from what was not, and no control string is left.
_OPENER = r"(<|\[)"
_TAIL = r"(?=\||/?s>|/?INST\]|/?SYS>)"


def escape(text: Column) -> Column:
    """Text without control strings; ``unescape`` gives back exactly the text."""
    return F.regexp_replace(text, _OPENER + "(~*)" + _TAIL, "$1~$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _OPENER + "~(~*)" + _TAIL, "$1$2")


def _visit_text(part: Column) -> tuple[Column, Column]:
    return escape(F.coalesce(part["text"], F.lit(""))), F.lit(0).cast("long")


def _visit_attachment(kind: str):
    def visit(part: Column) -> tuple[Column, Column]:
        units = F.coalesce(part["units"], F.lit(1)).cast("long")
        return F.lit(f"<|{kind}|>"), units * F.lit(TOKENS_PER_UNIT[kind]).cast("long")

    return visit


VISITORS = {"text": _visit_text} | {kind: _visit_attachment(kind) for kind in TOKENS_PER_UNIT}


def _visit(part: Column) -> Column:
    """One part as struct(rendered, kind, ref, tokens); the visitor is chosen by its kind."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    kind = F.when(kind.isin(list(VISITORS)), kind).otherwise("document")
    shown, tokens = F.lit(""), F.lit(0).cast("long")
    for name, visitor in VISITORS.items():
        text, count = visitor(part)
        shown, tokens = F.when(kind == name, text).otherwise(shown), F.when(kind == name, count).otherwise(tokens)
    return F.struct(shown.alias("rendered"), kind.alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))


def text_parts(text: Column) -> Column:
    """A plain text as an array of one part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("units")))


def format_chats(turns: DataFrame) -> DataFrame:
    """``turns``: conv_id, turn, role, parts array<PART>. Returns one row per conversation:

    conv_id, formatted string, n_turns, attachments array<struct(ordinal, turn, kind, ref, tokens)>
    in the order of their placeholders, attachment_tokens, loss_spans array<struct(start, length)>
    in code points of ``formatted``: what the assistant says, without the marks.
    """
    role = escape(F.coalesce(F.col("role"), F.lit("")))
    visited = F.transform(F.coalesce(F.col("parts"), F.array().cast(T.ArrayType(PART))), _visit)
    rows = turns.select("conv_id", F.col("turn").alias("turn"), role.alias("role"), visited.alias("parts"))
    rows = rows.withColumn("body", F.array_join(F.transform("parts", lambda p: p["rendered"]), ""))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), "role", F.lit(BODY)))
    rows = rows.withColumn("attached", F.transform(F.filter("parts", lambda p: p["kind"] != "text"), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "head", "attached"))).alias("turns"))
    empty = F.array().cast("array<struct<start:int,length:int>>")
    # Where each turn begins, folded over the turns in order.
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    flat = F.flatten(F.transform("turns", lambda t: F.transform(t["attached"], lambda a: F.struct(t["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = chats.select("conv_id", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"), F.size("turns").cast("long").alias("n_turns"), flat.alias("flat"), spans.alias("loss_spans"))
    numbered = F.transform("flat", lambda a, i: F.struct(i.alias("ordinal"), a["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    total = F.aggregate("flat", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"])
    return out.select("conv_id", "formatted", "n_turns", numbered.alias("attachments"), total.alias("attachment_tokens"), "loss_spans")


def read_back(chats: DataFrame) -> DataFrame:
    """From the formatted text alone: conv_id, turns array<struct(role, text)>, loss_text.

    Placeholders stay as they are; escaped control strings come back as the text had them.
    """
    pieces = F.split("formatted", r"<\|end\|>")
    pieces = F.filter(pieces, lambda piece, i: i < F.size(pieces) - 1)
    cut = F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(TURN) + 1)), r"<\|body\|>", 2))
    turns = F.transform(cut, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))), "")
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))

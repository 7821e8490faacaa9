"""Operator 7: conversations as one training string each, in DataFrame expressions only.

A message is a list of typed parts. A visitor turns a text part into its escaped text and an image,
audio or document part into an ordered placeholder; the attachment's reference and the number of tokens
that the placeholder will expand to are recorded beside the string.

Template: <|turn|>role<|says|>content<|end|> for each message, by turn, role and text. In roles and texts
a backslash becomes two, and one is put after the first character of every control string (those of the
template and of other common chat formats), so that no text can open or close a turn; unescaped() takes
them out again. The loss mask covers the contents of the trained roles, as ranges of code points.

Rows: one per distinct conv_id, null included. Null texts and roles count as empty. Repeated rows are
messages of their own. Messages of equal turn are ordered by role, then parts; null turns come first.
A part of an unknown type, of a null type or null itself gives a file placeholder of no tokens, and a row
among the attachments like any other. Other columns of the input are left out. An empty table gives no rows.
Texts are taken whole: a conversation is one string, and must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PARTS = "array<struct<type:string,text:string,ref:string,amount:double>>"
#: Tokens for each pixel of an image (a token a patch of 28 x 28), second of audio and page of a document; a parameter of format_chat.
RATES = {"image": 1 / 784, "audio": 25.0, "document": 512.0}
_CONTROL = r"<(?=\||/?s>)|\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _content(parts: Column) -> Column:
    """The visitor: what each part becomes in the string."""
    kind = lambda p: F.when(p["type"].isin(*RATES), p["type"]).otherwise("file")
    one = lambda p: F.when(p["type"].eqNullSafe("text"), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), kind(p), F.lit("|>"))
    )
    return F.array_join(F.transform(parts, one), "")


def _tokens(part: Column, rates: dict[str, float]) -> Column:
    out = F.lit(0)
    for kind, rate in rates.items():
        out = F.when(part["type"] == kind, F.ceil(F.coalesce(part["amount"], F.lit(0.0)) * rate)).otherwise(out)
    return out.cast("long")


def format_chat(messages: DataFrame, trained: tuple[str, ...] = ("assistant",), rates: dict[str, float] = RATES) -> DataFrame:
    """conv_id, formatted, loss_spans (start, length), attachments (place, type, ref, tokens).

    messages: conv_id, turn, role, and parts (PARTS) or text, which is then the only part.
    """
    none = F.lit(None)
    text_part = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), none.cast("string").alias("ref"), none.cast("double").alias("amount")))
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS)) if "parts" in messages.columns else text_part.cast(PARTS)
    role = F.coalesce("role", F.lit(""))
    message = F.struct(F.col("turn"), role.alias("role"), parts.alias("parts"))
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("turns"))
    said = turns.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(TURN), escaped(t["role"]), F.lit(SAYS)).alias("head"), _content(t["parts"]).alias("content"), t["role"].isin(*trained).alias("loss")
            ),
        ).alias("said"),
        F.transform(
            F.filter(F.flatten(F.transform("turns", lambda t: t["parts"])), lambda p: ~p["type"].eqNullSafe("text")),
            lambda p, i: F.struct(i.alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p, rates).alias("tokens")),
        ).alias("attachments"),
    )
    # Lengths first, then each content's start: what stands before it.
    length = lambda x: F.length(x["head"]) + F.length(x["content"]) + len(END)
    spanned = F.aggregate(
        "said",
        F.struct(F.array().cast("array<struct<start:int,length:int>>").alias("spans"), F.lit(0).alias("at")),
        lambda a, x: F.struct(
            F.when(
                x["loss"],
                F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(x["head"])).alias("start"), F.length(x["content"]).alias("length")))),
            ).otherwise(a["spans"]).alias("spans"),
            (a["at"] + length(x)).alias("at"),
        ),
    )
    return said.select(
        "conv_id",
        F.array_join(F.transform("said", lambda x: F.concat(x["head"], x["content"], F.lit(END))), "").alias("formatted"),
        spanned["spans"].alias("loss_spans"),
        "attachments",
    )


def read_turns(formatted: Column) -> Column:
    """The messages of a formatted string: array of role and text, both unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)
    role = lambda p: F.substring_index(p, SAYS, 1)
    text = lambda p: F.substr(p, F.length(role(p)) + F.lit(len(SAYS) + 1), F.length(p) - F.length(role(p)) - F.lit(len(SAYS) + len(END)))
    return F.transform(pieces, lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(text(p)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"] + F.lit(1), s["length"]))), "")


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from format_chat's output."""
    read = chats.withColumns({"turns": read_turns(F.col("formatted")), "loss": read_loss(F.col("formatted"), F.col("loss_spans"))})
    line = F.lit("\n")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )

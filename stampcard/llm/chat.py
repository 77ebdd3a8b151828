"""Conversations of typed content parts as one training text each, and back.

A turn is a role and a list of parts: text, image, audio or document. A visitor renders each part in order: text is escaped, any
other part becomes a numbered placeholder; the part's reference and the tokens that it will expand to are recorded.
Texts without an attachment between them are one text.
The template wraps a turn as ``<|turn|>role<|body|>text<|end|>``. Inside roles and texts a backslash is doubled and every control string
gets a backslash after its first character, so no control string survives in a text and ``unescape`` restores it exactly.

Turns are ordered by number (nulls first), then role, then text. Null roles and texts are empty; a turn with neither text nor parts
has an empty body; repeated rows are repeated turns; rows with a null conversation form one conversation. A conversation is one
value of the output, so it must fit a row; its turns are gathered for nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Control strings of this template and of other common ones, escaped inside texts. The first character is what gets the backslash.
CONTROL = r"(<)(\|)|(<)(/?s>)|(\[)(/?INST\])|(<)(</?SYS>>)"
#: Tokens that attachments expand to: pixels a side of an image patch, audio tokens a second, tokens of a page.
PATCH, PER_SECOND, PER_PAGE = 14, 25, 256
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3$5$7\\$2$4$6$8")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"),
        null("double").alias("seconds"), null("int").alias("pages"),
    )).cast(PARTS)


def expanded_tokens(part: Column) -> Column:
    """Tokens of an attachment once expanded; missing measures count as none."""
    patches = F.ceil(part["width"] / F.lit(PATCH)) * F.ceil(part["height"] / F.lit(PATCH))
    size = F.when(part["type"] == "image", patches).when(part["type"] == "audio", F.ceil(part["seconds"] * F.lit(PER_SECOND))).when(part["type"] == "document", part["pages"] * F.lit(PER_PAGE))
    return F.coalesce(size, F.lit(0)).cast("long")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visit(parts: Column) -> tuple[Column, Column]:
    """Body and attachments (place in the turn, type, reference, tokens) of a list of parts."""
    media = F.filter(parts, lambda p: ~_is_text(p))
    places = F.filter(F.transform(parts, lambda p, k: F.when(_is_text(p), F.lit(None)).otherwise(k)), lambda k: k.isNotNull())

    def run(k: Column) -> Column:
        """The texts behind attachment k - 1 and before attachment k as one text: joined first, so that no control string arises from its halves."""
        start = F.when(k == 0, 0).otherwise(F.get(places, k - 1) + 1)
        size = F.coalesce(F.get(places, k), F.size(parts)) - start
        return escape(F.array_join(F.transform(F.slice(parts, start + 1, size), lambda p: F.coalesce(p["text"], F.lit(""))), ""))

    def mark(k: Column) -> Column:
        return F.coalesce(F.concat(F.lit("<|"), escape(F.get(media, k)["type"]), F.lit(":"), F.get(places, k).cast("string"), F.lit("|>")), F.lit(""))

    body = F.array_join(F.transform(F.sequence(F.lit(0), F.size(media)), lambda k: F.concat(run(k), mark(k))), "")
    attached = F.zip_with(media, places, lambda p, k: F.struct(k.alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    return body, attached


def format_chats(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    parts_col: str | None = None, loss_role: str = "assistant",
) -> DataFrame:
    """One row a conversation: ``conv_col, formatted, n_turns, loss`` (code point spans of the loss role's bodies), ``attachments``
    (turn number in order, place, type, reference, tokens) and ``media_tokens``. ``parts_col`` holds ``PARTS``, else texts are used."""
    parts = F.coalesce(F.col(parts_col).cast(PARTS), F.array().cast(PARTS)) if parts_col else text_part(F.col(text_col))
    body, attached = visit(F.col("parts"))
    turns = rows.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts"))
    turns = turns.select("c", "n", "role", body.alias("body"), attached.alias("attached"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    pieces = turns.select("c", "n", "role", "body", "attached", head.alias("head"), F.concat(head, F.col("body"), F.lit(END)).alias("piece"))
    order = Window.partitionBy("c").orderBy(F.col("n").asc_nulls_first(), "role", "body", F.to_json("attached"))
    placed = pieces.select("*", F.row_number().over(order).alias("k"), F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"))
    start = F.col("stop") - F.length("piece") + F.length("head")
    span = F.when(F.col("role") == loss_role, F.struct(start.alias("start"), (F.col("stop") - F.lit(len(END))).alias("end")))
    gathered = placed.select("c", "k", F.struct("k", "piece", span.alias("loss"), "attached").alias("t")).groupBy("c").agg(F.array_sort(F.collect_list("t")).alias("t"))
    listed = F.flatten(F.transform("t", lambda t: F.transform(t["attached"], lambda a: F.struct(
        t["k"].alias("turn"), a["place"].alias("place"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")
    ))))
    return gathered.select(
        F.col("c").alias(conv_col), F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"), F.size("t").cast("long").alias("n_turns"),
        F.filter(F.transform("t", lambda t: t["loss"]), lambda s: s.isNotNull()).alias("loss"), listed.alias("attachments"),
        F.aggregate(listed, F.lit(0).cast("long"), lambda sum_, a: sum_ + a["tokens"]).alias("media_tokens"),
    )


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: role and text (placeholders as they stand), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    cut = lambda p: F.split(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), r"<\|body\|>")
    return F.transform(pieces, lambda p: F.struct(unescape(F.get(cut(p), 0)).alias("role"), unescape(F.get(cut(p), 1)).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, span after span."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")

"""Chat formatting with typed content parts, with DataFrame functions only.

A message is a list of parts (text, image, audio, document). A visitor renders
each part by its type: text is escaped, every other part becomes an ordered
placeholder and leaves an attachment reference with its expanded token count.
A conversation is one string, with the spans of the loss mask beside it.

Escaping: a backslash is doubled and "<|" becomes "<\\|", and a "|" that begins a later
part becomes "\\|", since the part before may end with "<". So no control string can stand
inside the texts of a message, wherever its parts are cut, and unescaping, left to right,
gives the texts back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings (fixed values).
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
MARKS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH = 28  # image pixels along a patch's side
AUDIO_RATE = 12.5  # tokens for a second of sound
PAGE_TOKENS = 256  # tokens for a page of a document


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """One text part; a null text is an empty one."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]).cast(PART))


def expanded(part: Column) -> Column:
    """Tokens that a placeholder stands for; 0 for text and unknown types."""
    side = lambda n: F.ceil(F.coalesce(part[n], F.lit(0)) / PATCH)
    image, audio = side("width") * side("height"), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE)
    found = F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS)
    return F.coalesce(found, F.lit(0)).cast("long")


def visit(part: Column, number: Column) -> Column:
    """How a part is rendered (number: its place in the message, from 0); a part of an
    unknown type is rendered as its text."""
    text = escape(F.coalesce(part["text"], F.lit("")))
    out = F.when((number > 0) & text.startswith("|"), F.concat(F.lit("\\"), text)).otherwise(text)
    for kind, mark in MARKS.items():
        out = F.when(part["type"] == kind, F.lit(mark)).otherwise(out)
    return out


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv, n_turns, formatted, loss_spans (start, length in code points) and
    attachments (message, order, type, ref, tokens) of every conversation.

    Turns are ordered by turn, then role and parts, nulls first; repeated rows are
    turns each. A null role or text is empty, a text of any length is rendered whole, null or empty parts render as nothing,
    a null conversation id is a conversation. An empty table gives an empty result.
    Only the named columns are read."""
    role = F.coalesce(F.col(role_col), F.lit(""))
    parts = F.coalesce(F.col(parts_col).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), parts.alias("parts"))
    rows = rows.withColumn("body", F.array_join(F.transform("parts", visit), ""))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    rows = rows.withColumn("head", F.length(head)).withColumn("piece", F.concat(head, F.col("body"), F.lit(END)))
    order = Window.partitionBy("conv").orderBy("turn", "role", "body")
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = F.when(F.col("role").isin(*learn), F.struct((F.col("before") + F.col("head")).alias("start"), F.length("body").cast("long").alias("length")))
    others = F.filter("parts", lambda p: p["type"].isin(*MARKS))
    refs = F.transform(others, lambda p, i: F.struct(F.col("k").alias("message"), (i + 1).alias("order"), p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens")))
    rows = rows.select("conv", F.struct("k", "piece", span.alias("span"), refs.alias("refs")).alias("m"))
    out = rows.groupBy("conv").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return out.select(
        F.col("conv").alias(conv_col),
        F.size("ms").cast("long").alias("n_turns"),
        F.array_join(F.col("ms.piece"), "").alias("formatted"),
        F.filter(F.col("ms.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("ms.refs")).alias("attachments"),
    )


def parsed(text: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(text, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.regexp_replace(p, r"(?s)\A.*?<\|im_sep\|>", "")
        return F.struct(unescape(F.substring_index(p, SEP, 1)).alias("role"), unescape(F.substring_index(body, END, 1)).alias("text"))

    return F.transform(pieces, turn)


def under_mask(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")

"""Chat formatting with typed content parts.

A message is a row with a role and an array of parts; a part has a type (text, image, audio, document) and what
that type needs. Formatting a conversation visits its parts in order: text is escaped and written, every other
part becomes a numbered placeholder, its reference is recorded as an attachment, and its tokens after expansion
are counted. The result is one text, as segments that say whether they count for the loss.

Template (control strings begin with "<|"):

  <|start|>ROLE<|message|>PART<|part|>PART<|end|>

Inside roles, texts and references every backslash is doubled and "<|" becomes "<\\|", so no text can hold a control string, and
reading left to right gives the original back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MESSAGE, PART, END = "<|start|>", "<|message|>", "<|part|>", "<|end|>"
# Tokens that parts expand to: an image by tiles, a sound by time, a document by pages.
TILE_PIXELS, TILE_TOKENS, IMAGE_TOKENS, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 1, 2, 25, 600


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def text_part(text: Column) -> Column:
    """A message that is one text."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    )


def _kind(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text"))


def _tokens(part: Column) -> Column:
    """Tokens of an attachment after expansion; sizes that are not known count as nothing."""
    tiles = F.ceil(part["width"] / TILE_PIXELS) * F.ceil(part["height"] / TILE_PIXELS) * TILE_TOKENS + IMAGE_TOKENS
    count = F.when(_kind(part) == "image", tiles).when(_kind(part) == "audio", F.ceil(part["seconds"] * TOKENS_PER_SECOND)).when(_kind(part) == "document", part["pages"] * TOKENS_PER_PAGE)
    return F.coalesce(count, F.lit(0)).cast("long")


def _visited(part: Column, number: Column) -> Column:
    """What a part writes: its escaped text, or a placeholder with its kind, number and tokens."""
    mark = F.concat(F.lit("<|"), escaped(_kind(part)), F.lit(":"), number.cast("string"), F.lit(":"), _tokens(part).cast("string"), F.lit("|>"))
    return F.when(_kind(part) == "text", escaped(part["text"])).otherwise(mark)


def format_conversations(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id from rows (conv_id, turn, role, parts).

    conv_id, n_turns, formatted, segments (array of text, loss: joined they are `formatted`; only texts of
    `loss_role` have loss), attachments (array of kind, ref, tokens in placeholder order), attachment_tokens.

    Rows are ordered by turn, ties by role and content; repeated rows are repeated turns; a null turn comes
    first, a null conv_id is a conversation of its own. Null roles, texts and parts are empty. Types that are not
    known are attachments of no tokens. An empty table gives no rows. Everything of a conversation is
    one output row, so a conversation must fit into a task's memory.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(messages.schema["parts"].dataType))
    other = F.size(F.filter(parts, lambda p: _kind(p) != "text"))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"), other.alias("_other"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.to_json("parts"))
    rows = rows.withColumn("_before", F.sum("_other").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_n", F.row_number().over(order))
    before = F.coalesce(F.col("_before"), F.lit(0)).cast("int")
    # the number of a part's placeholder: attachments of earlier turns and earlier parts
    seen = lambda i: F.size(F.filter(F.slice(F.col("parts"), 1, i + 1), lambda p: _kind(p) != "text"))
    number = lambda i: F.when(F.col("_other") == 0, F.lit(0)).otherwise(before + seen(i))
    written = F.transform(F.col("parts"), lambda p, i: F.struct(_visited(p, number(i)).alias("text"), ((_kind(p) == "text") & (F.col("role") == loss_role)).alias("loss")))
    plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
    glued = F.flatten(F.transform(written, lambda s, i: F.when(i == 0, F.array(s)).otherwise(F.array(plain(F.lit(PART)), s))))
    head = plain(F.concat(F.lit(START), escaped(F.col("role")), F.lit(MESSAGE)))
    turn = F.concat(F.array(head), glued, F.array(plain(F.lit(END))))
    found = F.transform(F.filter("parts", lambda p: _kind(p) != "text"), lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    rows = rows.select("conv_id", F.struct(F.col("_n").alias("n"), turn.alias("segments"), found.alias("attachments")).alias("_turn"))
    grouped = rows.groupBy("conv_id").agg(F.collect_list("_turn").alias("_turns"))
    grouped = grouped.withColumn("_turns", F.array_sort("_turns", lambda a, b: a["n"] - b["n"]))
    out = grouped.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.flatten("_turns.segments").alias("segments"), F.flatten("_turns.attachments").alias("attachments"))
    return out.select(
        "conv_id", "n_turns", F.array_join("segments.text", "").alias("formatted"), "segments", "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read from a formatted text; the parts of a turn are joined with nothing between."""
    turns = F.filter(F.split(formatted, r"<\|end\|>"), lambda t: t != "")

    def one(turn: Column) -> Column:
        body = F.substring_index(turn, MESSAGE, -1)
        role = F.replace(F.substring_index(turn, MESSAGE, 1), F.lit(START), F.lit(""))
        return F.struct(unescaped(role).alias("role"), unescaped(F.replace(body, F.lit(PART), F.lit(""))).alias("text"))

    return F.transform(turns, one)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescaped(F.array_join(F.filter(segments, lambda s: s["loss"])["text"], ""))

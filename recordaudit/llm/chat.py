"""Chat formatting: typed content parts flattened into one escaped text per conversation, with its loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Parts of a message's content; fields that a type doesn't use are null.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Expanded tokens: per image tile of TILE pixels a side plus one base, per second of audio, per page of a document.
TILE, TILE_TOKENS, IMAGE_BASE, AUDIO_TOKENS, PAGE_TOKENS = 512, 170, 85, 25, 600


def escape(text: Column) -> Column:
    """Doubles backslashes and breaks ``<|``, so that no text can contain a control string; ``unescape`` undoes it."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _visit(part: Column, turn: Column, place: Column) -> Column:
    """A part as (text, attachment, tokens): text is escaped, anything else becomes a numbered placeholder."""
    kind = F.coalesce(part["type"], F.lit("text"))
    tiles = F.ceil(F.coalesce(part["width"], F.lit(TILE)) / TILE) * F.ceil(F.coalesce(part["height"], F.lit(TILE)) / TILE)
    tokens = (
        F.when(kind == "text", F.regexp_count(F.coalesce(part["text"], F.lit("")), F.lit(r"\w+|[^\w\s]")))
        .when(kind == "image", tiles * TILE_TOKENS + IMAGE_BASE)
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS))
        .when(kind == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(0).cast("long")
    )
    name = F.concat(F.lit("<|"), escape(kind), F.lit(" "), turn.cast("string"), F.lit("."), place.cast("string"), F.lit("|>"))
    return F.struct(
        F.when(kind == "text", escape(part["text"])).otherwise(name).alias("text"),
        F.when(kind != "text", F.struct(turn.cast("long").alias("turn"), place.alias("part"), kind.alias("type"), part["ref"].alias("ref"),
                                        tokens.alias("tokens"))).alias("attachment"),
        tokens.alias("tokens"))


def text_part(text: Column) -> Column:
    """Content of a message that is one text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
                            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def format_chats(messages: DataFrame, parts: Column | None = None, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask, attachments, tokens, n_turns.

    ``messages`` has a row per turn: conv_id, turn, role and either text or ``parts`` (an array of ``PART``). A turn
    becomes TURN role TEXT content END. ``loss_mask`` holds (start, end) in code points of ``formatted`` for the
    content of turns whose role is trained; ``attachments`` lists (turn, part, type, ref, tokens) in order;
    ``tokens`` counts words and signs of texts plus the expanded size of attachments.

    Turns come by number, then role and text (null numbers first), so repeated rows and ties have one order. A
    null role or text is empty, null is a conversation id of its own, no rows give no conversations. Texts of any
    length stay whole: offsets come from a running sum, so the work is linear in a conversation.
    """
    content = text_part(F.col("text")) if parts is None else F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    order = Window.partitionBy("conv_id").orderBy("turn", "c_role", "c_body")
    rows = (
        messages.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("c_role"), content.alias("c_parts"))
        .withColumn("c_seen", F.transform("c_parts", lambda p, i: _visit(p, F.coalesce("turn", F.lit(-1)), i)))
        .withColumn("c_body", F.array_join(F.transform("c_seen", lambda v: v["text"]), ""))
        .withColumn("c_head", F.concat(F.lit(TURN), escape(F.col("c_role")), F.lit(TEXT)))
        .withColumn("c_end", F.sum(F.length("c_head") + F.length("c_body") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("c_place", F.row_number().over(order))
    )
    stop = F.col("c_end") - len(END)
    turn = F.struct(
        F.col("c_place").alias("place"), F.concat("c_head", "c_body", F.lit(END)).alias("formatted"),
        F.when(F.col("c_role").isin(*trained), F.struct((stop - F.length("c_body")).alias("start"), stop.alias("end"))).alias("mask"),
        F.filter(F.transform("c_seen", lambda v: v["attachment"]), lambda a: a.isNotNull()).alias("attachments"),
        F.aggregate("c_seen", F.lit(0).cast("long"), lambda a, v: a + v["tokens"]).alias("tokens"))
    joined = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return joined.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["formatted"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["mask"]), lambda m: m.isNotNull()).alias("loss_mask"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("tokens"),
        F.size("turns").cast("long").alias("n_turns"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds ``turns``, an array of (role, text) parsed from ``formatted``, and ``loss_texts``, the texts under the mask."""
    one = F.split("formatted", r"<\|end\|>", -1)
    turn = lambda x: F.struct(
        unescape(F.substring(x, F.lit(len(TURN) + 1), F.instr(x, TEXT) - len(TURN) - 1)).alias("role"),
        unescape(F.substring(x, F.instr(x, TEXT) + len(TEXT), F.length(x))).alias("text"))
    return chats.withColumn("turns", F.transform(F.slice(one, 1, F.size(one) - 1), turn)).withColumn(
        "loss_texts", F.transform("loss_mask", lambda m: unescape(F.substring("formatted", m["start"].cast("int") + 1, (m["end"] - m["start"]).cast("int")))))

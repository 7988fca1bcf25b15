"""Chat formatting with Spark expressions only.

    ### Role: text</part>text</turn>

A run of adjacent turns of one role shares a header; ``</part>`` divides its texts, so the turns
can be read back one by one. In texts a backslash precedes every backslash, every ``#`` and every
``/`` after ``<``; no marker can therefore appear inside a text, and dropping the backslashes
gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MID, PART, END = "### ", ": ", "</part>", "</turn>\n"
#: The role whose texts a model is trained to give.
SPEAKER = "assistant"
#: Turns that are put together at once; a longer conversation is put together from such blocks.
BLOCK_TURNS = 64



def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|#|(?<=<)/)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"(\\|#|:|(?<=<)/)", r"\\$1")


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def format_conversations(turns: DataFrame, speaker: str = SPEAKER, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per conversation: conv_id, formatted, and segments, an array of
    (text, loss) whose texts joined are ``formatted``; ``loss`` marks the escaped texts of
    ``speaker``, one segment per text.

    Turns are put in order of (turn, role, text), repeated rows included; null turns come first,
    a null role or text counts as empty, and rows with a null conv_id are one conversation. Rows
    are first collected and sorted in blocks of ``block_turns`` turn numbers, so a very long
    conversation is formatted by many tasks and only joined by one.
    """
    rows = turns.select(
        "conv_id", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / block_turns).alias("_block"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_t"))
    # Null turns must precede negative ones too.
    rows = rows.withColumn("_block", F.when(F.col("_t.turn").isNull(), F.lit(-2**62)).otherwise(F.col("_block")))
    blocks = rows.groupBy("conv_id", "_block").agg(F.array_sort(F.collect_list("_t"), _turn_order).alias("_ts"))

    def piece(t: Column, i: Column) -> Column:
        """What leads to a text, unless it is the block's first, and the text."""
        lead = (F.when(i == 0, F.lit(""))
                .when(_at("_ts", i - 1)["role"] == t["role"], F.lit(PART))
                .otherwise(F.concat(F.lit(END + HEAD), _escape_role(t["role"]), F.lit(MID))))
        return F.struct(lead.alias("lead"), escape(t["text"]).alias("text"), (t["role"] == speaker).alias("loss"))

    blocks = blocks.select(
        "conv_id", F.struct("_block", F.get("_ts", F.lit(0))["role"].alias("first"), F.element_at("_ts", -1)["role"].alias("last"),
                            F.transform("_ts", piece).alias("pieces")).alias("_b"))
    convs = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list("_b"), lambda a, b: F.when(a["_block"] < b["_block"], -1).otherwise(1)).alias("_bs"))

    def open_block(b: Column, i: Column) -> Column:
        """Segments of a block, joined to the block before it as its roles say."""
        start = F.concat(F.lit(HEAD), _escape_role(b["first"]), F.lit(MID))
        lead = (F.when(i == 0, start).when(_at("_bs", i - 1)["last"] == b["first"], F.lit(PART))
                .otherwise(F.concat(F.lit(END), start)))
        segments = F.flatten(F.transform(b["pieces"], lambda p: F.array(
            F.struct(p["lead"].alias("text"), F.lit(False).alias("loss")), F.struct(p["text"].alias("text"), p["loss"].alias("loss")))))
        return F.concat(F.array(F.struct(lead.alias("text"), F.lit(False).alias("loss"))), segments)

    closing = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    segments = convs.select("conv_id", F.concat(F.flatten(F.transform("_bs", open_block)), closing).alias("segments"))
    return segments.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def _turn_order(a: Column, b: Column) -> Column:
    """Compare two turns by (turn, role, text), a null turn first."""
    low = F.lit(-2**63)
    ta, tb = F.coalesce(a["turn"], low), F.coalesce(b["turn"], low)
    return (F.when(ta < tb, -1).when(ta > tb, 1).when(a["role"] < b["role"], -1).when(a["role"] > b["role"], 1)
            .when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), one per original turn."""
    runs = F.slice(F.split(formatted, END), 1, F.greatest(F.size(F.split(formatted, END)) - 1, F.lit(0)))

    def turns(run: Column) -> Column:
        head = F.regexp_extract(run, r"(?s)^### ((?:[^:\\]|\\.)*): ", 0)
        role = unescape(F.substring(head, F.lit(len(HEAD) + 1), F.char_length(head) - len(HEAD) - len(MID)))
        body = F.substring(run, F.char_length(head) + 1, F.char_length(run))
        return F.transform(F.split(body, PART), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, turns))


def masked_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped: nothing stands between the texts."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))

"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role merge into a block by an array
aggregation; markers and texts are concatenated, with a loss mask over assistant texts as run lengths. Texts are escaped
so that markers can't occur in them, and the format can be read back exactly:

    <turn:user>text<part:user>text</turn><turn:assistant>text</turn>

Backslash is written as \\\\b and < as \\\\l inside texts and roles, > as \\\\g inside roles too.

Defined cases: null texts and roles are empty; turns with equal numbers go by role and text, null numbers first;
repeated rows are repeated turns; null conv_ids form one conversation; extra columns are ignored; an empty
table gives an empty result. A conversation is one output row, so it must fit a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


_BLOCKS = "array<struct<role:string,texts:array<string>>>"


def merged_turns(turns: Column) -> Column:
    """Blocks of role and texts: adjacent turns of one role as one."""
    start = F.struct(F.array().cast(_BLOCKS).alias("done"), F.lit(None).cast("string").alias("role"), F.array().cast("array<string>").alias("texts"))
    block = lambda acc: F.array(F.struct(acc["role"].alias("role"), acc["texts"].alias("texts")))
    closed = lambda acc: F.when(acc["role"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], block(acc)))

    def step(acc: Column, t: Column) -> Column:
        same = acc["role"].eqNullSafe(t["role"])
        return F.struct(F.when(same, acc["done"]).otherwise(closed(acc)).alias("done"), t["role"].alias("role"), F.when(same, F.concat(acc["texts"], F.array(t["text"]))).otherwise(F.array(t["text"])).alias("texts"))

    return F.aggregate(turns, start, step, closed)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_runs (array of structs of chars, bytes in UTF-8 and loss, which cover formatted in order)."""
    text, role = (escape(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("text", "role"))
    turns = rows.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def marked(block: Column, b: Column) -> Column:
        def piece(text: Column, i: Column) -> Column:
            opening = F.when(i > 0, F.lit("<part:")).when(b > 0, F.lit("</turn><turn:")).otherwise(F.lit("<turn:"))
            return F.struct(F.concat(opening, block["role"], F.lit(">")).alias("marker"), text.alias("text"), (block["role"] == ASSISTANT).alias("loss"))

        return F.transform(block["texts"], piece)

    pieces = turns.select("conv_id", F.flatten(F.transform(merged_turns(F.col("turns")), marked)).alias("pieces"))
    end = F.lit("</turn>")
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["marker"], p["text"])), ""), end)
    run = lambda c, loss: F.struct(F.length(c).cast("long").alias("chars"), F.octet_length(c).cast("long").alias("bytes"), loss.alias("loss"))
    runs = F.flatten(F.transform("pieces", lambda p: F.array(run(p["marker"], F.lit(False)), run(p["text"], p["loss"]))))
    return pieces.select("conv_id", formatted.alias("formatted"), F.concat(runs, F.array(run(end, F.lit(False)))).alias("loss_runs"))


def text_under_loss(formatted: Column, runs: Column) -> Column:
    """What the loss mask covers, cut from the formatted text by the runs and unescaped."""
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def cut_out(raw: Column) -> Column:
        def step(acc: Column, run: Column) -> Column:
            part = unescape(F.decode(F.substr(raw, acc["at"].cast("int"), run["bytes"].cast("int")), "UTF-8"))
            return F.struct((acc["at"] + run["bytes"]).alias("at"), F.when(run["loss"], F.concat(acc["out"], F.array(part))).otherwise(acc["out"]).alias("out"))

        return F.array_join(F.aggregate(runs, start, step, lambda acc: acc["out"]), "")

    return F.element_at(F.transform(F.array(F.encode(formatted, "UTF-8")), cut_out), 1)  # encoded once a row


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns, read from the formatted text alone: an array of structs of role and text, as they were put in."""
    segments = F.filter(F.split(F.col("formatted"), "<"), lambda s, i: (i > 0) & ~s.startswith("/turn>"))

    def turn(s: Column) -> Column:
        head = F.substring_index(s, ">", 1)
        return F.struct(unescape(F.regexp_replace(head, "^(turn|part):", "")).alias("role"), unescape(F.substr(s, F.length(head) + 2)).alias("text"))

    return formatted.withColumn("turns", F.transform(segments, turn))

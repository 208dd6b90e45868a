"""Chat formatting with Spark expressions only: a window over each conversation gives every turn its place in the string, turns are
collected as structs, sorted, cut into runs of one role by array functions, and joined to one string with the character spans
of the assistant's texts (the loss mask). The work grows with the number of turns, not with its square.

Template: `<|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT...]<|im_end|>\\n` for each run of turns of one role. Inside roles and texts
`<`, any number of backslashes, `|` gets one more backslash before the bar, so no marker can be forged and the original
comes back by taking it away again; a line break inside a role becomes `<|nl|>`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, SEP, BREAK = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "<|nl|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans (start and end in characters of each text of the role `learn`).

    Turns go by number; equal numbers by role, then text; a null number first. Null roles and texts are empty, a null
    conv_id is a conversation of its own. An empty table gives an empty result; other columns are ignored. A conversation is
    one row of the result and so has to fit into a task, whatever share of the turns it holds."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), plain(role).alias("raw_role"), plain(text).alias("raw_text"))
    one = one.withColumn("role", F.replace(escaped(F.col("raw_role")), F.lit("\n"), F.lit(BREAK))).withColumn("text", escaped(F.col("raw_text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "raw_role", "raw_text")
    before = F.lag("role").over(order)
    opens = before.isNull() | (before != F.col("role"))
    # what stands in front of a turn's text: the end of the run before and the head of a new one, or a separator
    front = F.when(opens, F.when(before.isNull(), 0).otherwise(len(END)) + len(START) + F.length("role") + 1).otherwise(len(SEP))
    one = one.withColumn("nr", F.row_number().over(order)).withColumn("opens", opens).withColumn("front", front)
    end = F.sum(F.col("front") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    got = one.select("conv_id", F.struct("nr", "role", "text", "opens", end.cast("int").alias("end")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    # runs of one role: from each turn that opens one to the next
    starts = F.transform(F.filter("turns", lambda t: t["opens"]), lambda t: t["nr"])
    got = got.withColumn("starts", starts).withColumn("stops", F.concat(F.slice("starts", 2, F.size("turns")), F.array(F.size("turns") + 1)))
    run = lambda a, b: F.slice("turns", a, b - a)
    block = lambda a, b: F.concat(F.lit(START), F.get("turns", a - 1)["role"], F.lit("\n"), F.array_join(F.transform(run(a, b), lambda t: t["text"]), SEP), F.lit(END))
    formatted = F.array_join(F.zip_with("starts", "stops", block), "")
    learnt = F.filter("turns", lambda t: t["role"] == learn)
    spans = F.transform(learnt, lambda t: F.struct((t["end"] - F.length(t["text"])).alias("start"), t["end"].alias("end")))
    return got.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text), as they were before formatting."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescaped(F.replace(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1), F.lit(BREAK), F.lit("\n")))
        body = F.substr(b, F.locate("\n", b) + 1)
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")

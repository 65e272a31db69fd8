"""Chat formatting by prefix-target expansion, with DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it are context, and its text
alone is trainable. A conversation that does not end with an assistant turn has one more example,
without a trainable part, so that all turns can be read back from the output.

Template: <|im_start|>ROLE, line feed, TEXT, <|im_end|>, line feed. In texts and roles & is
written &amp; and <| is written &lt;| (in roles a line feed is &#10;), so no text can hold a
control string, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def chat_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: conv_id, example (number of its last turn from 0), text, loss_start,
    loss_length (code points in text; the mask is empty where the length is 0), trainable.

    Turns are ordered by turn, then role, then text (nulls first). Null roles and texts count as
    empty; repeated rows are turns of their own; a null conv_id is a conversation; an empty table
    gives an empty result; other columns are ignored. A conversation's turns are one row, since
    each example holds all turns before it.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = turns.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    whole = whole.select("conv_id", "turns", F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))).alias("parts"))
    targets = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (F.element_at("turns", i + 1)["role"] == LOSS_ROLE) | (i == F.size("turns") - 1))
    rows = whole.select("conv_id", "turns", "parts", F.explode(targets).alias("example"))
    last = F.element_at("turns", F.col("example") + 1)
    trainable = last["role"] == LOSS_ROLE
    before = F.length(F.array_join(F.slice("parts", F.lit(1), F.col("example")), ""))
    return rows.select("conv_id", "example", F.array_join(F.slice("parts", F.lit(1), F.col("example") + 1), "").alias("text"), (before + F.length(head(last))).cast("long").alias("loss_start"), F.when(trainable, F.length(escape(last["text"]))).otherwise(0).cast("long").alias("loss_length"), trainable.alias("trainable"))


def parsed_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")
    bare = F.transform(parts, lambda p: F.substr(p, F.lit(len(START) + 1)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        return F.struct(unescape(F.replace(role, F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(F.substr(p, F.length(role) + 2)).alias("text"))

    return F.transform(bare, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_examples. Turns come from the longest example, trained text
    from each example's mask."""
    masked = unescape(F.substr("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))
    per = examples.groupBy("conv_id").agg(F.max_by("text", "example").alias("longest"), F.sort_array(F.collect_list(F.when(F.col("trainable"), F.struct("example", masked.alias("loss"))))).alias("losses"), F.sum(F.length("text")).cast("long").alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"))
    per = per.select("conv_id", "formatted_chars", "n_examples", parsed_turns(F.col("longest")).alias("turns"), F.array_join(F.col("losses.loss"), "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")

"""Chat formatting, in DataFrame expressions only.

Template, per block of adjacent turns of one role::

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT ...]<|im_end|>\\n

Adjacent turns of one role share a block; <|im_sep|> marks where one of them
ends, so that the turns can be read back. Inside texts and roles every
backslash is doubled and every ``<|`` is written ``<\\|``; in roles a line break
is written ``<\\n>``. No control string can then stand inside a text, and the
reverse replacements give every text back.

Edge cases: a null role or text is the empty string; a null conversation id is
a conversation of its own; turns are ordered by (turn, role, text) as they are
before escaping, null turns first, and repeated rows are repeated turns; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    loss_spans holds (start, length) in code points of `formatted`, one for
    each text of `loss_role`, in order; marks and separators lie outside. One
    shuffle gathers a conversation, the unit of the output; blocks are cut at
    role changes by index arithmetic. The list of spans is grown turn by turn, so a
    conversation of n loss turns copies some n * n / 2 pairs of numbers.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    role = F.transform("turns", lambda t: escape_role(t["role"]))
    text = F.transform("turns", lambda t: escape(t["text"]))
    chats = chats.select("conv_id", role.alias("roles"), text.alias("texts"), F.size("turns").alias("n"))
    at = F.sequence(F.lit(1), F.col("n"))
    begins = F.filter(at, lambda i: (i == 1) | (F.get("roles", i - 1) != F.get("roles", i - 2)))
    chats = chats.withColumn("begins", begins)
    blocks = F.transform(
        "begins",
        lambda b, k: F.struct(
            F.get("roles", b - 1).alias("role"),
            F.slice("texts", b, F.coalesce(F.get("begins", k + 1), F.col("n") + 1) - b).alias("texts"),
        ),
    )
    chats = chats.withColumn("blocks", blocks)
    body = F.transform("blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END + "\n")))
    # each text's own length and what stands before it since the last text
    lead = len(START) + 1
    first = F.transform("roles", lambda r, i: (i == 0) | (r != F.coalesce(F.get("roles", i - 1), F.lit(""))))
    chats = chats.withColumn("first", first)
    gaps = F.transform(
        "texts",
        lambda t, i: F.struct(
            (F.when(F.get("first", i), F.lit(lead) + F.char_length(F.get("roles", i)) + F.when(i == 0, 0).otherwise(len(END) + 1)).otherwise(len(SEP))).cast("long").alias("gap"),
            F.char_length(t).cast("long").alias("size"),
            (F.get("roles", i) == escape_role(F.lit(loss_role))).alias("loss"),
        ),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, g: Column) -> Column:
        start = acc["at"] + g["gap"]
        grown = F.when(g["loss"], F.array_append(acc["spans"], F.struct(start.alias("start"), g["size"].alias("length")))).otherwise(acc["spans"])
        return F.struct((start + g["size"]).alias("at"), grown.alias("spans"))

    return chats.select("conv_id", F.array_join(body, "").alias("formatted"), F.aggregate(gaps, zero, step)["spans"].alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Reads conversations back from `formatted` and `loss_spans`: conv_id, turns (role, text), loss_text (the unescaped text under the mask)."""
    blocks = F.slice(F.split("formatted", "<\\|im_start\\|>"), 2, F.greatest(F.size(F.split("formatted", "<\\|im_start\\|>")) - 1, F.lit(0)))

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        inner = F.substring(block, F.char_length(role) + 2, F.char_length(block) - F.char_length(role) - len(END) - 2)
        return F.transform(F.split(inner, "<\\|im_sep\\|>"), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    masked = F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"), unescape(F.array_join(masked, "")).alias("loss_text"))

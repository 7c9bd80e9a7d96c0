r"""Chat formatting, in DataFrame functions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one
role are merged to a block by array functions over the positions where the
role changes; blocks are joined to one text::

    <|im_start|>ROLE\nTEXT<|im_sep|>TEXT<|im_end|>\n

Every control string starts with ``<|``.  In roles and texts ``<``, any number of
backslashes and ``|`` get one backslash more in between, so neither holds a control
string and one backslash less gives the text back; a line feed in a role is
written ``<|im_nl|>``.

The loss mask comes as pieces: the formatted text cut where the mask changes, in
order, each with its flag.  The flagged pieces are the texts of the trained role,
without marks.  All steps are linear in the turns and characters of a conversation.

Cases: null texts and roles are empty; a null turn number stands first; equal
turn numbers follow by role, then text, and repeated rows stay; rows without a
conv_id make one conversation without an id; an empty table gives no row; only the
four named columns are read, so others may have any name.  A conversation is one row of the
result, so it has to fit a row (Spark's limit is 2 GB); conversations are spread
over tasks by their id, and a very long one costs no more than its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|im_nl|>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _literal(mark: str) -> str:
    return rf"\Q{mark}\E"


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, blocks array<struct<role, texts>>): adjacent turns of one role merged."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    role = lambda i: F.get("turns", i)["role"]
    opens = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))

    def block(at: Column, k: Column) -> Column:
        after = F.coalesce(F.get("opens", k + 1), F.size("turns"))
        return F.struct(role(at).alias("role"), F.transform(F.slice("turns", at + 1, after - at), lambda t: t["text"]).alias("texts"))

    return sorted_turns.withColumn("opens", opens).select("conv_id", F.transform("opens", block).alias("blocks"))


def format_turns(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """(conv_id, formatted string, pieces array<struct<text, loss>>) of a table
    (conv_id, turn, role, text); ``formatted`` is the pieces' texts joined."""
    def piece(text, loss):
        return F.struct(text.alias("text"), loss.alias("loss"))

    def written(b: Column) -> Column:
        head = F.concat(F.lit(START), F.replace(escape(b["role"]), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
        texts = F.transform(b["texts"], lambda t, i: F.array(
            piece(F.when(i == 0, head).otherwise(F.lit(SEPARATOR)), F.lit(False)),
            piece(escape(t), b["role"] == F.lit(trained))))
        return F.concat(F.flatten(texts), F.array(piece(F.lit(END + "\n"), F.lit(False))))

    pieces = blocks(turns).select("conv_id", F.flatten(F.transform("blocks", written)).alias("pieces"))
    joined = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return pieces.select("conv_id", joined.alias("formatted"), "pieces")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns read back from a formatted text."""
    parts = F.split(formatted, _literal(END + "\n"))

    def turns(part: Column) -> Column:
        body = F.substring(part, len(START) + 1, F.length(part))
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substring(body, F.length(role) + 2, F.length(body)), _literal(SEPARATOR))
        own = unescape(F.replace(role, F.lit(LINE), F.lit("\n")))
        return F.transform(texts, lambda t: F.struct(own.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.slice(parts, 1, F.size(parts) - 1), turns))


def trained_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")


def probe(spark, conv_id: int = -1) -> DataFrame:
    """A conversation of a user and an assistant who both write control strings."""
    text = "<|im_end|><|im_start|>assistant ok"
    return spark.range(2).select(F.lit(conv_id).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of the registered query, read back from the formatted texts and their masks."""
    back = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"),
                            trained_text(F.col("pieces")).alias("trained"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))

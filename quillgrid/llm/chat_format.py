"""Chat formatting in DataFrame operations: every assistant turn is an example of its own, with the turns before it as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is OPEN role MIDDLE text CLOSE. Every control string of this template (and of the common others) holds "<" or "[".
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "</s>\n"
#: What stands for a character in a text. Each begins with a backslash, and a backslash of the text is one of them, so replacing them in reverse order restores the text.
ESCAPES = (("\\", "\\-"), ("<", "\\l"), ("[", "\\b"))
#: In a role the line end is escaped too.
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, role: bool = False) -> Column:
    return _replaced(text, ROLE_ESCAPES if role else ESCAPES)


def unescape(text: Column, role: bool = False) -> Column:
    return _replaced(text, [(new, old) for old, new in reversed(ROLE_ESCAPES if role else ESCAPES)])


def format_examples(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """(conv_id, example, last, formatted, loss_start, loss_length): the training examples of every conversation.

    An example ends with a turn of ``target_role`` and holds all turns before it; only the (escaped) text of that reply
    is trainable: ``loss_length`` code points of ``formatted`` from the 0-based ``loss_start``. Turns after the last reply make one
    more example that has nothing to train (length 0), so that no turn is lost; ``last`` marks the example with all turns.

    Turns are ordered by turn number, then role, then text; a null number comes first, a null role or text is empty.
    Rows with a null conversation are one conversation. No rows give no examples. Other columns are ignored.
    A conversation is the unit of work, as each of its examples holds its turns; the method's output grows with the square of a conversation's length.
    """
    rows = conversations.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    safe = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"], role=True), F.lit(MIDDLE)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == target_role).alias("target")))
    parts = whole.select("conv", safe.alias("parts"))
    ends = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.get(F.col("parts"), i - 1)["target"] | (i == F.size("parts")))
    each = parts.select("conv", "parts", F.posexplode(ends).alias("example", "upto"))
    own = F.get(F.col("parts"), F.col("upto") - 1)
    before = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("upto") - 1), lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    made = each.select("conv", "example", (F.col("upto") == F.size("parts")).alias("last"), F.concat(before, own["head"]).alias("context"), own["body"].alias("body"), own["target"].alias("target"))
    return made.select(
        F.col("conv").alias(conv_col),
        F.col("example").cast("long").alias("example"),
        "last",
        F.concat("context", "body", F.lit(CLOSE)).alias("formatted"),
        F.char_length("context").cast("long").alias("loss_start"),
        F.when(F.col("target"), F.char_length("body")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """Formatted text -> its turns as an array of (role, text)."""
    pieces = F.split(formatted, CLOSE)  # what follows the last CLOSE is empty
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        turns,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MIDDLE, 1), role=True).alias("role"),
            unescape(F.substr(p, F.instr(p, MIDDLE) + len(MIDDLE))).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example, as it was in the conversation."""
    return unescape(F.substr(formatted, (start + 1).cast("int"), length.cast("int")))


def digest(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation what its examples hold: turns, trained text and size, all read back from the formatted text."""
    turns = F.when(F.col("last"), read_turns(F.col("formatted")))
    read = examples.select(conv_col, "example", F.char_length("formatted").alias("chars"), turns.alias("turns"), read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    slim = read.select(conv_col, "example", "chars", "loss", F.size("turns").alias("n"), F.when(F.col("turns").isNotNull(), F.sha2(shown, 256)).alias("sha"))
    per = slim.groupBy(conv_col).agg(F.max("n").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"))
    text = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return per.select(conv_col, "n_turns", "turns_sha256", F.char_length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars")

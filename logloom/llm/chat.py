"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, merged while the role stays the same, and
concatenated under a template. Texts and roles may hold any characters: control strings inside them are
escaped, so the template's own markers are the only ones in the output and the turns can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of common chat templates; none stays whole inside a formatted text.
CONTROL_STRINGS = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")

OPEN, CLOSE, SEPARATOR, ROLE_NEWLINE = "<|turn|>", "<|end|>\n", "<|next|>", "<|nl|>"


def escape(text: Column) -> Column:
    """Double each backslash, then put one after the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL_STRINGS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: a lone backslash inside a control string is ours, all others are doubled."""
    out = text
    for control in CONTROL_STRINGS:
        out = F.replace(out, F.lit(control[0] + "\\" + control[1:]), F.lit(control))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def format_conversations(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_mask``.

    ``formatted`` holds, for each run of turns with one role, the opening marker, the role, a newline, the
    texts joined by the separator marker, and the closing marker. ``loss_mask`` has its pieces in order as
    (n_chars, loss): the loss falls on the texts of ``loss_roles`` alone, not on markers or other roles.

    Null texts and roles count as empty; rows with a null conversation id form one conversation; tied turn
    numbers are ordered by role and text, repeated rows stay; a null turn comes first. An empty table gives
    no rows. Other columns are not read.
    """
    rows = conversations.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    starts = sorted_turns.withColumn(
        "starts", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    )
    merged = starts.select(
        "conv_id",
        F.transform(
            "starts",
            lambda s, k: F.struct(
                F.get("turns", s)["role"].alias("role"),
                F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s), lambda t: escape(t["text"])).alias("texts"),
            ),
        ).alias("runs"),
    )
    pieces = merged.select(
        "conv_id",
        F.flatten(
            F.transform(
                "runs",
                lambda r: F.concat(
                    F.array(F.struct(F.concat(F.lit(OPEN), F.replace(escape(r["role"]), F.lit("\n"), F.lit(ROLE_NEWLINE)), F.lit("\n")).alias("text"), F.lit(False).alias("loss"))),
                    F.flatten(
                        F.transform(
                            r["texts"],
                            lambda x, i: F.array(
                                F.struct(F.when(i > 0, F.lit(SEPARATOR)).otherwise(F.lit("")).alias("text"), F.lit(False).alias("loss")),
                                F.struct(x.alias("text"), r["role"].isin(*loss_roles).alias("loss")),
                            ),
                        )
                    ),
                    F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss"))),
                ),
            )
        ).alias("pieces"),
    )
    return pieces.select(
        "conv_id",
        F.array_join(F.col("pieces")["text"], "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(F.length(p["text"]).alias("n_chars"), p["loss"].alias("loss"))).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), unescaped, in order."""
    blocks = F.slice(F.split(formatted, r"<\|end\|>\n"), F.lit(1), F.size(F.split(formatted, r"<\|end\|>\n")) - 1)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = unescape(F.replace(F.substring(head, F.lit(len(OPEN) + 1), F.length(head)), F.lit(ROLE_NEWLINE), F.lit("\n")))
        body = F.substring(block, F.length(head) + 2, F.length(block))
        return F.transform(F.split(body, r"<\|next\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_mask(formatted: Column, loss_mask: Column) -> Column:
    """The text that the loss falls on: what ``loss_mask`` marks of ``formatted``, unescaped, one piece after another.

    An escaped piece neither begins nor ends inside an escape, so joined pieces are unescaped as they would be alone.
    """
    marks = F.array_join(F.transform(loss_mask, lambda p: F.repeat(F.when(p["loss"], F.lit("1")).otherwise(F.lit("0")), p["n_chars"])), "")
    # character by character: cutting pieces out by their places would read a long conversation once for each
    chars = F.zip_with(F.split(formatted, ""), F.split(marks, ""), lambda c, mark: F.when(mark == "1", c).otherwise(F.lit("")))
    return unescape(F.array_join(chars, ""))

"""Conversations as one training text each, with the parts that carry loss.

A block is ``<turn:ROLE>`` text ``</turn>`` and a line break; adjacent turns of one role share a
block, parted by ``<part>``. In roles and texts a backslash goes before every ``\\``, ``<`` and
``>``, so no text can hold a control string, and dropping one backslash of each pair restores it.

Null text and null role are empty. Turns are in order of turn, role and text, nulls first, so ties
and repeated rows have a fixed order and each is kept. Rows with a null conversation form one
conversation. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LOSS_ROLE = "assistant"
CLOSE = "</turn>\n"
PART = "<part>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<>])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _block(run: Column, loss_role: str) -> Column:
    """The pieces of one run of turns: head, texts with parts between them, close."""
    control = F.lit(False)
    texts = F.transform(
        run,
        lambda t, i: F.array(
            _piece(
                F.when(i == 0, F.concat(F.lit("<turn:"), escape(t["role"]), F.lit(">")))
                .otherwise(F.lit(PART)),
                control,
            ),
            _piece(escape(t["text"]), t["role"] == loss_role),
        ),
    )
    return F.concat(F.flatten(texts), F.array(_piece(F.lit(CLOSE), control)))


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """``(conv_id, pieces, formatted)``: ``pieces`` are texts with a loss flag, in order."""
    rows = turns.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("entry"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("entry")).alias("turns"))
    starts = sorted_turns.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(1), F.size("turns")),
            lambda i: (i == 1)
            | (
                F.element_at("turns", i)["role"]
                != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]
            ),
        ),
    )
    runs = starts.select(
        "conv_id",
        F.transform(
            "starts",
            lambda s, i: F.slice(
                "turns",
                s,
                F.coalesce(F.try_element_at("starts", i + 2), F.size("turns") + 1) - s,
            ),
        ).alias("runs"),
    )
    pieces = runs.select(
        "conv_id",
        F.flatten(F.transform("runs", lambda run: _block(run, loss_role))).alias("pieces"),
    )
    return pieces.withColumn("formatted", F.array_join("pieces.text", ""))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of ``(role, text)``."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")
    head = r"^<turn:([^>\\]*+(?:\\.[^>\\]*+)*+)>"

    def turns(block):
        role = F.regexp_extract(block, "(?s)" + head, 1)
        body = F.substring(block, F.length(role) + 8, F.length(block))
        return F.transform(
            F.split(body, PART, -1),
            lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def read_loss(pieces: Column) -> Column:
    """All text under the loss flags, unescaped, with nothing between the texts."""
    texts = F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"]))
    return F.array_join(texts, "")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted conversations."""
    read = formatted.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("pieces")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )

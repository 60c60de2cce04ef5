"""Chat formatting as a relational plan (Spark expressions only).

The turns of a conversation are collected as structs, sorted, and written with
one header per run of adjacent turns of the same role:

    <|user|>
    first text<|&|>second text of the same role<|end|>
    <|assistant|>
    reply<|end|>

Control strings inside texts are broken by one backslash and backslashes are
doubled, so formatting is reversible: :func:`parse_chat` gives back each turn.
Texts of the trained roles, and nothing else, carry loss; ``loss_runs`` gives
the mask as alternating run lengths in code points of ``formatted``, starting
with a run without loss.

Defined results: null text and null role count as empty strings; a null turn
sorts first; equal turns sort by role, then text, and repeated rows all stay;
a null conversation id is a conversation of its own; an empty table gives no
rows; columns other than the four named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that mean something in this or in common chat templates.
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]")
JOINT, END = "<|&|>", "<|end|>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for mark in reversed(CONTROL):
        out = F.replace(out, F.lit(mark[0] + "\\" + mark[1:]), F.lit(mark))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def format_chat(turns: DataFrame, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_runs``.

    Expects ``conv_id, turn, role, text``.  One shuffle by conversation; all
    later steps are linear in the number of turns and run inside the row.
    """
    turn = F.struct(
        F.col("turn"),
        escape(F.coalesce(F.col("role"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
    )
    grouped = turns.groupBy("conv_id").agg(F.collect_list(turn).alias("got"))
    ordered = grouped.select("conv_id", F.sort_array("got").alias("t"))

    def opening(i: Column, x: Column) -> Column:
        begins = (i == 0) | ~F.get("t", i - 1)["role"].eqNullSafe(x["role"])
        return F.when(begins, F.concat(F.lit("<|"), x["role"], F.lit("|>\n"))).otherwise(F.lit(JOINT))

    def closing(i: Column, x: Column) -> Column:
        ends = ~F.get("t", i + 1)["role"].eqNullSafe(x["role"])
        return F.when(ends, F.lit(END)).otherwise(F.lit(""))

    pieces = F.transform(
        "t",
        lambda x, i: F.struct(
            opening(i, x).alias("a"), x["text"].alias("b"), closing(i, x).alias("c"),
            x["role"].isin(*loss_roles).alias("loss"),
        ),
    )
    cut = ordered.select("conv_id", pieces.alias("p"))
    runs = F.flatten(
        F.transform(
            "p",
            lambda x: F.array(
                F.char_length(x["a"]),
                F.when(x["loss"], F.char_length(x["b"])).otherwise(F.lit(0)),
                F.when(x["loss"], F.lit(0)).otherwise(F.char_length(x["b"])) + F.char_length(x["c"]),
                F.lit(0),
            ),
        )
    )
    return cut.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["a"], x["b"], x["c"])), "").alias("formatted"),
        runs.alias("loss_runs"),
    )


def parse_chat(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.regexp_extract(block, r"(?s)^<\|(.*?)\|>\n", 1))
        body = F.regexp_replace(block, r"(?s)^<\|.*?\|>\n", "")
        return F.transform(
            F.split(body, r"<\|&\|>"),
            lambda x: F.struct(role.alias("role"), unescape(x).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def masked_texts(formatted: Column, loss_runs: Column) -> Column:
    """``array<string>``: the texts of ``formatted`` that carry loss, cut out by the mask."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("cut"))
    # Loss runs are those at odd places.
    placed = F.aggregate(
        F.transform(loss_runs, lambda n, i: F.struct(n.alias("n"), (i % 2 == 1).alias("loss"))), start,
        lambda got, run: F.struct(
            (got["at"] + run["n"]).alias("at"),
            F.when(run["loss"] & (run["n"] > 0), F.concat(got["cut"], F.array(F.struct(got["at"].alias("at"), run["n"].alias("n")))))
            .otherwise(got["cut"]).alias("cut"),
        ),
    )["cut"]
    return F.transform(placed, lambda x: unescape(F.substring(formatted, x["at"] + 1, x["n"])))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Digest columns read back from :func:`format_chat`'s output: turns by parsing, trained texts under the loss mask."""
    parsed = formatted.select(
        "conv_id", F.char_length("formatted").alias("n"), parse_chat(F.col("formatted")).alias("r"),
        F.array_join(masked_texts(F.col("formatted"), F.col("loss_runs")), "").alias("trained"),
    )
    spoken = F.array_join(F.transform("r", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    both = parsed.select("conv_id", "n", F.size("r").alias("k"), spoken.alias("spoken"), "trained")
    return both.select(
        "conv_id",
        F.col("k").cast("long").alias("n_turns"),
        F.sha2(F.col("spoken").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.col("n").cast("long").alias("formatted_chars"),
    )

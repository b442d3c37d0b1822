"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only
the text of that reply is trainable. A conversation that ends with another role (or has no
assistant turn) gives one more example with no trainable text, so that no turn is lost.

Template, turn after turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``\\`` becomes
``\\\\`` and ``<|`` becomes ``<\\|`` (in roles a line break becomes ``<|n|>``), so a text can hold
control strings without ending a turn, and unescaping gives it back exactly.

Turns are ordered by turn (nulls first), then role, then text; repeated rows stay. Null texts are
empty, null roles too. Null conversation ids form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def prefix_target_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, example, formatted, loss_start, loss_chars``: the trainable part of ``formatted`` as a 0-based span.

    One shuffle, by conversation. The example rows repeat their context, which is what training reads.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.struct(
            F.col(f"`{turn_col}`").alias("turn"),
            F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END)))
    n = F.size("turns")
    targets = F.filter(
        F.transform("turns", lambda t, i: F.when((t["role"] == "assistant") | (i == n - 1), i)),
        lambda i: i.isNotNull(),
    )
    picked = talks.select("conv_id", "turns", pieces.alias("pieces"), targets.alias("targets")).select(
        "conv_id", "turns", "pieces", F.posexplode("targets").alias("example", "at")
    )
    last = F.element_at("turns", F.col("at") + 1)
    reply = F.length(escape(last["text"]))
    formatted = F.concat_ws("", F.slice("pieces", 1, F.col("at") + 1))
    trained = last["role"] == "assistant"
    return picked.select(
        "conv_id", "example", formatted.alias("formatted"), trained.alias("trained"), reply.alias("reply")
    ).select(
        "conv_id",
        "example",
        "formatted",
        F.when(F.col("trained"), F.length("formatted") - len(END) - F.col("reply")).cast("long").alias("loss_start"),
        F.when(F.col("trained"), F.col("reply")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """The digests of each conversation, parsed from its examples.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``: turns from the longest example
    (role, line break, text, line break each); the texts under the loss masks in order of the examples;
    formatted_chars is the length of all examples together.
    """
    parts = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda p: F.length(p) > 0)
    body = lambda p: F.substring(p, len(START) + 1, 2_000_000_000)
    role = lambda p: F.substring_index(body(p), "\n", 1)
    turns = F.transform(
        parts,
        lambda p: F.concat(
            unescape_role(role(p)), F.lit("\n"), unescape(F.substring(p, F.length(role(p)) + F.lit(len(START) + 2), F.length(p))), F.lit("\n")
        ),
    )
    masked = F.when(F.col("loss_start").isNotNull(), unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars")))).otherwise("")
    seen = examples.select("conv_id", "example", "formatted", masked.alias("masked"))
    talks = seen.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "masked"))), lambda x: x["masked"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    return talks.select("conv_id", "loss", "formatted_chars", turns.alias("turns")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )

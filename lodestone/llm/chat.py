"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text
lies under the loss mask (``loss_start``, ``loss_end``: code points in ``formatted``). Turns after the last
assistant turn, and conversations without one, give one example without a target, so that no turn is lost.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` per turn. Inside roles and texts a control string, or one
that already carries backslashes, gets one backslash more (``<|im_end|>`` becomes ``<\\|im_end|>``), so
unescaping by one backslash less restores every text; a line break in a role becomes ``<\\n>`` in the same way.

Turns are ordered by (turn, role, text), nulls first; repeated rows are turns of their own. Null role or
text: empty. A null conv_id is a conversation like others. A conversation is one row while it is
formatted (its hash and its longest example need that), so memory follows the longest conversation.
Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = r"(\\*\|im_(?:start|end)\|>)"
_BREAK = r"(\\*n>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, "<" + _CONTROL, r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\" + _CONTROL, "<$1")


def _escape_role(role: Column) -> Column:
    kept = F.regexp_replace(escape(role), r"<(\\+n>)", r"<\\$1")
    return F.replace(kept, F.lit("\n"), F.lit("<\\n>"))


def _unescape_role(role: Column) -> Column:
    broken = F.regexp_replace(role, r"<\\n>", "\n")
    return unescape(F.regexp_replace(broken, r"<\\(\\+n>)", "<$1"))


def chat_examples(turns: DataFrame, conv: str = "conv_id", target_role: str = "assistant") -> DataFrame:
    """One row per example: conv_id, target (turn index, null without one), n_turns (in it), formatted,
    loss_start, loss_end. Input: conv_id, turn, role, text; other columns are not used."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    parts = grouped.select(
        "conv_id", F.transform("ts", lambda t: t["role"] == target_role).alias("is_target"),
        F.transform("ts", lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("ts", lambda t: escape(t["text"])).alias("bodies"),
    )
    n = F.size("heads")
    parts = parts.withColumn(
        "formed", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.get("heads", i), F.get("bodies", i), F.lit(END + "\n")))
    ).withColumn(
        "targets",
        F.filter(
            F.transform(
                "is_target", lambda y, i: F.when(y, i).when(i == n - 1, F.lit(-1))  # -1: the rest has no target
            ),
            lambda x: x.isNotNull(),
        ),
    )
    rows = parts.select("conv_id", "heads", "bodies", "formed", F.explode("targets").alias("at"))
    context = F.array_join(F.when(F.col("at") > 0, F.slice("formed", F.lit(1), F.col("at"))).otherwise(F.array()), "")
    begin = F.length("context") + F.length(F.get("heads", F.col("at")))
    has = F.col("at") >= 0
    return (
        rows.withColumn("context", F.when(has, context).otherwise(F.array_join("formed", "")))
        .select(
            "conv_id", F.when(has, F.col("at")).cast("long").alias("target"),
            F.when(has, F.col("at") + 1).otherwise(F.size("formed")).cast("long").alias("n_turns"),
            F.when(has, F.concat("context", F.get("formed", F.col("at")))).otherwise(F.col("context")).alias("formatted"),
            F.when(has, begin).otherwise(F.lit(0)).cast("long").alias("loss_start"),
            F.when(has, begin + F.length(F.get("bodies", F.col("at")))).otherwise(F.lit(0)).cast("long").alias("loss_end"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted example."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    return F.transform(
        pieces,
        lambda p: F.struct(
            _unescape_role(F.substring_index(body(p), "\n", 1)).alias("role"),
            unescape(F.substr(body(p), F.length(F.substring_index(body(p), "\n", 1)) + 2)).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """Unescaped text under the loss mask."""
    return unescape(F.substr(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def conversation_digest(examples: DataFrame) -> DataFrame:
    """What the examples say of each conversation, read back from their text."""
    loss = F.when(F.col("target").isNotNull(), read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))).otherwise("")
    each = examples.select("conv_id", "n_turns", F.length("formatted").cast("long").alias("chars"), "formatted",
                           F.coalesce("target", F.lit(1 << 40)).alias("at"), loss.alias("loss"))
    rolled = each.groupBy("conv_id").agg(
        F.max(F.struct("n_turns", "formatted")).alias("full"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("at", "loss"))).alias("losses"),
    )
    text = F.array_join(F.transform(read_turns(F.col("full.formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return rolled.select(
        "conv_id", F.size(read_turns(F.col("full.formatted"))).cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars",
    )

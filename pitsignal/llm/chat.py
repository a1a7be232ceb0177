"""Chat formatting by prefix-target expansion, on DataFrame functions alone.

Each assistant turn becomes an example: all turns before it as context, and that reply as the only
trainable text. A conversation that does not end with a reply has one more example, without a
target, so that no turn is lost. A turn is written as ``### role``, a line end, its text and a line
end with ``</turn>``; in texts a backslash is put before ``### ``, ``</turn>`` and backslashes, so a text can never
pose as a turn, and taking the backslashes away restores it exactly.

Nulls and edge cases: a null text or role is empty, a null turn comes first, null conversation ids make a
conversation of their own. Rows of equal turn number are ordered by role, then text, and repeated
rows are turns of their own. Only ``role = 'assistant'`` is trained on. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "\n</turn>\n"
REPLY = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|### |</turn>)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def head(role: Column) -> Column:
    return F.concat(F.lit("### "), escape_role(role), F.lit("\n"))


def examples(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``target`` (number of the last turn shown, from 1), ``formatted``, ``loss_start`` and
    ``loss_length`` in characters; the latter is null for an example without a target."""
    plain = rows.select(
        F.col("conv_id").cast("bigint"),
        F.struct(
            F.col("turn").cast("bigint").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("row"),
    )
    turns = plain.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    shown = turns.select(
        "conv_id",
        "turns",
        F.transform("turns", lambda t: F.concat(head(t["role"]), escape(t["text"]), F.lit(TURN_END))).alias("parts"),
    )
    n = F.size("turns")
    ends = F.filter(
        F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i)["role"] == REPLY) | (i == n)
    )
    each = shown.select("conv_id", "turns", "parts", F.explode(ends).alias("target"))
    last = F.element_at("turns", F.col("target"))
    trained = last["role"] == REPLY
    each = each.select(
        "conv_id",
        "target",
        F.array_join(F.slice("parts", F.lit(1), F.col("target")), "").alias("formatted"),
        F.when(trained, F.length(escape(last["text"]))).alias("loss_length"),
    )
    start = F.length("formatted") - F.length(F.lit(TURN_END)) - F.col("loss_length")
    return each.withColumn("loss_start", start)


def read_back(shown: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, from their text and mask alone."""
    reply = F.when(
        F.col("loss_length").isNotNull(),
        unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length"))),
    )
    per = shown.withColumn("reply", reply).groupBy("conv_id").agg(
        F.max_by("formatted", "target").alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("target", "reply")))).alias("replies"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    parts = F.filter(F.split("whole", TURN_END), lambda p: p != "")

    def turn(part: Column) -> Column:
        line_end = F.instr(part, "\n")
        role = F.substring(part, F.lit(5), line_end - 5)
        text = F.substring(part, line_end + 1, F.length(part))
        return F.concat(unescape_role(role), F.lit("\n"), unescape(text), F.lit("\n"))

    losses = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    return per.select(
        "conv_id",
        F.size(parts).cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform(parts, turn), ""), 256).alias("turns_sha256"),
        F.length(losses).cast("bigint").alias("loss_chars"),
        F.sha2(losses, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint"),
    )

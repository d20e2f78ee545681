"""Chat examples from every participant's point of view, with loss masks. Native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.ordering import running_totals, slice_ordered

# The marks of the widespread chat template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _safe(text: Column) -> Column:
    """A text cannot close its own message: a mark inside it is broken by a space."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>"))


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every dialogue rendered once per participant, one row per message, in reading order.

    In a participant's rendering its own messages are the assistant's, system messages stay system
    messages, and everyone else is a user named by role. Columns: conv_id, perspective, position
    (from 0), shown (assistant, system or user), name (of users), rendered, start and length (code
    points in the whole rendering), target_start and target_end (what the loss covers: an assistant's
    text and closing mark; null for others). The rendering is the concatenation of ``rendered`` by
    position; it is never gathered here, so a dialogue may have any length.

    Messages are ordered by turn (null first), role and text; repeated rows are repeated messages.
    A null text is empty, a null role is a participant named unknown, a null conv_id is a dialogue
    of its own. A dialogue of system messages only has no participant and no rendering. Extra columns
    are ignored.
    """
    speaker = F.coalesce(F.col(role), F.lit("unknown"))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), speaker.alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    messages = rows.groupBy("conv_id", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("copies"))
    people = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    shown = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    head = F.concat(F.lit(OPEN), F.col("shown"), F.when(F.col("shown") == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""), F.lit("\n"))
    seen = (
        messages.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("shown", shown).withColumn("head", head)
        .withColumn("rendered", F.concat("head", _safe(F.col("text")), F.lit(CLOSE + "\n")))
        .withColumn("length", F.length("rendered").cast("long"))
        .select("conv_id", "perspective", "turn", "speaker", "copies", "shown", F.length("head").alias("lead"), "rendered", "length", "text")
    )
    keys, order = ["conv_id", "perspective"], [F.col("turn").asc_nulls_first(), "speaker", "text"]
    placed = running_totals(slice_ordered(seen, keys, order), keys, order, {"start": F.col("copies") * F.col("length"), "position": F.col("copies")})
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start = F.col("start") + F.col("copy") * F.col("length")
    target = F.col("shown") == "assistant"
    return each.select(
        "conv_id", "perspective", (F.col("position") + F.col("copy")).alias("position"), "shown", F.when(F.col("shown") == "user", F.col("speaker")).alias("name"),
        "rendered", start.alias("start"), "length",
        F.when(target, start + F.col("lead")).alias("target_start"), F.when(target, start + F.col("length") - 1).alias("target_end"))

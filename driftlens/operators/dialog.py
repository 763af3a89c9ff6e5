"""Dialogs to (source so far, next turn) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.session import broadcast_if_small

BLOCK_TURNS = 256


def accumulate_dialog(
    df: DataFrame,
    dialog: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    eos: str = "</s>",
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """One row per turn but the last: all turns so far, each with ``eos`` behind it, and the next turn.

    Turn numbers are unique integers per dialog. Prefixes are built per block of turns, so a long dialog
    is spread over its blocks; only the block texts of one dialog meet, and those are no longer than the
    source of its last row. Which dialogs have several blocks is found without texts, and only theirs are
    carried from block to block: the others are shuffled once.
    """
    turns = df.select(dialog, turn, text).withColumn("_block", F.call_function("div", F.col(turn).cast("long"), F.lit(block_turns).cast("long")))
    inside = W.partitionBy(dialog, "_block").orderBy(turn)
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    local = turns.select(
        dialog,
        turn,
        "_block",
        F.array_join(F.collect_list(F.concat(F.col(text), F.lit(eos))).over(so_far), "").alias("_prefix"),
        F.lead(text).over(inside).alias("_next"),
    )
    several = turns.groupBy(dialog).agg(F.min("_block").alias("_low"), F.max("_block").alias("_high")).where("_low < _high").select(dialog)
    several = broadcast_if_small(several)
    if several.isEmpty():
        return local.where(F.col("_next").isNotNull()).select(dialog, turn, F.col("_prefix").alias("source"), F.col("_next").alias("target"))
    # What a block needs from its neighbours.
    blocks = turns.join(several, dialog, "left_semi").groupBy(dialog, "_block").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.concat(F.col(text), F.lit(eos)).alias("x")))),
                lambda s: s["x"],
            ),
            "",
        ).alias("_text"),
        F.min_by(text, turn).alias("_first"),
    )
    along = W.partitionBy(dialog).orderBy("_block")
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    joints = blocks.select(
        dialog,
        "_block",
        F.array_join(F.collect_list("_text").over(earlier), "").alias("_before"),
        F.lead("_first").over(along).alias("_after"),
    )
    return (
        local.join(joints, [dialog, "_block"], "left")
        .withColumn("target", F.coalesce("_next", "_after"))
        .where(F.col("target").isNotNull())
        .select(dialog, turn, F.concat(F.coalesce("_before", F.lit("")), F.col("_prefix")).alias("source"), "target")
    )


def accumulate_dialog_array(df: DataFrame, column: str = "dialog", eos: str = "</s>") -> DataFrame:
    """The same for a dialog held in one array; ``turn`` counts from 0."""
    kept = [c for c in df.columns if c != column.split(".")[0]]
    steps = df.select(*kept, F.col(column).alias("_turns")).where(F.size("_turns") > 1)
    last = F.size("_turns") - 1
    return steps.select(
        *kept, "_turns", F.explode(F.sequence(F.lit(1), last)).alias("_k")
    ).select(
        *kept,
        (F.col("_k") - 1).alias("turn"),
        F.concat(F.array_join(F.slice("_turns", F.lit(1), F.col("_k")), eos), F.lit(eos)).alias("source"),
        F.element_at("_turns", F.col("_k") + 1).alias("target"),
    )

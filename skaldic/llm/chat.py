"""Chat formatting by perspective rotation (operator 5). DataFrame functions only.

For every participant of a conversation (every role but `system`) the dialogue is rendered once with that
participant as assistant and all others as users named by their role; system turns stay system. The result has
a row for each turn of each rendering, with its place in the whole text and the span that the loss covers, so
that no rendering, however long, has to fit into one row or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns whose lengths are summed together, before the sums of the blocks are.
TURNS = 256


def perspectives(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, position, turn, role, segment, start, end, loss_start, loss_end).

    `segment` is the rendered turn, `start`..`end` its code points in the rendering, whose text is the segments
    joined in order of position; loss_start..loss_end covers the assistant's words and the closing marker and is
    empty (at `end`) for other turns. Turns are ordered by turn (null first), then role and text. Null text counts as empty, null
    role is a participant `unknown`, rows with a null conv_id form one conversation; equal rows each count as a
    turn; markers inside texts are broken by a zero-width space. Names of users are their roles, percent-encoded, so
    that no two roles share one (an empty role is `%`). Turns without a number, or with equal ones, are summed by one task. A conversation of system turns only, having no
    participant, gives no rows. Other columns are ignored.
    """
    role = F.coalesce("role", F.lit("unknown"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|", "<​|")
    rows = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-(1 << 63))).alias("c"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("t"), role.alias("role"), text.alias("text"))
    people = rows.where("role <> 'system'").groupBy("c", F.col("role").alias("perspective")).agg(F.count(F.lit(1)).alias("own")).select(F.col("c").alias("pc"), "perspective")
    rows = rows.join(people, F.col("c") == F.col("pc")).drop("pc")
    name = F.when(F.col("role") == "", F.lit("%")).otherwise(F.url_encode("role"))
    head = F.when(F.col("role") == "system", F.lit(f"{OPEN}system\n")).when(F.col("role") == F.col("perspective"), F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))
    rows = rows.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "text", F.lit(f"{CLOSE}\n"))).withColumn("size", F.length("segment")).withColumn("b", F.floor(F.col("t") / TURNS)).drop("text")
    blocks = rows.groupBy("c", "perspective", "b").agg(F.sum("size").alias("chars"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("c", "perspective").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("c").alias("bc"), F.col("perspective").alias("bp"), F.col("b").alias("bb"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"))
    rows = rows.join(blocks, (F.col("c") == F.col("bc")) & (F.col("perspective") == F.col("bp")) & (F.col("b") == F.col("bb")))
    inside = Window.partitionBy("c", "perspective", "b").orderBy("t", "role", "segment")
    end = F.col("chars") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("position", F.col("n") + F.row_number().over(inside) - 1).withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    own = F.col("role") == F.col("perspective")
    return rows.select(
        F.when(F.col("c") != -(1 << 63), F.col("c")).alias("conv_id"), "perspective", "position", F.when(F.col("t") != -(1 << 62), F.col("t")).alias("turn"), "role", "segment", "start", "end",
        F.when(own, F.col("start") + F.col("head")).otherwise(F.col("end")).alias("loss_start"), F.when(own, F.col("end") - 1).otherwise(F.col("end")).alias("loss_end"),
    )

"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation once after each turn. Every turn has a hash of its position, role
and text; the running XOR of these hashes is the hash of the prefix that ends there. A conversation
whose whole hash is another's proper prefix hash, at the same length, is a snapshot and goes; of
equal conversations the smallest conv_id stays. Those that stay are rendered.

A conversation may hold a third of all turns: positions and prefix hashes come from blocks of
turns, summed by block first, and a rendering comes in segments of at most ``segment`` turns (a
parameter), one row each in order, so that no task holds a whole long conversation; those of up to
that many turns are one row. The anti-join meets distinct prefixes only, so a first turn that many
share is one row.

Markers inside roles and texts are escaped: a backslash is put before the bar of ``<|``, and one more
where backslashes stand there already, so no text can forge a turn and all can be read back.

Rows: a null conv_id is a conversation of its own; null turns come first; null role and text
are empty; rows that repeat a turn are turns of their own, ordered by role and text. An empty
table gives an empty result; other columns are ignored, whatever their names. Texts are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import materialise

BLOCK = 256
SEGMENT = 256


def turns(conversations: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id, pos (from 0), role, text, one and two: both halves of the prefix hash up to pos."""
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1 << 62)).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("block", F.floor(F.col("turn") / BLOCK))
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(before, F.lit(0)).alias("before"))
    rows = rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))).drop("c", "b")
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", F.col("before") + F.row_number().over(inner) - 1)
    rows = rows.withColumn("x", F.xxhash64("pos", "role", "text")).withColumn("y", F.xxhash64("text", "pos", F.lit("2"), "role"))
    whole = rows.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    prior = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *[F.coalesce(F.bit_xor(k).over(prior), F.lit(0)).alias(f"before_{k}") for k in "xy"])
    rows = rows.join(whole, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    run = inner.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("conv_id", "pos", "role", "text", *[F.bit_xor(k).over(run).bitwiseXOR(F.col(f"before_{k}")).alias(name) for k, name in (("x", "one"), ("y", "two"))])


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id) of the conversations that no other one continues; of equal ones the smallest id."""
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("pos", "one", "two")).alias("end")).select("conv_id", "end.*")
    ends = materialise(ends, "chat-ends")
    one = ends.groupBy("pos", "one", "two").agg(F.min("conv_id").alias("conv_id"), F.count("conv_id").alias("named"))
    # prefixes that some conversation continues: all but its last
    known = ends.select(F.col("conv_id").alias("c"), F.col("pos").alias("end"))
    proper = prefixes.select("conv_id", "pos", "one", "two").join(known, F.col("conv_id").eqNullSafe(F.col("c"))).where("pos < end").select("pos", "one", "two").distinct()
    return one.join(proper, ["pos", "one", "two"], "left_anti").select("conv_id")


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def render(conversations: DataFrame, *, segment: int = SEGMENT, **cols) -> DataFrame:
    """Segments of the maximal conversations: conv_id, segment, n_turns, text."""
    rows = materialise(turns(conversations, **cols), "chat-turns")
    stay = maximal(rows).select(F.col("conv_id").alias("c"))
    rows = rows.join(stay, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    line = F.concat(F.lit("<|"), escaped(F.col("role")), F.lit("|>\n"), escaped(F.col("text")), F.lit("\n<|end|>\n"))
    parts = rows.withColumn("segment", F.floor(F.col("pos") / segment)).groupBy("conv_id", "segment")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "")
    return parts.agg(F.count("*").alias("n_turns"), said.alias("text"))

"""Chat logs: collapse of cumulative snapshots, then rendering. DataFrame operations only.

A service that logs the whole conversation after each turn leaves every shorter state beside
the longest. Each conversation gets a hash of each of its turn prefixes; one whose last hash is
an inner prefix hash of another conversation is a snapshot and goes by an anti-join, equal
conversations are folded into one, and what is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stage


def _field(value: Column) -> Column:
    """value with its length before it, so that joined fields can't be read in two ways; null is -."""
    return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def rendered(turns: Column) -> Column:
    """The text of an array of (role, text) turns, in order."""
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.concat(
                F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n")
            ),
        ),
        "",
    )


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1), role, text, prefix, last of every turn: prefix is the hash of all turns up to it.

    A turn's hash is the SHA-256 of its place, role and text, as four numbers of 64 bits. These
    are added up along the conversation, so the work grows with the number of turns.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    along = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumn("at", F.row_number().over(along)).withColumn("last", F.lead(F.lit(1)).over(along).isNull())
    hashed = placed.withColumn("hash", F.sha2(F.concat_ws("|", "at", _field(F.col("role")), _field(F.col("text"))), 256))
    lanes = [F.conv(F.substring("hash", k, 16), 16, 10).cast("decimal(20,0)") for k in (1, 17, 33, 49)]
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = F.concat_ws("-", *[F.sum(lane).over(so_far) for lane in lanes])
    return hashed.select("conv_id", "at", "role", "text", rolled.alias("prefix"), "last")


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered of each conversation that none prolongs.

    conversations: conv_id, turn, role, text. Turns are ordered by turn, then role, then text,
    nulls first; two conversations are compared by their roles and texts, where null differs
    from empty (both are rendered as nothing). Equal conversations are kept once, under the
    smallest conv_id, and n_copies counts them; snapshots don't count. Rows with a null conv_id
    are one conversation, named after none unless it is the only one. A conversation has to fit
    into a row, as its rendering does. Repeated rows are repeated turns, other columns are
    ignored, an empty table gives an empty result.
    """
    logged = stage(turn_prefixes(conversations), "turn-prefixes")
    ends = logged.filter("last").groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = logged.filter("not last").select("prefix").distinct()
    kept = ends.join(inner, "prefix", "left_anti").select("conv_id", "n_copies")
    turns = kept.alias("k").join(logged.alias("l"), F.col("k.conv_id").eqNullSafe(F.col("l.conv_id")))
    return (
        turns.groupBy("k.conv_id", "k.n_copies")
        .agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("l.at", "l.role", "l.text"))).alias("turns"))
        .select("conv_id", "n_turns", "n_copies", rendered(F.col("turns")).alias("rendered"))
    )

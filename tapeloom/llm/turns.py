"""Ordered turns of conversations without their texts: digests and word counts by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word: no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def digest(role: Column, text: Column) -> Column:
    """128 bits of a turn; the role's length keeps (role, text) apart from other splits of the same characters."""
    return F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))


def ordered(conversations: DataFrame) -> DataFrame:
    """Columns c, pos (from 1), turn_digest, words: turns by number, null first, then by role and text.

    Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    lean = rows.select("c", "turn", "role", "text", digest(F.col("role"), F.col("text")).alias("turn_digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return lean.withColumn("pos", F.row_number().over(order)).select("c", "pos", "turn_digest", "words")


def rebuilt(turns: DataFrame, block: int = 20, kinds: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their block does: rows (c, d, turn_digest, words) and all ids (c).

    With h = crc32(decimal c) mod kinds, conversation c has the first h turns of c - c mod block (all if fewer, none if
    absent), then its own after its first h.
    """
    ids = turns.select("c").distinct().withColumn("h", (F.crc32(F.col("c").cast("string").cast("binary")) % kinds).cast("int")).withColumn("head", F.col("c") - F.pmod("c", F.lit(block)))
    heads = turns.filter((F.pmod("c", F.lit(block)) == 0) & (F.col("pos") < kinds)).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("pos", "turn_digest", "words"))).alias("turns")).withColumnRenamed("c", "head")
    begun = ids.join(heads, "head", "left").withColumn("taken", F.slice("turns", 1, F.col("h")))
    begun = begun.select("c", "h", F.when(F.col("taken").isNull(), 0).otherwise(F.size("taken")).alias("n"), "taken")
    first = begun.select("c", F.explode("taken").alias("t")).select("c", F.col("t.pos").alias("d"), "t.turn_digest", "t.words")
    own = turns.join(begun.select("c", "h", "n"), "c").filter("pos > h").select("c", (F.col("n") + F.col("pos") - F.col("h")).alias("d"), "turn_digest", "words")
    return first.unionByName(own), ids.select("c")

"""Ranks and aggregates across a market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.frames import percentile_rank


def group_ranks(ranked: DataFrame, group: str, least: int = 3) -> DataFrame:
    """Rank 1..99 of each group of at least three ranked members, by their median rank."""
    g = ranked.filter(F.col("rs_rank").isNotNull()).groupBy("market", group).agg(F.median("rs_rank").alias("median_rank"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return g.withColumn("group_rank", F.greatest(F.lit(1), F.least(F.lit(99), F.bround(percentile_rank("median_rank", "market") * 99))).cast("int"))

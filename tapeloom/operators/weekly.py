"""Weekly bars and what days may know of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom import config


def to_weekly(bars: DataFrame, partial: bool = False) -> DataFrame:
    """Bars by week, labelled with its Friday; a ticker's last week goes unless its last bar is on the label or partial is set."""
    x = bars.withColumn("week", F.next_day(F.date_sub("d", 1), "FRI"))
    wk = x.groupBy("market", "ticker", "week").agg(F.min_by("o", "d").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "d").alias("c"), F.sum("v").alias("v"), F.max("d").alias("last"))
    if partial:
        return wk
    w = Window.partitionBy("market", "ticker")
    return wk.withColumn("_end", F.max("week").over(w)).filter((F.col("week") < F.col("_end")) | (F.col("last") >= F.col("week"))).drop("_end")


def weekly_facts(bars: DataFrame) -> DataFrame:
    """Weeks with the 30-week mean and whether it has risen over ten weeks; null until there are enough."""
    w = Window.partitionBy("market", "ticker").orderBy("week")
    ma = F.when(F.count("c").over(w.rowsBetween(1 - config.STAGE_WEEKS, 0)) == config.STAGE_WEEKS, F.avg("c").over(w.rowsBetween(1 - config.STAGE_WEEKS, 0)))
    x = to_weekly(bars).withColumn("ma30w", ma)
    return x.withColumn("rising", F.coalesce(F.col("ma30w") > F.lag("ma30w", config.SLOPE_WEEKS).over(w), F.lit(False)))


def aligned(bars: DataFrame) -> DataFrame:
    """Days with the facts of the last week before their own label: a week is known only once the next has begun.

    A backward as-of join: weeks and days in one ordered stream, the last week seen carried forward.
    """
    w = Window.partitionBy("market", "ticker").orderBy("week")
    facts = weekly_facts(bars).select("market", "ticker", F.col("week").alias("t"), F.struct(F.lag("ma30w").over(w).alias("ma30w"), F.lag("rising").over(w).alias("rising")).alias("fact"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("c"))
    days = bars.select("market", "ticker", F.col("d").alias("t"), F.lit(None).cast(facts.schema["fact"].dataType).alias("fact"), F.lit(1).alias("kind"), "c")
    order = Window.partitionBy("market", "ticker").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    x = facts.unionByName(days).withColumn("seen", F.last("fact", ignorenulls=True).over(order)).filter("kind = 1")
    return x.select("market", "ticker", F.col("t").alias("d"), F.col("seen.ma30w").alias("ma30w"), F.coalesce("seen.rising", F.lit(False)).alias("rising"), F.coalesce(F.col("c") > F.col("seen.ma30w"), F.lit(False)).alias("above"))

"""State of the market: benchmark, distribution days, regime, breadth, rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.frames import newest_first


def benchmark(bars: DataFrame) -> DataFrame:
    """A market's mean close and total volume by day, as bars of one ticker per market: c and v."""
    return bars.groupBy("market", "d").agg((F.sum("c") / F.count("c")).alias("c"), F.sum("v").alias("v")).withColumn("ticker", F.concat(F.lit("IX."), "market"))


def distribution(index: DataFrame, window: int = 25) -> DataFrame:
    """Per day, the drops of over 0.2 % on higher volume among the last window changes that the close has not risen 5 % above; null before window closes or without volume."""
    w = Window.partitionBy("market", "ticker").orderBy("d")
    x = index.withColumns({"c1": F.lag("c").over(w), "v1": F.lag("v").over(w)})
    drop = F.when((F.col("c") < F.col("c1") * 0.998) & (F.col("v") > F.col("v1")) & (F.col("v1") > 0), F.col("c"))
    frame = w.rowsBetween(1 - window, 0)
    x = x.withColumns({"_drops": F.collect_list(drop).over(frame), "_n": F.count("c").over(w.rowsBetween(-window, 0)), "_v": F.max("v").over(frame)})
    return x.withColumn("dist_days", F.when((F.col("_n") >= window) & (F.col("_v") > 0), F.size(F.filter("_drops", lambda y: F.col("c") < y * 1.05))))


def indices(bars: DataFrame) -> DataFrame:
    """Two stand-in indices a market, as the panel has no index instruments: the mean close of all its tickers, and of those with an even industry digit.

    v is the number of tickers, as meaningless as a fund's own turnover: see regime_frame.
    """
    some = F.substring("ticker", 7, 1).cast("int") % 2 == 0
    each = bars.select("market", "d", "c", F.explode(F.array(F.lit("IX.ALL"), F.when(some, "IX.EVEN"))).alias("ticker")).filter("ticker is not null")
    return each.groupBy("market", "ticker", "d").agg((F.sum("c") / F.count("c")).alias("c"), F.count("*").cast("double").alias("v"))


def regime_frame(index: DataFrame, bars: DataFrame) -> DataFrame:
    """Index prices with the whole market's volume, carried on over days on which nothing traded; 0 before the first."""
    total = bars.groupBy("market", "d").agg(F.sum("v").alias("_v"))
    w = Window.partitionBy("market", "ticker").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    x = index.drop("v").join(total, ["market", "d"], "left")
    return x.withColumn("v", F.coalesce(F.last("_v", ignorenulls=True).over(w), F.lit(0.0))).drop("_v")


def recent_follow_through(index: DataFrame, lookback: int = 40) -> DataFrame:
    """Index bars with recent_ft: whether, as of that day, the first follow-through day of the lookback is one of the last five bars (see follow_through)."""
    w = Window.partitionBy("market", "ticker").orderBy("d").rowsBetween(1 - lookback, 0)
    x = index.withColumns({"_c": F.collect_list("c").over(w), "_v": F.collect_list("v").over(w)})
    n, low = F.size("_c"), F.array_min("_c")
    at = (F.array_position("_c", low) - 1).cast("int")

    def rises(i):
        return (F.get("_c", i) / F.get("_c", i - 1) - 1 >= 0.015) & (F.get("_v", i) > F.get("_v", i - 1)) & (F.get("_v", i - 1) > 0)

    days = F.when(at + 3 < n, F.filter(F.sequence(at + 3, n - 1), rises))
    fallen = (at >= 5) & (low <= F.array_max(F.slice("_c", 1, F.greatest(at, F.lit(0)))) * 0.94)
    return x.withColumn("recent_ft", F.coalesce(fallen & (F.get(days, F.lit(0)) >= n - 5), F.lit(False))).drop("_c", "_v")


def regime(index: DataFrame) -> DataFrame:
    """Light of each market and day from all its indices: market, d, light, risk_pct, dist_days (the most of any), recent_ft.

    Green if every index closes above its 50- and 200-day means, yellow if half of these tests hold, else red. Six
    distribution days or more in any index lower it a step; without them a recent follow-through day lifts red to
    yellow. An index counts from its 200th bar; only bars up to the day count.
    """
    w = Window.partitionBy("market", "ticker").orderBy("d")
    x = recent_follow_through(distribution(index)).withColumns({"_50": F.avg("c").over(w.rowsBetween(-49, 0)), "_200": F.avg("c").over(w.rowsBetween(-199, 0)), "_k": F.row_number().over(w)})
    above = (F.col("c") > F.col("_50")).cast("int") + (F.col("c") > F.col("_200")).cast("int")
    day = x.filter("_k >= 200").groupBy("market", "d").agg(F.sum(above).alias("_score"), (2 * F.count("*")).alias("_checks"), F.max(F.coalesce("dist_days", F.lit(0))).alias("dist_days"), F.bool_or("recent_ft").alias("recent_ft"))
    light = F.when(F.col("_score") == F.col("_checks"), 2).when(2 * F.col("_score") >= F.col("_checks"), 1).otherwise(0)
    heavy = F.col("dist_days") >= 6
    step = F.when(heavy, F.greatest(F.lit(0), light - 1)).when((light == 0) & F.col("recent_ft"), 1).otherwise(light)
    out = day.withColumn("light", F.element_at(F.array(F.lit("red"), F.lit("yellow"), F.lit("green")), step + 1))
    risk = F.when(F.col("light") == "green", 1.0).when(F.col("light") == "yellow", 0.5).otherwise(0.0)
    return out.withColumn("risk_pct", risk).select("market", "d", "light", "risk_pct", "dist_days", "recent_ft")


def follow_through(index: DataFrame, lookback: int = 40) -> DataFrame:
    """Per market the first rise of 1.5 % on higher volume three bars or more after the earliest low of the lookback, which must follow a fall of 6 % and lie off both ends."""
    t = index.withColumn("_r", F.row_number().over(newest_first())).filter(F.col("_r") <= lookback)
    w = Window.partitionBy("market", "ticker").orderBy("d")
    x = t.withColumns({"i": F.row_number().over(w) - 1, "c1": F.lag("c").over(w), "v1": F.lag("v").over(w)})
    low = x.groupBy("market", "ticker").agg(F.min(F.struct("c", "i")).alias("low"), F.count("*").alias("n")).filter((F.col("low.i") >= 5) & (F.col("low.i") < F.col("n") - 3))
    y = x.join(low, ["market", "ticker"])
    peak = y.filter("i < low.i").groupBy("market", "ticker").agg(F.max("c").alias("peak"))
    hit = y.filter((F.col("i") >= F.col("low.i") + 3) & (F.col("c") / F.col("c1") - 1 >= 0.015) & (F.col("v") > F.col("v1")) & (F.col("v1") > 0)).join(peak, ["market", "ticker"]).filter(F.col("low.c") <= F.col("peak") * 0.94)
    return hit.groupBy("market", "ticker").agg(F.min(F.struct("i", "d", "c", "c1", "low", "n")).alias("x")).select("market", F.col("x.d").alias("d"), (F.col("x.i") - F.col("x.low.i") + 1).alias("day_of_rally"), ((F.col("x.c") / F.col("x.c1") - 1) * 100).alias("pct"), (F.col("x.i") >= F.col("x.n") - 5).alias("recent"))


def breadth(newest: DataFrame) -> DataFrame:
    """Per market the shares of tickers with 200 bars that stand above their means, and new highs and lows."""
    x = newest.filter("k >= 200")
    return x.groupBy("market").agg(
        (F.count_if(F.col("c") > F.col("ma200")) / F.count("*") * 100).alias("above_200"),
        (F.count_if(F.col("c") > F.col("ma50")) / F.count("*") * 100).alias("above_50"),
        F.count_if(F.col("c") >= F.col("hi252") * 0.998).alias("new_highs"),
        F.count_if(F.col("c") <= F.col("lo252") * 1.002).alias("new_lows"),
        F.count("*").alias("universe"),
    )


def group_bars(bars: DataFrame) -> DataFrame:
    """Each industry's mean close and volume by day, as bars of one ticker (the industry) that stand in for sector funds; bars: with a column industry."""
    g = bars.groupBy("market", F.col("industry").alias("ticker"), "d")
    return g.agg(*((F.sum(x) / F.count(x)).alias(x) for x in ("o", "h", "l", "c")), F.sum("v").alias("v"))


def rotation(groups: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Groups (newest feature rows) against the market's benchmark (one such row a market): momentum over 21 and 63 bars, the same less the benchmark's, quadrant, direction, place.

    Groups of fewer than 260 bars or without a momentum have no row; a benchmark without one counts as 0. Places are by
    raw momentum, ties by name. A group rotates in when its short relative momentum is above the long one and positive,
    out when below and negative.
    """
    short, long = F.col("c") / F.col("c21") - 1, F.col("c") / F.col("c63") - 1
    base = benchmark.select("market", F.coalesce(short, F.lit(0.0)).alias("_short"), F.coalesce(long, F.lit(0.0)).alias("_long"))
    x = groups.filter("k >= 260 and rs_raw is not null and c21 is not null and c63 is not null").join(base, "market")
    x = x.withColumns({"short": short, "long": long, "rel_short": short - F.col("_short"), "rel_long": long - F.col("_long")})
    s, g = F.col("rel_short"), F.col("rel_long")
    quadrant = F.when((g >= 0) & (s >= 0), "leading").when(g >= 0, "weakening").when(s >= 0, "improving").otherwise("lagging")
    place = F.row_number().over(Window.partitionBy("market").orderBy(F.desc("rs_raw"), "ticker"))
    return x.withColumns({"quadrant": quadrant, "rotating_in": (s > g) & (s > 0), "rotating_out": (s < g) & (s < 0), "place": place})

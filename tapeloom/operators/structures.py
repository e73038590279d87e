"""Swings and the structures built from them: contractions, zones, candle and chart patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.frames import newest_first

SPAN = 5


def _tail(bars: DataFrame, lookback: int) -> DataFrame:
    """The newest lookback bars of each ticker, with their place i from 0 and their number n; edges of windows are the tail's."""
    t = bars.withColumn("_r", F.row_number().over(newest_first())).filter(F.col("_r") <= lookback).drop("_r")
    w = Window.partitionBy("market", "ticker")
    return t.withColumn("i", (F.row_number().over(w.orderBy("d")) - 1).cast("int")).withColumn("n", F.count("*").over(w).cast("int"))


def swings(bars: DataFrame, lookback: int) -> DataFrame:
    """The tail with flags high and low where a bar is the extreme of the eleven around it; the first and last five never are."""
    w = Window.partitionBy("market", "ticker").orderBy("i").rowsBetween(-SPAN, SPAN)
    inner = (F.col("i") >= SPAN) & (F.col("i") < F.col("n") - SPAN)
    return _tail(bars, lookback).withColumns({"high": inner & (F.max("h").over(w) == F.col("h")), "low": inner & (F.min("l").over(w) == F.col("l"))})


def contractions(bars: DataFrame, lookback: int = 75) -> DataFrame:
    """Per ticker with 40 bars: contraction depths in order (per cent), volume dry-up, pivot, vcp.

    Each swing high pairs with the deepest swing low before the next swing high; ties take the earliest low.
    """
    s = swings(bars, lookback).filter("n >= 40")
    w = Window.partitionBy("market", "ticker").orderBy("i")
    legs = s.withColumn("leg", F.sum(F.col("high").cast("int")).over(w)).filter("leg > 0")
    leg = legs.groupBy("market", "ticker", "leg").agg(F.max(F.when(F.col("high"), F.struct("i", "h"))).alias("top"), F.min(F.when(F.col("low") & ~F.col("high"), F.col("l"))).alias("bottom"))
    deep = leg.withColumn("depth", (F.col("top.h") - F.col("bottom")) / F.col("top.h") * 100)
    listed = deep.groupBy("market", "ticker").agg(
        F.transform(F.array_sort(F.collect_list(F.when((F.col("depth") > 0) & (F.col("depth") < 40), F.struct("leg", "depth")))), lambda x: x["depth"]).alias("depths"),
        F.reverse(F.array_sort(F.collect_list("top"))).alias("tops"),
    )
    new = bars.withColumn("_r", F.row_number().over(newest_first()))
    volume = new.groupBy("market", "ticker").agg(F.count("*").alias("n"), F.avg(F.when(F.col("_r") <= 5, F.col("v"))).alias("vol5"), F.avg(F.when((F.col("_r") > 5) & (F.col("_r") <= 55), F.col("v"))).alias("vol50")).filter("n >= 40")
    d, size = F.col("depths"), F.size("depths")
    out = volume.join(listed, ["market", "ticker"], "left").withColumn("depths", F.coalesce("depths", F.array().cast("array<double>")))
    worse = F.size(F.filter(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda k: (k < size) & (F.get(d, k) >= F.get(d, k - 1))))
    shrinking = (size >= 2) & (F.get(d, size - 1) < F.get(d, F.lit(0))) & (F.get(d, size - 1) < 12.05) & (worse <= 1)
    dry = F.coalesce((F.col("n") >= 55) & (F.col("vol50") > 0) & (F.col("vol5") < 0.6 * F.col("vol50")), F.lit(False))
    first, second = F.get("tops", F.lit(0))["h"], F.get("tops", F.lit(1))["h"]
    pivot = F.when(F.col("tops").isNotNull(), F.greatest(first, second))
    return out.select("market", "ticker", "depths", dry.alias("dry_up"), pivot.alias("pivot"), F.coalesce(shrinking & dry & pivot.isNotNull(), F.lit(False)).alias("vcp"))


def candle_shapes(df: DataFrame) -> DataFrame:
    """Shapes of each bar against the one before, as flags: exact rules on open, high, low, close."""
    o, h, low, c, po, pc = (F.col(x) for x in ("o", "h", "l", "c", "o1", "c1"))
    span, body = h - low, F.abs(c - o)
    lower, upper = F.least(o, c) - low, h - F.greatest(o, c)
    on = span > 0
    w7 = Window.partitionBy("market", "ticker").orderBy("d").rowsBetween(-6, 0)
    shapes = {
        "doji": on & (body < 0.15 * span),
        "hammer": on & (lower > 2 * body) & (upper < body),
        "shooting_star": on & (upper > 2 * body) & (lower < body),
        "bullish_engulfing": on & (c > o) & (pc < po) & (c > po) & (o < pc),
        "bearish_engulfing": on & (c < o) & (pc > po) & (c < po) & (o > pc),
        "inside_day": (h < F.col("h1")) & (low > F.col("l1")),
        "nr7": span == F.min(span).over(w7),
        "gap_up": low > F.col("h1"),
    }
    return df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in shapes.items()})


def double_bottoms(bars: DataFrame, lookback: int = 120) -> DataFrame:
    """The first pair of consecutive swing lows within 3 % and 10 bars apart or more, with a swing high 6 % above between them that the price has nearly cleared."""
    s = swings(bars, lookback).filter("n >= 45")
    last = s.filter("i = n - 1").select("market", "ticker", F.col("c").alias("price"))
    w = Window.partitionBy("market", "ticker").orderBy("i")
    lows = s.filter("low").select("market", "ticker", F.col("i").alias("i1"), F.col("l").alias("l1"), F.lead("i").over(w).alias("i2"), F.lead("l").over(w).alias("l2")).filter("i2 - i1 >= 10 and abs(l1 - l2) / l1 <= 0.03")
    tops = s.filter("high").select("market", "ticker", F.col("i").alias("j"), F.col("h").alias("top"))
    between = lows.join(tops, ["market", "ticker"]).filter("i1 < j and j < i2").groupBy("market", "ticker", "i1", "l1", "i2", "l2").agg(F.max("top").alias("middle"))
    hit = between.join(last, ["market", "ticker"]).filter((F.col("middle") >= F.least("l1", "l2") * 1.06) & (F.col("price") > F.col("middle") * 0.97))
    return hit.groupBy("market", "ticker").agg(F.min(F.struct("i1", "i2", "l1", "l2", "middle")).alias("x")).select("market", "ticker", "x.*")


def double_tops(bars: DataFrame, lookback: int = 120) -> DataFrame:
    """The mirror image, whose second peak lies within the last 40 bars and which the price has left by 1 %."""
    s = swings(bars, lookback).filter("n >= 45")
    last = s.filter("i = n - 1").select("market", "ticker", F.col("c").alias("price"), F.col("n").alias("bars"))
    w = Window.partitionBy("market", "ticker").orderBy("i")
    tops = s.filter("high").select("market", "ticker", F.col("i").alias("i1"), F.col("h").alias("h1"), F.lead("i").over(w).alias("i2"), F.lead("h").over(w).alias("h2")).filter("i2 - i1 >= 10 and abs(h1 - h2) / h1 <= 0.03")
    lows = s.filter("low").select("market", "ticker", F.col("i").alias("j"), F.col("l").alias("bottom"))
    between = tops.join(lows, ["market", "ticker"]).filter("i1 < j and j < i2").groupBy("market", "ticker", "i1", "h1", "i2", "h2").agg(F.min("bottom").alias("middle"))
    hit = between.join(last, ["market", "ticker"]).filter((F.col("i2") >= F.col("bars") - 40) & (F.col("middle") <= F.greatest("h1", "h2") * 0.94) & (F.col("price") < F.greatest("h1", "h2") * 0.99))
    return hit.groupBy("market", "ticker").agg(F.min(F.struct("i1", "i2", "h1", "h2", "middle")).alias("x")).select("market", "ticker", "x.*")


def zones(bars: DataFrame, lookback: int = 250) -> DataFrame:
    """Price zones of swings: sorted swing prices join while the gap stays within 1.5 % or half the mean true range; visits of a zone end after three bars outside."""
    s = swings(bars, lookback)
    w = Window.partitionBy("market", "ticker")
    before = F.lag("c").over(w.orderBy("i"))
    span = F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - before), F.abs(F.col("l") - before))
    t = s.withColumn("tr", span)
    atr = t.filter("i >= n - 14").groupBy("market", "ticker").agg(F.avg("tr").alias("atr"), F.max(F.struct("i", "c")).alias("_c"), F.max("n").alias("n")).select("market", "ticker", "atr", "n", F.col("_c.c").alias("price"))
    points = s.filter("high").select("market", "ticker", F.col("h").alias("p")).union(s.filter("low").select("market", "ticker", F.col("l").alias("p"))).join(atr, ["market", "ticker"])
    by_price = w.orderBy("p")
    gap = F.col("p") - F.lag("p").over(by_price)
    island = points.withColumn("z", F.sum(F.when(gap > F.greatest(F.lag("p").over(by_price) * 0.015, 0.5 * F.col("atr")), 1).otherwise(0)).over(by_price))
    zone = island.groupBy("market", "ticker", "z").agg((F.min("p") - 0.25 * F.max("atr")).alias("lo"), (F.max("p") + 0.25 * F.max("atr")).alias("hi"), F.max("price").alias("price"), F.max("n").alias("bars"))
    inside = zone.join(s.select("market", "ticker", "i", "h", "l"), ["market", "ticker"]).filter("l <= hi and h >= lo")
    by_zone = Window.partitionBy("market", "ticker", "z").orderBy("i")
    begin = F.lag("i").over(by_zone).isNull() | (F.col("i") - F.lag("i").over(by_zone) > 3)
    visits = inside.withColumn("begin", begin).groupBy("market", "ticker", "z", "lo", "hi", "price", "bars").agg(
        F.count_if("begin").alias("touches"), F.sum(F.when(F.col("begin"), F.when(F.col("i") >= F.col("bars") - 63, 2).otherwise(1)).otherwise(0)).alias("weighted"), F.max("i").alias("last")
    )
    out = visits.filter("touches >= 2").withColumn("mid", (F.col("lo") + F.col("hi")) / 2).withColumn("side", F.when(F.col("mid") < F.col("price"), "support").otherwise("resistance")).withColumn("strong", F.col("weighted") >= 3)
    order = Window.partitionBy("market", "ticker", "side").orderBy(F.desc("strong"), F.abs(F.col("mid") - F.col("price")), "mid")
    return out.withColumn("place", F.row_number().over(order)).filter("place <= 2").select("market", "ticker", "side", "place", "lo", "hi", "touches", "weighted", "strong", (F.col("bars") - 1 - F.col("last")).alias("last_touch"))

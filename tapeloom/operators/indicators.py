"""Rolling features per ticker, and the rules built on them. All of them read a ticker's own bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom import config
from tapeloom.functions.frames import back, block_extremes, extreme, full, mean, newest_first, over, own, percentile_rank, with_totals


def features(bars: DataFrame) -> DataFrame:
    """Bars with the windows that most rules share: one exchange, one sort."""
    blocks = block_extremes(with_totals(bars, "c", "v"), h=(F.max, "h"), l=(F.min, "l"))
    first = blocks.select(
        *bars.columns,
        F.row_number().over(own()).alias("k"),
        *(mean("c", n).alias(f"ma{n}") for n in (10, 20, 50, 150, 200)),
        extreme("h", True, 252).alias("hi252"),
        extreme("l", False, 252).alias("lo252"),
        mean("v", 50, 1).alias("vol50"),
        *(back("c", n).alias(f"c{n}") for n in (1, 5, 6, 10, 20, 21, 63, 126, 189, 252)),
        back("h").alias("h1"),
        back("l").alias("l1"),
        back("o").alias("o1"),
        back("v").alias("v1"),
    )
    return first.withColumn("ma200_22", back("ma200", 22)).withColumn("rs_raw", rs_raw())


def rs_raw() -> Column:
    """Weighted momentum over the legs that exist; null under 126 bars or on a base that is not positive."""
    legs = [(w, F.col(f"c{n}")) for w, n in config.LEGS]
    total = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), F.lit(w) * (F.col("c") / F.when(x > 0, x))).otherwise(F.lit(0.0)) for w, x in legs])
    weight = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, x in legs])
    return F.when((F.col("k") >= config.YOUNG_BARS) & F.col("c63").isNotNull(), total / weight)


def newest(df: DataFrame) -> DataFrame:
    """The newest bar of each ticker."""
    return df.withColumn("_r", F.row_number().over(newest_first())).filter("_r = 1").drop("_r")


def with_rank(df: DataFrame) -> DataFrame:
    """rs_rank 1..99 within the market and day; null where there is no score."""
    return df.withColumn("rs_pct", percentile_rank("rs_raw", "market")).withColumn("rs_rank", F.greatest(F.lit(1), F.least(F.lit(99), F.bround(F.col("rs_pct") * 99))).cast("int")).withColumn("rs_rank", F.when(F.col("rs_raw").isNotNull(), F.col("rs_rank")))


def template(df: DataFrame) -> DataFrame:
    """checks: struct of the rules that a ticker's history allows (null: not evaluated); passed, total, failed, pass_all."""
    whole, mid = F.col("k") >= config.FULL_BARS, F.col("k") >= 152
    c = F.col("c")
    rules = {
        "price_above_150_200": F.when(whole, (c > F.col("ma150")) & (c > F.col("ma200"))).when(mid, c > F.col("ma150")),
        "ma150_above_ma200": F.when(whole, F.col("ma150") > F.col("ma200")),
        "ma200_rising_1m": F.when(whole, F.coalesce(F.col("ma200") > F.col("ma200_22"), F.lit(False))),
        "ma50_above_150_200": F.when(whole, (F.col("ma50") > F.col("ma150")) & (F.col("ma50") > F.col("ma200"))).when(mid, F.col("ma50") > F.col("ma150")),
        "price_above_ma50": c > F.col("ma50"),
        "above_52w_low_30pct": c >= F.col("lo252") * 1.30,
        "within_25pct_of_52w_high": c >= F.col("hi252") * 0.75,
        "rs_rank_ge_70": F.coalesce(F.col("rs_rank") >= 70, F.lit(False)),
    }
    out = df.filter(F.col("k") >= config.YOUNG_BARS).withColumn("checks", F.struct(*(v.alias(k) for k, v in rules.items())))
    got = [F.col(f"checks.{k}") for k in rules]
    return (
        out.withColumn("passed", reduce(lambda a, b: a + b, [F.coalesce(x.cast("int"), F.lit(0)) for x in got]))
        .withColumn("total", reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in got]))
        .withColumn("failed", F.concat_ws(",", *(F.when(~x, F.lit(k)) for k, x in zip(rules, got, strict=True))))
        .withColumn("pass_all", F.col("passed") == F.col("total"))
    )


def pocket_pivot(df: DataFrame, lookback: int = 10) -> DataFrame:
    """An up day in the upper part of its range, at the 10-day mean, on more volume than any down day before it."""
    down = df.withColumn("_down", F.when(F.col("c") < F.col("c1"), F.col("v"))).withColumn("_most", over(F.max, "_down", -lookback, -1))
    hit = (F.col("k") >= 52) & (F.col("c") > F.col("c1")) & (F.col("c") > F.col("ma50")) & (F.col("h") > F.col("l")) & ((F.col("c") - F.col("l")) >= 0.62 * (F.col("h") - F.col("l"))) & (F.col("l") <= F.col("ma10") * 1.02) & (F.col("v") > F.col("_most"))
    return down.withColumn("pocket_pivot", F.coalesce(hit, F.lit(False))).drop("_down", "_most")


def bounce(df: DataFrame, window: int, min_bars: int, rising_lag: int, tag_days: int, stop_span: int, cap: float) -> DataFrame:
    """Pullback to a rising mean: the nearest bar that touched it, within tag_days, must be on light volume."""
    ma = F.col(f"ma{window}")
    tagged = (
        df.withColumn("_lag", back(f"ma{window}", rising_lag))
        .withColumn("_above", over(F.sum, F.coalesce((F.col("c") > ma).cast("int"), F.lit(0)), -39))
        .withColumn("_tag", F.when(F.col("l") <= ma * 1.005, F.struct("k", "v")))
        .withColumn("_near", F.max("_tag").over(own().rowsBetween(-tag_days, -1)))
        .withColumn("stop", over(F.min, "l", 1 - stop_span))
    )
    c, h, low = F.col("c"), F.col("h"), F.col("l")
    risk = (c - F.col("stop")) / c * 100
    hit = (F.col("k") >= min_bars) & (ma > F.col("_lag")) & (F.col("_above") >= 30) & (F.col("_near.v") < F.col("vol50")) & (c > F.col("c1")) & (c > ma) & (h > low) & ((c - low) >= 0.5 * (h - low)) & (F.col("stop") < c) & (risk < cap + 0.05)
    return tagged.withColumn("bounce", F.coalesce(hit, F.lit(False))).withColumn("risk_pct", risk)


def episodic_pivot(df: DataFrame) -> DataFrame:
    o, h, low, c, pc = (F.col(x) for x in ("o", "h", "l", "c", "c1"))
    risk = (h - low) / h * 100
    hit = (F.col("k") >= 70) & (F.col("vol50") > 0) & (h > low) & ((o > F.col("h1")) | ((o / pc - 1) * 100 >= 4)) & ((c / pc - 1) * 100 >= 6) & (F.col("v") / F.col("vol50") >= 3) & (c >= o) & (pc / F.col("c63") <= 1.10) & (risk < 12.05)
    return df.withColumn("episodic", F.coalesce(hit, F.lit(False))).withColumn("risk_pct", risk)


def momentum_burst(df: DataFrame) -> DataFrame:
    c, pc = F.col("c"), F.col("c1")
    hit = (F.col("k") >= 60) & ((c / pc - 1) * 100 >= 4) & (F.col("v") / F.col("vol50") >= 1.5) & (F.col("v") > F.col("v1")) & (F.abs(pc / F.col("c6") - 1) <= 0.03) & (c <= F.col("ma20") * 1.15)
    return df.withColumn("burst", F.coalesce(hit, F.lit(False)))


def atr(n: int = 14) -> Column:
    """Mean true range; the first bar has no close before it."""
    span = F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - F.col("c1")), F.abs(F.col("l") - F.col("c1")))
    return full(F.avg, span, n)


def tightening() -> dict[str, Column]:
    """Ranges of the last ten bars and of the ten before, and the 40-bar high."""
    return {
        "r1": over(F.max, "h", -9) - over(F.min, "l", -9),
        "r0": over(F.max, "h", -19, -10) - over(F.min, "l", -19, -10),
        "hi40": over(F.max, "h", -39),
    }


def volume_profile(df: DataFrame, window: int = 25) -> DataFrame:
    """Up and down closes on more than that day's own prior mean volume, over the last window bars' changes."""
    heavy = F.col("v") > F.col("vol50")
    up = over(F.sum, F.coalesce((heavy & (F.col("c") > F.col("c1"))).cast("int"), F.lit(0)), 2 - window)
    down = over(F.sum, F.coalesce((heavy & (F.col("c") < F.col("c1"))).cast("int"), F.lit(0)), 2 - window)
    out = df.withColumn("accumulation", up).withColumn("distribution", down)
    return out.withColumn("verdict", F.when(F.col("accumulation") >= F.col("distribution") + 3, "accumulation").when(F.col("distribution") >= F.col("accumulation") + 3, "distribution").otherwise("balanced"))


def base_count(bars: DataFrame) -> DataFrame:
    """Bases of the present uptrend: stretches of 15 bars or more without a new high since the last close under the 200-day mean (504 bars at most)."""
    sized = bars.withColumn("_n", F.count("*").over(own().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    below = F.when((F.col("c") < F.col("ma200")) & (F.col("k") > F.col("_n") - 504), F.col("k"))
    every = own().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    since = sized.withColumn("_from", F.greatest(F.coalesce(F.max(below).over(every), F.lit(0)), F.col("_n") - 504)).filter((F.col("k") > F.col("_from")) & (F.col("_n") >= config.FULL_BARS))
    peak = since.withColumn("_peak", F.max("h").over(own().rowsBetween(Window.unboundedPreceding, -1)))
    island = peak.withColumn("_i", F.sum(F.when(F.col("_peak").isNull() | (F.col("h") > F.col("_peak")), 1).otherwise(0)).over(own().rowsBetween(Window.unboundedPreceding, 0)))
    runs = island.groupBy("market", "ticker", "_i").agg(F.count("*").alias("_size"))
    return runs.groupBy("market", "ticker").agg(F.sum("_size").alias("sessions"), F.count_if(F.col("_size") >= 16).alias("_bases")).select("market", "ticker", "sessions", F.when(F.col("sessions") < 20, 0).otherwise(F.col("_bases")).cast("long").alias("bases"))

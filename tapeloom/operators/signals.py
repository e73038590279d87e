"""Entry signals on the market's session clock.

Windows count market sessions, not a ticker's own bars: a session without a bar is a gap that empties every full window
over it. Sessions are numbered per market and windows range over the number, so no grid of empty cells is built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeloom import config
from tapeloom.functions.frames import percentile_rank

# The strategies.
STRATEGIES = ("breakout", "ma20_bounce", "ma50_bounce", "episodic_pivot", "pocket_pivot", "buyable_gap_up", "ma200_reclaim", "undercut_rally", "donchian", "darvas")


def numbered(bars: DataFrame, least: float = 0.2) -> DataFrame:
    """Bars on real sessions (a fifth of the market's tickers trade), with the session's number s in its market.

    A ticker counts for its market from its first bar, so one pass counts sessions and tickers. Sessions are few (days
    of the calendar, for each market) and therefore broadcast; the bars stay dealt by ticker, as every later window wants.
    """
    x = bars.withColumn("_first", (F.row_number().over(Window.partitionBy("market", "ticker").orderBy("d")) == 1).cast("int"))
    days = x.groupBy("market", "d").agg(F.count("c").alias("n"), F.sum("_first").alias("tickers"))
    days = days.withColumn("tickers", F.sum("tickers").over(Window.partitionBy("market"))).filter((F.col("n") > 0) & (F.col("n") / F.col("tickers") >= least))
    days = days.select("market", "d", F.row_number().over(Window.partitionBy("market").orderBy("d")).alias("s"))
    return x.drop("_first").join(F.broadcast(days), ["market", "d"])


def _clock() -> WindowSpec:
    return Window.partitionBy("market", "ticker").orderBy("s")


def _with_totals(x: DataFrame, sums: list[str], counts: list[str]) -> DataFrame:
    """Running sums `_s_x` and counts `_n_x`; see frames.with_totals for what that spares and how it rounds."""
    every = _clock().rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumns({f"_s_{c}": F.sum(c).over(every) for c in sums} | {f"_n_{c}": F.count(c).over(every) for c in counts})


def _until(name: str, n: int) -> Column:
    """A running total as it stood n sessions ago, whether or not that session has a bar."""
    return F.coalesce(F.last(name).over(_clock().rangeBetween(Window.unboundedPreceding, -n)) if n else F.col(name), F.lit(0))


def _values(x: str, n: int, gap: int = 0) -> Column:
    return _until(f"_n_{x}", gap) - _until(f"_n_{x}", gap + n)


def _mean(x: str, n: int, gap: int = 0) -> Column:
    """Mean of the n sessions that end gap sessions ago; null if one of them has no value."""
    return F.when(_values(x, n, gap) == n, (_until(f"_s_{x}", gap) - _until(f"_s_{x}", gap + n)) / n)


def _at(f: Callable, x: Column | str, first: int, last: int = 0) -> Column:
    return f(F.col(x) if isinstance(x, str) else x).over(_clock().rangeBetween(first, last))


def _full(f: Callable, x: Column | str, n: int, gap: int = 0) -> Column:
    return F.when(_at(F.count, x, 1 - n - gap, -gap) == n, _at(f, x, 1 - n - gap, -gap))


def _back(x: Column | str, n: int = 1) -> Column:
    return _at(F.max, x, -n, -n)


def _times(flag: Column, n: int) -> Column:
    """How often flag held in the last n sessions; null before session n. A gap counts as not."""
    return F.when(F.col("s") >= n, _at(F.sum, F.coalesce(flag.cast("int"), F.lit(0)), 1 - n))


def session_features(bars: DataFrame) -> DataFrame:
    """Numbered bars with the shared windows, the daily momentum rank and the trend gate tt."""
    x = numbered(bars)
    x = _with_totals(x, ["c", "v"], ["c", "v", "h", "l"]).select(
        *x.columns,
        *(_mean("c", n).alias(f"ma{n}") for n in (10, 20, 50, 150, 200)),
        F.when(_values("h", 252) >= 126, _at(F.max, "h", -251)).alias("hi52"),
        F.when(_values("l", 252) >= 126, _at(F.min, "l", -251)).alias("lo52"),
        _mean("v", 50, 1).alias("vol50"),
        *(_back("c", n).alias(f"c{n}") for n in (1, 63, 64, 126, 189, 252)),
        _back("h").alias("h1"),
        F.when(_values("h", 25, 1) == 25, _at(F.max, "h", -25, -1)).alias("pivot"),
        F.when(_values("h", 25, 2) == 25, _at(F.max, "h", -26, -2)).alias("pivot1"),
    )
    legs = [(w, F.col(f"c{n}")) for w, n in config.LEGS]
    weight = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, v in legs])
    total = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(w) * (F.col("c") / v)).otherwise(F.lit(0.0)) for w, v in legs])
    x = x.withColumn("mom", F.when(weight > 0.39, total / weight)).withColumn("ma200_22", _back("ma200", 22))
    x = x.withColumn("rs_rank", percentile_rank("mom", "market", "s") * 99)
    c = F.col("c")
    rising = (F.col("ma150") > F.col("ma200")) & (F.col("ma200") > F.col("ma200_22")) & (F.col("ma50") > F.col("ma150")) & (F.col("ma50") > F.col("ma200"))
    above = (c > F.col("ma150")) & (c > F.col("ma200")) & (c > F.col("ma50")) & (c >= F.col("lo52") * 1.30) & (c >= F.col("hi52") * 0.75)
    gate = rising & above & (F.col("rs_rank") >= 70)
    return x.withColumn("tt", F.coalesce(gate, F.lit(False)))


def signals(x: DataFrame, strategy: str) -> DataFrame:
    """Session features with the flag signal of one strategy."""
    o, h, low, c, v, vol50 = (F.col(k) for k in ("o", "h", "l", "c", "v", "vol50"))
    strong = (c - low) >= 0.5 * (h - low)
    if strategy in ("ma20_bounce", "ma50_bounce"):
        window, lag, tag = (20, 5, 4) if strategy == "ma20_bounce" else (50, 10, 5)
        ma = F.col(f"ma{window}")
        light = F.when(F.col("s") > tag, _at(F.max, F.coalesce(((low <= ma * 1.005) & (v < vol50)).cast("int"), F.lit(0)), -tag, -1))
        x = x.withColumns({"_was": _back(f"ma{window}", lag), "_above": _times(c > ma, 40), "_light": light})
        hit = F.col("tt") & (ma > F.col("_was")) & (F.col("_above") >= 30) & (F.col("_light") > 0) & (c > F.col("c1")) & (c > ma) & strong
    elif strategy == "episodic_pivot":
        hit = ((o > F.col("h1")) | (o >= F.col("c1") * 1.04)) & (c / F.col("c1") - 1 >= 0.06) & (v / vol50 >= 3) & (c >= o) & (F.col("c1") / F.col("c64") <= 1.10)
    elif strategy == "donchian":
        x = x.withColumns({"_top": _full(F.max, "h", 20, 1), "_top1": _full(F.max, "h", 20, 2)})
        hit = (c > F.col("_top")) & (F.col("c1") <= F.col("_top1"))
    elif strategy == "darvas":
        x = x.withColumn("_box", _full(F.max, "h", 60, 10))
        x = x.withColumns({"_box1": _back("_box"), "_in": _times(h <= F.col("_box"), 10), "_on": _times(low >= F.col("_box") * 0.92, 10)})
        hit = (c > F.col("_box")) & (F.col("c1") <= F.col("_box1")) & (F.col("_in") >= 9) & (F.col("_on") >= 9) & (v > 1.4 * vol50)
    elif strategy == "ma200_reclaim":
        x = x.withColumns({"_below": _times(c < F.col("ma200"), 90), "_ma1": _back("ma200"), "_ma20": _back("ma200", 20)})
        hit = (F.col("_below") >= 40) & (c > F.col("ma200")) & (F.col("c1") <= F.col("_ma1")) & (F.col("ma200") >= F.col("_ma20") * 0.98) & (v > 1.4 * vol50) & strong
    elif strategy == "undercut_rally":
        x = x.withColumn("_low", _full(F.min, "l", 40, 5))
        x = x.withColumn("_under", _times(low <= F.col("_low"), 5))
        hit = (F.col("_under") >= 1) & (c > F.col("_low")) & (F.col("c1") <= F.col("_low")) & (v > 1.2 * vol50) & (c > F.col("c1")) & strong
    elif strategy == "pocket_pivot":
        x = x.withColumn("_down", F.when(c < F.col("c1"), v))
        x = x.withColumn("_most", _at(F.max, "_down", -10, -1))
        hit = F.col("tt") & (c > F.col("c1")) & (c > F.col("ma50")) & (h > low) & ((c - low) >= 0.62 * (h - low)) & (low <= F.col("ma10") * 1.02) & (v > F.col("_most"))
    elif strategy == "buyable_gap_up":
        hit = F.col("tt") & (low > F.col("h1")) & (v / vol50 >= 2) & (c > o) & (c >= F.col("pivot") * 0.98)
    elif strategy == "breakout":
        hit = F.col("tt") & (c > F.col("pivot")) & (F.col("c1") <= F.col("pivot1")) & (v > 1.4 * vol50)
    else:
        raise ValueError(f"no such strategy: {strategy}")
    return x.withColumn("signal", F.coalesce(hit, F.lit(False)))


def fired(x: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Session features with the names of the strategies whose signal a bar gives: all of them in one pass over the windows."""
    kept = x.columns
    for name in strategies:
        x = signals(x.select(*kept, *(c for c in x.columns if c.startswith("_fired_"))), name).withColumn(f"_fired_{name}", F.col("signal"))
    names = F.array(*(F.when(F.col(f"_fired_{name}"), F.lit(name)) for name in strategies))
    return x.select(*kept, F.array_compact(names).alias("fired"))

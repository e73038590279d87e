"""The board: rank the whole market, keep the tradeable, judge each setup, sort into buckets, cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom import config
from tapeloom.functions.frames import newest_first, over
from tapeloom.operators import indicators as ind
from tapeloom.operators import structures as st

KEY = ["market", "ticker"]
#: Arguments of the two pullback entries: mean, least bars, bars it must have risen over, tag days, stop span, risk cap.
BOUNCES = {"ma20": (20, 60, 5, 4, 6, 8.0), "ma50": (50, 120, 10, 5, 7, 10.0)}


def per_market(key: str) -> Column:
    """A market's fixed value; null for a market that has none."""
    return F.create_map(*(F.lit(x) for m, v in config.MARKETS.items() for x in (m, v[key])))[F.col("market")]


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


#: Bars of a ticker that its newest bar is judged by: the longest window is 252, the oldest rule asks for 260.
RECENT = 300


def recent(bars: DataFrame, n: int = RECENT) -> DataFrame:
    """The newest n bars of each ticker: the cut comes before the exchange, so older bars move nowhere."""
    return bars.withColumn("_r", F.row_number().over(newest_first())).filter(F.col("_r") <= n).drop("_r")


def setups(bars: DataFrame) -> DataFrame:
    """The newest bar of each ticker with every window that its setup is judged by."""
    x = ind.volume_profile(ind.features(bars)).withColumns(
        ind.tightening()
        | {
            "low10": over(F.min, "l", -9),
            "best9": over(F.max, "c", -9, -1),
            "depth75": (over(F.max, "h", -74) - over(F.min, "l", -74)) / over(F.max, "h", -74) * 100,
            "high5": over(F.max, "h", -4),
            "low8": over(F.min, "l", -7),
            "adr": F.round(over(F.avg, F.col("h") / F.col("l") - 1, -19) * 100, 2),
            "value20": over(F.avg, F.col("c") * F.col("v"), -19),
            "atr": ind.atr(),
        }
    )
    for name, how in BOUNCES.items():
        y = ind.bounce(x, *how)
        x = y.select(*x.columns, F.col("bounce").alias(f"{name}_bounce"), F.col("stop").alias(f"{name}_stop"))
    x = ind.momentum_burst(ind.episodic_pivot(x).drop("risk_pct"))
    return ind.newest(x)


def liquid(newest: DataFrame) -> DataFrame:
    """Tickers at or above their market's floors of price and of 20-day mean value. Applied after ranking, never before."""
    return newest.filter((F.col("c") >= per_market("price")) & (F.col("value20") >= per_market("value")))


def early_entry(pivot: Column) -> dict[str, Column]:
    """Trigger and stop inside the base: over the last five highs, while the price stands 2 to 20 % below the pivot.

    A stop further than 8 % is set at 6 % below the trigger. Nulls where there is no such entry.
    """
    c, trigger, low = F.col("c"), F.col("high5"), F.col("low8")
    inside = (F.col("k") >= 30) & (c < pivot * 0.98) & (c >= pivot * 0.80) & (trigger < pivot) & (trigger > c * 0.995) & (low < trigger * 0.99)
    wide = F.round((trigger - low) / trigger * 100, 1) > 8
    return {"early_trigger": F.when(inside, trigger), "early_stop": F.when(inside, F.when(wide, trigger * 0.94).otherwise(low))}


def stop_for(entry: Column) -> Column:
    """The higher of the ten-day low and 8 % below the entry; that floor where the low is not below the entry."""
    best = F.greatest(F.col("low10"), entry * 0.92)
    return F.when(best >= entry, entry * 0.92).otherwise(best)


def targets(entry: Column, stop: Column) -> dict[str, Column]:
    """Risk and profit levels of twice and three times it; null where risk is not positive."""
    risk = F.when(entry > stop, entry - stop)
    return {"risk_share": risk, "risk_pct": risk / entry * 100, "target2r": entry + 2 * risk, "target3r": entry + 3 * risk}


def judge(x: DataFrame) -> DataFrame:
    """Setups (with template checks and contractions) with bucket, quality, tactic, entry, stop, targets, warnings and flags.

    A pivot more than a quarter overhead is no entry. The buckets: `forming` where a rule fails; `swing` for a complete
    base inside the buy window, unless the daily range is too small, the price extended, or a grave warning stands
    (these wait as `watchlist`); `watchlist` for other bases; else `position`. A live bounce decides entry and stop.
    """
    c = F.col("c")
    x = x.withColumn("pv", F.when(c >= F.col("pivot") * 0.8, F.col("pivot")))
    from_pivot = c / F.col("pivot") - 1
    extended = F.coalesce(F.round((c / F.col("pv") - 1) * 100, 1) > 5, F.lit(False)) | F.coalesce(F.round((c / F.col("ma50") - 1) * 100, 1) > 25, F.lit(False))
    last, many = F.round(F.get("depths", F.size("depths") - 1), 1), F.size("depths") >= 2
    volume = F.when(F.col("vol50") > 0, F.when(F.col("dry_up"), 15.0).otherwise(0.0) + 15 * clamp(F.col("v") / F.col("vol50") - 1)).otherwise(0.0)
    depth = 25 * clamp((35 - F.col("depth75")) / 20) + F.when(last.isNotNull(), 25 * clamp((12 - last) / 9)).otherwise(0.0)
    overhead = 20 * clamp(1 - (F.col("hi252") - F.coalesce("pivot", "c")) / F.col("hi252") / 0.15)
    tight = F.coalesce((F.col("k") >= 25) & (F.col("r0") > 0) & (F.col("r1") < 0.6 * F.col("r0")) & (c >= F.col("hi40") * 0.9), F.lit(False))
    x = x.withColumns(
        {
            "extended": extended,
            "near": F.coalesce(from_pivot.between(-config.BUY_BELOW, config.BUY_ABOVE), F.lit(False)),
            "quality": F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), depth + volume + overhead))).cast("int"),
            "vol_ratio": F.when(F.col("vol50") > 0, F.round(F.col("v") / F.col("vol50"), 2)),
            "tight": tight,
            "below_50ma": ~F.col("checks.price_above_ma50"),
            "failed_breakout": F.coalesce((F.col("k") >= 12) & (F.col("best9") >= F.col("pv")) & (c < F.col("pv") * 0.99), F.lit(False)),
        }
    )
    grave = {"below_50ma": F.col("below_50ma"), "failed_breakout": F.col("failed_breakout"), "episodic_pivot_unverified": F.col("episodic")}
    light = {"distribution": F.col("distribution") >= F.col("accumulation") + 3, "climax_run": F.coalesce(c / F.col("c10") - 1 >= 0.25, F.lit(False))}
    base = F.when(F.col("near") & ~F.col("extended") & (F.col("adr") >= per_market("adr")), "swing").otherwise("watchlist")
    bucket = F.when(~F.col("pass_all"), "forming").when(F.col("vcp"), base).when(many, "watchlist").otherwise("position")
    demoted = F.when(bucket == "swing", F.concat_ws(",", *(F.when(v, k) for k, v in grave.items())))
    live = {k: F.col("pass_all") & F.col(f"{k}_bounce") for k in BOUNCES}
    pivot_or_price = F.coalesce("pv", "c")
    entry = F.when(live["ma20"] | live["ma50"], c).otherwise(pivot_or_price)
    dist = (F.col("pv") - c) / F.col("pv")
    ready = 30 * (1 - dist / 0.06) + 30 * clamp((12 - last) / 12) + F.when(F.col("dry_up"), 20).otherwise(0) + F.when(tight, 20).otherwise(0)
    x = x.withColumns(
        {
            "bucket": F.when(demoted != "", "watchlist").otherwise(bucket),
            "demoted_by": F.coalesce(demoted, F.lit("")),
            "warnings": F.concat_ws(",", *(F.when(v, k) for k, v in (grave | light).items())),
            "tactic": F.when(live["ma20"], "ma20_bounce").when(live["ma50"], "ma50_bounce").otherwise("breakout"),
            "entry": entry,
            "stop": F.when(live["ma20"], F.col("ma20_stop")).when(live["ma50"], F.col("ma50_stop")).otherwise(stop_for(pivot_or_price)),
            "ready": F.when(many & (c < F.col("pv")) & (dist <= 0.06), F.bround(ready)).cast("int"),
            "gap_up": F.coalesce((F.col("l") > F.col("h1")) & (F.col("vol_ratio") >= 2) & (c > F.col("o")) & (c >= F.col("pv") * 0.98), F.lit(False)),
            "burst": F.col("burst") & ~F.col("episodic"),
        }
        | early_entry(F.col("pv"))
    )
    x = x.withColumns(targets(F.col("entry"), F.col("stop")))
    return x.withColumn("stop_atr", F.when((F.col("atr") > 0) & F.col("risk_share").isNotNull(), F.round(F.col("risk_share") / F.col("atr"), 2)))


def candidates(bars: DataFrame) -> DataFrame:
    """All tickers that reach the board before caps: tradeable, of rank 55 or more, with at most two rules failed.

    The rank comes before any filter: a filtered pool would rank differently.
    """
    bars = recent(bars)
    x = ind.template(liquid(ind.with_rank(setups(bars))).filter(F.col("rs_rank") >= config.RANK_FLOOR))
    return judge(x.filter(F.col("passed") >= F.col("total") - 2).join(st.contractions(bars), KEY))


def capped(x: DataFrame) -> DataFrame:
    """Candidates with their place, by market and bucket, cut at the bucket's cap: swings by quality, others by rank."""
    best = F.when(F.col("bucket") == "swing", F.col("quality")).otherwise(F.col("rs_rank"))
    order = Window.partitionBy("market", "bucket").orderBy(best.desc(), "ticker")
    cap = F.create_map(*(F.lit(y) for kv in config.CAPS.items() for y in kv))[F.col("bucket")]
    return x.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap)


def board(bars: DataFrame) -> DataFrame:
    """The newest board."""
    return capped(candidates(bars))


def position_size(x: DataFrame, equity: float, risk: float = config.RISK, most: float = config.MAX_POSITION) -> DataFrame:
    """Shares of entry and stop columns, in whole lots of the market, at risk of equity and at most a quarter of it; 0 where risk is not positive."""
    lot, per = per_market("lot"), F.col("entry") - F.col("stop")
    n = F.least(F.floor(F.try_divide(F.lit(equity * risk), per)), F.floor(F.try_divide(F.lit(equity * most), F.col("entry"))))
    return x.withColumn("shares", F.when(per > 0, F.floor(n / lot) * lot).otherwise(0).cast("long"))

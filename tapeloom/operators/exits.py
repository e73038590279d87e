"""Sell rules for open positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distribution_weeks(bars: DataFrame) -> DataFrame:
    """Per ticker whether the last two weekly closes each fell and the two weeks' mean volume is above that of the six before.

    Weeks end on Sunday, and the running one counts. It takes four weeks with bars and a span of eight; a week without
    bars has no close and no volume.
    """
    key = ["market", "ticker"]
    week = F.floor(F.datediff("d", F.lit("1970-01-05").cast("date")) / 7)
    weeks = bars.groupBy(*key, week.alias("week")).agg(F.max_by("c", "d").alias("c"), F.sum("v").alias("v"))
    w = Window.partitionBy(*key)
    x = weeks.withColumns({"r": F.row_number().over(w.orderBy(F.desc("week"))), "ago": F.max("week").over(w) - F.col("week")})
    close = {r: F.max(F.when(F.col("r") == r, F.col("c"))) for r in (1, 2, 3)}
    recent, before = F.sum(F.when(F.col("ago") <= 1, F.col("v"))) / 2, F.coalesce(F.sum(F.when(F.col("ago").between(2, 7), F.col("v"))), F.lit(0)) / 6
    flag = (F.count("*") >= 4) & (close[1] < close[2]) & (close[2] < close[3]) & (F.max("ago") >= 7) & (recent > before)
    return x.groupBy(*key).agg(F.coalesce(flag, F.lit(False)).alias("distribution_weeks"))


def exit_signals(df: DataFrame) -> DataFrame:
    """signals: a struct of rules over a newest bar with entry, stop, pivot (may be null), held and distribution_weeks; null inputs fire nothing.

    time_stop: no 2 % in five sessions; failed_breakout: bought over the pivot, now under it; climax_run: 25 % in ten
    bars; line_failure: bought at the pivot, now 1 % under it; sell_strength: 15 % over the pivot within 21 sessions.
    heavy_volume is a detail of below_50ma: half as much again as the mean of the 50 bars before.
    """
    c, entry, stop, pivot, held = (F.col(x) for x in ("c", "entry", "stop", "pivot", "held"))
    rules = {
        "time_stop": (held >= 5) & (c < entry * 1.02) & (c >= stop),
        "stop_violated": c < stop,
        "below_50ma": c < F.col("ma50"),
        "failed_breakout": (entry >= pivot) & (c < pivot),
        "distribution_weeks": F.col("distribution_weeks"),
        "climax_run": c / F.col("c10") - 1 >= 0.25,
        "line_failure": (entry >= pivot * 0.97) & (c < pivot * 0.99),
        "sell_strength": (c >= pivot * 1.15) & (held.isNull() | (held <= 21)),
    }
    heavy = F.coalesce((F.col("vol50") > 0) & (F.col("v") > 1.5 * F.col("vol50")), F.lit(False))
    return df.withColumn("signals", F.struct(*(F.coalesce(v, F.lit(False)).alias(k) for k, v in rules.items()))).withColumn("heavy_volume", heavy)

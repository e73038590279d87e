"""Receipts: what a board's picks were, graded on later bars, kept for good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators import evaluation as ev
from tapeloom.operators.storage import newest, upsert
from tapeloom.sources.vendor import finite

KEY = ["d", "ticker", "kind"]
SIGNAL = ["market", "ticker", "d", "kind", "trigger", "stop", "target"]


def from_board(rows: DataFrame) -> DataFrame:
    """Up to five signals per board row: market, ticker, d, kind, trigger, stop, target.

    A breakout (at the pivot) and an early entry count only in buckets built on a base (swing, watchlist); bounces and
    episodic pivots in any. Targets lie at twice the risk, a breakout's at target2r. What lacks a price is no signal.
    rows: market, ticker, d, bucket, pivot, stop, target2r and <kind>_trigger, <kind>_stop of early_entry, ma20_bounce,
    ma50_bounce, episodic_pivot.
    """
    based = F.col("bucket").isin("swing", "watchlist")

    def signal(kind: str, trigger: Column, stop: Column, target: Column, on: Column) -> Column:
        sound = on & (trigger > 0) & (stop > 0) & (target > 0)
        return F.when(sound, F.struct(F.lit(kind).alias("kind"), trigger.alias("trigger"), stop.alias("stop"), target.alias("target")))

    found = [signal("breakout", F.col("pivot"), F.col("stop"), F.col("target2r"), based)]
    for kind in ("early_entry", "ma20_bounce", "ma50_bounce", "episodic_pivot"):
        trigger, stop = F.col(f"{kind}_trigger"), F.col(f"{kind}_stop")
        found.append(signal(kind, trigger, stop, trigger + 2 * (trigger - stop), based if kind == "early_entry" else F.lit(True)))
    return rows.select("market", "ticker", "d", F.explode(F.array_compact(F.array(*found))).alias("x")).select("market", "ticker", "d", "x.*")


def first_sightings(signals: DataFrame) -> DataFrame:
    """One signal per ticker, kind and trigger to the cent: the earliest; of one day, the one of the lowest stop."""
    x = signals.filter("trigger is not null and stop is not null and target is not null").withColumn("_cents", F.round(F.col("trigger"), 2))
    return newest(x, 1, [F.asc("d"), F.asc("stop")], ["ticker", "kind", "_cents"]).select(SIGNAL)


def evaluate(outcomes: DataFrame, board: DataFrame, bars: DataFrame, run_day: str, days: int = 90) -> DataFrame:
    """The outcomes table after a run: all signals on record and those of boards of the last days, graded on bars after their day.

    outcomes: SIGNAL, eval_d, triggered, outcome, r, days_to_trigger. A signal whose ticker has no later bar keeps its
    row as it was, and none is ever deleted: dropping those that left the universe would drop mostly losers.
    """
    run = F.lit(run_day).cast("date")
    picks = from_board(board.filter((F.col("d") < run) & (F.col("d") >= F.date_sub(run, days))))
    signals = first_sightings(outcomes.select(SIGNAL).unionByName(picks))
    last = bars.groupBy("market", "ticker").agg(F.max("d").alias("_last"))
    live = signals.join(last, ["market", "ticker"]).filter(F.col("_last") > F.col("d")).drop("_last")
    graded = ev.grade(live, bars).withColumn("eval_d", run)
    return upsert(outcomes, graded.select(outcomes.columns), KEY)


def board_tickers(board: DataFrame) -> DataFrame:
    """Tickers of the newest board."""
    last = board.agg(F.max("d").alias("d"))
    return board.join(F.broadcast(last), "d").select("ticker").distinct()


def curve_statistics(curve: DataFrame, start: float) -> DataFrame:
    """Per market of an equity curve (market, d, equity): days, final equity, yearly growth, largest fall, volatility and ratios of daily returns (252 a year); nulls where not finite.

    A year has 365.25 days; growth is from start to the last day over the time between first and last day.
    """
    w = Window.partitionBy("market").orderBy("d")
    x = curve.withColumns({"_peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_ret": F.col("equity") / F.lag("equity").over(w) - 1})
    g = x.groupBy("market").agg(
        F.count("*").alias("days"),
        F.max_by("equity", "d").alias("final_equity"),
        F.datediff(F.max("d"), F.min("d")).alias("_span"),
        (F.min(F.col("equity") / F.col("_peak") - 1) * 100).alias("max_drawdown"),
        F.avg("_ret").alias("_mean"),
        F.stddev_samp("_ret").alias("_sd"),
        F.stddev_samp(F.when(F.col("_ret") < 0, F.col("_ret"))).alias("_down"),
    )
    year = F.lit(252.0)
    return g.select(
        "market", "days", "final_equity",
        finite((F.pow(F.col("final_equity") / start, F.lit(365.25) / F.greatest(F.col("_span"), F.lit(1))) - 1) * 100).alias("growth"),
        "max_drawdown",
        finite(F.col("_sd") * F.sqrt(year) * 100).alias("volatility"),
        finite(F.try_divide("_mean", "_sd") * F.sqrt(year)).alias("sharpe"),
        finite(F.try_divide("_mean", "_down") * F.sqrt(year)).alias("sortino"),
    )


def monthly_returns(curve: DataFrame) -> DataFrame:
    """Compounded return of each market, year and month: the month's last equity over the last before it (the first month: over its first)."""
    m = curve.groupBy("market", F.year("d").alias("year"), F.month("d").alias("month")).agg(F.max_by("equity", "d").alias("last"), F.min_by("equity", "d").alias("first"))
    before = F.lag("last").over(Window.partitionBy("market").orderBy("year", "month"))
    return m.select("market", "year", "month", ((F.col("last") / F.coalesce(before, "first") - 1) * 100).alias("pct"))


def worst_drawdowns(curve: DataFrame, n: int = 5) -> DataFrame:
    """The n deepest falls of each market: first and last day below the peak before, calendar days between them and the depth; ties go to the earlier."""
    w = Window.partitionBy("market").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    x = curve.withColumn("_peak", F.max("equity").over(w)).withColumn("_fall", F.col("equity") / F.col("_peak") - 1)
    x = x.withColumn("_run", F.sum((F.col("_fall") >= 0).cast("int")).over(w)).filter("_fall < 0")
    falls = x.groupBy("market", "_run").agg(F.min("d").alias("start"), F.max("d").alias("end"), (F.min("_fall") * 100).alias("depth"))
    falls = falls.withColumn("days", F.datediff("end", "start"))
    place = F.row_number().over(Window.partitionBy("market").orderBy("depth", "start"))
    return falls.withColumn("place", place).filter(F.col("place") <= n).select("market", "place", "start", "end", "days", "depth")

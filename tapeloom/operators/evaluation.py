"""What became of signals: grades, forward returns, buckets, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom import config
from tapeloom.functions import stage
from tapeloom.functions.frames import own


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("k", F.row_number().over(own()))


def grade(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """signals (market, ticker, d, kind, trigger, stop, target) with triggered, outcome, r, days_to_trigger.

    The trigger must be reached within 15 bars after d; from that bar on, 60 bars count. A bar that reaches both stop
    and target is a loss. Risk that is not positive, or no trigger, is never_triggered.
    """
    b = stage.written(numbered(bars).select("market", "ticker", "d", "k", "h", "l", "c"), "graded-bars")
    signals = stage.written(signals, "graded-signals")
    at = signals.join(b.select("market", "ticker", "d", F.col("k").alias("k0")), ["market", "ticker", "d"])
    # bars are dealt to stretches as long as a signal lives, so a signal meets two stretches, not all bars of its ticker
    life = config.TRIGGER_WINDOW + config.EVAL_WINDOW
    stretch = F.floor(F.col("k") / life).alias("stretch")
    at = at.withColumn("stretch", F.explode(F.array_distinct(F.array(F.floor((F.col("k0") + 1) / life), F.floor((F.col("k0") + life) / life)))))
    after = at.join(b.select("market", "ticker", "k", "h", "l", "c", stretch), ["market", "ticker", "stretch"]).filter((F.col("k") > F.col("k0")) & (F.col("k") <= F.col("k0") + life)).withColumn("i", F.col("k") - F.col("k0") - 1)
    key = ["market", "ticker", "d", "kind"]
    hit = F.min(F.when((F.col("i") < config.TRIGGER_WINDOW) & (F.col("h") >= F.col("trigger")), F.col("i"))).over(Window.partitionBy(*key))
    tail = after.withColumn("t", hit).filter((F.col("i") >= F.col("t")) & (F.col("i") < F.col("t") + config.EVAL_WINDOW))
    met = tail.groupBy(*key).agg(F.max("t").alias("t"), F.min(F.when(F.col("l") <= F.col("stop"), F.col("i"))).alias("stopped"), F.min(F.when(F.col("h") >= F.col("target"), F.col("i"))).alias("won"), F.max_by("c", "i").alias("last"))
    risk = F.col("trigger") - F.col("stop")
    on = F.col("t").isNotNull() & (risk > 0)
    lost = F.col("stopped").isNotNull() & (F.col("won").isNull() | (F.col("stopped") <= F.col("won")))
    outcome = F.when(~on, "never_triggered").when(lost, "loss").when(F.col("won").isNotNull(), "win").otherwise("open")
    r = F.when(outcome == "loss", -1.0).when(outcome == "win", (F.col("target") - F.col("trigger")) / risk).when(outcome == "open", (F.col("last") - F.col("trigger")) / risk)
    return signals.join(met, key, "left").select(*signals.columns, on.alias("triggered"), outcome.alias("outcome"), r.alias("r"), F.when(on, F.col("t")).alias("days_to_trigger"))


def forward_returns(rows: DataFrame, bars: DataFrame, sessions: int = config.FORWARD) -> DataFrame:
    """rows (market, ticker, d, ...) with fwd: the change, in per cent, from the first bar on or after d to sessions bars later; rows without both bars go.

    A forward as-of join: rows and bars in one stream, the next bar carried back.
    """
    b = bars.withColumn("c1", F.lead("c", sessions).over(own())).select("market", "ticker", "d", F.struct("c", "c1").alias("bar"))
    w = Window.partitionBy("market", "ticker").orderBy(F.desc("d"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    row, none = F.struct(*rows.columns), F.lit(None)
    kind = rows.select(row.alias("x")).schema["x"].dataType
    asked = rows.select("market", "ticker", "d", none.cast(b.schema["bar"].dataType).alias("bar"), F.lit(0).alias("kind"), row.alias("row"))
    stream = b.withColumn("kind", F.lit(1)).withColumn("row", none.cast(kind)).unionByName(asked)
    x = stream.withColumn("next", F.last("bar", ignorenulls=True).over(w)).filter("kind = 0 and next.c1 is not null and next.c > 0")
    return x.select("row.*", ((F.col("next.c1") / F.col("next.c") - 1) * 100).alias("fwd"))


def unpivoted(rows: DataFrame, factors: list[str]) -> DataFrame:
    """One row per row and factor that it has: market, ticker, d, fwd, factor, value."""
    pairs = F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("value")) for f in factors))
    return rows.select("market", "ticker", "d", "fwd", F.explode(pairs).alias("x")).select("market", "ticker", "d", "fwd", "x.*").filter("value is not null and not isnan(value)")


def buckets(rows: DataFrame, factor: str, n: int = config.BUCKETS, by: tuple[str, ...] = ("market",), ranges: int = 200) -> DataFrame:
    """Equal-count buckets 1..n of a factor by group; ties go by ticker and day; rows without a factor go, and groups of one row.

    Rows are ordered in value ranges (approximate percentiles of the group) whose counts add up to exact places, so no
    group is sorted in one task; only rows of one and the same value share a range of necessity.
    """
    x = stage.written(rows.filter(F.col(factor).isNotNull()), "bucket-rows")  # read for the cuts, the sizes and the places
    # approximate percentiles depend on the order in which their parts arrive: counts and places must read one and the same cuts
    cuts = stage.written(x.groupBy(*by).agg(F.percentile_approx(factor, [k / ranges for k in range(1, ranges)], 10_000).alias("_cuts"), F.count("*").alias("_n")), "bucket-cuts")
    x = x.join(F.broadcast(cuts), [*by]).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(factor)))).drop("_cuts")
    sizes = x.groupBy(*by, "_range").agg(F.count("*").alias("_size"))  # at most so many rows a group
    before = sizes.select(*by, "_range", (F.sum("_size").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_size")).alias("_before"))
    w = Window.partitionBy(*by, "_range").orderBy(factor, "ticker", "d")
    x = x.join(F.broadcast(before), [*by, "_range"]).withColumn("_k", F.row_number().over(w) + F.col("_before")).filter("_n > 1")
    return x.withColumn("bucket", F.expr(f"greatest(1, ((_k - 1) * {n} + _n - 2) div (_n - 1))").cast("int")).drop("_k", "_n", "_range", "_before")


def factor_table(rows: DataFrame, by: tuple[str, ...] = ("market",)) -> DataFrame:
    """Per group and bucket n, mean, median and win share of fwd, and whether the means never fall from bucket to bucket (three or more, 30 rows or more)."""
    g = rows.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean"), F.median("fwd").alias("median"), (F.count_if(F.col("fwd") > 0) / F.count("*") * 100).alias("win"))
    w = Window.partitionBy(*by)
    up = F.coalesce(F.col("mean") >= F.lag("mean").over(w.orderBy("bucket")), F.lit(True))
    x = g.withColumn("_up", up)
    return x.withColumns({"monotone": F.bool_and("_up").over(w) & (F.count("*").over(w) >= 3), "_all": F.sum("n").over(w)}).filter(F.col("_all") >= config.FACTOR_ROWS).drop("_up", "_all")


def graded_table(rows: DataFrame, order: tuple[str, ...] = ("E", "D", "C", "B", "A")) -> DataFrame:
    """The same for grades, which are buckets themselves, from worst to best; rows of no such grade go."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("grade")).cast("int")
    return factor_table(rows.withColumn("bucket", place).filter("bucket > 0")).withColumn("grade", F.element_at(F.array(*(F.lit(x) for x in order)), F.col("bucket"))).drop("bucket")


def scoreboard(outcomes: DataFrame, as_of: str) -> DataFrame:
    """Per market and kind: counts, win rate of the decided, mean R and profit factor over all time and 30 days, and the drift between them."""
    done = F.col("outcome").isin("win", "loss")
    late = F.col("d") >= F.date_sub(F.lit(as_of).cast("date"), 30)
    x = outcomes.groupBy("market", "kind").agg(
        F.count("*").alias("signals"),
        F.count_if("triggered").alias("triggered"),
        F.count_if(F.col("outcome") == "win").alias("wins"),
        F.count_if(done).alias("decided"),
        F.avg("r").alias("mean_r"),
        F.sum(F.when(F.col("r") > 0, F.col("r"))).alias("gain"),
        F.sum(F.when(F.col("r") <= 0, -F.col("r"))).alias("loss"),
        F.avg(F.when(F.col("triggered"), F.col("days_to_trigger"))).alias("days"),
        F.avg(F.when(late, F.col("r"))).alias("recent_r"),
    )
    drift = F.when(F.col("recent_r").isNull(), "none").when(F.col("recent_r") < F.col("mean_r") - 0.3, "cooling").when(F.col("recent_r") > F.col("mean_r") + 0.3, "heating").otherwise("steady")
    return x.withColumns({"win_rate": F.try_divide("wins", "decided"), "profit_factor": F.try_divide("gain", "loss"), "drift": drift})

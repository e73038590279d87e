"""Chart patterns over the last 120 bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.frames import over
from tapeloom.operators import candles as cd
from tapeloom.operators import indicators as ind
from tapeloom.operators.storage import union_all
from tapeloom.operators.structures import _tail, double_bottoms, double_tops, swings

KEY = ["market", "ticker"]


def _first(x: Column, on: Column) -> Column:
    return F.max(F.when(on, x))


def cup_and_handle(bars: DataFrame) -> DataFrame:
    """A fall of 12 to 35 % from the left rim, its earliest low in the middle three fifths, back to the rim, then ten quiet bars that give up 12 % at most."""
    t = _tail(bars, 120).filter("n >= 60").withColumn("off", F.greatest(F.lit(0), F.col("n") - 110)).withColumn("m", F.col("n") - 10 - F.col("off")).filter("m >= 40")
    j = F.col("i") - F.col("off")
    cup, handle = (j >= 0) & (j < F.col("m")), F.col("i") >= F.col("n") - 10
    g = t.groupBy(*KEY).agg(
        _first(F.col("h"), cup & (j < F.floor(F.col("m") / 4))).alias("rim"), F.min(F.when(cup, F.struct("l", j.alias("at")))).alias("low"), F.max("m").alias("m"), F.max(F.when(cup, F.struct("i", "c"))).alias("right"),
        F.max(F.when(handle, F.col("h"))).alias("hh"), F.min(F.when(handle, F.col("l"))).alias("hl"), F.avg(F.when(handle, F.col("v"))).alias("hv"), F.avg("v").alias("av"),
    )
    depth = (F.col("rim") - F.col("low.l")) / F.col("rim")
    hit = depth.between(0.12, 0.35) & F.col("low.at").between(F.floor(F.col("m") / 5), F.floor(4 * F.col("m") / 5)) & (F.col("right.c") >= F.col("rim") * 0.95) & ((F.col("hh") - F.col("hl")) / F.col("hh") <= 0.12) & (F.col("hv") < F.col("av"))
    return g.filter(hit).select(*KEY, F.lit("cup and handle").alias("name"), F.col("rim").alias("pivot"))


def high_tight_flag(bars: DataFrame) -> DataFrame:
    """Up 90 % within 40 bars to the earliest peak of the last 30, then 4 to 15 bars that give up a quarter at most on less volume."""
    t = _tail(bars, 120).filter("n >= 55")
    peak = t.filter("i >= n - 30").groupBy(*KEY).agg(F.min(F.struct((-F.col("h")).alias("neg"), "i")).alias("p"), F.max("n").alias("n")).select(*KEY, (-F.col("p.neg")).alias("peak"), F.col("p.i").alias("at")).alias("p")
    x = t.join(peak, KEY).filter((F.col("n") - 1 - F.col("at")).between(4, 15))
    pole, flag = (F.col("i") >= F.col("at") - 40) & (F.col("i") < F.col("at")), F.col("i") >= F.col("at")
    g = x.groupBy(*KEY).agg(F.max("peak").alias("peak"), F.count_if(pole).alias("np"), F.min(F.when(pole, F.col("l"))).alias("base"), F.avg(F.when(pole, F.col("v"))).alias("pv"), F.min(F.when(flag, F.col("l"))).alias("fl"), F.avg(F.when(flag, F.col("v"))).alias("fv"), F.max_by("c", "i").alias("price"))
    hit = (F.col("np") >= 15) & (F.col("peak") / F.col("base") - 1 >= 0.9) & ((F.col("peak") - F.col("fl")) / F.col("peak") <= 0.25) & (F.col("price") >= F.col("peak") * 0.78) & (F.col("fv") < F.col("pv"))
    return g.filter(hit).select(*KEY, F.lit("high tight flag").alias("name"), F.col("peak").alias("pivot"))


def bull_flag(bars: DataFrame) -> DataFrame:
    """Up 20 % over 10 or 15 bars to the eighth bar from the end, then within 10 %. Tickers with a high tight flag are left out by chart_patterns."""
    t = _tail(bars, 120).filter("n >= 30")
    at = lambda k: _first(F.col("c"), F.col("i") == F.col("n") - k)
    flag = F.col("i") >= F.col("n") - 8
    g = t.groupBy(*KEY).agg(at(8).alias("top"), at(18).alias("c18"), at(23).alias("c23"), F.max(F.when(flag, F.col("h"))).alias("fh"), F.min(F.when(flag, F.col("l"))).alias("fl"), F.max_by("c", "i").alias("price"))
    hit = ((F.col("top") / F.col("c18") - 1 >= 0.2) | (F.col("top") / F.col("c23") - 1 >= 0.2)) & ((F.col("fh") - F.col("fl")) / F.col("fh") <= 0.1) & (F.col("price") >= F.col("fl"))
    return g.filter(hit).select(*KEY, F.lit("bull flag").alias("name"), F.col("fh").alias("pivot"))


def ascending_triangle(bars: DataFrame) -> DataFrame:
    """Swing highs of the last 60 bars within 2 % over rising swing lows, two of each or more, the price within 6 % of the lowest high."""
    s = swings(bars, 120).filter("n >= 45")
    counts = s.groupBy(*KEY).agg(F.count_if("high").alias("a"), F.count_if("low").alias("b"), F.max_by("c", "i").alias("price"))
    late = s.filter("i >= n - 60")
    highs = late.filter("high").groupBy(*KEY).agg(F.count("*").alias("nh"), F.max("h").alias("top"), F.min("h").alias("low_top"))
    w = Window.partitionBy(*KEY).orderBy("i")
    lows = late.filter("low").withColumn("up", F.coalesce(F.col("l") > F.lag("l").over(w), F.lit(True))).groupBy(*KEY).agg(F.count("*").alias("nl"), F.bool_and("up").alias("rising"))
    x = counts.join(highs, KEY).join(lows, KEY)
    hit = (F.col("a") >= 2) & (F.col("b") >= 2) & (F.col("nh") >= 2) & (F.col("nl") >= 2) & ((F.col("top") - F.col("low_top")) / F.col("top") <= 0.02) & F.col("rising") & (F.col("price") >= F.col("low_top") * 0.94)
    return x.filter(hit).select(*KEY, F.lit("ascending triangle").alias("name"), F.col("top").alias("pivot"))


def head_and_shoulders(bars: DataFrame) -> DataFrame:
    """The last three swing highs: the middle 3 % above both others, those within 4 %, the last within 30 bars, a swing low between, the price 3 % under the head."""
    s = swings(bars, 120).filter("n >= 45")
    r = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("i")))
    top = s.filter("high").withColumn("r", r).groupBy(*KEY).agg(*(_first(F.col(c), F.col("r") == k).alias(f"{c}{4 - k}") for k in (1, 2, 3) for c in ("h", "i")))
    price = s.groupBy(*KEY).agg(F.max_by("c", "i").alias("price"), F.max("n").alias("bars"))
    neck = top.join(s.filter("low").select(*KEY, "i", "l"), KEY).filter((F.col("i") > F.col("i1")) & (F.col("i") < F.col("i3"))).groupBy(*KEY).agg(F.min("l").alias("neck"))
    x = top.join(price, KEY).join(neck, KEY)
    hit = (F.col("h2") > F.col("h1") * 1.03) & (F.col("h2") > F.col("h3") * 1.03) & (F.abs(F.col("h1") - F.col("h3")) / F.col("h1") <= 0.04) & (F.col("i3") >= F.col("bars") - 30) & (F.col("price") < F.col("h2") * 0.97)
    return x.filter(hit).select(*KEY, F.lit("head and shoulders").alias("name"), F.col("neck").alias("pivot"))


def chart_patterns(bars: DataFrame) -> DataFrame:
    """All of these and the double bottoms and tops, one row per ticker and name: market, ticker, name, pivot; a high tight flag suppresses a bull flag."""
    tight = high_tight_flag(bars)
    flags = bull_flag(bars).join(tight.select(*KEY), KEY, "left_anti")
    doubles = [f(bars).select(*KEY, F.lit(name).alias("name"), F.col("middle").alias("pivot")) for f, name in ((double_bottoms, "double bottom"), (double_tops, "double top"))]
    return union_all([cup_and_handle(bars), tight, flags, ascending_triangle(bars), head_and_shoulders(bars), *doubles]).dropDuplicates([*KEY, "name"])


# Chart patterns that tell of falling prices; the others tell of rising ones.
FALLING = ("double top", "head and shoulders")
#: Shares of the 20-day range from which, and up to which, a close counts as its top and bottom.
TOP, BOTTOM = 70, 30


def reading(bars: DataFrame) -> DataFrame:
    """One row per ticker, read at its newest bar: change5 (per cent over five bars), place (of the close in the 20-bar range, per cent), charts and candles (name, bias), verdict of the volume, marks for the chart, and narrative, these in a sentence.

    A young ticker has no change; the verdict is a word (accumulation, distribution, balanced). Patterns of the newest
    bar are marked below it, bearish ones above.
    """
    hi, lo = over(F.max, "h", -19), over(F.min, "l", -19)
    x = ind.newest(ind.volume_profile(ind.features(bars)).withColumns({"_hi": hi, "_lo": lo}))
    place = F.when(F.col("_hi") > F.col("_lo"), (F.col("c") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 100).otherwise(50.0)
    x = x.select(*KEY, "d", F.when(F.col("k") > 6, F.round((F.col("c") / F.col("c5") - 1) * 100, 1)).alias("change5"), F.round(place, 0).alias("place"), "verdict")
    told = F.struct("name", F.when(F.col("name").isin(*FALLING), "bearish").otherwise("bullish").alias("bias"))
    shapes = chart_patterns(bars).groupBy(*KEY).agg(F.sort_array(F.collect_list(told)).alias("charts"))
    bias = {1: "bullish", -1: "bearish", 0: "neutral"}
    flags = F.array(*(F.when(F.col(k), F.struct(F.lit(k.replace("_", " ")).alias("name"), F.lit(bias[v]).alias("bias"))) for k, v in cd.PATTERNS.items()))
    candles = ind.newest(cd.candle_patterns(bars)).select(*KEY, F.slice(F.array_compact(flags), 1, cd.MOST).alias("candles"))
    none = F.array().cast("array<struct<name:string,bias:string>>")
    x = x.join(shapes, KEY, "left").join(candles, KEY, "left").withColumns({"charts": F.coalesce("charts", none), "candles": F.coalesce("candles", none)})
    below = lambda p: F.when(p["bias"] == "bearish", "aboveBar").otherwise("belowBar")
    arrow = lambda p: F.when(p["bias"] == "bullish", "arrowUp").when(p["bias"] == "bearish", "arrowDown").otherwise("circle")
    marks = F.transform("candles", lambda p: F.struct(below(p).alias("position"), arrow(p).alias("shape"), p["name"].alias("text")))
    moved = F.concat(F.when(F.col("change5") >= 0, "up ").otherwise("down "), F.abs("change5").cast("string"), F.lit("% over 5 days"))
    at = F.concat(F.lit("sitting at the "), F.when(F.col("place") >= TOP, "top").when(F.col("place") <= BOTTOM, "bottom").otherwise("middle"), F.lit(" of its 20-day range"))
    drawn = F.when(F.size("charts") > 0, F.concat(F.lit("chart pattern: "), F.array_join(F.transform("charts", lambda p: F.concat(p["name"], F.lit(" ("), p["bias"], F.lit(")"))), ", ")))
    shown = F.when(F.size("candles") > 0, F.concat(F.lit("latest candle: "), F.array_join(F.transform("candles", lambda p: p["name"]), ", ")))
    text = F.concat_ws("; ", moved, at, drawn, shown, "verdict")
    return x.withColumns({"marks": marks, "narrative": F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 10_000)), F.lit("."))})

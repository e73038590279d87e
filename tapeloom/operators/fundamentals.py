"""Quarterly growth, scorecards and filed facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def growth(quarters: DataFrame) -> DataFrame:
    """Per ticker the newest quarter's growth over the year before, by position (0 against 4), and the quarter before's.

    quarters: ticker, q_end, revenue, net_income, eps. A base that is not positive gives null; so does a missing
    quarter. Tickers without any revenue or income growth have no row.
    """
    w = Window.partitionBy("ticker").orderBy(F.desc("q_end"))

    def yoy(x: str) -> Column:
        base = F.lead(x, 4).over(w)
        return F.when(base > 0, (F.col(x) / base - 1) * 100)

    margin = F.when(F.col("revenue") > 0, F.col("net_income") / F.col("revenue") * 100)
    x = quarters.withColumns({"i": F.row_number().over(w) - 1, "rev": yoy("revenue"), "ni": yoy("net_income"), "eps_g": yoy("eps"), "margin": margin})
    x = x.withColumns({"rev1": F.lead("rev").over(w), "ni1": F.lead("ni").over(w), "eps1": F.lead("eps_g").over(w), "margin4": F.lead("margin", 4).over(w)}).filter("i = 0").filter(F.coalesce("rev", "rev1", "ni", "ni1").isNotNull())
    return x.select(
        "ticker", F.col("q_end").alias("quarter_end"), F.col("rev").alias("rev_yoy"), F.col("rev1").alias("rev_yoy_prev"), F.col("ni").alias("ni_yoy"), F.col("ni1").alias("ni_yoy_prev"), F.col("eps_g").alias("eps_yoy"), F.col("eps1").alias("eps_yoy_prev"),
        F.coalesce(F.col("ni") > F.col("ni1"), F.lit(False)).alias("accelerating"), F.coalesce(F.col("eps_g") > F.col("eps1"), F.lit(False)).alias("eps_accelerating"), "margin", (F.col("margin") - F.col("margin4")).alias("margin_delta"),
    )


def scorecard(m: DataFrame, roe: str = "roe") -> DataFrame:
    """A to E from the share of known boxes that hold; null with fewer than three known."""
    boxes = F.array(
        F.coalesce("eps_yoy", "ni_yoy") >= 25,
        F.col("rev_yoy") >= 20,
        F.when(F.col("eps_yoy_prev").isNotNull() | F.col("ni_yoy_prev").isNotNull(), F.col("eps_accelerating") | F.col("accelerating")),
        F.col("margin_delta") > 0,
        F.col(roe) >= 17,
    )
    known = F.array_compact(boxes)
    share = F.try_divide(F.size(F.filter(known, lambda b: b)), F.size(known))
    return m.withColumn("grade", F.when(F.size(known) >= 3, F.when(share >= 0.8, "A").when(share >= 0.6, "B").when(share >= 0.4, "C").when(share >= 0.2, "D").otherwise("E")))


def is_quarter(frame: Column, start: Column, end: Column) -> Column:
    """Whether a filed fact covers a quarter: by its frame label, else by 75 to 100 days."""
    return F.when(frame.isNotNull(), frame.rlike("^CY[0-9]{4}Q[1-4]$")).otherwise(F.datediff(end, start).between(75, 100))


def flow_series(facts: DataFrame, tags: list[str], as_of: str, years: int = 4) -> DataFrame:
    """Quarterly values by period end: of several facts the earlier tag of the list wins, then the later filing. facts: ticker, tag, frame, start, end, filed, val."""
    rank = F.array_position(F.array(*(F.lit(t) for t in tags)), F.col("tag"))
    x = facts.withColumn("_rank", rank).filter("_rank > 0").filter(is_quarter(F.col("frame"), F.col("start"), F.col("end"))).filter(F.col("end") >= F.add_months(F.lit(as_of).cast("date"), -12 * years))
    return x.groupBy("ticker", "end").agg(F.min_by("val", F.struct("_rank", -F.unix_date("filed"), "val")).alias("val"))


def latest_instant(facts: DataFrame, tags: list[str]) -> DataFrame:
    """The newest value (by end, then filing) of the first tag of the list that has any."""
    rank = F.array_position(F.array(*(F.lit(t) for t in tags)), F.col("tag"))
    x = facts.withColumn("_rank", rank).filter("_rank > 0").groupBy("ticker", "_rank").agg(F.max(F.struct("end", "filed", "val")).alias("x"))
    return x.groupBy("ticker").agg(F.min_by("x", "_rank").alias("x")).select("ticker", F.col("x.end").alias("end"), F.col("x.val").alias("val"))


def quarter_grid(series: DataFrame, slots: int = 12, step: int = 91, snap: int = 30) -> DataFrame:
    """Quarter ends walked back from the newest: each slot lies step days before the last and snaps to the nearest filing within snap days; a gap keeps its label with a null value.

    The walk depends on each snap, so it folds over the ticker's own short array of filings.
    """
    days = series.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(F.unix_date("end").alias("e"), "val"))).alias("f"))

    def walk(acc: Column, _: Column) -> Column:
        want = acc["at"] - step
        near = F.array_min(F.transform(F.filter(F.col("f"), lambda x: F.abs(x["e"] - want) <= snap), lambda x: F.struct(F.abs(x["e"] - want).alias("far"), x["e"].alias("e"), x["val"].alias("val"))))
        at = F.coalesce(near["e"], want)
        return F.struct(at.cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(at.cast("int").alias("e"), near["val"].alias("val")))).alias("out"))

    newest = F.element_at("f", -1)
    begin = F.struct(newest["e"].cast("int").alias("at"), F.array(F.struct(newest["e"].cast("int").alias("e"), newest["val"].alias("val"))).alias("out"))
    grid = days.select("ticker", F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(slots - 1)), begin, walk)["out"]).alias("slot", "x"))
    return grid.select("ticker", "slot", F.date_from_unix_date("x.e").alias("q_end"), F.col("x.val").alias("val"))


def complete(quarters: DataFrame, least: int = 5) -> DataFrame:
    """Quarters (ticker, q_end, ...) of tickers that have least dated ones: with fewer there is no year to compare with."""
    dated = quarters.filter("q_end is not null")
    n = dated.groupBy("ticker").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return dated.join(n.select("ticker"), "ticker", "left_semi")


def from_filed(revenue: DataFrame, income: DataFrame, eps: DataFrame, least: int = 5) -> DataFrame:
    """Quarters (ticker, slot, q_end, revenue, net_income, eps) on the walked grid of the periods that have both revenue and income; tickers with fewer than least such periods, or series of fewer, have none.

    Series: ticker, end, val. A slot without a filing keeps its label with nulls: what is compared by position must be
    consecutive quarters. eps is null where it was not filed.
    """

    def enough(x: DataFrame) -> DataFrame:
        return x.groupBy("ticker").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("ticker")

    both = revenue.select("ticker", "end").join(income.select("ticker", "end"), ["ticker", "end"])
    for x in (revenue, income, both):
        both = both.join(enough(x), "ticker", "left_semi")
    grid = quarter_grid(both.withColumn("val", F.lit(1.0)))
    slots = grid.withColumn("end", F.when(F.col("val").isNotNull(), F.col("q_end"))).drop("val")
    for name, x in (("revenue", revenue), ("net_income", income), ("eps", eps)):
        slots = slots.join(x.select("ticker", "end", F.col("val").alias(name)), ["ticker", "end"], "left")
    return slots.select("ticker", "slot", "q_end", "revenue", "net_income", "eps")


def trailing_roe(income: DataFrame, equity: DataFrame) -> DataFrame:
    """ticker, roe: the last four quarters' income over the newest equity, in per cent; null with fewer than four or an equity that is not positive."""
    w = Window.partitionBy("ticker").orderBy(F.desc("end"))
    last = income.withColumn("_r", F.row_number().over(w)).filter("_r <= 4").groupBy("ticker").agg(F.sum("val").alias("_sum"), F.count("*").alias("_n"))
    x = last.join(equity.select("ticker", F.col("val").alias("_equity")), "ticker", "left")
    return x.select("ticker", F.when((F.col("_n") >= 4) & (F.col("_equity") > 0), F.round(F.col("_sum") / F.col("_equity") * 100, 1)).alias("roe"))


def graded(growths: DataFrame, roe: DataFrame, registered: DataFrame) -> DataFrame:
    """grade of every registered ticker, or the reason why it is withheld: too few quarters, or too few known boxes.

    A margin beyond 100 % either way measures one-off items: its change is not graded.
    """
    odd = F.abs(F.col("margin")) > 100
    x = growths.withColumn("margin_delta", F.when(~F.coalesce(odd, F.lit(False)), F.col("margin_delta"))).join(roe, "ticker", "left")
    x = registered.select("ticker").distinct().join(scorecard(x), "ticker", "left")
    why = F.when(F.col("quarter_end").isNull(), "too few quarters with both revenue and income").when(F.col("grade").isNull(), "too few gradeable measures")
    return x.select("ticker", "quarter_end", "roe", "grade", why.alias("withheld"))


def annual_roe(quarters: DataFrame) -> DataFrame:
    """ticker, roe: four times the newest quarterly figure (ticker, q_end, roe) that is known."""
    known = quarters.filter("roe is not null").groupBy("ticker").agg(F.max_by("roe", "q_end").alias("_roe"))
    return known.select("ticker", F.round(F.col("_roe") * 4, 1).alias("roe"))


def shareholding(events: DataFrame, as_of: str, days: int = 90, top: int = 5) -> DataFrame:
    """Per ticker of events (ticker, name, kind, shares, d): shares acquired and disposed of in the last days, the net, and the top holders by net movement, the largest first.

    A kind that begins with `acquir` adds, any other takes; nulls count as no shares. Of equal movements the name decides.
    """
    x = events.filter(F.col("d") >= F.date_sub(F.lit(as_of).cast("date"), days))
    signed = F.coalesce("shares", F.lit(0)) * F.when(F.lower(F.trim("kind")).startswith("acquir"), 1).otherwise(-1)
    per = x.withColumn("_s", signed).groupBy("ticker", "name").agg(F.sum("_s").alias("net"), F.sum(F.greatest("_s", F.lit(0))).alias("up"), F.sum(F.greatest(-F.col("_s"), F.lit(0))).alias("down"))
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc(F.abs("net")), "name"))
    placed = per.withColumn("place", place)
    held = F.array_sort(F.collect_list(F.when(F.col("place") <= top, F.struct("place", "name", "net"))))
    return placed.groupBy("ticker").agg(F.sum("up").alias("acquired"), F.sum("down").alias("disposed"), F.sum("net").alias("net"), F.transform(held, lambda h: h["name"]).alias("holders"))


def number(text: Column) -> Column:
    """Numbers as pages print them: separators, per cent, currency, k/m/b/t, brackets for negative; null where there is none."""
    t = F.lower(F.trim(text))
    negative = t.rlike(r"^\(.*\)$") | t.startswith("-")
    digits = F.regexp_extract(F.regexp_replace(t, r"[,\s]", ""), r"([0-9]*\.?[0-9]+)", 1)
    scale = F.regexp_extract(F.regexp_replace(t, r"[,\s)]", ""), r"[0-9]([kmbt])(?:n)?$", 1)
    value = digits.try_cast("double")
    return F.when(negative, -1.0).otherwise(1.0) * value * F.when(scale == "k", 1e3).when(scale == "m", 1e6).when(scale == "b", 1e9).when(scale == "t", 1e12).otherwise(1.0)


#: Days from a quarter's end to the expected report of the next, and the days around it that are a hazard.
REPORT_AFTER, HAZARD = 151, (-7, 14)


def report_window(quarters: DataFrame, as_of: str) -> DataFrame:
    """Per ticker: when its next report is expected after its newest quarter, in how many days, and whether a trade now would meet it. Tickers without a quarter by then go."""
    day = F.lit(as_of).cast("date")
    x = quarters.filter(F.col("q_end") <= day).groupBy("ticker").agg(F.date_add(F.max("q_end"), REPORT_AFTER).alias("expected"))
    days = F.datediff("expected", day)
    return x.select("ticker", "expected", days.alias("days"), days.between(*HAZARD).alias("high_risk"))


def shared_quarters(revenue: DataFrame, income: DataFrame) -> DataFrame:
    """Quarter ends (ticker, end) that both series have: each once."""
    return revenue.select("ticker", "end").intersect(income.select("ticker", "end"))

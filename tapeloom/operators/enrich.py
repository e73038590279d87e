"""What is added to a board before it is saved: caches and whom to fetch anew, group ranks, the grade gate, notes, grouped news.

A board is capped by market and bucket, so orders over all of it are over some hundred rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ages in days from which a cached entry is due, the nightly fetches, the notes per market, the barred grade.
FUND_DAYS, STREET_DAYS, FETCHES, NOTES, BARRED = 7, 3, 40, 90, "E"
# The buckets, the most actionable first.
BUCKETS = ("swing", "watchlist", "position", "forming")


def bucket_order() -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(b) for b in BUCKETS)), F.col("bucket")), F.lit(0)), F.lit(9))


def cached(entries: DataFrame, now: str, days: int) -> DataFrame:
    """Entries (with a column updated) younger than so many days, with their age: stale is served, very stale is not.

    Ages are counted in microseconds: whole seconds would add a day to an entry inside its last second.
    """
    day = 86_400_000_000
    lived = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("updated").cast("timestamp"))
    return entries.withColumn("age_days", F.floor(lived / day).cast("int")).filter(lived < days * day)


def due(age: Column, days: int) -> Column:
    """Whether an entry of that age (null: none) is to be read anew."""
    return age.isNull() | (age >= days)


def fetch_order(board: DataFrame, fund: DataFrame, street: DataFrame, budget: int = FETCHES, market: str = "MY") -> DataFrame:
    """Tickers of one market to fetch tonight, with their place: those whose fundamentals or filings are due or that carry no grade, the readiest first.

    Ready: a live entry, then a price within 5 % of the pivot, then the bucket, then the rank; ties by ticker. board:
    market, ticker, bucket, price, pivot, rs_rank, live; fund: ticker, age_days, grade; street: ticker, age_days.
    """
    x = board.filter(F.col("market") == market).join(fund.select("ticker", F.col("age_days").alias("_f"), "grade"), "ticker", "left").join(street.select("ticker", F.col("age_days").alias("_s")), "ticker", "left")
    near = F.coalesce(F.abs(F.col("price") / F.col("pivot") - 1) <= 0.05, F.lit(False))
    x = x.filter(due(F.col("_f"), FUND_DAYS) | F.col("grade").isNull() | due(F.col("_s"), STREET_DAYS))
    order = Window.orderBy((~F.col("live")).cast("int"), (~near).cast("int"), bucket_order(), F.desc_nulls_last("rs_rank"), "ticker")
    return x.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= budget).select("ticker", "place")


def enrich(board: DataFrame, meta: DataFrame, groups: DataFrame, fund: DataFrame) -> DataFrame:
    """The board with name and industry (meta, by ticker), group_rank (groups, by market and industry) and grade (fund, by ticker); a swing of the barred grade waits as watchlist.

    All three are looked up: a row without a match stays, with nulls. demoted_by gains the grade that demoted.
    """
    x = board.join(meta, "ticker", "left").join(groups, ["market", "industry"], "left").join(fund.select("ticker", "grade"), "ticker", "left")
    barred = F.coalesce((F.col("bucket") == "swing") & (F.col("grade") == BARRED), F.lit(False))
    by = F.when(barred, F.concat_ws(",", F.nullif("demoted_by", F.lit("")), F.concat(F.lit("grade_"), "grade"))).otherwise(F.col("demoted_by"))
    return x.withColumns({"demoted_by": by, "bucket": F.when(barred, "watchlist").otherwise(F.col("bucket"))})


def note_order(board: DataFrame, per_market: int = NOTES) -> DataFrame:
    """Rows that get a note, with their place over all markets: actionable buckets first, then quality; so many for each market present."""
    place = F.row_number().over(Window.orderBy(bucket_order(), F.desc_nulls_last("quality"), "ticker"))
    markets = F.size(F.collect_set("market").over(Window.partitionBy()))
    return board.withColumns({"place": place, "_m": markets}).filter(F.col("place") <= F.greatest("_m", F.lit(1)) * per_market).drop("_m")


def tactic_markers(rows: DataFrame) -> DataFrame:
    """market, ticker, d, position, text of a chart's marks for the live tactics of each row (flags, and the tag days of bounces)."""
    # The texts of the marks, and where they stand.

    def mark(on: Column, day: Column, position: str, text: str) -> Column:
        return F.when(on, F.struct(day.alias("at"), F.lit(position).alias("position"), F.lit(text).alias("text")))

    d, marks = F.col("d"), [mark(F.col("pocket_pivot"), F.col("d"), "belowBar", "pocket pivot")]
    for name, label in (("ma20", "20MA"), ("ma50", "50MA")):
        marks += [mark(F.col(f"{name}_bounce") & F.col(f"{name}_tag").isNotNull(), F.col(f"{name}_tag"), "belowBar", f"{label} tag"), mark(F.col(f"{name}_bounce"), d, "belowBar", f"{label} bounce")]
    marks += [mark(F.col("episodic"), d, "aboveBar", "EP — verify catalyst"), mark(F.col("burst"), d, "belowBar", "4% burst"), mark(F.col("gap_up"), d, "belowBar", "buyable gap-up")]
    return rows.select("market", "ticker", F.explode(F.array_compact(F.array(*marks))).alias("m")).select("market", "ticker", F.col("m.at").alias("d"), "m.position", "m.text")


def rotation_news(sectors: DataFrame, items: DataFrame, since: str, n: int = 3) -> DataFrame:
    """Per sector that rotates or leads (place 3 or better): direction and its newest n headlines on or after since, one of each address.

    sectors: market, industry, rotating_in, rotating_out, place; items: market, industry, url, d. Ties go by address.
    """
    direction = F.when(F.col("rotating_in"), "in").when(F.col("rotating_out"), "out").when(F.col("place") <= 3, "leading")
    told = sectors.select("market", "industry", direction.alias("direction")).filter("direction is not null")
    fresh = items.filter(F.col("d") >= F.lit(since).cast("date")).groupBy("market", "industry", "url").agg(F.max("d").alias("d"))
    w = Window.partitionBy("market", "industry").orderBy(F.desc("d"), "url")
    return fresh.join(told, ["market", "industry"]).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).select("market", "industry", "direction", "k", "url", "d")


def leading_counters(candidates: DataFrame, industries: int = 3, counters: int = 2) -> DataFrame:
    """The strongest counters (by rank, null as 0) of the industries with most candidates: market, industry, ticker, place. Ties go by name; candidates without industry go."""
    known = candidates.filter("industry is not null")
    sizes = known.groupBy("market", "industry").agg(F.count("*").alias("_n"))
    largest = sizes.withColumn("_p", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("_n"), "industry"))).filter(F.col("_p") <= industries)
    order = Window.partitionBy("market", "industry").orderBy(F.desc(F.coalesce("rs_rank", F.lit(0))), "ticker")
    x = known.join(F.broadcast(largest.select("market", "industry")), ["market", "industry"])  # so many rows a market
    return x.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= counters).select("market", "industry", "ticker", "place")


def industry_headlines(candidates: DataFrame, items: DataFrame, since: str, industries: int = 3, counters: int = 2, n: int = 3) -> DataFrame:
    """Where a market has no sector funds: the newest n headlines on or after since of its leading industries, told by their strongest counters, one of each address.

    candidates: market, industry, ticker, rs_rank; items: ticker, url, d. An industry without a headline has no row.
    """
    told = leading_counters(candidates, industries, counters)
    fresh = items.filter(F.col("d") >= F.lit(since).cast("date")).join(F.broadcast(told), "ticker").groupBy("market", "industry", "url").agg(F.max("d").alias("d"))
    w = Window.partitionBy("market", "industry").orderBy(F.desc("d"), "url")
    return fresh.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).select("market", "industry", F.lit("leading").alias("direction"), "k", "url", "d")

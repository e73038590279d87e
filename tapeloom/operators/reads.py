"""What readers of the board ask for: charts, gaps to the template, open positions, changes, counts, newest runs, page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom import config
from tapeloom.functions.frames import full, mean, newest_first, own, with_totals
from tapeloom.operators.exits import distribution_weeks, exit_signals
from tapeloom.operators.storage import newest

KEY = ["market", "ticker"]


def relative_strength(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Bars with ratio: the close over the market's benchmark close of that very day, carried on over days without one; a benchmark day between two bars counts for neither."""
    x = bars.join(benchmark.select("market", "d", F.col("c").alias("_b")), ["market", "d"], "left")
    return x.withColumn("ratio", F.col("c") / F.last("_b", ignorenulls=True).over(own().rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def candle_payload(bars: DataFrame, benchmark: DataFrame, n: int = 130) -> DataFrame:
    """market, ticker, candles: the last n bars as structs t, o, h, l, c, v, m20, m50, m150, m200, rs, bbu, bbl, v50.

    Windows reach back before the first candle. rs is the relative-strength line, 1 at the first candle; null
    throughout where that has none. Prices keep three decimals in MY, two elsewhere.
    """
    x = with_totals(relative_strength(bars, benchmark), "c", "v")
    x = x.select(*KEY, "d", "o", "h", "l", "c", "v", "ratio", *(mean("c", k).alias(f"m{k}") for k in (20, 50, 150, 200)), full(F.stddev_samp, "c", 20).alias("_sd"), mean("v", 50, 1).alias("v50"), F.row_number().over(newest_first()).alias("_r"))
    tail = x.filter(F.col("_r") <= n)
    base = F.first("ratio").over(Window.partitionBy(*KEY).orderBy("d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tail = tail.withColumn("rs", F.when(base > 0, F.round(F.col("ratio") / base, 4))).withColumns({"bbu": F.col("m20") + 2 * F.col("_sd"), "bbl": F.col("m20") - 2 * F.col("_sd")})

    def price(c: str) -> Column:
        return F.when(F.col("market") == "MY", F.round(c, 3)).otherwise(F.round(c, 2)).alias(c)

    whole = [F.floor(c).cast("long").alias(c) for c in ("v", "v50")]
    candle = F.struct(F.col("d").alias("t"), *(price(c) for c in ("o", "h", "l", "c", "m20", "m50", "m150", "m200", "bbu", "bbl")), "rs", *whole)
    return tail.groupBy(*KEY).agg(F.array_sort(F.collect_list(candle)).alias("candles"))


def gaps(templated: DataFrame) -> DataFrame:
    """One row per failed template rule: market, ticker, rule, have (the value that falls short), want (what it has to pass)."""
    c = F.col("c")
    values = {
        "price_above_150_200": (c, F.greatest("ma150", "ma200")),
        "ma150_above_ma200": (F.col("ma150"), F.col("ma200")),
        "ma200_rising_1m": (F.col("ma200"), F.col("ma200_22")),
        "ma50_above_150_200": (F.col("ma50"), F.greatest("ma150", "ma200")),
        "price_above_ma50": (c, F.col("ma50")),
        "above_52w_low_30pct": ((c / F.col("lo252") - 1) * 100, F.lit(30.0)),
        "within_25pct_of_52w_high": ((1 - c / F.col("hi252")) * 100, F.lit(25.0)),
        "rs_rank_ge_70": (F.col("rs_rank").cast("double"), F.lit(70.0)),
    }
    failed = [F.when(~F.col(f"checks.{k}"), F.struct(F.lit(k).alias("rule"), h.alias("have"), w.alias("want"))) for k, (h, w) in values.items()]
    return templated.select(*KEY, F.explode(F.array_compact(F.array(*failed))).alias("x")).select(*KEY, "x.*")


def stage(facts: DataFrame) -> DataFrame:
    """Weekly reading of each ticker with more than 30 weeks and a 30-week mean: the last week's close against it, whether it rises, stage2 (above and rising) and a label."""
    last = facts.withColumns({"_r": F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("week"))), "weeks": F.count("*").over(Window.partitionBy(*KEY))})
    x = last.filter((F.col("_r") == 1) & (F.col("weeks") > config.STAGE_WEEKS) & F.col("ma30w").isNotNull())
    above = F.col("c") > F.col("ma30w")
    label = F.when(above & F.col("rising"), "stage 2").when(above, "base").otherwise("below")
    return x.select(*KEY, "weeks", "ma30w", "rising", above.alias("above"), ((F.col("c") / F.col("ma30w") - 1) * 100).alias("pct"), (above & F.col("rising")).alias("stage2"), label.alias("label"))


def open_positions(positions: DataFrame, features: DataFrame, bars: DataFrame, run_day: str, least: int = 60) -> DataFrame:
    """Exit signals of open positions (id, market, ticker, entry_d, entry, stop, pivot) whose ticker has least bars or more, with the last price and the days held.

    features: the newest bar of each ticker. A ticker without a bar (suspended, delisted) has nothing new to judge.
    """
    x = positions.withColumn("held", F.datediff(F.lit(run_day).cast("date"), "entry_d")).join(features.filter(F.col("k") >= least), KEY).join(distribution_weeks(bars), KEY)
    return exit_signals(x).select("id", *KEY, F.round("c", 2).alias("last_price"), "held", "signals", "heavy_volume")


def changes(now: DataFrame, was: DataFrame) -> DataFrame:
    """Tickers that are on one board only: market, ticker, change (`new` or `dropped`)."""
    a, b = now.select(*KEY).distinct(), was.select(*KEY).distinct()
    return a.subtract(b).withColumn("change", F.lit("new")).unionByName(b.subtract(a).withColumn("change", F.lit("dropped")))


def bucket_counts(board: DataFrame) -> DataFrame:
    return board.groupBy("market", "bucket").agg(F.count("*").alias("n"))


def newest_runs(runs: DataFrame) -> DataFrame:
    """Of each strategy (null: breakout) its newest run (created, then id), ranked by expectancy, runs without one last."""
    x = newest(runs.withColumn("strategy", F.coalesce("strategy", F.lit("breakout"))), 1, [F.desc("created"), F.desc("id")], ["strategy"])
    return x.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("expectancy"), "strategy")))


def page_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """page columns, table, header, row, cells: the rows of each HTML table of a page, tags and entities of cells removed, banner rows (fewer cells than the header) dropped."""

    def clean(x: Column) -> Column:
        bare = F.regexp_replace(x, r"<[^>]*>", " ")
        for code, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            bare = F.regexp_replace(bare, code, char)
        return F.trim(F.regexp_replace(bare, r"\s+", " "))

    def cells(row: Column, tag: str) -> Column:
        return F.transform(F.regexp_extract_all(row, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1), clean)

    rest = pages.drop(html).columns
    tables = pages.select(*rest, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), 1)).alias("table", "_t"))
    # below the explode, so a header is read once for a table and not for each of its rows
    heads = tables.select(*rest, "table", "_t", cells(F.col("_t"), "th").alias("header"))
    rows = heads.select(*rest, "table", "header", F.posexplode(F.regexp_extract_all("_t", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("row", "_r"))
    out = rows.withColumn("cells", cells(F.col("_r"), "td")).filter((F.size("cells") > 0) & (F.size("cells") >= F.size("header")))
    return out.select(*rest, "table", "header", "row", "cells")


def pick_table(rows: DataFrame, required: list[str], denied: list[str], by: list[str]) -> DataFrame:
    """Rows of the one table of each page whose header has all required names and no denied one; of several the one with most rows, then the first."""
    names = F.transform("header", F.lower)
    ok = F.forall(F.array(*(F.lit(x.lower()) for x in required)), lambda x: F.array_contains(names, x)) & ~F.exists(F.array(*(F.lit(x.lower()) for x in denied)).cast("array<string>"), lambda x: F.array_contains(names, x))
    fit = rows.filter(ok)
    sizes = newest(fit.groupBy(*by, "table").agg(F.count("*").alias("_n")), 1, [F.desc("_n"), F.asc("table")], by)
    return fit.join(sizes.select(*by, "table"), [*by, "table"], "left_semi")


def field(name: str) -> Column:
    """The cell under a header, null where there is none."""
    at = F.array_position(F.transform("header", F.lower), name.lower())
    return F.when(at > 0, F.get("cells", (at - 1).cast("int")))


def universe_table(rows: DataFrame) -> DataFrame:
    """code, name, shariah, industry, board of a market's listing page (columns Code, Name, Category): the name's `[s]` marks compliance, the category reads `industry, board`; the first row of a code stands."""
    name, category = field("name"), field("category")
    out = rows.select(
        field("code").alias("code"),
        F.trim(F.regexp_replace(name, r"(?i)\s*\[s\]\s*$", "")).alias("name"),
        name.rlike(r"(?i)\[s\]\s*$").alias("shariah"),
        F.trim(F.regexp_extract(category, r"^(.*?)(?:,\s*([^,]*))?$", 1)).alias("industry"),
        F.nullif(F.trim(F.regexp_extract(category, r"^(.*?)(?:,\s*([^,]*))?$", 2)), F.lit("")).alias("board"),
        "row",
    )
    return newest(out.filter("code <> ''"), 1, [F.asc("row")], ["code"]).drop("row")

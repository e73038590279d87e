"""Readers of vendor rows: bars, directory, splits, deep history, filings, headlines, feeds; and the gates in front of them.

Rows come from any Spark source (JSON lines, Parquet); the vendor's transport is not part of this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.storage import adjust, newest

# Prefixes of exchanges that are not listed ones; least bars, value floor and age of a real delisting.
UNLISTED, DEEP_BARS, DEEP_VALUE, STALE_DAYS = ("OTC", "PINK", "GREY", "EXPM"), 260, 100_000.0, 15
# Forms of material filings.
MATERIAL = ("8-K", "10-Q", "10-K", "SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A", "424B5", "S-3", "S-3ASR", "DEF 14A", "20-F")
# Words of company names that say nothing, and the tag limits of a headline's relevance.
NAME_STOPS = "inc corp corporation co company ltd limited plc holdings holding group the and class common stock sa nv ag berhad bhd".split()
MOST_SYMBOLS, FEW_SYMBOLS = 6, 2


def to_vendor(ticker: Column) -> Column:
    """`1155.KL` to `1155.KLSE`, `AAPL` to `AAPL.US`; other suffixes stay."""
    return F.when(ticker.endswith(".KL"), F.concat(F.regexp_replace(ticker, r"\.KL$", ""), F.lit(".KLSE"))).when(ticker.contains("."), ticker).otherwise(F.concat(ticker, F.lit(".US")))


def to_internal(code: Column, market: Column) -> Column:
    """A vendor's code as a ticker of its market."""
    return F.when(market == "MY", F.concat(code, F.lit(".KL"))).otherwise(code)


def bulk(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Typed bars of a whole exchange from JSON texts, numbers as numbers or strings; rows without day, close or volume, or with a close that is not positive, go."""
    names = ["open", "high", "low", "close", "adjusted_close", "volume"]
    j = rows.select(F.from_json(raw, "code string, market string, date string, " + ", ".join(f"{n} string" for n in names)).alias("j")).select("j.*")
    x = j.select(to_internal(F.col("code"), F.col("market")).alias("ticker"), "market", F.col("date").try_cast("date").alias("d"), *(F.col(n).try_cast("double").alias(a) for n, a in zip(names, ("o", "h", "l", "c", "adj", "v"), strict=True)))
    return x.dropna(subset=["ticker", "d", "c", "v"]).filter("c > 0")


def modal_day(bars: DataFrame) -> DataFrame:
    """The day that most rows of a market carry, the earliest of several."""
    n = bars.groupBy("market", "d").agg(F.count("*").alias("n"))
    return newest(n, 1, [F.desc("n"), F.asc("d")], ["market"]).select("market", F.col("d").alias("mode"), "n")


def history(rows: DataFrame) -> DataFrame:
    """Adjusted bars (market, ticker, d, o, h, l, c, v) of rows with adj and arrival: of several rows of one day the last to arrive stands."""
    return adjust(newest(rows, 1, [F.desc("arrival")], ["market", "ticker", "d"]))


def directory(live: DataFrame, delisted: DataFrame) -> DataFrame:
    """ticker, name, type, exchange, market, delisted of common stocks: the live listing first, then the delisted one; no unlisted venues, and in MY only codes that begin with a digit.

    Listings: code, name, type, exchange, market. Of several rows of a ticker the live one stands, then the first by name.
    """
    x = live.withColumn("delisted", F.lit(False)).unionByName(delisted.withColumn("delisted", F.lit(True)))
    x = x.filter(F.lower("type") == "common stock").withColumn("ticker", to_internal(F.col("code"), F.col("market")))
    x = newest(x, 1, [F.asc("delisted"), F.asc_nulls_last("name")], ["market", "ticker"])
    venue = F.upper("exchange")
    unlisted = F.coalesce(F.greatest(*(venue.startswith(p) for p in UNLISTED)), F.lit(False)) & (F.col("market") == "US")
    alias = (F.col("market") == "MY") & ~F.col("ticker").rlike("^[0-9]")
    return x.filter(~unlisted & ~alias).select("market", "ticker", "name", "type", "exchange", "delisted")


def splits(events: DataFrame, since: str) -> DataFrame:
    """Tickers with a split on or after a day, with the first of them: what must be read anew."""
    return events.filter(F.col("d") >= F.lit(since).cast("date")).groupBy("ticker").agg(F.min("d").alias("first"), F.count("*").alias("n"))


def deep_history(bars: DataFrame, listed: DataFrame, as_of: str, least: int = DEEP_BARS, value: float = DEEP_VALUE, stale: int = STALE_DAYS) -> DataFrame:
    """Bars of directory tickers, the delisted included, that have least bars or more and a median daily value at the floor or above.

    A "delisted" ticker that traded within stale days of as_of is an alias of a live one and goes.
    """
    flags = listed.groupBy("market", "ticker").agg(F.bool_and("delisted").alias("delisted"))
    per = bars.groupBy("market", "ticker").agg(F.count("*").alias("n"), F.max("d").alias("last"), F.median(F.col("c") * F.col("v")).alias("value")).join(flags, ["market", "ticker"])
    alias = F.col("delisted") & (F.datediff(F.lit(as_of).cast("date"), "last") <= stale)
    ok = per.filter(~alias & (F.col("n") >= least) & (F.col("value") >= value))
    return bars.join(ok.select("market", "ticker"), ["market", "ticker"], "left_semi")


def filings(submissions: DataFrame, forms: tuple[str, ...] = MATERIAL) -> DataFrame:
    """One row per filing of the parallel arrays of a registry's submissions (ticker, accession, form, filed, document), of the given forms; short arrays end with nulls."""
    zipped = F.arrays_zip("accession", "form", "filed", "document")
    x = submissions.select("ticker", F.explode(zipped).alias("f")).select("ticker", "f.*")
    return x.filter(F.col("form").isin(*forms) & F.col("accession").isNotNull())


def news_items(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """title, publisher, url, d of headline JSON in its two shapes: flat, or nested in `content`; items without title or address go. Other columns stay."""
    shape = "title string, publisher string, link string, pubDate string, providerPublishTime long, provider struct<displayName:string>, canonicalUrl struct<url:string>"
    j = F.from_json(raw, f"{shape}, content struct<{', '.join(':'.join(p.split(' ', 1)) for p in shape.split(', '))}>")
    x = rows.withColumn("_j", j).withColumn("_c", F.when(F.col("_j.content").isNotNull(), F.col("_j.content")))
    pick = lambda n: F.when(F.col("_c").isNotNull(), F.col(f"_c.{n}")).otherwise(F.col(f"_j.{n}"))
    day = F.coalesce(F.substring(pick("pubDate"), 1, 10).try_cast("date"), F.to_date(F.timestamp_seconds(pick("providerPublishTime"))))
    url = F.coalesce(pick("canonicalUrl.url"), pick("link"))
    out = x.select(*rows.drop(raw).columns, pick("title").alias("title"), F.coalesce(pick("provider.displayName"), pick("publisher")).alias("publisher"), url.alias("url"), day.alias("d"))
    return out.filter("title <> '' and url <> ''")


def relevant(title: Column, symbols: Column, ticker: Column, company: Column) -> Column:
    """Whether a headline is about a ticker: its title has the bare ticker as a word or a telling word of the company's name, or it is tagged with that ticker and hardly any other."""
    low, bare = F.lower(title), F.split_part(ticker, F.lit("."), F.lit(1))
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(company, F.lit(""))), F.lit(r"([a-z0-9.']+)"), 1), lambda w: (F.length(w) > 2) & ~w.isin(*NAME_STOPS))
    named = F.exists(F.regexp_extract_all(low, F.lit(r"(\w+)"), 1), lambda w: w == F.lower(bare)) | F.exists(words, lambda w: F.contains(low, w))
    tagged = F.exists(symbols, lambda s: (F.upper(s) == F.upper(to_vendor(ticker))) | (F.split_part(F.upper(s), F.lit("."), F.lit(1)) == F.upper(bare)))
    return F.coalesce(named, F.lit(False)) | F.coalesce(tagged & (F.size(symbols) <= FEW_SYMBOLS) & (F.size(symbols) <= MOST_SYMBOLS), F.lit(False))


def feed_walk(items: DataFrame, known: DataFrame, since: str) -> DataFrame:
    """New items of paged feeds (feed, page, item_id, d) as a reader would find them who stops early.

    An item counts on its first page. Reading stops before a page without new items or with none on or after since
    (an item without a day counts as recent), and, where anything is known, after a page of which all such items are.
    """
    once = newest(items, 1, [F.asc("page")], ["feed", "item_id"])
    recent = once.withColumn("fresh", F.col("d").isNull() | (F.col("d") >= F.lit(since).cast("date")))
    marked = recent.join(known.select("item_id").distinct().withColumn("_known", F.lit(True)), "item_id", "left").withColumn("new", F.col("fresh") & F.col("_known").isNull())
    pages = items.select("feed", "page").distinct().join(marked.groupBy("feed", "page").agg(F.count_if("fresh").alias("fresh"), F.count_if("new").alias("new")), ["feed", "page"], "left")
    ends = pages.groupBy("feed").agg(F.min(F.when(F.coalesce("fresh", F.lit(0)) == 0, F.col("page"))).alias("_before"), F.min(F.when(F.coalesce("new", F.lit(0)) == 0, F.col("page"))).alias("_after"))
    use = F.least(F.coalesce("_before", F.lit(1 << 30)), F.when(known.exists(), F.coalesce(F.col("_after") + 1, F.lit(1 << 30))).otherwise(F.lit(1 << 30)))
    return marked.filter("new").join(ends, "feed").filter(F.col("page") < use).select("feed", "page", "item_id", "d")


def stale_markets(bars: DataFrame, expected: DataFrame) -> DataFrame:
    """Markets whose newest bar is not of the expected session (market, session): empty if all are fresh."""
    last = bars.groupBy("market").agg(F.max("d").alias("last"))
    return expected.join(last, "market", "left").filter(~F.col("last").eqNullSafe(F.col("session"))).select("market", "session", "last")


def assert_fresh(bars: DataFrame, expected: DataFrame) -> None:
    """Raise if a market's newest bar is not of its expected session."""
    rows = stale_markets(bars, expected).collect()  # one row a market at most
    if rows:
        raise ValueError("stale: " + ", ".join(f"{r['market']} at {r['last']}, expected {r['session']}" for r in rows))


def sessions_on(calendar: DataFrame, day: str) -> DataFrame:
    """Markets that trade on a day."""
    return calendar.filter(F.col("d") == F.lit(day).cast("date")).select("market").distinct()


def finite(x: Column) -> Column:
    """A number, or null for NaN and the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


# The instruments that a market's regime is read from; they are no common stock.
BENCHMARKS = {"MY": ["0820EA.KL"], "US": ["SPY", "QQQ"]}


def benchmark_dimension(spark) -> DataFrame:
    """market, ticker, place of the benchmarks: a small table, to be joined and extended like others."""
    rows = [(m, t, k) for m, ts in BENCHMARKS.items() for k, t in enumerate(ts)]
    return spark.createDataFrame(rows, "market string, ticker string, place int")


def benchmarks_for(bars: DataFrame, dimension: DataFrame, years: int, as_of: str) -> DataFrame:
    """Bars of the benchmarks over so many years before a day, with their place; a benchmark without bars has none, and no error."""
    since = F.add_months(F.lit(as_of).cast("date"), -12 * years)
    x = bars.join(F.broadcast(dimension.select("market", "ticker", "place")), ["market", "ticker"])  # a few rows a market
    return x.filter((F.col("d") > since) & (F.col("d") <= F.lit(as_of).cast("date")))


def all_listed(live: DataFrame, delisted: DataFrame) -> DataFrame:
    """Every ticker of either directory once: market, ticker, delisted (only where no live entry has it)."""
    both = live.select("market", "ticker", F.lit(False).alias("delisted")).union(delisted.select("market", "ticker", F.lit(True).alias("delisted")))
    return both.groupBy("market", "ticker").agg(F.bool_and("delisted").alias("delisted"))

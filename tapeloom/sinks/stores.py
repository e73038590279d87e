"""The stored tables of a screening installation, and the saves that a night makes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import storage as st
from tapeloom.sinks.tables import Table

BARS = "market string, ticker string, d date, o double, h double, l double, c double, v double"
#: Saved backtests of the nightly label that stay.
NIGHTLY = 30


def bars(spark: SparkSession, path: str) -> Table:
    """Daily bars by market and month: a night's save rewrites one month of each market."""
    return Table(spark, path, BARS, ["market", "ticker", "d"], {"by_market": "market", "by_month": "date_format(d, 'yyyy-MM')"})


def history(spark: SparkSession, path: str) -> Table:
    """The cache of deep histories: by market and a hash of the ticker, so that a ticker's bars lie in one partition."""
    return Table(spark, path, BARS + ", years int", ["market", "ticker", "years", "d"], {"by_market": "market", "by_hash": "pmod(hash(ticker), 64)"})


def news(spark: SparkSession, path: str) -> Table:
    """Headlines and announcements by kind and a hash of the item id."""
    return Table(spark, path, "ticker string, kind string, item_id string, title string, url string, source string, category string, published date", ["kind", "item_id"], {"by_kind": "kind", "by_hash": "pmod(hash(item_id), 16)"})


def runs(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, "run_day date, regime map<string, string>", ["run_day"], {"by_year": "year(run_day)"})


def board(spark: SparkSession, path: str) -> Table:
    """Candidates by run and market: a later scan of one market replaces its own rows only."""
    return Table(spark, path, "run_day date, market string, ticker string, bucket string, place int, quality int, rs_rank int, price double, pivot double, stop double", ["run_day", "market", "ticker"], {"by_day": "run_day", "by_market": "market"})


def sectors(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, "run_day date, market string, industry string, place int, score double", ["run_day", "market", "industry"], {"by_day": "run_day", "by_market": "market"})


def positions(spark: SparkSession, path: str) -> Table:
    """Open positions with their newest price and signals."""
    return Table(spark, path, "id long, market string, ticker string, last_price double, as_of date, signals map<string, boolean>", ["id"], {"by_hash": "pmod(id, 8)"})


def backtests(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, "id long, created timestamp, label string, market string, strategy string, trades long, expectancy double", ["id"], {"by_year": "year(created)"})


def save_run(run_table: Table, board_table: Table, sector_table: Table, run: DataFrame, candidates: DataFrame, industries: DataFrame) -> None:
    """One night's run: its regime entries merged over those of the day, its candidates in place of the day's of the same markets, and its sectors likewise, if it has any.

    Candidates and sectors of markets that the run lacks stay. The run comes first, so that a board never lacks its run.
    """
    day = run.select("run_day").distinct()
    stored = run_table.rows().join(F.broadcast(day), "run_day", "left_semi")
    run_table.upsert(st.save_run(stored, run))
    board_table.replace(candidates)
    if not industries.isEmpty():
        sector_table.replace(industries)


def save_positions(table: Table, newest: DataFrame) -> None:
    """Each position's newest price and signals over the stored ones; a missing price keeps the last."""
    table.upsert(newest, keep=["last_price"], order=["as_of"])


def save_backtests(table: Table, new: DataFrame, keep: int = NIGHTLY) -> None:
    """New backtests beside the others; of those labelled `nightly ...` the newest stay."""
    table.append(new)

    def retained(rows: DataFrame) -> DataFrame:
        nightly = F.coalesce(F.col("label").startswith("nightly "), F.lit(False))
        return rows.filter(~nightly).unionByName(rows.filter(nightly).orderBy(F.desc("created"), F.desc("id")).limit(keep))

    table.rewrite(retained)


def through_cache(cache: Table, wanted: DataFrame, years: int, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Deep histories of wanted tickers (market, ticker): those that the cache has for so many years, and the rest fetched once and stored.

    fetch gets the tickers that are missing. A ticker without history is asked for again the next time.
    """
    have = cache.rows().filter(F.col("years") == years).select("market", "ticker").distinct()
    missing = wanted.select("market", "ticker").distinct().join(have, ["market", "ticker"], "left_anti")
    if not missing.isEmpty():
        cache.upsert(fetch(missing).withColumn("years", F.lit(years)))
    return cache.rows().filter(F.col("years") == years).join(wanted.select("market", "ticker").distinct(), ["market", "ticker"], "left_semi").drop("years")

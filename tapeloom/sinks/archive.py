"""The archive walk: feeds read back page by page, deeper each round, with the progress saved.

A round asks for the next pages of every feed that is still open, twice as many as the round before. What it finds and
how far it came are saved before the next round begins, so a stopped walk goes on where it stopped. Feeds are walked
side by side, as rows of one DataFrame; only the rounds follow each other, and their number is the logarithm of a
feed's depth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.stage import kept, written
from tapeloom.sinks.tables import Table
from tapeloom.sources import dossier, markup

Fetch = Callable[[DataFrame], DataFrame]
FEED = ["ticker", "kind"]


class NothingParsed(RuntimeError):
    """Pages came, no item was read from any, and the archive is empty: the pages have changed, or the parser is wrong."""


def progress(spark: SparkSession, path: str) -> Table:
    """How far each feed of a walk was read: pages done, whether it is open, items read."""
    return Table(spark, path, "walk string, ticker string, kind string, pages int, is_open boolean, items long", ["walk", "ticker", "kind"], {"by_walk": "walk"})


def found(spark: SparkSession, path: str) -> Table:
    """The items that each feed of a walk has shown, with their page: what a page shows again is not news."""
    return Table(spark, path, "walk string, ticker string, kind string, item_id string, page int", ["walk", "ticker", "kind", "item_id"], {"by_walk": "walk", "by_hash": "pmod(hash(item_id), 16)"})


def _round(items: DataFrame, asked: DataFrame, seen: DataFrame, since: str) -> tuple[DataFrame, DataFrame]:
    """The items of a round that count, and each feed's page (the first that ends its reading, or null).

    Reading ends at a page without an item that the walk has not seen, and at one whose unseen items are all older than
    since; an item without a date has no age.
    """
    once = items.withColumn("_r", F.row_number().over(Window.partitionBy(*FEED, "item_id").orderBy("page"))).filter("_r = 1").drop("_r")
    unseen = once.join(seen.select(*FEED, "item_id"), [*FEED, "item_id"], "left_anti").withColumn("fresh", F.col("published").isNull() | (F.col("published") >= F.lit(since).cast("date")))
    pages = asked.join(unseen.groupBy(*FEED, "page").agg(F.count_if("fresh").alias("fresh")), [*FEED, "page"], "left")
    ends = pages.groupBy(*FEED).agg(F.min(F.when(F.coalesce("fresh", F.lit(0)) == 0, F.col("page"))).alias("end"), F.max("page").alias("last"))
    counted = unseen.filter("fresh").join(ends, FEED).filter(F.col("end").isNull() | (F.col("page") < F.col("end")))
    return counted.drop("fresh", "end", "last"), ends


def walk(name: str, tickers: DataFrame, fetch: Fetch, news: Table, state: Table, shown: Table, base: str, since: str, most: int = 15, most_filed: int = 5, first: int = 1) -> DataFrame:
    """Walk the feeds of tickers (ticker) to their stored depth and return the walk's progress rows.

    fetch(asked) gives the pages (ticker, kind, page, html) of the asked (ticker, kind, page) that exist. Items are
    saved over the archive by kind and id: a known one is refreshed, and does not stop the walk. Announcements carry no
    year, so their pages are bounded apart. A walk of a name that is finished does nothing more.
    """
    kinds = F.explode(F.array(F.lit("news"), F.lit("announcement")))
    most_of = F.when(F.col("kind") == "news", most).otherwise(min(most, most_filed))
    mine = lambda table: table.rows().filter(F.col("walk") == name)
    known = mine(state).select(*FEED)
    new = tickers.select(F.col("ticker").cast("string").alias("ticker")).distinct().withColumn("kind", kinds).join(known, FEED, "left_anti")
    state.upsert(new.select(F.lit(name).alias("walk"), *FEED, F.lit(0).alias("pages"), F.lit(True).alias("is_open"), F.lit(0).cast("long").alias("items")))
    step = first
    while _go_on(name, fetch, news, state, shown, base, since, most_of, step):
        step *= 2
    if news.rows().isEmpty() and not mine(state).isEmpty():
        raise NothingParsed(f"walk {name}: no item was read and the archive is empty")
    return mine(state)


def _go_on(name: str, fetch: Fetch, news: Table, state: Table, shown: Table, base: str, since: str, most_of, step: int) -> bool:
    """One round of step pages for every open feed; false if none is open."""
    with kept():
        todo = written(state.rows().filter((F.col("walk") == name) & F.col("is_open")), "walk-open")
        if todo.isEmpty():
            return False
        pages = F.sequence(F.col("pages") + 1, F.least(F.col("pages") + step, most_of))
        asked = written(todo.withColumn("page", F.explode(pages)).select(*FEED, "page"), "walk-asked")
        got = fetch(asked).select(*FEED, "page", "html")
        filed = F.col("kind") == "announcement"
        items = dossier.feed(markup.parsed(got, parts=["feed"]), base).withColumnRenamed("d", "published")
        items = items.withColumns({"category": F.when(filed, dossier.announcement_kind(F.col("title"))), "source": F.when(filed, "").otherwise(F.col("source"))})
        counted, ends = _round(written(items, "walk-items"), asked, shown.rows().filter(F.col("walk") == name), since)
        counted = written(counted, "walk-counted")
        # items first, progress last: a walk that stops in between reads the same pages again, to the same state
        news.upsert(counted, keep=["published"], order=["ticker"], settled=True)
        per = counted.groupBy(*FEED).agg(F.count("*").alias("more"))
        after = todo.join(ends, FEED).join(per, FEED, "left")
        is_open = F.col("end").isNull() & (F.col("last") < most_of)
        read = after.select("walk", *FEED, F.coalesce("end", "last").cast("int").alias("pages"), is_open.alias("is_open"), (F.col("items") + F.coalesce("more", F.lit(0))).alias("items"))
        read = written(read, "walk-progress")
        shown.upsert(counted.select(F.lit(name).alias("walk"), *FEED, "item_id", "page"), settled=True)
        state.upsert(read, settled=True)
        return True

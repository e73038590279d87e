"""Upserts, retention, gates and reads of the warehouse, on plain tables: each gives the table's next state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = (), order: list[str] = ()) -> DataFrame:
    """Rows of old with those of new over them, by key; columns in keep fall back to the old value where the new is null.

    Of rows of one key within new that with the largest order counts; without an order new has one row a key.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("_new"), *(F.desc_nulls_last(c) for c in order))
    rest = [c for c in old.columns if c not in key]
    filled = [F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias(c) if c in keep else F.col(c) for c in rest]
    return both.select(*key, *filled, F.row_number().over(w).alias("_r")).filter("_r = 1").drop("_r")


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Old rows outside the scopes that new has, and new: delete-then-insert by partition."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def newest(df: DataFrame, n: int, order: list[Column], by: list[str]) -> DataFrame:
    """The first n rows in order, by group: retention."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, nothing replaced."""
    return old.unionByName(new)


def ingest(bars: DataFrame, fresh: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next states of the bars and of meta (market, last_ingested): fresh bars over stored ones by ticker and day; a market's newest fresh day, never back."""
    days = fresh.groupBy("market").agg(F.max("d").alias("last_ingested"))
    later = meta.unionByName(days).groupBy("market").agg(F.max("last_ingested").alias("last_ingested"))
    return upsert(bars, fresh, ["market", "ticker", "d"]), later


def merge_maps(old: Column, new: Column) -> Column:
    """Entries of both maps; of one key the new entry stands. A null map counts as empty."""
    a, b = F.coalesce(old, F.map_filter(new, lambda k, v: F.lit(False))), F.coalesce(new, F.map_filter(old, lambda k, v: F.lit(False)))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def save_run(runs: DataFrame, run: DataFrame) -> DataFrame:
    """Runs (run_day, regime map, ...) after one is saved: by run_day, its regime entries merged over the stored ones."""
    both = runs.select("run_day", F.col("regime").alias("_old")).join(run.select("run_day", F.col("regime").alias("_new")), "run_day", "full")
    return both.select("run_day", merge_maps(F.col("_old"), F.col("_new")).alias("regime"))


def repull(bars: DataFrame, affected: DataFrame, fresh: DataFrame) -> DataFrame:
    """Bars with every affected ticker's history replaced by the fresh one; an affected ticker without fresh rows keeps its old ones."""
    got = affected.select("ticker").distinct().join(fresh.select("ticker").distinct(), "ticker", "left_semi")
    return bars.join(got, "ticker", "left_anti").unionByName(fresh.join(got, "ticker", "left_semi"))


def save_news(old: DataFrame, new: DataFrame) -> DataFrame:
    """News after an upsert by kind and item id: rows without an id are skipped, and a missing date keeps the stored one.

    Of new rows of one item the newest counts, of one day that of the smallest hash.
    """
    return upsert(old, newest(new.filter("item_id is not null"), 1, [F.desc_nulls_last("published"), F.asc(F.xxhash64(*new.columns))], ["kind", "item_id"]), ["kind", "item_id"], keep=["published"])


def news_window(news: DataFrame, now: str, days: int = 90, headlines: int = 12, announcements: int = 10) -> DataFrame:
    """Per ticker its newest headlines within days, and its newest announcements of any age: by date, then by ids that are numbers, others last."""
    number = F.when(F.col("item_id").rlike("^[0-9]+$"), F.col("item_id").try_cast("decimal(38,0)"))
    since = F.date_sub(F.lit(now).cast("date"), days)
    items = newest(news.filter((F.col("kind") == "news") & (F.col("published") > since)), headlines, [F.desc("published"), F.asc("item_id")], ["ticker"])
    filed = newest(news.filter("kind = 'announcement'"), announcements, [F.desc_nulls_last("published"), number.desc_nulls_last(), F.asc("item_id")], ["ticker"])
    return items.unionByName(filed)


def known_ids(news: DataFrame) -> DataFrame:
    return news.filter("item_id is not null").select("item_id").distinct()


def prune(df: DataFrame, now: str, keep: int) -> DataFrame:
    """Rows no older than what keep sessions span: int(keep x 1.45) calendar days."""
    return df.filter(F.col("d") >= F.date_sub(F.lit(now).cast("date"), int(keep * 1.45)))


def purge(table: DataFrame, directory: DataFrame, key: str, always: list[str] = ()) -> DataFrame:
    """Rows whose key the directory (or always) has; everything where the directory is empty. Rows without a key go."""
    listed = directory.select(key).dropna().distinct().withColumn("_listed", F.lit(True))
    keep = F.col("_listed") | F.col(key).isin(list(always)) | ~directory.exists()
    return table.join(listed, key, "left").filter(keep).select(table.columns)


def load_window(bars: DataFrame, sessions: int = 3, least: int = 200) -> DataFrame:
    """Bars of tickers that traded in their market's last three sessions and have least bars or more."""
    days = newest(bars.select("market", "d").distinct(), sessions, [F.desc("d")], ["market"]).groupBy("market").agg(F.min("d").alias("since"))
    ok = bars.join(F.broadcast(days), "market").groupBy("market", "ticker").agg(F.max("d").alias("last"), F.max("since").alias("since"), F.count("*").alias("n")).filter((F.col("last") >= F.col("since")) & (F.col("n") >= least))
    return bars.join(ok.select("market", "ticker"), ["market", "ticker"], "left_semi")


def adjust(bars: DataFrame) -> DataFrame:
    """Prices scaled by adjusted over raw close (1 where that is null or not positive), volume the other way."""
    f = F.coalesce(F.when(F.col("c") > 0, F.col("adj") / F.col("c")), F.lit(1.0))
    return bars.select("market", "ticker", "d", *((F.col(x) * f).alias(x) for x in ("o", "h", "l", "c")), F.round(F.try_divide("v", f)).alias("v"))


def coverage(bars: DataFrame, days: int = 10) -> DataFrame:
    """Per market and day the tickers with volume, the median of the ten days before, and whether the drop exceeds 2 %."""
    n = bars.groupBy("market", "d").agg(F.count_if(F.col("v") > 0).alias("n"))
    w = Window.partitionBy("market").orderBy("d").rowsBetween(-days, -1)
    x = n.withColumn("usual", F.percentile("n", F.lit(0.5)).over(w))
    return x.withColumn("short", F.coalesce(F.col("n") < 0.98 * F.col("usual"), F.lit(False)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def classify(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first rule whose pattern the text has."""
    out = F.when(text.rlike(rules[0][1]), rules[0][0])
    for label, pattern in rules[1:]:
        out = out.when(text.rlike(pattern), label)
    return out.otherwise(default)


def headlines(items: DataFrame, limit: int) -> DataFrame:
    """The newest limit items per ticker, one of each title (letters and digits only, lower case): the newest, then the smallest id."""
    x = items.withColumn("_t", F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    x = newest(x, 1, [F.desc_nulls_last("published"), F.asc("item_id")], ["ticker", "_t"])
    return newest(x, limit, [F.desc_nulls_last("published"), F.asc("item_id")], ["ticker"]).drop("_t")

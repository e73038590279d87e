"""Queries of stored tables: what is read back after several saves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapeloom.functions.stage import folder, written
from tapeloom.plans.company import _FEED, _KINDS_SQL, feed_documents
from tapeloom.plans.indicators import FEATURES_SQL
from tapeloom.registry import query
from tapeloom.sinks import archive, stores, upkeep
from tapeloom.sources.panel import BARS_SQL, bars


def _place(spark, name: str) -> str:
    """A new table's folder: a query stores to a table of its own."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(BARS_SQL + """ SELECT market, strftime(d, '%Y-%m') AS month, count(*) AS n, sum(CASE WHEN d < DATE '2000-01-10' THEN 2 * c ELSE c END) AS total, max(d) AS last
  FROM bars GROUP BY 1, 2""")
def stored_bars(spark, sf_dir):
    """A first save of bars at twice their price, then one of those from a day in the middle of a month on."""
    b = bars(spark, sf_dir)
    t = stores.bars(spark, _place(spark, "bars"))
    t.upsert(b.filter("d < date '2000-03-01'").withColumn("c", F.col("c") * 2))
    t.upsert(b.filter("d >= date '2000-01-10'"))
    return t.read().groupBy("market", F.col("by_month").alias("month")).agg(F.count("*").alias("n"), F.sum("c").alias("total"), F.max("d").alias("last"))


@query(BARS_SQL + """, n AS (SELECT market, ticker, d, c, row_number() OVER (PARTITION BY market, ticker ORDER BY d DESC) AS r FROM bars)
SELECT CAST(DATE '2001-01-01' + CAST(r AS INTEGER) AS DATE) AS run_day, market, count(*) AS n, round(sum(c), 4) AS total FROM n
  WHERE r <= 4 AND (r < 4 OR market = 'MY') AND (r <> 2 OR market <> 'US' OR c >= 50) GROUP BY 1, 2""")
def stored_boards(spark, sf_dir):
    """Four runs; the second run's US board is saved again, shorter, and the last run has MY alone."""
    from tapeloom.functions.frames import newest_first

    r = F.row_number().over(newest_first())
    b = bars(spark, sf_dir).withColumn("r", r).filter("r <= 4").withColumn("run_day", F.date_add(F.lit("2001-01-01").cast("date"), F.col("r")))
    none = [F.lit(None).cast(k).alias(c) for c, k in (("bucket", "string"), ("place", "int"), ("quality", "int"), ("rs_rank", "int"), ("pivot", "double"), ("stop", "double"))]
    rows = b.select("r", "run_day", "market", "ticker", F.col("c").alias("price"), *none)
    at = _place(spark, "run")
    tables = [f(spark, f"{at}-{i}") for i, f in enumerate((stores.runs, stores.board, stores.sectors))]
    empty = rows.limit(0).select("run_day", "market", F.lit("x").alias("industry"), F.lit(1).alias("place"), F.lit(1.0).alias("score"))
    for part in (rows.filter("r < 4"), rows.filter("r = 4 and market = 'MY'"), rows.filter("r = 2 and market = 'US' and price >= 50")):
        lights = part.select("run_day", "market").distinct().groupBy("run_day").agg(F.map_from_entries(F.collect_list(F.struct("market", F.lit("green")))).alias("regime"))
        stores.save_run(*tables, lights, part.drop("r"), empty)
    x = tables[1].rows().join(tables[0].rows().select("run_day", F.explode("regime").alias("market", "light")), ["run_day", "market"])
    return x.groupBy("run_day", "market").agg(F.count("*").alias("n"), F.round(F.sum("price"), 4).alias("total"))


@query(BARS_SQL + " SELECT market, ticker, count(*) AS n FROM bars WHERE ascii(ticker[7]) % 3 < 2 GROUP BY 1, 2")
def cached_histories(spark, sf_dir):
    """Asked for a third of the tickers, then for two: only the second third is fetched then, and what is fetched is not looked at twice."""
    b = bars(spark, sf_dir)
    part = F.ascii(F.substring("ticker", 7, 1)) % 3
    cache = stores.history(spark, _place(spark, "history"))
    stores.through_cache(cache, b.filter(part == 0).select("market", "ticker"), 5, lambda m: b.join(m, ["market", "ticker"], "left_semi"))
    got = stores.through_cache(cache, b.filter(part < 2).select("market", "ticker"), 5, lambda m: b.filter(part == 1).join(m, ["market", "ticker"], "left_semi"))
    return got.groupBy("market", "ticker").agg(F.count("*").alias("n"))


@query(f"""WITH {_FEED}, k AS (SELECT *, page + 1 AS p, CASE WHEN news THEN d END AS published FROM f), g AS (SELECT *, published IS NULL OR published >= DATE '2024-02-20' AS fresh FROM k),
pages AS (SELECT feed, p, count(*) FILTER (fresh) AS n FROM g GROUP BY 1, 2), ends AS (SELECT feed, least(coalesce(min(p) FILTER (n = 0), 1000000), CASE WHEN ascii(feed) % 2 = 1 THEN 16 ELSE 6 END) AS stop FROM pages GROUP BY 1)
SELECT feed AS ticker, CASE WHEN news THEN 'news' ELSE 'announcement' END AS kind, CAST(doc_id AS VARCHAR) AS item_id, published,
  CASE WHEN NOT news THEN {_KINDS_SQL} END AS category FROM g JOIN ends USING (feed) WHERE fresh AND p < stop""")
def archived_items(spark, sf_dir):
    """Feeds printed from documents, walked back to a day."""
    pages = feed_documents(spark, sf_dir).select(F.col("feed").alias("ticker"), F.when(F.ascii("feed") % 2 == 1, "news").otherwise("announcement").alias("kind"), (F.col("page") + 1).alias("page"), "html")
    pages = written(pages, "feed-pages")  # every round reads of them
    at = _place(spark, "archive")
    news, state, shown = stores.news(spark, f"{at}-n"), archive.progress(spark, f"{at}-p"), archive.found(spark, f"{at}-f")
    archive.walk("deep", pages.select("ticker").distinct(), lambda asked: pages.join(asked, ["ticker", "kind", "page"], "left_semi"), news, state, shown, "http://x.example", "2024-02-20", first=4)
    return news.rows().select("ticker", "kind", "item_id", "published", "category")


@query(FEATURES_SQL + """ SELECT ticker, d, CAST(k AS BIGINT) AS k, round(ma50, 6) AS ma50, round(ma200, 6) AS ma200, round(ma200_22, 6) AS ma200_22, hi252, lo252,
  round(vol50, 4) AS vol50, round(rs_raw, 6) AS rs_raw FROM features WHERE d >= DATE '2001-08-01'""")
def nightly_features(spark, sf_dir):
    """An extension: two nights after a history; some tickers' bars of the first come with the second."""
    b = bars(spark, sf_dir)
    at = _place(spark, "nightly")
    tables = stores.bars(spark, f"{at}-b"), upkeep.tails(spark, f"{at}-t"), upkeep.features(spark, f"{at}-f")
    held = (F.col("d") < F.lit("2001-08-20").cast("date")) & (F.ascii(F.substring("ticker", 7, 1)) % 7 == 0)
    late = b.filter("d >= date '2001-08-10'")
    upkeep.night(*tables, b.filter("d < date '2001-08-10'"))
    upkeep.night(*tables, late.filter("d < date '2001-08-20'").filter(~held))
    upkeep.night(*tables, late.filter((F.col("d") >= F.lit("2001-08-20").cast("date")) | held))
    x = tables[2].rows().filter("d >= date '2001-08-01'")
    return x.select("ticker", "d", "k", *(F.round(c, 6).alias(c) for c in ("ma50", "ma200", "ma200_22")), "hi252", "lo252", F.round("vol50", 4).alias("vol50"), F.round("rs_raw", 6).alias("rs_raw"))

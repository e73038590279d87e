"""Queries of pages, over a made-up history of boards: customers are tickers, orders the runs they were on."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import pages as pg
from tapeloom.plans.indicators import _r
from tapeloom.registry import query
from tapeloom.sources.panel import table

_HISTORY_SQL = """WITH cand AS (SELECT CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS run_id, 'C' || CAST(o_custkey AS VARCHAR) AS ticker, max(o_totalprice) AS quality FROM orders GROUP BY 1, 2),
runs AS (SELECT DISTINCT CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS run_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS run_day FROM orders)"""


def _history(spark, sf_dir):
    o, run = table(spark, sf_dir, "orders"), F.date_format("o_orderdate", "yyyyMM").cast("long")
    cand = o.groupBy(run.alias("run_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker")).agg(F.max("o_totalprice").alias("quality"))
    return cand, o.select(run.alias("run_id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("run_day")).distinct()


@query(_HISTORY_SQL + " SELECT ticker, quality, run_day AS as_of FROM cand JOIN runs USING (run_id) WHERE run_day = (SELECT max(run_day) FROM runs)")
def newest_board(spark, sf_dir):
    return pg.newest_board(*_history(spark, sf_dir)).select("ticker", "quality", "as_of")


@query(_HISTORY_SQL + " SELECT ticker, quality, run_day AS as_of FROM cand JOIN runs USING (run_id) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY run_day DESC) = 1")
def candidate_detail(spark, sf_dir):
    return pg.candidate_detail(*_history(spark, sf_dir)).select("ticker", "quality", "as_of")


@query("SELECT event_type AS market, event_id AS id FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE) DESC, event_id DESC) = 1")
def newest_run_by_market(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("market"), F.col("event_id").alias("id"), F.to_date("ts").alias("created"))
    return pg.newest_by(e, "market").select("market", "id")


_GROUP_SQL = """WITH b AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS ticker, ['swing', 'watchlist', 'position', 'forming'][p_partkey % 4 + 1] AS bucket, 100.0::DOUBLE AS price, CASE WHEN p_partkey % 5 > 0 THEN 80 + p_partkey % 41 END AS pv, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS ready, p_partkey % 99 AS rank FROM part),
o AS (SELECT *, (price / pv - 1) * 100 AS off FROM b), g AS (SELECT *, CASE WHEN bucket = 'swing' AND coalesce(off >= 0, false) THEN 'triggered' WHEN bucket = 'swing' THEN 'at_buy_point' WHEN coalesce(off > -12 AND off < 3, false) THEN 'close' ELSE bucket END AS grp FROM o)"""


@query(_GROUP_SQL + """ SELECT ticker, grp AS "group", row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN grp = 'close' THEN coalesce(ready, -1) END DESC NULLS LAST, CASE WHEN grp = 'close' THEN abs(off) END NULLS LAST, rank DESC, ticker) AS place,
 CASE WHEN rank >= 90 THEN 'high' WHEN rank >= 70 THEN 'middle' ELSE 'low' END AS tier FROM g""")
def board_groups(spark, sf_dir):
    k = F.col("p_partkey")
    bucket = F.element_at(F.array(*(F.lit(b) for b in ("swing", "watchlist", "position", "forming"))), (k % 4 + 1).cast("int"))
    b = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), k.cast("string")).alias("ticker"), bucket.alias("bucket"), F.lit(100.0).alias("price"), F.when(k % 5 > 0, (80 + k % 41).cast("double")).alias("pivot"), F.when(k % 3 > 0, F.col("p_size")).alias("ready"), (k % 99).alias("rs_rank"))
    return pg.board_groups(b).select("ticker", "group", F.col("place").cast("long").alias("place"), pg.tier(F.col("rs_rank"), 90, 70).alias("tier"))


@query("""WITH b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'MY' ELSE 'US' END AS market, 100.0::DOUBLE AS pv, 90.0::DOUBLE + s_suppkey % 16 AS stop FROM supplier), c AS (SELECT * FROM b WHERE pv > stop)
SELECT id AS ticker, 'stop' AS level, stop AS price FROM c UNION ALL SELECT id, 'expectancy', round(pv + 0.25 * (pv - stop), 6) FROM c WHERE market = 'MY' UNION ALL SELECT id, 'mean_win', round(pv + 2.5 * (pv - stop), 6) FROM c WHERE market = 'MY'""")
def chart_levels(spark, sf_dir):
    s = F.col("s_suppkey")
    b = table(spark, sf_dir, "supplier").select(s.alias("ticker"), F.when(s % 2 == 0, "MY").otherwise("US").alias("market"), F.lit(100.0).alias("pivot"), (F.lit(90.0) + s % 16).alias("stop"))
    stats = spark.createDataFrame([("MY", 0.25, 2.5), ("US", None, None)], "market string, expectancy double, mean_win double")
    return pg.chart_levels(b, stats).select("ticker", "level", _r(F.col("price"), "price"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(ts AS DATE) END AS d, CASE WHEN event_id % 3 = 0 THEN 'n' || CAST(user_id AS VARCHAR) || '.example' WHEN event_id % 3 = 1 THEN 'a.example:80' ELSE '' END AS host, CAST(props->>'$.k' AS DOUBLE) AS k FROM events""")
def page_scalars(spark, sf_dir):
    """Days in four formats and none, addresses, and a number inside JSON."""
    k, day = F.col("event_id") % 5, F.to_date("ts")
    text = F.when(k == 0, F.date_format(day, "d MMM, yyyy")).when(k == 1, F.date_format(day, "d MMMM yyyy")).when(k == 2, day.cast("string")).when(k == 3, F.date_format(day, "dd/MM/yyyy")).otherwise("soon")
    m = F.col("event_id") % 3
    url = F.when(m == 0, F.concat(F.lit("https://www.n"), F.col("user_id").cast("string"), F.lit(".example/a?b"))).when(m == 1, "http://a.example:80").otherwise("nothing")
    return table(spark, sf_dir, "events").select("event_id", pg.parse_day(text).alias("d"), pg.host(url).alias("host"), pg.json_number(F.col("props"), "$.k").alias("k"))

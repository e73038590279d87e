"""Queries of the desk's reads: runs, reviews, factor batches, the brief, industries' headlines, benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import charts
from tapeloom.operators import enrich as en
from tapeloom.operators import fundamentals as fu
from tapeloom.operators import pages as pg
from tapeloom.operators import reads as rd
from tapeloom.plans.fundamentals import QUARTERS_SQL, quarters
from tapeloom.plans.receipts import _BOARD_SQL, _board
from tapeloom.registry import ORACLE_SQL, query
from tapeloom.sources import vendor as vd
from tapeloom.sources.panel import BARS_SQL, bars, table


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created"), F.col("event_type").alias("label"), F.col("value").alias("expectancy"))


@query("SELECT event_id AS id, event_type AS label FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_runs(spark, sf_dir):
    return pg.recent_runs(_runs(spark, sf_dir)).select("id", "label")


@query("SELECT event_id AS id, event_type AS label FROM events WHERE event_id = (SELECT max(event_id) // 2 FROM events)")
def run_by_id(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return pg.run_by_id(runs, runs.agg(F.max("id")).first()[0] // 2).select("id", "label")


@query("SELECT event_id AS id, event_type AS label FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_review(spark, sf_dir):
    return pg.latest_review(_runs(spark, sf_dir).filter("label = 'purchase'")).select("id", "label")


_BATCH_SQL = """f AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'MY' ELSE 'US' END AS market, o_orderpriority AS factor, CAST(o_custkey % 5 + 1 AS INTEGER) AS bucket,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS computed, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders
  WHERE NOT (o_orderpriority LIKE '1%' AND o_orderdate >= TIMESTAMP '2001-03-01') GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {_BATCH_SQL} SELECT market, factor, bucket, computed, n, mean FROM f WHERE computed = (SELECT max(computed) FROM f g WHERE g.factor = f.factor)")
def factor_batches(spark, sf_dir):
    """Factor rows of every month; one factor's newest batch is older than the others'."""
    o = table(spark, sf_dir, "orders").filter("not (o_orderpriority like '1%' and o_orderdate >= timestamp '2001-03-01')")
    market = F.when(F.col("o_custkey") % 2 == 0, "MY").otherwise("US")
    month = F.trunc(F.to_date("o_orderdate"), "month")
    rows = o.groupBy(market.alias("market"), F.col("o_orderpriority").alias("factor"), (F.col("o_custkey") % 5 + 1).cast("int").alias("bucket"), month.alias("computed")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return pg.latest_factor_tables(rows)


_SEG = "candidates AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'MY' ELSE 'US' END AS market, c_mktsegment AS industry, c_custkey AS ticker, CASE WHEN c_custkey % 6 > 0 THEN CAST(c_custkey % 99 AS INTEGER) END AS rs_rank FROM customer)"


@query(f"""WITH {_SEG}, big AS (SELECT market, industry FROM candidates WHERE market = 'MY' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY market ORDER BY count(*) DESC, industry) <= 3),
top AS (SELECT c.* FROM candidates c JOIN big USING (market, industry) QUALIFY row_number() OVER (PARTITION BY market, industry ORDER BY coalesce(rs_rank, 0) DESC, ticker) <= 2),
h AS (SELECT industry, 'u' || (o_orderkey % 40) AS url, max(CAST(o_orderdate AS DATE)) AS d FROM orders JOIN top ON ticker = o_custkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1, 2)
SELECT industry, row_number() OVER (PARTITION BY industry ORDER BY d DESC, url) AS k, url, d FROM h QUALIFY k <= 3""")
def industry_headlines(spark, sf_dir):
    """Customers as the candidates of one market, orders as headlines."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, "MY").otherwise("US").alias("market"), F.col("c_mktsegment").alias("industry"), k.alias("ticker"), F.when(k % 6 > 0, (k % 99).cast("int")).alias("rs_rank"))
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.concat(F.lit("u"), (F.col("o_orderkey") % 40).cast("string")).alias("url"), F.to_date("o_orderdate").alias("d"))
    return en.industry_headlines(c.filter("market = 'MY'"), items, "1998-01-01").select("industry", F.col("k").cast("long").alias("k"), "url", "d")


@query(_BOARD_SQL + """ SELECT market, ticker, row_number() OVER (PARTITION BY market ORDER BY quality DESC, rs_rank DESC, ticker) AS place FROM board WHERE bucket = 'swing' QUALIFY place <= 5""")
def top_swings(spark, sf_dir):
    return pg.top_swings(_board(spark, sf_dir)).select("market", "ticker", F.col("place").cast("long").alias("place"))


@query(_BOARD_SQL + """, w AS (SELECT 'C' || (o_custkey * 2) AS ticker, min(o_orderkey) AS place FROM orders GROUP BY 1) SELECT ticker, place FROM w WHERE ticker IN (SELECT ticker FROM board)""")
def guarded_notes(spark, sf_dir):
    """Notes on twice each order's customer: half of them are on tickers that no board has."""
    w = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), (F.col("o_custkey") * 2).cast("string")).alias("ticker"), F.col("o_orderkey").alias("place"))
    return pg.guarded(w, _board(spark, sf_dir), ["ticker"]).select("ticker", "place")


@query(_BOARD_SQL + " SELECT market, bucket, count(*) AS n FROM board GROUP BY 1, 2")
def brief_counts(spark, sf_dir):
    return rd.bucket_counts(_board(spark, sf_dir))


@query(QUARTERS_SQL + """, r AS (SELECT ticker, q_end AS "end" FROM quarters WHERE month(q_end) <> 9), i AS (SELECT ticker, q_end AS "end" FROM quarters WHERE month(q_end) <> 12) SELECT * FROM (SELECT * FROM r INTERSECT SELECT * FROM i)""")
def shared_quarters(spark, sf_dir):
    q = quarters(spark, sf_dir).select("ticker", F.col("q_end").alias("end"))
    return fu.shared_quarters(q.filter(F.month("end") != 9), q.filter(F.month("end") != 12))


@query("""SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'MY' ELSE 'US' END AS market, 'T' || s_suppkey AS ticker, bool_and(part) AS delisted FROM (SELECT s_suppkey, false AS part FROM supplier WHERE s_suppkey % 3 < 2
  UNION ALL SELECT s_suppkey, true FROM supplier WHERE s_suppkey % 3 > 0) GROUP BY s_suppkey""")
def all_listed(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k, F.when(k % 2 == 0, "MY").otherwise("US").alias("market"), F.concat(F.lit("T"), k.cast("string")).alias("ticker"))
    return vd.all_listed(s.filter(k % 3 < 2), s.filter(k % 3 > 0))


@query(BARS_SQL + """, dim AS (SELECT market, ticker, row_number() OVER (PARTITION BY market ORDER BY ticker) - 1 AS place FROM (SELECT DISTINCT market, ticker FROM bars) QUALIFY place < 2)
SELECT market, ticker, CAST(place AS INTEGER) AS place, d, round(c, 6) AS c FROM bars JOIN dim USING (market, ticker) WHERE d > DATE '1999-06-30' AND d <= DATE '2001-06-30'""")
def benchmark_rows(spark, sf_dir):
    """The panel has no index funds: the first two tickers of each market stand in its dimension."""
    from pyspark.sql import Window

    b = bars(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("market").orderBy("ticker")) - 1
    dim = b.select("market", "ticker").distinct().withColumn("place", place.cast("int")).filter("place < 2")
    return vd.benchmarks_for(b, dim, 2, "2001-06-30").select("market", "ticker", "place", "d", F.round("c", 6).alias("c"))


_INNER = {k: ORACLE_SQL[k] for k in ("chart_patterns", "candles_shown", "volume_profiles")}


@query(f"""WITH shapes AS (SELECT ticker, string_agg(name || CASE WHEN name IN ('double top', 'head and shoulders') THEN ' (bearish)' ELSE ' (bullish)' END, ', ' ORDER BY name) AS charts FROM ({_INNER['chart_patterns']}) GROUP BY 1),
candles AS ({_INNER['candles_shown']}), volume AS (SELECT ticker, arg_max(verdict, d) AS verdict FROM ({_INNER['volume_profiles']}) GROUP BY 1),
b AS (SELECT * FROM ({BARS_SQL} SELECT * FROM bars)), f AS (SELECT ticker, d, c, lag(c, 5) OVER w AS c5, row_number() OVER w AS k, max(h) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS hi,
  min(l) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS lo FROM b WINDOW w AS (PARTITION BY ticker ORDER BY d)),
n AS (SELECT *, CASE WHEN k > 6 THEN round((c / c5 - 1) * 100, 1) END AS change5, round(CASE WHEN hi > lo THEN (c - lo) / (hi - lo) * 100 ELSE 50 END, 0) AS place
  FROM f QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY d DESC) = 1),
t AS (SELECT n.ticker, len(string_split(patterns, ',')) AS marks, concat_ws('; ', CASE WHEN change5 >= 0 THEN 'up ' ELSE 'down ' END || abs(change5) || '% over 5 days',
  'sitting at the ' || CASE WHEN place >= 70 THEN 'top' WHEN place <= 30 THEN 'bottom' ELSE 'middle' END || ' of its 20-day range', 'chart pattern: ' || charts, 'latest candle: ' || replace(replace(patterns, ',', ', '), '_', ' '), verdict) AS said
  FROM n LEFT JOIN shapes USING (ticker) LEFT JOIN candles ON candles.ticker = n.ticker AND candles.d = n.d LEFT JOIN volume ON volume.ticker = n.ticker)
SELECT ticker, CAST(coalesce(marks, 0) AS BIGINT) AS marks, upper(said[1]) || lower(said[2:]) || '.' AS narrative FROM t""")
def readings(spark, sf_dir):
    return charts.reading(bars(spark, sf_dir)).select("ticker", F.size("marks").cast("long").alias("marks"), "narrative")
